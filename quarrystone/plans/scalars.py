"""Queries of windows, CTEs, and text, date, JSON and geometric functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import geo, text
from quarrystone.functions import json as J
from quarrystone.operators import dml
from quarrystone.operators import relational as R
from quarrystone.plans.registry import query, statement
from quarrystone.sources.tables import load


@query("SELECT * FROM (SELECT user_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS win FROM events) WHERE len(win) = 3")
def w1_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return R.sliding(load(spark, sf, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], 3, "value", "win").select("user_id", "event_id", "win")


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def w2_running(spark: SparkSession, sf: str) -> DataFrame:
    return R.running(load(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.sum("o_totalprice"), "running").select("o_custkey", "o_orderkey", F.round("running", 2).alias("running"))


_STOP = "SELECT user_id, event_id FROM (SELECT *, bool_or(NOT coalesce(value < 80, false)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stop FROM events) WHERE {}"


@query(_STOP.format("NOT stop"))
def w3_take_while(spark: SparkSession, sf: str) -> DataFrame:
    return R.take_while(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 80).select("user_id", "event_id")


@query(_STOP.format("stop"))
def w3_skip_while(spark: SparkSession, sf: str) -> DataFrame:
    return R.skip_while(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 80).select("user_id", "event_id")


@query("SELECT user_id, batch, count(*) AS n, min(event_id) AS least FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS batch FROM events) GROUP BY user_id, batch")
def w4_batched(spark: SparkSession, sf: str) -> DataFrame:
    return R.batches(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 4).groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))


statement("w5_ranks", """
SELECT c_custkey, row_number() OVER w AS row_no, rank() OVER v AS rnk, dense_rank() OVER v AS dense, round(percent_rank() OVER w, 6) AS pct, ntile(4) OVER w AS quartile
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), v AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""")
statement("w6_lag_lead", """
SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS lag1, lag(o_totalprice, 7) OVER w AS lag7, lead(o_totalprice, 12) OVER w AS lead12
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
statement("w7_first_last", """
SELECT o_orderkey, first_value(o_totalprice) OVER w AS first_price, last_value(o_totalprice) OVER w AS last_price
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
statement("w8_frames", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total,
round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS week,
round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS centred,
round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING), 4) AS ahead,
round(stddev_samp(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 4) AS spread FROM events""")
statement("w9_share", """
SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS share, count(*) OVER (PARTITION BY s_nationkey) AS suppliers FROM supplier""")
statement("w10_nested", """
SELECT c_custkey, quartile, rank() OVER (PARTITION BY c_nationkey, quartile ORDER BY c_custkey) AS place
FROM (SELECT c_custkey, c_nationkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quartile FROM customer) t""")
statement("w11_cte", """
WITH per_order AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey),
per_customer AS (SELECT o_custkey, sum(quantity) AS quantity FROM per_order JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT c_mktsegment, round(avg(quantity), 4) AS mean FROM per_customer JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
statement("w12_recursive", """
WITH RECURSIVE steps(n, keys) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, keys * 2 FROM steps WHERE n < 10)
SELECT n, keys FROM steps""")


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: strlen(w) > 2))::INTEGER AS tokens FROM documents")
def x1_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.size(text.tokenize(F.col("text"))).alias("tokens"))


@query(r"""
WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, round(least(len(w) / 1000.0, 1.0), 6)::DOUBLE AS word_score, round(least(length(text) / 5000.0, 1.0), 6)::DOUBLE AS char_score,
round(least((length(text) - length(replace(text, '.', ''))) / 50.0, 1.0), 6)::DOUBLE AS sentence_score,
round(len(list_distinct(w)) / greatest(len(w), 1)::DOUBLE, 6) AS diversity,
round(length(regexp_replace(text, '[^!-/:-@\[-`{-~]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 6) AS punctuation,
round(least(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1)::DOUBLE / 10.0, 1.0), 6)::DOUBLE AS word_length FROM t""")
def x2_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", *[F.round(c, 6).alias(n) for n, c in text.text_stats(F.col("text")).items()])


_KEYS = [k for keys in text.INDICATORS.values() for k in keys]


@query("SELECT doc_id, [" + ", ".join(f"CAST(contains(lower(text), '{k}') AS DOUBLE)" for k in _KEYS) + "] AS features FROM documents")
def x3_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", text.indicators(F.col("text")).alias("features"))


@query("SELECT c_custkey, lower(hex(c_name)) AS encoded, c_name AS decoded FROM customer")
def x4_hex(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", F.lower(F.hex("c_name")).alias("encoded"), F.unhex(F.hex("c_name")).cast("string").alias("decoded"))


@query(None)
def x4_crc32(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"))


@query("SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS number, CAST(value AS BIGINT) = TRY_CAST(CAST(CAST(value AS BIGINT) AS VARCHAR) AS DOUBLE) AS same FROM events")
def x5_loose_equality(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.round("value", 0).cast("bigint")
    return load(spark, sf, "events").select("event_id", text.number_of(F.col("event_type")).alias("number"), text.loosely_equal(whole, whole.cast("string")).alias("same"))


@query("""
WITH t AS (SELECT doc_id, text, greatest(instr(lower(text), 'the') - 50, 1) AS s FROM documents)
SELECT doc_id, (CASE WHEN s > 1 THEN '...' ELSE '' END) || substring(text, s, 200) || (CASE WHEN s + 199 < length(text) THEN '...' ELSE '' END) AS snippet FROM t""")
def x6_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), "the").alias("snippet"))


@query("""
WITH w AS (SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(string_split(replace(replace(text, chr(10), ' '), chr(9), ' '), ' '), lambda x: x <> '') AS w FROM documents))),
h AS (SELECT doc_id, pos, sum(CASE WHEN contains(lower(word), 'the') OR contains(lower(word), 'que') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS hits, count(*) OVER (PARTITION BY doc_id) AS n FROM w),
best AS (SELECT doc_id, arg_min(pos, (-hits, pos)) AS start FROM h WHERE pos <= greatest(n - 30, 0) GROUP BY doc_id)
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS snippet FROM w JOIN best USING (doc_id) WHERE pos >= start AND pos < start + 30 GROUP BY doc_id""")
def x6_best_snippet(spark: SparkSession, sf: str) -> DataFrame:
    """The 30 words in a row that have the most of the words looked for, the first of several."""
    d = load(spark, sf, "documents").select("doc_id", text.best_snippet(F.col("text"), ["the", "que"], 30).alias("snippet"))
    return d.where("snippet is not null")


statement("x7_lower_like", "SELECT p_partkey, lower(p_brand) AS brand FROM part WHERE lower(p_type) LIKE '%prom%'")
statement("x8_functions", """
SELECT event_id, coalesce(value, 0) AS v, CAST(round(value) AS BIGINT) AS whole, round(power(value, 2), 4) AS square, round(sqrt(abs(value)), 6) AS root, least(value, 50.0) AS capped,
event_type || '-' || CAST(user_id AS STRING) AS label FROM events""", """
SELECT event_id, coalesce(value, 0) AS v, CAST(round(value) AS BIGINT) AS whole, round(power(value, 2), 4) AS square, round(sqrt(abs(value)), 6) AS root, least(value, 50.0) AS capped,
event_type || '-' || CAST(user_id AS VARCHAR) AS label FROM events""")
statement("x9_dates", """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS INT) AS q,
CAST(o_orderdate AS DATE) AS d, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(o_orderdate - INTERVAL 1 HOUR AS DATE) AS before FROM orders""", """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS INT) AS q,
CAST(o_orderdate AS DATE) AS d, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INT) AS days, CAST(o_orderdate - INTERVAL 1 HOUR AS DATE) AS before FROM orders""")


@query("""
SELECT s_suppkey, round(sqrt(power(s_acctbal - 1000, 2) + power(s_nationkey - 5, 2)), 6) AS distance FROM supplier""")
def x11_distance(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "supplier").select("s_suppkey", F.round(geo.distance(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), F.lit(1000.0), F.lit(5.0)), 6).alias("distance"))


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def x12_flat_map(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query("""
SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, CAST(d AS DATE) AS full_date, year(d)::INT AS y, quarter(d)::INT AS q, month(d)::INT AS m, dayofyear(d)::INT AS day_of_year,
CASE WHEN month(d) >= 4 THEN year(d) ELSE year(d) - 1 END::INT AS fiscal_year, ((quarter(d) + 2) % 4 + 1)::INT AS fiscal_quarter
FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY)) AS d FROM orders)""")
def x13_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """A date dimension over the days of the orders; fiscal years begin in April."""
    span = load(spark, sf, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    d = span.select(F.explode(F.sequence("a", "b")).alias("d"))
    y, m, q = F.year("d"), F.month("d"), F.quarter("d")
    return d.select(
        F.date_format("d", "yyyyMMdd").cast("int").alias("date_key"), F.col("d").alias("full_date"), y.alias("y"), q.alias("q"), m.alias("m"), F.dayofyear("d").alias("day_of_year"),
        F.when(m >= 4, y).otherwise(y - 1).alias("fiscal_year"), ((q + 2) % 4 + 1).alias("fiscal_quarter"),
    )


@query("""
WITH t AS (SELECT event_id, event_id % 6 AS kind, event_id % 4 < 2 AS yes, json_extract_string(props, '$.k')::BIGINT AS k, event_type FROM events)
SELECT event_id, row_number() OVER (ORDER BY kind, CASE kind WHEN 1 THEN yes::BIGINT WHEN 2 THEN k - 50 WHEN 4 THEN CASE WHEN yes THEN 1 ELSE 2 END WHEN 5 THEN 1 ELSE 0 END,
CASE WHEN kind = 3 THEN event_type END, CASE WHEN kind IN (4, 5) THEN k END, event_id) AS place FROM t""")
def n1_json_order(spark: SparkSession, sf: str) -> DataFrame:
    """Places in the total order of JSON values of all kinds, ranked by ranges of their keys."""
    k, yes = F.get_json_object("props", "$.k"), F.col("event_id") % 4 < 2
    made = [F.lit("null"), yes.cast("string"), (k.cast("int") - 50).cast("string"), F.concat(F.lit('"'), "event_type", F.lit('"')), F.when(yes, F.concat(F.lit("["), k, F.lit("]"))).otherwise(F.concat(F.lit("["), k, F.lit(", null]"))), F.concat(F.lit('{"k": '), k, F.lit("}"))]
    value = F.get(F.array(*made), (F.col("event_id") % 6).cast("int"))
    e = load(spark, sf, "events").select("event_id", J.json_sort_key(value).alias("key"))
    return dml.ranked(e, ["key", "event_id"], "place").select("event_id", F.col("place").cast("bigint").alias("place"))


@query("SELECT event_id, CAST(event_id % 7 + 1 AS INTEGER) AS depth, event_id % 7 + 1 > 4 AS deeper FROM events WHERE props IS NOT NULL UNION ALL SELECT -1 - event_id, NULL, NULL FROM events WHERE props IS NOT NULL")
def n2_json_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays and objects in turn around the event's number; without their last character they are no JSON, and have no depth."""
    e = load(spark, sf, "events").where("props is not null")
    value = F.get_json_object("props", "$.k")
    for i in range(6):
        outer = F.concat(F.lit("["), value, F.lit("]")) if i % 2 else F.concat(F.lit('{"a": '), value, F.lit("}"))
        value = F.when(F.col("event_id") % 7 > i, outer).otherwise(value)
    e = e.select("event_id", value.alias("j"))
    broken = e.select((-1 - F.col("event_id")).alias("event_id"), F.concat(F.lit("["), F.col("j")).alias("j"))
    return e.unionByName(broken).select("event_id", J.json_depth(F.col("j")).alias("depth"), J.json_exceeds_depth(F.col("j"), 4).alias("deeper"))


@query("SELECT event_id, k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def n3_json_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.inline(J.json_leaves(F.col("props")))).select("event_id", "path", "value")


@query("SELECT event_id, json_keys(props) AS paths FROM events")
def n4_json_paths(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", J.json_paths(F.col("props")).alias("paths"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def n5_json_extract(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", J.json_extract(F.col("props"), "$.k").alias("k"))


_TAGS = "'[\"' || event_type || '\",\"all\"]'"


@query(f"SELECT event_id, json_contains({_TAGS}, '\"click\"') AS is_click FROM events")
def n6_json_contains(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", J.json_contains(F.to_json(F.array("event_type", F.lit("all"))), "click").alias("is_click"))


@query("SELECT event_id, len(json_keys(props))::INTEGER AS members FROM events")
def n7_json_length(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", J.json_length(F.col("props")).alias("members"))


@query("SELECT event_id, CAST(to_json({'k': json_extract_string(props, '$.k'), 'kind': event_type}) AS VARCHAR) AS changed, '[\"' || event_type || '\",\"new\"]' AS grown FROM events")
def n8_json_set(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.select("event_id", J.json_set(F.col("props"), "kind", F.col("event_type")).alias("changed"), J.json_append(F.to_json(F.array("event_type")), F.lit("new")).alias("grown"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def n9_generated_column(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).where("k > 50").select("event_id", "k")


@query("SELECT event_id, true AS has_k, 1 AS members, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL")
def n10_map_access(spark: SparkSession, sf: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return load(spark, sf, "events").where("props is not null").select("event_id", F.map_contains_key(m, "k").alias("has_k"), F.size(m).alias("members"), F.element_at(m, "k").alias("k"))


_RECTS = """r AS (SELECT p_partkey % 50 AS id, min(p_size) AS min_x, min(p_retailprice) AS min_y, max(p_size) + 0.0 AS max_x, max(p_retailprice) AS max_y FROM part GROUP BY p_partkey % 50)"""


@query(f"""WITH {_RECTS} SELECT a.id AS a, b.id AS b, round((a.max_x - a.min_x) * (a.max_y - a.min_y), 4)::DOUBLE AS area, round(2 * (a.max_x - a.min_x + a.max_y - a.min_y), 4)::DOUBLE AS perimeter,
round((greatest(a.max_x, b.max_x) - least(a.min_x, b.min_x)) * (greatest(a.max_y, b.max_y) - least(a.min_y, b.min_y)) - (a.max_x - a.min_x) * (a.max_y - a.min_y), 4)::DOUBLE AS enlargement,
round((least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * (least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)), 4)::DOUBLE AS overlap,
(b.min_x >= a.min_x AND b.max_x <= a.max_x AND b.min_y >= a.min_y AND b.max_y <= a.max_y) AS holds
FROM r a JOIN r b ON a.id < b.id AND a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y""")
def i8_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """Spatial self-join of 50 bounding boxes with their measures."""
    boxes = load(spark, sf, "part").groupBy((F.col("p_partkey") % 50).alias("id")).agg(
        F.min("p_size").cast("double").alias("min_x"), F.min("p_retailprice").alias("min_y"), F.max("p_size").cast("double").alias("max_x"), F.max("p_retailprice").alias("max_y")
    )
    a, b = (boxes.select(*[F.col(c).alias(f"{side}_{c}") for c in boxes.columns]) for side in "ab")
    ra, rb = geo.Rect.of("a_"), geo.Rect.of("b_")
    met = a.join(b, (F.col("a_id") < F.col("b_id")) & ra.intersects(rb))
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(ra.area(), 4).alias("area"), F.round(ra.perimeter(), 4).alias("perimeter"), F.round(ra.enlargement(rb), 4).alias("enlargement"), F.round(ra.overlap_area(rb), 4).alias("overlap"), ra.contains(rb).alias("holds"))
