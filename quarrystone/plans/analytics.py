"""End-to-end analyses, changes of tables, snapshots and event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quarrystone.engine import Connection
from quarrystone.operators import dml
from quarrystone.operators import relational as R
from quarrystone.operators.dml import ForeignKey, TableSchema
from quarrystone.plans.registry import query, statement
from quarrystone.sources.catalog import Catalog, ConflictError
from quarrystone.sources.formats import chunk_text, round_trip, strip_boilerplate, to_json_rows
from quarrystone.sources.shared import cut, shared_path
from quarrystone.sources.tables import load
from quarrystone.streaming import windows

_DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders GROUP BY CAST(o_orderdate AS DATE))"

statement("q1_running_total", f"""
WITH {_DAILY} SELECT day, revenue, round(sum(revenue) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS running,
round(avg(revenue) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS moving, lag(revenue, 1) OVER (ORDER BY day) AS previous,
round(revenue - lag(revenue, 1) OVER (ORDER BY day), 2) AS change, round(percent_rank() OVER (ORDER BY revenue, day), 6) AS standing FROM daily""")


def _tile(place: Column, n: int, tiles: int) -> Column:
    """ntile of a place (from 1) among n rows: the first n % tiles tiles have a row more."""
    size, more = divmod(n, tiles)
    return F.when(place <= more * (size + 1), F.ceil(place / (size + 1))).otherwise(more + F.ceil((place - more * (size + 1)) / max(size, 1))).cast("int")


@query("""
WITH spent AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_custkey),
ranked AS (SELECT *, rank() OVER (ORDER BY total DESC) AS place, ntile(5) OVER (ORDER BY total DESC, o_custkey) AS tier FROM spent)
SELECT o_custkey, total, n, place, CASE WHEN tier = 1 THEN 'VIP' WHEN tier <= 3 THEN 'regular' ELSE 'occasional' END AS segment FROM ranked""")
def q2_customer_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks over all customers by ranges of their totals, not in one task."""
    spent = load(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    at = cut(dml.ranked(spent, [F.col("total").desc_nulls_last(), "o_custkey"], "at"))
    first = at.groupBy(F.col("total").alias("_total")).agg(F.min("at").alias("place"))
    tier = _tile(F.col("at"), at.count(), 5)
    segment = F.when(tier == 1, "VIP").when(tier <= 3, "regular").otherwise("occasional")
    return at.join(first, F.col("total").eqNullSafe(F.col("_total"))).select("o_custkey", "total", "n", F.col("place").cast("bigint").alias("place"), segment.alias("segment"))


statement("q3_region_share", """
WITH t AS (SELECT r_name, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, o_orderpriority)
SELECT r_name, o_orderpriority, total, rank() OVER (PARTITION BY r_name ORDER BY total DESC) AS place, round(total / sum(total) OVER (PARTITION BY r_name), 6) AS share FROM t""")
statement("q4_hierarchy", """
WITH RECURSIVE tree(key, parent, level) AS (SELECT p_partkey, CAST(NULL AS BIGINT), 0 FROM part WHERE p_partkey <= 1
UNION ALL SELECT p.p_partkey, t.key, t.level + 1 FROM part p JOIN tree t ON CAST(floor(p.p_partkey / 8) AS BIGINT) = t.key AND p.p_partkey > 7)
SELECT key, parent, level FROM tree""", """
WITH RECURSIVE tree(key, parent, level) AS (SELECT p_partkey, CAST(NULL AS BIGINT), 0 FROM part WHERE p_partkey <= 1
UNION ALL SELECT p.p_partkey, t.key, t.level + 1 FROM part p JOIN tree t ON p.p_partkey // 8 = t.key AND p.p_partkey > 7)
SELECT key, parent, level FROM tree""")
statement("q5_funnel", """
WITH kinds AS (SELECT DISTINCT user_id, event_type FROM events), firsts AS (SELECT user_id, event_type, min(ts) AS first_at FROM events GROUP BY user_id, event_type),
steps AS (SELECT k.user_id, count(*) AS kinds FROM kinds k GROUP BY k.user_id)
SELECT f.event_type, count(*) AS users, CAST(sum(CASE WHEN s.kinds >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS engaged, min(f.first_at) AS earliest FROM firsts f JOIN steps s ON f.user_id = s.user_id GROUP BY f.event_type""")
statement("q6_cohorts", """
WITH firsts AS (SELECT o_custkey, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS cohort FROM orders GROUP BY o_custkey),
months AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)
SELECT cohort, (year(month) - year(cohort)) * 12 + month(month) - month(cohort) AS age, count(*) AS customers FROM firsts JOIN months ON firsts.o_custkey = months.o_custkey GROUP BY cohort, (year(month) - year(cohort)) * 12 + month(month) - month(cohort)""")
statement("q7_gap_filled", f"""
WITH {_DAILY}, days AS (SELECT explode(sequence(min(day), max(day))) AS day FROM daily)
SELECT days.day, coalesce(revenue, 0) AS revenue, lag(coalesce(revenue, 0), 7) OVER (ORDER BY days.day) AS week_ago FROM days LEFT JOIN daily ON days.day = daily.day""", f"""
WITH {_DAILY}, days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily)
SELECT days.day, coalesce(revenue, 0) AS revenue, lag(coalesce(revenue, 0), 7) OVER (ORDER BY days.day) AS week_ago FROM days LEFT JOIN daily ON days.day = daily.day""")
statement("q8_seasonal", """
WITH m AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS mon, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY year(o_orderdate), quarter(o_orderdate), month(o_orderdate))
SELECT y, mon, revenue, round(revenue / sum(revenue) OVER (PARTITION BY y, q), 6) AS quarter_share, lag(revenue, 12) OVER (ORDER BY y, mon) AS year_ago FROM m""")
statement("q9_trend_bands", f"""
WITH {_DAILY} SELECT day, round(avg(revenue) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS centre,
round(avg(revenue) OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) + 2 * stddev_samp(revenue) OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 4) AS high FROM daily""")
statement("q10_cube", """
SELECT r_name, o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY CUBE (r_name, o_orderpriority, o_orderstatus)""")
statement("q11_outliers", """
SELECT c_mktsegment, count(*) AS customers, round(stddev_samp(c_acctbal), 4) AS spread, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal), 4) AS p90,
CAST(sum(CASE WHEN c_acctbal > (SELECT avg(c_acctbal) FROM customer) THEN 1 ELSE 0 END) AS BIGINT) AS above FROM customer GROUP BY c_mktsegment""")
statement("q12_frames", f"""
WITH {_DAILY} SELECT day, first_value(revenue) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS opening, last_value(revenue) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closing,
round(sum(revenue) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING), 2) AS next_week, round(avg(revenue) OVER (ORDER BY day ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 4) AS dozen FROM daily""")
statement("q13_star", """
SELECT n_name, p_brand, count(*) AS n_lines, count(DISTINCT o_custkey) AS customers, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, p_brand""")
statement("q14_scd2", """
WITH changes AS (SELECT o_custkey, o_orderpriority, o_orderdate, o_orderkey, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
starts AS (SELECT * FROM changes WHERE before IS NULL OR before <> o_orderpriority)
SELECT o_custkey, o_orderpriority AS state, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to,
lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS is_current, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision FROM starts""")
statement("q15_data_quality", """
SELECT 'orders' AS name, count(*) AS n, count(*) - count(o_custkey) AS missing, count(*) - count(DISTINCT o_orderkey) AS repeated, CAST(sum(CASE WHEN o_totalprice < 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM orders
UNION ALL SELECT 'events', count(*), count(*) - count(value), count(*) - count(DISTINCT event_id), CAST(sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM events
UNION ALL SELECT 'documents', count(*), count(*) - count(text), count(*) - count(DISTINCT text), CAST(sum(CASE WHEN n_chars <> length(text) THEN 1 ELSE 0 END) AS BIGINT) FROM documents""")
@query("""
WITH base AS (SELECT o_custkey, max(o_orderdate) AS last_at, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey),
s AS (SELECT o_custkey, ntile(5) OVER (ORDER BY last_at, o_custkey) AS r, ntile(5) OVER (ORDER BY n, o_custkey) AS f, ntile(5) OVER (ORDER BY total, o_custkey) AS m FROM base)
SELECT o_custkey, r, f, m, CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'champion' WHEN r >= 3 AND f >= 3 THEN 'loyal' WHEN r <= 2 THEN 'at risk' ELSE 'other' END AS segment FROM s""")
def q16_rfm(spark: SparkSession, sf: str) -> DataFrame:
    """Quintiles over all customers by ranges of each measure, not in one task."""
    base = load(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_at"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    base = cut(base)
    count = base.count()
    out = base.select("o_custkey")
    for name, column in (("r", "last_at"), ("f", "n"), ("m", "total")):
        out = out.join(dml.ranked(base, [column, "o_custkey"], "at").select("o_custkey", _tile(F.col("at"), count, 5).cast("bigint").alias(name)), "o_custkey")
    r, f, m = (F.col(c) for c in "rfm")
    segment = F.when((r >= 4) & (f >= 4) & (m >= 4), "champion").when((r >= 3) & (f >= 3), "loyal").when(r <= 2, "at risk").otherwise("other")
    return out.select("o_custkey", "r", "f", "m", segment.alias("segment"))


statement("q17_market_basket", """
WITH baskets AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), sizes AS (SELECT p_brand, count(*) AS n FROM baskets GROUP BY p_brand), total AS (SELECT count(DISTINCT l_orderkey) AS n FROM baskets),
pairs AS (SELECT a.p_brand AS x, b.p_brand AS y, count(*) AS n FROM baskets a JOIN baskets b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY a.p_brand, b.p_brand)
SELECT x, y, pairs.n AS together, round(pairs.n / CAST(total.n AS DOUBLE), 6) AS support, round(pairs.n / CAST(sx.n AS DOUBLE), 6) AS confidence, round(pairs.n * CAST(total.n AS DOUBLE) / (CAST(sx.n AS DOUBLE) * sy.n), 6) AS lift
FROM pairs JOIN sizes sx ON sx.p_brand = x JOIN sizes sy ON sy.p_brand = y CROSS JOIN total""")
statement("q18_category", """
SELECT p_type, count(DISTINCT p_partkey) AS parts, count(l_orderkey) AS sold, round(coalesce(sum(l_extendedprice), 0), 2) AS revenue FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_type HAVING count(l_orderkey) > 10""")
statement("q19_lifetime_value", """
SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS spent, round(coalesce(avg(o_totalprice), 0), 7) AS mean, datediff(CAST(max(o_orderdate) AS DATE), CAST(min(o_orderdate) AS DATE)) AS days FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""", """
SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS spent, round(coalesce(avg(o_totalprice), 0), 7) AS mean, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS days FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
statement("q20_category_customers", """
SELECT p_brand, count(DISTINCT l_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, round(avg(l_quantity), 4) AS quantity FROM part LEFT JOIN lineitem ON p_partkey = l_partkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY p_brand""")
statement("q21_above_average", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o JOIN (SELECT o_custkey, avg(o_totalprice) AS mean FROM orders GROUP BY o_custkey) m ON o.o_custkey = m.o_custkey WHERE o.o_totalprice > 1.5 * m.mean""")
statement("q22_price_bands", """
SELECT CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice BETWEEN 1000 AND 1500 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part
GROUP BY CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice BETWEEN 1000 AND 1500 THEN 'middle' ELSE 'high' END""")
statement("q23_json_pipeline", """
SELECT event_type, get_json_object(props, '$.k') AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type, get_json_object(props, '$.k')""", """
SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type, json_extract_string(props, '$.k')""")
statement("q24_text_search", "SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%rights reserved%'")


@query("""
SELECT a.s_suppkey, b.s_suppkey AS near, round(sqrt(power(a.s_acctbal - b.s_acctbal, 2) + power(a.s_nationkey - b.s_nationkey, 2)), 6) AS distance FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""")
def q25_geo_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of a nation's suppliers, spread over tasks: there are 25 nations, however many suppliers."""
    a = load(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    b = a.withColumnsRenamed({"s_suppkey": "near", "s_acctbal": "near_acctbal"})
    pairs = R.few_keys_join(a, b, "s_nationkey").where("s_suppkey <> near")
    return pairs.select("s_suppkey", "near", F.expr("round(sqrt(power(s_acctbal - near_acctbal, 2) + power(s_nationkey - s_nationkey, 2)), 6)").alias("distance"))


statement("q26_page_analytics", """
WITH gaps AS (SELECT user_id, event_id, event_type, ts, value, CASE WHEN unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS TIMESTAMP)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
per AS (SELECT user_id, session, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks FROM s GROUP BY user_id, session)
SELECT n AS session_size, count(*) AS sessions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS bounces FROM per GROUP BY n""", """
WITH gaps AS (SELECT user_id, event_id, event_type, ts, value, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
per AS (SELECT user_id, session, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks FROM s GROUP BY user_id, session)
SELECT n AS session_size, count(*) AS sessions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS bounces FROM per GROUP BY n""")
statement("q27_utilisation", """
SELECT n_name, customers, orders, round(orders / CAST(customers AS DOUBLE), 6) AS per_customer FROM nation JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey) c ON n_nationkey = c_nationkey
JOIN (SELECT c_nationkey AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) o ON n_nationkey = o.k""")

# Changes of tables: the rows after the change.

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query(f"{_NATION} UNION ALL VALUES (100, 'ATLANTIS', 1), (101, 'LEMURIA', NULL)")
def d1_insert(spark: SparkSession, sf: str) -> DataFrame:
    return dml.insert_df(load(spark, sf, "nation"), spark.createDataFrame([(100, "ATLANTIS", 1), (101, "LEMURIA", None)], "n_nationkey int, n_name string, n_regionkey int"))


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name), n_name FROM nation")
def d2_auto_increment(spark: SparkSession, sf: str) -> DataFrame:
    old = load(spark, sf, "supplier").select("s_suppkey", "s_name")
    schema = TableSchema(StructType([StructField("s_suppkey", LongType()), StructField("s_name", StringType())]), primary_key="s_suppkey", auto_increment="s_suppkey")
    return dml.insert_df(old, load(spark, sf, "nation").select(F.col("n_name").alias("s_name")), schema)


@query("SELECT 'unique' AS rule, 'o_orderkey' AS \"column\", count(*) AS n FROM orders UNION ALL SELECT 'check', 'o_orderkey', count(*) FROM orders WHERE NOT (o_totalprice < 5000)")
def d3_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """What inserting all orders a second time would break."""
    o = load(spark, sf, "orders")
    schema = TableSchema(o.schema, primary_key="o_orderkey", not_null=("o_orderkey",), checks=("o_totalprice < 5000",))
    return dml.violations(o, schema, o).withColumn("column", F.lit("o_orderkey"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def d4_update(spark: SparkSession, sf: str) -> DataFrame:
    return dml.update_df(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderstatus": F.lit("X")}, F.col("o_orderstatus") == "F")


@query("SELECT event_id FROM events WHERE NOT coalesce(value > 50, false)")
def d5_delete(spark: SparkSession, sf: str) -> DataFrame:
    return dml.delete_df(load(spark, sf, "events"), F.col("value") > 50).select("event_id")


@query("SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region UNION ALL VALUES (50, 'it''s new')")
def d6_parameters(spark: SparkSession, sf: str) -> DataFrame:
    c = Connection.open_in_memory(spark)
    load(spark, sf, "region").createOrReplaceTempView("region")
    c.execute("CREATE TABLE places (id INTEGER PRIMARY KEY, name TEXT NOT NULL)")
    c.execute("INSERT INTO places SELECT r_regionkey, r_name FROM region")
    c.execute("INSERT INTO places (id, name) VALUES (?, ?)", [50, "it's new"])
    return c.query("SELECT * FROM places")


@query("SELECT p_partkey, p_size + 1 AS p_size, round(p_retailprice * 2, 2) AS p_retailprice FROM part")
def d7_expressions(spark: SparkSession, sf: str) -> DataFrame:
    return dml.update_df(load(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), {"p_size": F.col("p_size") + 1, "p_retailprice": F.round(F.col("p_retailprice") * 2, 2)})


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1 - s_suppkey, 1 FROM supplier")
def d8_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = load(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.lit(1.0).alias("c_acctbal"))
    return dml.upsert_df(c, c.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(new), ["c_custkey"])


@query("SELECT 'foreign key' AS rule, 'c_nationkey' AS \"column\", count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def d9_foreign_key(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    schema = TableSchema(c.schema, foreign_keys=(ForeignKey("c_nationkey", "nation", "n_nationkey"),))
    return dml.violations(c, schema, None, {"nation": load(spark, sf, "nation").where("n_regionkey < 3")})


def _catalog(spark: SparkSession, sf: str) -> Catalog:
    c = Catalog(spark, shared_path(spark, "catalog"))
    fields = [StructField("id", LongType()), StructField("name", StringType()), StructField("balance", DoubleType())]
    c.create_table("accounts", TableSchema(StructType(fields), primary_key="id", not_null=("name",)))
    c.insert("accounts", load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))
    return c


_ACCOUNTS = "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier"


@query(_ACCOUNTS)
def s3_snapshot_store(spark: SparkSession, sf: str) -> DataFrame:
    """A table created, filled and opened again from its folder."""
    return Catalog(spark, _catalog(spark, sf).root).table("accounts")


@query("SELECT * FROM (VALUES (1, 'create', 'accounts'), (2, 'insert', 'accounts'), (3, 'delete', 'accounts')) t(version, op, \"table\")")
def s6_commit_log(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf)
    c.delete("accounts", F.col("balance") < 0)
    return c.log()


@query("SELECT * FROM (VALUES ('id', 'bigint', true), ('name', 'string', false), ('balance', 'double', false)) t(col_name, kind, is_key)")
def s10_create_table(spark: SparkSession, sf: str) -> DataFrame:
    """The schema of a table as it was created."""
    schema = _catalog(spark, sf).schema("accounts")
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.name == schema.primary_key) for f in schema.columns], "col_name string, kind string, is_key boolean")


@query("SELECT count(*) AS n FROM supplier")
def s12_persist(spark: SparkSession, sf: str) -> DataFrame:
    """Another connection to the same folder sees what was committed."""
    c = Connection(spark, _catalog(spark, sf))
    c.persist()
    return Connection.open(spark, c.catalog.root).query("SELECT count(*) AS n FROM accounts")


@query(f"SELECT id, name FROM ({_ACCOUNTS}) WHERE balance BETWEEN 1000 AND 3000")
def i1_index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A lookup by an indexed column: rows lie in its order, and the scan skips row groups by their bounds."""
    c = Connection(spark, _catalog(spark, sf))
    c.execute("CREATE INDEX by_balance ON accounts (balance)")
    return c.query("SELECT id, name FROM accounts WHERE balance BETWEEN 1000 AND 3000")


@query("SELECT count(*) AS n, true AS refused, true AS allowed FROM supplier")
def i2_unique_index(spark: SparkSession, sf: str) -> DataFrame:
    """A unique index refuses a row that repeats a name; without it the row is taken."""
    c = Connection(spark, _catalog(spark, sf))
    c.execute("CREATE UNIQUE INDEX by_name ON accounts (name)")
    n, name = c.query("SELECT count(*) AS n, min(name) AS name FROM accounts").first()

    def insert(key: int) -> bool:
        try:
            return c.execute_update("INSERT INTO accounts VALUES (?, ?, 0.0)", [key, name]) == 1
        except dml.ConstraintError:
            return False

    refused = not insert(-1)
    c.execute("DROP INDEX by_name")
    return spark.createDataFrame([(n, refused, insert(-1))], "n long, refused boolean, allowed boolean")


@query(f"SELECT * FROM ({_ACCOUNTS}) WHERE id IN (3, 7)")
def i4_sorted_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """By key, over rows in the order of the key; one row inserted later lies in a folder of its own, and one is gone again."""
    c = Connection(spark, _catalog(spark, sf))
    c.execute("CREATE INDEX by_id ON accounts (id)")
    c.execute("INSERT INTO accounts VALUES (-5, 'later', 1.0)")
    c.execute("DELETE FROM accounts WHERE id = -5")
    return c.query("SELECT * FROM accounts WHERE id IN (-5, 3, 7)")


@query(f"SELECT * FROM ({_ACCOUNTS}) WHERE id = 7")
def i3_hash_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).lookup("accounts", "id", 7)


@query("SELECT false AS there, true AS gone_quietly")
def s11_drop_table(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf)
    c.drop_table("accounts")
    c.drop_table("accounts", if_exists=True)
    return spark.createDataFrame([("accounts" in c.tables(), True)], "there boolean, gone_quietly boolean")


@query("SELECT s_suppkey AS id, round(s_acctbal + 1, 2) AS balance FROM supplier")
def s13_vacuum(spark: SparkSession, sf: str) -> DataFrame:
    """The newest snapshot survives the removal of the old ones."""
    c = _catalog(spark, sf)
    c.update("accounts", {"balance": F.round(F.col("balance") + 1, 2)})
    c.vacuum()
    return c.table("accounts").select("id", "balance")


@query("SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS json FROM nation")
def s14_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    return to_json_rows(load(spark, sf, "nation"))


@query("SELECT doc_id, i AS chunk, substring(text, i * 500 + 1, 500) AS piece FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500) AS BIGINT))) AS i FROM documents)")
def s15_text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_text(load(spark, sf, "documents"), "doc_id", "text", 500)


for _format in ("csv", "json", "orc", "parquet"):

    def _formats(spark: SparkSession, sf: str, kind: str = _format) -> DataFrame:
        return round_trip(load(spark, sf, "part"), kind, shared_path(spark, kind))

    _formats.__name__ = f"s16_{_format}"
    query("SELECT * FROM part")(_formats)


@query(f"{_ACCOUNTS} WHERE s_acctbal >= 0")
def c2_commit(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf)
    with c.begin() as t:
        t.delete("accounts", F.col("balance") < 0)
    return c.table("accounts")


@query(_ACCOUNTS)
def c2_rollback(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf)
    t = c.begin()
    t.delete("accounts")
    t.rollback()
    return c.table("accounts")


@query("SELECT count(*) + 1 AS n FROM supplier")
def c1_auto_commit(spark: SparkSession, sf: str) -> DataFrame:
    """Each statement outside a transaction is one."""
    c = Connection(spark, _catalog(spark, sf))
    c.execute("INSERT INTO accounts (id, name) VALUES (-1, 'new')")
    return c.query("SELECT count(*) AS n FROM accounts")


@query("SELECT true AS refused, count(*) AS n FROM supplier WHERE s_acctbal >= 0")
def c4_conflict(spark: SparkSession, sf: str) -> DataFrame:
    """Of two transactions that change a table, the second to commit is refused."""
    c = _catalog(spark, sf)
    first, second = c.begin(), c.begin()
    second.delete("accounts")
    first.delete("accounts", F.col("balance") < 0)
    first.commit()
    refused = False
    try:
        second.commit()
    except ConflictError:
        refused = True
    return c.table("accounts").agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('snapshot', true, true), ('serializable', true, false)) t(isolation, first_commits, second_commits)")
def c5_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """Two transactions that read each other's table and write their own: snapshots let both commit, serializability only one."""
    out = []
    for isolation in ("snapshot", "serializable"):
        c = _catalog(spark, sf)
        c.create_table("other", c.schema("accounts"))
        a, b = c.begin(isolation), c.begin(isolation)
        a.table("other").count()
        b.table("accounts").count()
        a.delete("accounts", F.col("balance") < 0)
        b.insert("other", a.table("accounts").limit(1))
        done = []
        for t in (a, b):
            try:
                t.commit()
                done.append(True)
            except ConflictError:
                done.append(False)
        out.append((isolation, *done))
    return spark.createDataFrame(out, "isolation string, first_commits boolean, second_commits boolean")


@query("SELECT doc_id, n, value FROM (SELECT doc_id, n, value, max(CASE WHEN contains(value, 'de') THEN n END) OVER (PARTITION BY doc_id) AS a, min(CASE WHEN contains(value, 'zz') THEN n END) OVER (PARTITION BY doc_id) AS b FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS n, unnest(string_split(text, chr(10))) AS value FROM documents)) WHERE (a IS NULL OR n > a) AND (b IS NULL OR n < b)")
def s15_strip_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a file of lines: what stands after the last begin mark and before the first end mark."""
    d = load(spark, sf, "documents")
    lines = d.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("n", "value"))
    return strip_boilerplate(lines, "de", "zz").select(F.col("path").alias("doc_id"), "n", "value")


@query(_ACCOUNTS)
def c3_snapshot_read(spark: SparkSession, sf: str) -> DataFrame:
    """Version 2 stays readable after a later change."""
    c = _catalog(spark, sf)
    c.delete("accounts", F.col("balance") < 0)
    return c.table("accounts", version=2)


# Event-time windows, on all events as a batch; tests run them as streams.


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t1_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(load(spark, sf, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("SELECT start + INTERVAL (15 * k) MINUTE AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE AS start, event_type, value, unnest(range(4)) AS k FROM events) GROUP BY ALL")
def t1_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(load(spark, sf, "events"), "1 hour", "15 minutes").withColumn("total", F.round("total", 4))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def t2_session(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessions(load(spark, sf, "events"), "30 minutes")


@query("SELECT user_id, event_type FROM events GROUP BY user_id, event_type")
def t5_distinct_events(spark: SparkSession, sf: str) -> DataFrame:
    return windows.distinct_events(load(spark, sf, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t3_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """With a watermark; a batch has no late rows."""
    return windows.tumbling(load(spark, sf, "events"), "1 day", watermark="2 hours").drop("total")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def t4_keyed_state(spark: SparkSession, sf: str) -> DataFrame:
    """What the stateful stream ends with: all events in one micro-batch."""
    e = load(spark, sf, "events").select("user_id", "value")
    root = shared_path(spark, "events")
    e.write.parquet(f"{root}/in")
    stream = windows.running_totals(spark.readStream.schema(e.schema).parquet(f"{root}/in"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")  # a batch that runs again replaces itself

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    t = spark.read.schema("user_id long, n long, total double, batch int").parquet(f"{root}/out").groupBy("user_id").agg(F.max(F.struct("n", "total")).alias("x"))
    return t.select("user_id", "x.n", F.round("x.total", 4).alias("total"))
