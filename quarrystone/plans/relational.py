"""Queries of scans, filters, joins, aggregation, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.engine import Connection
from quarrystone.operators import relational as R
from quarrystone.plans.registry import query, statement
from quarrystone.sources.tables import load


@query("SELECT * FROM orders")
def s1_scan(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 37")
def s2_index_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Point lookup: the equality reaches the parquet row groups."""
    return load(spark, sf, "orders").where(F.col("o_custkey") == 37).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT * FROM nation WHERE n_regionkey >= 2")
def s4_in_memory(spark: SparkSession, sf: str) -> DataFrame:
    """A cached view answers."""
    load(spark, sf, "nation").createOrReplaceTempView("nation_cached")
    spark.catalog.cacheTable("nation_cached")
    return spark.sql("SELECT * FROM nation_cached WHERE n_regionkey >= 2")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 5000")
def i5_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Closed range over the key; min/max statistics prune row groups."""
    return load(spark, sf, "lineitem").where(F.col("l_orderkey").between(1000, 5000)).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("SELECT c_custkey, c_acctbal FROM customer")
def p1_project(spark: SparkSession, sf: str) -> DataFrame:
    return R.project(load(spark, sf, "customer"), [0, 3])


@query("SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment FROM customer c")
def p2_select_star(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").alias("c").select("c.*")


@query("SELECT s_suppkey AS supplier_id, s_acctbal AS balance FROM supplier")
def p3_column_alias(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_acctbal").alias("balance"))


statement("p4_table_alias", "SELECT n.n_name, r.r_name FROM nation AS n JOIN region r ON n.n_regionkey = r.r_regionkey")


def _filtered(name: str, table: str, columns: list[str], condition, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return load(spark, sf, table).where(condition()).select(*columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}")(run)


_ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice"]
_filtered("f1_filter", "orders", _ORDER, lambda: F.expr("o_totalprice > 1000"), "o_totalprice > 1000")
_filtered("f2_eq", "orders", _ORDER, lambda: R.predicate("o_orderstatus", "=", "F"), "o_orderstatus = 'F'")
_filtered("f2_ne", "orders", _ORDER, lambda: R.predicate("o_orderstatus", "!=", "F"), "o_orderstatus != 'F'")
_filtered("f2_null_safe_eq", "orders", _ORDER, lambda: R.predicate("o_orderstatus", "<=>", "O"), "o_orderstatus IS NOT DISTINCT FROM 'O'")
_filtered("f3_lt", "orders", _ORDER, lambda: R.predicate("o_totalprice", "<", 5000), "o_totalprice < 5000")
_filtered("f3_gt", "orders", _ORDER, lambda: R.predicate("o_totalprice", ">", 5000), "o_totalprice > 5000")
_filtered("f4_le", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], lambda: R.predicate("l_quantity", "<=", 10), "l_quantity <= 10")
_filtered("f4_ge", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], lambda: R.predicate("l_quantity", ">=", 45), "l_quantity >= 45")
_filtered("f5_not_equal_sign", "customer", ["c_custkey", "c_mktsegment"], lambda: R.predicate("c_mktsegment", "<>", "BUILDING"), "c_mktsegment <> 'BUILDING'")
_filtered("f6_and_or", "customer", ["c_custkey", "c_acctbal"], lambda: ((F.col("c_acctbal") > 0) & (F.col("c_nationkey") < 5)) | (F.col("c_mktsegment") == "BUILDING"), "(c_acctbal > 0 AND c_nationkey < 5) OR c_mktsegment = 'BUILDING'")
_filtered("f7_not", "part", ["p_partkey", "p_size"], lambda: ~((F.col("p_size") < 20) | (F.col("p_retailprice") > 1500)), "NOT (p_size < 20 OR p_retailprice > 1500)")
_filtered("f8_is_null", "events", ["event_id"], lambda: R.predicate(F.nullif(F.col("event_type"), F.lit("click")), "is null"), "nullif(event_type, 'click') IS NULL")
_filtered("f8_is_not_null", "events", ["event_id", "value"], lambda: R.predicate("value", "is not null"), "value IS NOT NULL")
_filtered("f10_column_compare", "lineitem", ["l_orderkey", "l_linenumber"], lambda: F.col("l_discount") > F.col("l_tax"), "l_discount > l_tax")
_filtered("f12_in", "part", ["p_partkey", "p_size"], lambda: R.predicate("p_size", "in", (1, 5, 9)), "p_size IN (1, 5, 9)")
_filtered("f12_not_in", "part", ["p_partkey", "p_size"], lambda: R.predicate("p_size", "not in", (1, 5, 9)), "p_size NOT IN (1, 5, 9)")
_filtered("f13_like", "part", ["p_partkey", "p_name"], lambda: R.predicate("p_name", "like", "%d_r%n_"), "p_name LIKE '%d_r%n_'")
_filtered("f13_not_like", "part", ["p_partkey", "p_name"], lambda: R.predicate("p_name", "not like", "%ring%"), "p_name NOT LIKE '%ring%'")
_filtered("f15_compare", "events", ["event_id"], lambda: R.compare(F.col("value"), F.lit(20)) == 1, "sign(value - 20) = 1")
_filtered("f16_between", "orders", _ORDER, lambda: R.predicate("o_totalprice", "between", (1000, 20000)), "o_totalprice BETWEEN 1000 AND 20000")


@query("SELECT event_id, 'it''s' AS quoted, CAST(-1.5 AS DOUBLE) AS negative, TRUE AS yes, CAST(NULL AS VARCHAR) AS nothing FROM events")
def f9_literals(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.lit("it's").alias("quoted"), F.lit(-1.5).alias("negative"), F.lit(True).alias("yes"), F.lit(None).cast("string").alias("nothing"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 20000")
def f11_parameters(spark: SparkSession, sf: str) -> DataFrame:
    load(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", args=["O", 20000])


@query("SELECT o_orderkey, CAST(o_orderkey AS DECIMAL(38,10)) > CAST(o_totalprice AS DECIMAL(38,10)) AS greater FROM orders")
def f14_exact_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Whole numbers against doubles without loss beyond 2^53."""
    exact = lambda c: F.col(c).cast("decimal(38,10)")
    return load(spark, sf, "orders").select("o_orderkey", (exact("o_orderkey") > exact("o_totalprice")).alias("greater"))


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, sum(CASE WHEN value BETWEEN 10 AND 20 THEN 1 ELSE 0 END)::BIGINT AS band FROM events GROUP BY event_type")
def f16_case(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.sum(F.when(F.col("value").between(10, 20), 1).otherwise(0)).alias("band"))


@query("SELECT n_name, n_regionkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def f16_exists(spark: SparkSession, sf: str) -> DataFrame:
    rich = load(spark, sf, "supplier").where("s_acctbal > 5000")
    n = load(spark, sf, "nation")
    return n.join(rich, n["n_nationkey"] == rich["s_nationkey"], "left_semi").select("n_name", "n_regionkey")


def _joined(name: str, how: str, word: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = load(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
        o = load(spark, sf, "orders").where("o_totalprice > 15000").select("o_orderkey", "o_custkey")
        return R.join(c, o, [("c_custkey", "o_custkey")], how)

    run.__name__ = name
    query(f"SELECT c_custkey, c_name, o_orderkey, o_custkey FROM (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) {word} JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 15000) ON c_custkey = o_custkey")(run)


for _name, _how, _word in (("j1_inner", "inner", "INNER"), ("j3_left", "left", "LEFT"), ("j4_right", "right", "RIGHT"), ("j5_full", "full", "FULL")):
    _joined(_name, _how, _word)


@query("SELECT a.event_type, a.value AS left_value, b.value AS right_value FROM (SELECT event_type, max(value) AS value FROM events GROUP BY event_type) a JOIN (SELECT event_type, min(value) AS value FROM events GROUP BY event_type) b ON a.event_type IS NOT DISTINCT FROM b.event_type")
def j1_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    a = e.groupBy("event_type").agg(F.max("value").alias("left_value"))
    b = e.groupBy(F.col("event_type").alias("kind")).agg(F.min("value").alias("right_value"))
    return R.join(a, b, [("event_type", "kind")], null_safe=True).drop("kind")


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j2_inner_on(spark: SparkSession, sf: str) -> DataFrame:
    return R.join(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), [("l_orderkey", "o_orderkey")]).drop("o_orderkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def j6_cross(spark: SparkSession, sf: str) -> DataFrame:
    return R.join(load(spark, sf, "region").select("r_name"), load(spark, sf, "nation").select("n_name"), None)


statement("j7_chain", """
SELECT r_name, n_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
statement("j8_theta", """
SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal""")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j11_semi(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    c = load(spark, sf, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j11_anti(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").where("o_totalprice > 300000")
    c = load(spark, sf, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("""
WITH b AS (SELECT user_id, ts AS bts, max(event_id) AS last_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT a.event_id, b.last_id FROM events a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.bts""")
def j11_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the user's latest click until then."""
    e = load(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("bts"), F.col("event_id").alias("last_id"))
    return R.asof_join(e.select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "bts", ["last_id"]).select("event_id", "last_id")


@query("""
WITH bands AS (SELECT p_size AS band, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_size)
SELECT s_suppkey, band FROM supplier JOIN bands ON abs(s_acctbal) >= low AND abs(s_acctbal) < high""")
def j11_range(spark: SparkSession, sf: str) -> DataFrame:
    bands = load(spark, sf, "part").groupBy(F.col("p_size").alias("band")).agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    s = load(spark, sf, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("point"))
    return R.range_join(s, bands, "point", "low", "high", 500.0).select("s_suppkey", "band")


statement("j12_self_join", """
SELECT a.l_partkey AS first_part, b.l_partkey AS second_part, count(*) AS together FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY a.l_partkey, b.l_partkey""")


@query("SELECT o_orderpriority, count(*) AS n, count(o_custkey) AS with_customer, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority")
def a1_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    specs = [R.AggSpec("count", None, "n"), R.AggSpec("count", "o_custkey", "with_customer"), R.AggSpec("sum", "o_totalprice", "total"), R.AggSpec("avg", "o_totalprice", "mean"), R.AggSpec("min", "o_totalprice", "least"), R.AggSpec("max", "o_totalprice", "most")]
    return R.aggregate(load(spark, sf, "orders"), ["o_orderpriority"], specs).withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


for _name, _spec, _sql in (
    ("a2_count_star", R.AggSpec("count", None, "n"), "count(*) AS n"),
    ("a3_count_column", R.AggSpec("count", "value", "n"), "count(value) AS n"),
    ("a6_min", R.AggSpec("min", "value", "least"), "min(value) AS least"),
    ("a6_max", R.AggSpec("max", "value", "most"), "max(value) AS most"),
    ("a11_count_distinct", R.AggSpec("count_distinct", "user_id", "users"), "count(DISTINCT user_id) AS users"),
):

    def _one(spark: SparkSession, sf: str, spec: R.AggSpec = _spec) -> DataFrame:
        return R.aggregate(load(spark, sf, "events"), [], [spec])

    _one.__name__ = _name
    query(f"SELECT {_sql} FROM events")(_one)

statement("a4_sum", "SELECT round(sum(l_quantity), 2) AS quantity, sum(CASE WHEN l_quantity < 0 THEN l_quantity END) AS of_nothing FROM lineitem")
statement("a5_avg", "SELECT l_returnflag, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY l_returnflag")
statement("a7_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
statement("a8_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")


@query('SELECT count(*) AS "COUNT(*)", max(p_size) AS "MAX(p_size)" FROM part')
def a10_default_names(spark: SparkSession, sf: str) -> DataFrame:
    return R.aggregate(load(spark, sf, "part"), [], [R.AggSpec("count"), R.AggSpec("max", "p_size")])


statement("a11_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
statement("a12_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
statement("a12_rollup", "SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)")
statement("a12_grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
statement("a13_stddev", "SELECT event_type, round(stddev_samp(value), 6) AS spread FROM events GROUP BY event_type")
statement(
    "a13_percentile",
    "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS median, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95 FROM events GROUP BY event_type",
)
statement("a13_count_if", "SELECT event_type, count(*) FILTER (WHERE value > 90) AS high FROM events GROUP BY event_type")


@query("SELECT count(value) AS present, bool_and(value >= 0) AS all_positive, bool_or(value > 99) AS any_high FROM events")
def a14_column_folds(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").agg(F.count("value").alias("present"), F.every(F.col("value") >= 0).alias("all_positive"), F.some(F.col("value") > 99).alias("any_high"))


statement("a16_metrics", """
SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS calls, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most
FROM events GROUP BY event_type, date_trunc('hour', ts)""")


@query("SELECT 'INSERT' AS kind, count(*) AS n FROM region UNION ALL SELECT 'SELECT', count(DISTINCT r_regionkey) FROM region UNION ALL SELECT 'CREATE', 1")
def a16_statement_report(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's own statements by kind, as its monitor counts them: a row is inserted and looked up for each region."""
    c = Connection.open_in_memory(spark)
    c.enable_performance_monitoring()
    c.execute("CREATE TABLE regions (id INTEGER PRIMARY KEY, name TEXT)")
    for r in load(spark, sf, "region").orderBy("r_regionkey").collect():  # five rows
        c.execute("INSERT INTO regions VALUES (?, ?)", [r["r_regionkey"], r["r_name"]])
        c.query("SELECT name FROM regions WHERE id = ?", [r["r_regionkey"]])
    return c.get_performance_report().select("kind", "n")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey")
def o1_order_by(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc_nulls_last(), "p_partkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def o2_limit(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(25)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10")
def o3_offset(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").offset(10).limit(25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o6_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100)


@query("SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def o7_top_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k_per_group(load(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_returnflag ORDER BY n DESC LIMIT 2")
def o8_plan_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, filter, project, join, aggregate, sort and limit in one plan."""
    o = load(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    j = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")).orderBy(F.desc("n")).limit(2)


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def u1_chain(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).unionByName(load(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


statement("u3_union_all", "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
statement("u4_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
statement("u4_intersect", "SELECT l_partkey AS part FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
statement("u4_except", "SELECT c_custkey AS customer FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
statement("u4_except_all", "SELECT o_custkey AS customer FROM orders EXCEPT ALL SELECT c_custkey FROM customer")


@query("SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS suppliers FROM lineitem GROUP BY l_orderkey")
def u5_sorted_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("suppliers"))
