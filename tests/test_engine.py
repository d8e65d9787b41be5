"""SQL over snapshots, transactions, and the event-time operators as streams."""

import pytest
from pyspark.sql import functions as F

from quarrystone.engine import Connection, SqlError, bind, markers
from quarrystone.operators.dml import ConstraintError, TableSchema
from quarrystone.sources.catalog import Catalog, ConflictError
from quarrystone.sources.formats import strip_boilerplate
from quarrystone.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def db(spark):
    c = Connection.open_in_memory(spark)
    c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL, age INTEGER DEFAULT 3, v VECTOR[3], CHECK (age < 200))")
    return c


def test_insert_update_delete(db):
    assert db.execute_update("INSERT INTO t (name) VALUES ('Alice'), ('Bob?')") == 2
    assert db.execute_update("INSERT INTO t (name, age) VALUES (?, ?)", ["it's", 25]) == 1
    assert [tuple(r)[:3] for r in db.query_all("SELECT * FROM t ORDER BY id")] == [(1, "Alice", 3), (2, "Bob?", 3), (3, "it's", 25)]
    assert db.query_first("SELECT name FROM t WHERE id = ?", [3])["name"] == "it's"
    assert db.execute_update("UPDATE t SET age = age + ? WHERE name = ?", [1, "it's"]) == 1
    assert db.execute_update("DELETE FROM t WHERE id = 1") == 1
    assert [(r["id"], r["age"]) for r in db.query_all("SELECT id, age FROM t ORDER BY id")] == [(2, 3), (3, 26)]


@pytest.mark.parametrize("bad", ["INSERT INTO t (id, name) VALUES (1, 'x')", "INSERT INTO t (id) VALUES (9)", "INSERT INTO t (name, age) VALUES ('z', 300)"])
def test_constraints_hold(db, bad):
    db.execute("INSERT INTO t (name) VALUES ('Alice')")
    with pytest.raises(ConstraintError):
        db.execute(bad)
    assert db.query("SELECT * FROM t").count() == 1


def test_bad_statements(db):
    for bad in ("INSERT INTO t (name) VALUES (1, 2)", "FOO", "CREATE TABLE u (x NOSUCHTYPE)", "UPDATE t SET nope = 1", "COMMIT"):
        with pytest.raises(SqlError):
            db.execute(bad)
    with pytest.raises(SqlError):
        db.query("SELECT * FROM t WHERE id = ?")
    assert markers("a = ? AND b = '?' AND c = ?") == [4, 26]
    assert bind("x = ? AND y = ?", ["o'k", None]) == "x = 'o\\'k' AND y = NULL"


def test_transactions(db):
    db.execute("INSERT INTO t (name) VALUES ('one')")
    db.execute("BEGIN")
    db.execute("INSERT INTO t (name) VALUES ('two')")
    assert db.query("SELECT * FROM t").count() == 2
    db.execute("ROLLBACK")
    assert db.query("SELECT * FROM t").count() == 1
    a, b = db.catalog.begin(), db.catalog.begin()
    a.delete("t")
    a.commit()
    b.delete("t")
    with pytest.raises(ConflictError):
        b.commit()
    db.execute("VACUUM")
    assert db.query("SELECT * FROM t").count() == 0
    db.execute("DROP TABLE IF EXISTS nope")
    db.execute("DROP TABLE t")
    assert Catalog(db.spark, db.catalog.root).tables() == []


def test_boilerplate(spark):
    lines = spark.createDataFrame([("f", 0, "head"), ("f", 1, "*** START"), ("f", 2, "text"), ("f", 3, "*** END"), ("g", 0, "all")], "path string, n int, value string")
    assert sorted(r["value"] for r in strip_boilerplate(lines, "*** START", "*** END").collect()) == ["all", "text"]


def _stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))


def _run(df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    e, s = _stream(spark, tmp_path)
    key = lambda r: tuple(map(str, r))
    want = sorted(map(key, windows.tumbling(e, "1 hour").select("start", "event_type", "n").collect()))
    got = sorted(map(key, _run(windows.tumbling(s, "1 hour"), "complete", "tumbling", tmp_path).select("start", "event_type", "n").collect()))
    assert got == want
    late = {key(r) for r in _run(windows.tumbling(s, "1 hour", watermark="10 minutes"), "append", "late", tmp_path).select("start", "event_type", "n").collect()}
    assert late <= set(want)
    got = _run(windows.distinct_events(s, ["user_id", "event_type"], "10000 days"), "append", "first", tmp_path).count()
    assert got == windows.distinct_events(e, ["user_id", "event_type"]).count()
    totals = {r["user_id"]: r["n"] for r in _run(windows.running_totals(s), "update", "totals", tmp_path).collect()}
    assert totals == {r["user_id"]: r["count"] for r in e.groupBy("user_id").count().collect()}


def test_commits_of_two_threads_are_both_there(spark, tmp_path):
    """Transactions on different tables at the same moment: none that reported success is lost."""
    import threading

    from pyspark.sql.types import LongType, StructField, StructType

    schema = TableSchema(StructType([StructField("id", LongType())]))
    for trial in range(25):
        c = Catalog(spark, str(tmp_path / f"c{trial}"))
        start, done = threading.Barrier(4), []

        def work(name, c=c, start=start, done=done):
            t = c.begin()
            t.create_table(name, schema)
            start.wait()
            t.commit()
            done.append(name)

        threads = [threading.Thread(target=work, args=(f"t{i}",)) for i in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(done) == 4 and c.tables() == sorted(done) and c.versions() == [1, 2, 3, 4]
        assert [r["version"] for r in c.log().collect()] == [1, 2, 3, 4]


def test_inserts_add_folders(db):
    db.execute("CREATE TABLE a (id INTEGER PRIMARY KEY, x TEXT)")
    for i in range(3):
        db.execute(f"INSERT INTO a VALUES ({i}, 'v{i}')")
    first = db.catalog.version().snapshots["a"]
    assert len(first) == 3 and db.query("SELECT * FROM a").count() == 3
    db.execute("INSERT INTO a VALUES (3, 'v3')")
    assert db.catalog.version().snapshots["a"][:3] == first
    db.catalog.compact("a")
    assert len(db.catalog.version().snapshots["a"]) == 1 and db.query("SELECT * FROM a").count() == 4
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO a VALUES (3, 'again')")


def test_vacuum_spares_open_transactions(db):
    """What a transaction has staged survives, what it dropped or left behind doesn't; the log stays whole."""
    db.execute("CREATE TABLE v (id INTEGER)")
    db.execute("INSERT INTO v VALUES (1)")
    t = db.catalog.begin()
    t.insert("v", db.spark.createDataFrame([(2,)], "id long"))
    left = db.catalog.begin()
    left.insert("v", db.spark.createDataFrame([(9,)], "id long"))
    left.rollback()
    before = db.catalog.log().collect()
    assert db.catalog.vacuum() == 1
    t.commit()
    assert sorted(r["id"] for r in db.query("SELECT * FROM v").collect()) == [1, 2]
    assert db.catalog.log().collect()[:-1] == before
    stale = db.catalog.begin()
    stale.delete("v")
    assert db.catalog.vacuum(lease_s=0) >= 1
    assert db.query("SELECT * FROM v").count() == 2


def test_indexes(db):
    db.execute("CREATE TABLE i (e TEXT, n INTEGER)")
    db.execute("INSERT INTO i VALUES ('a', 1), ('b', 2), (NULL, 3), (NULL, 4)")
    db.execute("CREATE UNIQUE INDEX u ON i (e)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO i VALUES ('a', 5)")
    db.execute("CREATE INDEX byn ON i (n)")
    with pytest.raises(ValueError, match="exists"):
        db.execute("CREATE INDEX byn ON i (e)")
    db.execute("DROP INDEX u")
    db.execute("INSERT INTO i VALUES ('a', 1)")
    with pytest.raises(ConstraintError):
        db.execute("CREATE UNIQUE INDEX u ON i (e)")
    assert db.query("SELECT * FROM i WHERE n = 1").count() == 2


def test_alter(db):
    db.execute("CREATE TABLE old (id INTEGER PRIMARY KEY, x TEXT)")
    db.execute("INSERT INTO old VALUES (1, 'a')")
    db.execute("ALTER TABLE old ADD COLUMN y INTEGER")
    db.execute("ALTER TABLE old ADD z INTEGER DEFAULT 7")
    db.execute("INSERT INTO old (id, x) VALUES (2, 'b')")
    assert [tuple(r) for r in db.query("SELECT * FROM old ORDER BY id").collect()] == [(1, "a", None, 7), (2, "b", None, 7)]
    with pytest.raises(ValueError, match="needed"):
        db.execute("ALTER TABLE old DROP COLUMN id")
    db.execute("ALTER TABLE old DROP COLUMN x")
    db.execute("ALTER TABLE old RENAME TO new")
    assert [tuple(r) for r in db.query("SELECT * FROM new ORDER BY id").collect()] == [(1, None, 7), (2, None, 7)]
    with pytest.raises(ValueError, match="exists"):
        db.execute("ALTER TABLE new ADD y TEXT")


def test_ranks_by_ranges(spark):
    from quarrystone.operators.dml import ranked

    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)] + [(5, 0), (None, 1)], "a int, b int").repartition(5)
    rows = ranked(df, ["a", "b"], "place").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, 104))
    key = lambda r: (r["a"] is not None, r["a"] or 0, r["b"])
    assert [key(r) for r in rows] == sorted(map(key, df.collect()))
    assert ranked(df.limit(0), ["a"], "place").count() == 0
