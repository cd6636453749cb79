"""Versioned tables, the vector index and the relational source: failures, conflicts, repeated batches, what is read."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from quire.sources import relational
from quire.sources.index import VectorIndex
from quire.sources.versioned import Change, Conflict, Store

SCHEMA = "doc_id long, n int, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def said(own):
    return sorted(str(r) for r in own)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    with s.change() as c:
        c.create("pages", SCHEMA, "doc_id", buckets=8)
        c.replace("pages", frame(spark, [(i, n, f"page {n} of {i}") for i in range(20) for n in range(3)]))
    return s


def files(s):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(s.path) for f in names if not f.startswith("."))


def test_replace_and_earlier_versions(spark, store):
    first = store.read("pages")
    before = rows(first)
    with store.change() as c:
        c.replace("pages", frame(spark, [(3, 0, "new"), (3, 0, "new"), (99, 0, None), (None, 1, "no document")]))
    now = [(i, n, f"page {n} of {i}") for i in range(20) if i != 3 for n in range(3)] + [(3, 0, "new"), (3, 0, "new"), (99, 0, None), (None, 1, "no document")]
    assert rows(store.read("pages")) == said(now)
    assert rows(first) == before == rows(store.read("pages", 1))  # readers of the old version
    with store.change() as c:
        c.replace("pages", frame(spark, [(None, 2, "again")]))
        c.delete("pages", frame(spark, [(4, 0, ""), (77, 0, "")]).select("doc_id"))
    assert rows(store.read("pages")) == said([r for r in now if r[0] not in (None, 4)] + [(None, 2, "again")])
    assert store.versions() == [1, 2, 3] and store.tables() == ["pages"]


def test_one_bucket_is_read_for_a_key(spark, store):
    own = store.read_key("pages", 7)
    assert rows(own) == said([(7, n, f"page {n} of 7") for n in range(3)])
    buckets = {f.split("bucket=")[1].split("/")[0] for f in own.inputFiles()}
    assert len(buckets) == 1 and len(own.inputFiles()) < len(store.read("pages").inputFiles())
    assert store.read_key("pages", 1000).collect() == []


def test_change_leaves_other_buckets_alone(spark, store):
    """Files of buckets without a changed key stay where they are."""
    before = set(store.read("pages").inputFiles())
    with store.change() as c:
        c.replace("pages", frame(spark, [(7, 0, "new")]))
    gone = {f.split("bucket=")[1].split("/")[0] for f in before - set(store.read("pages").inputFiles())}
    assert len(gone) == 1


@pytest.mark.parametrize("where", ["_switch", "_without", "_add"])
def test_failed_change_leaves_no_trace(spark, store, monkeypatch, where):
    before, shown = files(store), rows(store.read("pages"))
    real = getattr(Change, where)

    def fails(self, *args):
        assert set(files(self.store)) > set(before) or where == "_without"  # something is written by now
        real(self, *args) if where == "_add" else None
        raise OSError("lost")

    monkeypatch.setattr(Change, where, fails)
    with pytest.raises(OSError), store.change() as c:
        c.replace("pages", frame(spark, [(i, 0, "half") for i in range(10)]))
    monkeypatch.undo()
    assert files(store) == before and store.version == 1 and rows(store.read("pages")) == shown


def test_failure_while_rows_are_written(spark, store):
    before = files(store)
    broken = frame(spark, [(i, 0, "x") for i in range(100)]).withColumn("n", F.when(F.col("doc_id") == 50, F.raise_error(F.lit("bad row")).cast("int")).otherwise(0))
    with pytest.raises(Exception, match="bad row"), store.change() as c:
        c.replace("pages", broken)
    assert files(store) == before


def test_two_tables_change_together(spark, store):
    with store.change() as c:
        c.create("tables", "doc_id long, t string", "doc_id")
        c.replace("tables", spark.createDataFrame([(1, "a")], "doc_id long, t string"))
        c.delete("pages", frame(spark, [(1, 0, "")]).select("doc_id"))
    assert store.version == 2 and store.read("tables").count() == 1 and store.read_key("pages", 1).count() == 0
    with pytest.raises(RuntimeError), store.change() as c:
        c.delete("tables", spark.createDataFrame([(1,)], "doc_id long"))
        c.replace("pages", frame(spark, [(1, 0, "back")]))
        raise RuntimeError
    assert store.version == 2 and store.read("tables").count() == 1 and store.read_key("pages", 1).count() == 0


def test_second_of_two_changes_conflicts(spark, store):
    a, b = store.change(), store.change()
    a.replace("pages", frame(spark, [(1, 0, "a")]))
    b.replace("pages", frame(spark, [(2, 0, "b")]))
    assert a.commit() == 2
    kept = files(store)
    with pytest.raises(Conflict):
        b.commit()
    assert set(files(store)) < set(kept) and rows(store.read_key("pages", 2)) == said([(2, n, f"page {n} of 2") for n in range(3)])


def test_append_is_idempotent(spark, store):
    """By batch and row: a batch again, in part, with rows twice; the same rows in another batch count."""
    own = [(30, n, f"p{n}") for n in range(4)] + [(31, None, None), (None, 0, "x")]

    def append(batch, new):
        with store.change() as c:
            c.append("pages", frame(spark, new), batch, ["doc_id", "n"])

    append("a", own[:3])
    append("a", own + own)
    assert store.version == 3
    append("a", own)
    append("a", own[2:4])
    assert store.version == 3  # nothing to add, no version
    base = [(i, n, f"page {n} of {i}") for i in range(20) for n in range(3)]
    assert rows(store.read("pages")) == said(base + own)
    append("b", own[:1])
    assert rows(store.read("pages")) == said(base + own + own[:1])
    with store.change() as c:  # a replaced document's batch is forgotten with it
        c.replace("pages", frame(spark, [(30, 9, "new")]))
    assert rows(store.read_key("pages", 30)) == said([(30, 9, "new")])


def test_compact_and_vacuum(spark, store):
    for n in range(5):
        with store.change() as c:
            c.append("pages", frame(spark, [(1, 100 + n, "x")]), f"b{n}", ["doc_id", "n"])
    shown, n_files = rows(store.read("pages")), len(store.read_key("pages", 1).inputFiles())
    with store.change() as c:
        c.compact("pages", most=2)
    assert rows(store.read("pages")) == shown and len(store.read_key("pages", 1).inputFiles()) < n_files
    with store.change() as c:  # batches are still known
        c.append("pages", frame(spark, [(1, 100, "x")]), "b0", ["doc_id", "n"])
    assert rows(store.read("pages")) == shown
    assert store.vacuum(keep=1, older_than=3600) == 0  # another change may be writing these
    assert store.vacuum(keep=1, older_than=-60) > 0
    assert rows(store.read("pages")) == shown and store.versions() == [store.version]
    with pytest.raises(FileNotFoundError):
        store.read("pages", 1)


def test_empty_and_missing_tables(spark, tmp_path):
    s = Store(spark, str(tmp_path / "none"))
    assert s.version == 0 and s.tables() == []
    with pytest.raises(FileNotFoundError):
        s.read("pages")
    with s.change() as c:
        c.create("pages", SCHEMA, "doc_id")
        c.replace("pages", frame(spark, []))
        c.append("pages", frame(spark, []), "a", ["n"])
    assert s.read("pages").collect() == [] and s.read_key("pages", 1).collect() == [] and s.version == 1
    with s.change():
        pass
    assert s.version == 1
    for wrong in ({"schema": "doc_id string, n int", "key": "doc_id"}, {"schema": SCHEMA, "key": "n"}, {"schema": SCHEMA, "key": "m"}, {"schema": "_batch int, doc_id int", "key": "doc_id"}):
        with pytest.raises(ValueError), s.change() as c:
            c.create("pages", **wrong)


def test_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """One document with most rows."""
    s = Store(spark, str(tmp_path / "hot"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        with s.change() as c:
            c.create("pages", SCHEMA, "doc_id", buckets=4)
            c.replace("pages", spark.range(200_000, numPartitions=8).select(F.lit(5).alias("doc_id"), F.col("id").cast("int").alias("n"), F.md5(F.col("id").cast("string")).alias("text")))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    own = s.read_key("pages", 5)
    assert len(own.inputFiles()) > 3 and own.count() == 200_000


def test_index_build_and_load(spark, tmp_path):
    index = VectorIndex(Store(spark, str(tmp_path / "index")))
    made = lambda rows: spark.createDataFrame(rows, "doc_id string, ord int, embedding array<double>, content string")
    with pytest.raises(FileNotFoundError):
        index.load()
    for bad in ([], [("d", 0, None, "x")], [("d", 0, [], "x")], [("d", 0, [1.0, None], "x")], [("d", 0, [1.0, float("nan")], "x")], [("d", 0, [1.0], "x"), ("d", 1, [1.0, 2.0], "y")]):
        with pytest.raises(ValueError):
            index.build(made(bad))
    index.build(made([("d1", 0, [3.0, 4.0], "a"), ("d1", 1, [0.0, 0.0], "b"), ("d2", 0, [0.0, 2.0], "c")]))
    one = index.load("d1")
    assert {r["ord"]: [round(x, 6) for x in r["embedding"]] for r in one.collect()} == {0: [0.6, 0.8], 1: [0.0, 0.0]}
    assert index.load("d1") is one  # cached
    with pytest.raises(ValueError, match="those of the index"):
        index.build(made([("d3", 0, [1.0, 0.0, 0.0], "x")]))
    index.build(made([("d1", 7, [1.0, 0.0], "new")]))
    assert [(r["ord"], r["content"]) for r in index.load("d1").collect()] == [(7, "new")] and index.load().count() == 2
    with pytest.raises(FileNotFoundError):
        index.load("d9")
    index.close()


@pytest.fixture
def database(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as c:
        c.execute('create table docs (id integer, name text, "odd ""col" real, body blob)')
        c.executemany("insert into docs values (?, ?, ?, ?)", [(i if i % 50 else None, f"n{i % 7}", None if i % 5 == 0 else i / 2, bytes([i % 256])) for i in range(1000)] + [(3, "twice", 1.0, None)] * 3)
    return path


def test_relational_read(spark, database):
    got = relational.read_table(spark, database, "docs", key="id", partitions=6)
    expected = sqlite3.connect(database).execute("select * from docs").fetchall()
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "double", "binary"]
    assert sorted(str((r[0], r[1], r[2], r[3] and bytes(r[3]))) for r in got.collect()) == sorted(map(str, expected))
    n = [x for x in got.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()]
    assert len(n) == 7 and max(n) < 200 and sum(n) == len(expected)  # six ranges of like size, and rows without a key
    assert relational.read_table(spark, database, "docs").rdd.getNumPartitions() == 1


def test_relational_filters(spark, database):
    c = sqlite3.connect(database)
    for condition in ("id between 100 and 140", "name = 'n3' and id > 900", "name in ('n1', 'n2') and `odd \"col` < 20.0", "`odd \"col` is null", "id is null", "name like 'n3%' and id <= 50", "id = 3", "not id = 3", "id > 10000"):
        got = relational.read_table(spark, database, "docs", key="id", partitions=4).where(condition)
        assert got.count() == c.execute("select count(*) from docs where " + condition.replace('`odd "col`', '"odd ""col"')).fetchone()[0], condition


def test_relational_filter_reaches_the_database(spark, database):
    """Rows that a filter drops aren't read: ranges cover what it leaves, and the reader keeps the condition."""
    reader = relational.RangeReader({"database": database, "table": "docs", "key": "id", "partitions": "4"}, relational.RelationalSource({"database": database, "table": "docs"}).schema())
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    left = list(reader.pushFilters([GreaterThan(("id",), 900), EqualTo(("name",), "n3"), StringContains(("name",), "n")]))
    assert left == [StringContains(("name",), "n")]
    parts = reader.partitions()
    assert len(parts) > 1 and min(p.low for p in parts) > 900
    assert [r for p in parts for r in reader.read(p)] == sqlite3.connect(database).execute("select * from docs where id > 900 and name = 'n3' order by id").fetchall()
    plan = relational.read_table(spark, database, "docs", key="id").where("id > 900 and length(name) > 1")._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan") :]
    assert "length" in physical and "> 900" not in physical


def test_relational_write(spark, tmp_path):
    path = str(tmp_path / "w.db")
    df = spark.range(5000, numPartitions=6).select(F.col("id"), F.concat(F.lit("t"), "id").alias("text"), (F.col("id") / 4).alias("x"))
    relational.write_table(df, path, "t", key="id")
    relational.write_table(df.where("id < 10").withColumn("text", F.lit("new")), path, "t", key="id")
    c = sqlite3.connect(path)
    assert c.execute("select count(*), sum(text = 'new'), sum(x) from t").fetchone() == (5000, 10, sum(range(5000)) / 4)
    broken = df.withColumn("text", F.when(F.col("id") == 4000, F.raise_error(F.lit("bad row"))).otherwise("half"))
    with pytest.raises(Exception, match="bad row"):
        relational.write_table(broken, path, "t", key="id")
    assert c.execute("select count(*) from t where text = 'half'").fetchone() == (0,)
    assert [n for (n,) in c.execute("select name from sqlite_master where type = 'table'")] == ["t"]  # no staging table is left
    relational.write_table(df.limit(3), path, "t", key="id", mode="overwrite")
    assert c.execute("select count(*) from t").fetchone() == (3,)
    with pytest.raises(Exception, match="no table|can't be stored"):
        relational.read_table(spark, path, "missing")


def test_relational_write_counts_each_task_once(tmp_path):
    """What a task that failed, or ran twice, has put in isn't counted."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("id", LongType())])
    options = {"database": str(tmp_path / "s.db"), "table": "t"}
    writer = relational.TableWriter(options, schema, False)
    lost = writer.write(iter([(1,), (2,)]))
    again = writer.write(iter([(1,), (2,)]))
    other = writer.write(iter([(3,)]))
    assert lost.label != again.label
    writer.commit([again, other, None])
    assert sqlite3.connect(options["database"]).execute("select id from t order by 1").fetchall() == [(1,), (2,), (3,)]
