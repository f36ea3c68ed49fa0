"""Keyed tables that grow: splits, joint commits, failures, and a filing tree that arrives in parts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import prices as pr
from tidemark.sources import readers as rd, sinks as sk
from tidemark.streaming import jobs as st

ROWS = "k long, v string"


def put(current, incoming):
    return current.join(incoming.select("k"), "k", "left_anti").unionByName(incoming)


def commit(store, **tables):
    c = store.begin()
    for name, rows in tables.items():
        c.merge(name, ["k"], rows, put)
    c.done()


def test_buckets_split_and_merges_touch_few(spark, tmp_path):
    store = sk.TableStore(spark, str(tmp_path / "s"), bound=6000)
    rnd = random.Random(1)
    want = {}
    for step in range(5):
        rows = [(rnd.randrange(4000), f"{step}-{rnd.random()}") for _ in range(800)]
        rows = list(dict(rows).items())
        want.update(rows)
        commit(store, t=spark.createDataFrame(rows, ROWS))
        assert dict(map(tuple, store.read("t").collect())) == want
    buckets = store.state()["tables"]["t"]["buckets"]
    assert len(buckets) > 4 and max(b[3] for b in buckets) < 3 * 6000
    assert sum(2.0 ** -d for d, *_ in buckets) == 1.0  # the buckets part the hash range
    before = {tuple(b) for b in buckets}
    commit(store, t=spark.createDataFrame([(5, "one")], ROWS))
    after = {tuple(b) for b in store.state()["tables"]["t"]["buckets"]}
    assert len(before - after) == 1
    assert store.read("t").where("k = 5").first().v == "one" and store.read("t").count() == len({**want, 5: ""})


def test_a_bucket_can_become_empty(spark, tmp_path):
    table = sk.KeyedTable(spark, str(tmp_path / "t"), ["k"], bound=800)
    table.merge(spark.createDataFrame([(i, str(i)) for i in range(300)], ROWS), put)
    assert len(table.store.state()["tables"]["rows"]["buckets"]) > 1
    drop = lambda current, incoming: current.join(incoming.select("k"), "k", "left_anti")
    table.merge(spark.createDataFrame([(i, "") for i in range(300)], ROWS), drop)
    assert table.read() is None
    table.merge(spark.createDataFrame([(7, "back")], ROWS), put)
    assert [tuple(r) for r in table.read().collect()] == [(7, "back")]
    table.merge(spark.createDataFrame([], ROWS), put)
    assert table.read().count() == 1


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    store = sk.TableStore(spark, str(tmp_path / "s"))
    commit(store, a=spark.createDataFrame([(1, "a")], ROWS), b=spark.createDataFrame([(1, "b")], ROWS))
    c = store.begin()
    c.merge("a", ["k"], spark.createDataFrame([(2, "new")], ROWS), put)
    with pytest.raises(Exception, match="lost"):
        c.merge("b", ["k"], spark.createDataFrame([(2, "new")], ROWS).withColumn("v", F.raise_error(F.lit("lost"))), put)
    for name in "ab":  # the first table's files are written, but nothing names them
        assert [tuple(r) for r in store.read(name).collect()] == [(1, name)]
    stale = store.begin()
    commit(store, a=spark.createDataFrame([(2, "new")], ROWS), b=spark.createDataFrame([(2, "new")], ROWS))
    assert store.read("a").count() == store.read("b").count() == 2
    stale.merge("a", ["k"], spark.createDataFrame([(9, "late")], ROWS), put)
    with pytest.raises(OSError):  # another writer was faster
        stale.done()
    assert store.read("a").count() == 2


def test_readers_keep_the_version_before(spark, tmp_path):
    store = sk.TableStore(spark, str(tmp_path / "s"))
    for i in range(4):
        if i:
            held = store.read("t")
        commit(store, t=spark.createDataFrame([(1, str(i))], ROWS))
        if i:
            assert held.first().v == str(i - 1)
    assert len(list((tmp_path / "s" / "data").glob("*/_bucket=*"))) == 2 and len(list((tmp_path / "s" / "manifest").glob("*.json"))) == 2


def test_bars_and_coverage_show_together(spark, tmp_path, monkeypatch):
    store = sk.TableStore(spark, str(tmp_path / "s"))
    batch = st.bars_into(store)
    bars = lambda day: spark.createDataFrame([("c", day, 1.0, 1)], "cik string, d string, close double, fetched_at int").select(
        "cik", F.to_date("d").alias("trade_date"), "close", "fetched_at")
    batch(bars("2024-01-02"), 0)
    monkeypatch.setattr(pr, "bar_coverage", lambda df: df.select(F.raise_error(F.lit("lost")).alias("cik")))
    with pytest.raises(Exception, match="lost"):
        batch(bars("2024-01-03"), 1)
    assert store.read("bars").count() == 1
    monkeypatch.undo()
    batch(bars("2024-01-03"), 1)
    assert store.read("bars").count() == 2 and store.read("coverage").first().n == 2


def test_tree_in_arrivals(spark, tmp_path):
    root, store = tmp_path / "in", sk.TableStore(spark, str(tmp_path / "s"))

    def put_file(cik, year, folder, name, doc):
        d = root / "companies" / cik / year / folder
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))

    def rows():
        st.run_available(rd.tree_stream(spark, str(root)), st.tree_into(store), str(tmp_path / "ck"))
        return {(r.cik, r.accession): (r.form, r.category) for r in rd.assemble_documents(store.read("documents")).collect()}
    put_file("0000000001", "2020", "a b", "filing.json", {"filingDate": "2020-01-01", "form": "6-K"})
    put_file("0000000001", "2020", "x", "meta.json", {"category": "governance"})
    put_file("0000000001", "notayear", "x", "filing.json", {"filingDate": "2020-01-01", "form": "6-K"})
    put_file("0000000001", "2020", "x", "other.json", "{}")
    assert rows() == {("0000000001", "a b"): ("6-K", "unknown")}
    put_file("0000000001", "2020", "x", "filing.json", {"filingDate": "2020-01-01", "form": "4"})  # later than its meta
    put_file("0000000001", "2020", "a b", "meta.json", {"category": "press_note"})
    put_file("0000000002", "2019", "y", "filing.json", "{broken")
    assert rows() == {("0000000001", "a b"): ("6-K", "press_note"), ("0000000001", "x"): ("4", "governance")}
    put_file("0000000001", "2020", "x", "filing.json", {"filingDate": "2021-01-01", "form": "changed"})
    assert rows()[("0000000001", "x")] == ("4", "governance")
    batch = {(r.cik, r.accession): r.form for r in rd.read_filings(spark, str(root), "0000000001").collect()}
    assert batch == {("0000000001", "a b"): "6-K", ("0000000001", "x"): "changed"}
    assert rd.read_filings(spark, str(root), "0000000009").count() == 0
