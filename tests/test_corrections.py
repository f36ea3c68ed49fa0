"""Cases in which an earlier form of an operator lost rows or gave another answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as dr, estimates as es, filings as fl, prices as pr
from tidemark.session import scratch_path
from tidemark.sources import sinks as sk
from tidemark.streaming import jobs as st


def stored(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("k", "y", "v").collect())


@pytest.mark.parametrize("partition", [["y"], []])
def test_forced_write_keeps_other_artifacts(spark, tmp_path, partition):
    path = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(rows, "k int, y int, v string")
    sk.write_new(df((1, 2020, "a"), (2, 2020, "a"), (3, 2021, "a"), (3, 2021, "a")), path, ["k"], partition=partition)
    assert stored(spark, path) == [(1, 2020, "a"), (2, 2020, "a"), (3, 2021, "a")]
    sk.write_new(df((1, 2020, "b"), (1, 2020, "b")), path, ["k"], partition=partition, force=True)
    assert stored(spark, path) == [(1, 2020, "b"), (2, 2020, "a"), (3, 2021, "a")]
    sk.write_new(df((3, 2022, "c")), path, ["k"], partition=partition, force=True)  # its old partition is left empty
    assert stored(spark, path) == [(1, 2020, "b"), (2, 2020, "a"), (3, 2022, "c")]


def test_no_facet_is_cut(spark):
    counts = spark.range(1500).select(F.lit("c").alias("cik"), F.concat(F.lit("f"), "id").alias("value"), (F.col("id") + 1).alias("n"))
    assert fl.facet_list(counts, ["cik"]).count() == 1500
    assert [r.value for r in fl.facet_list(counts, ["cik"], top=2).orderBy("position").collect()] == ["f1499", "f1498"]


def test_unknown_first_trade_goes_to_the_floor(spark):
    df = spark.createDataFrame([("x", dt.date(2024, 7, 15), None), ("y", dt.date(2024, 7, 15), dt.date(2022, 1, 1))], "cik string, to_date date, first date")
    rows = pr.backward_chunks(df, "to_date", "first", 5, "2000-01-01").collect()
    assert {(r.cik, r.open_ended) for r in rows} == {("x", True), ("y", False)}
    assert min(r.chunk_from for r in rows if r.cik == "x") <= dt.date(2000, 1, 1)
    assert len([r for r in rows if r.cik == "y"]) == 1


def test_documents_of_one_size_and_name_are_one_sample(spark):
    schema = "type_id int, doc_id int, original_name string, size_bytes int, content_hash string, seen_at int"
    none = spark.createDataFrame([], "type_id int, sample_id int, file_id int, original_name string, size_bytes int, content_hash string, first_seen_at int, last_seen_at int, analysis_count long")
    new = spark.createDataFrame([(1, 1, "A.pdf", 10, "h1", 1), (1, 2, " a.PDF ", 10, "h2", 2), (1, 3, "b.pdf", 20, "h1", 3), (1, 4, "c.pdf", 30, "", 4), (1, 5, "C.pdf", 30, "h5", 5)], schema)
    rows = {tuple(r) for r in dr.register_samples(none, new).select("sample_id", "file_id", "content_hash", "analysis_count").collect()}
    assert rows == {(1, 3, "h1", 3), (4, 5, "h5", 2)}


def test_estimates_fall_back_to_the_default_source(spark):
    coverage = spark.createDataFrame([("1", None), ("2", ""), ("3", "vendor")], "cik string, provider string")
    estimates = spark.createDataFrame([("1", "finnhub", 1), ("2", "finnhub", 2), ("3", "vendor", 3), ("3", "finnhub", 4)], "cik string, source string, n int")
    assert {(r.cik, r.n) for r in es.estimates_view(coverage, estimates).collect()} == {("1", 1), ("2", 2), ("3", 3)}
    assert {(r.cik, r.n) for r in es.estimates_view(coverage, estimates, "finnhub").collect()} == {("1", 1), ("2", 2), ("3", 4)}


def test_every_unnamed_question_counts(spark):
    df = spark.createDataFrame([(1, True, False, False, "", True, ["", "q", ""])], "n_fields int, use_ocr boolean, convert_to_image boolean, multi_pass boolean, rationale string, needs_help boolean, question_ids array<string>")
    assert [r.code for r in dr.proposal_questions(df).collect()] == ["empty_question_id"] * 2


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
    with pytest.raises(ValueError):
        scratch_path(Cluster, "x")


def test_streams_over_three_batches(spark, tmp_path):
    """Late and repeated rows, state carried across batches, and only touched buckets rewritten."""
    schema = "cik string, trade_date date, close double, fetched_at int"
    days = [dt.date(2024, 1, d) for d in range(1, 10)]
    batches = [[("1", days[3], 1.0, 1), ("1", days[3], 2.0, 2), ("2", days[0], 1.0, 1)], [("1", days[1], 3.0, 3)], [("1", days[3], 9.0, 4), ("1", days[3], 9.0, 4), ("3", days[5], 1.0, 1)]]
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        folder.mkdir(exist_ok=True)
        part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
        part.rename(folder / f"{i}.parquet")
        stream = st.file_stream(spark, str(folder), "*.parquet", spark.createDataFrame([], schema).schema)
        if i == 0:
            store = sk.TableStore(spark, str(tmp_path / "store"), 300)
            first = sk.KeyedTable(spark, str(tmp_path / "first"), ["cik"])
        st.run_available(stream, st.bars_into(store), str(tmp_path / "ck1"))
        st.run_available(stream, st.new_only_into(first, ["cik"], ["fetched_at", "close"]), str(tmp_path / "ck2"))
    assert {(r.cik, r.trade_date, r.close) for r in store.read("bars").collect()} == {("1", days[1], 3.0), ("1", days[3], 9.0), ("2", days[0], 1.0), ("3", days[5], 1.0)}
    assert {(r.cik, r.earliest, r.latest, r.n) for r in store.read("coverage").collect()} == {("1", days[1], days[3], 2), ("2", days[0], days[0], 1), ("3", days[5], days[5], 1)}
    assert {(r.cik, r.close) for r in first.read().collect()} == {("1", 1.0), ("2", 1.0), ("3", 1.0)}
    live = sum(len(t["buckets"]) for t in store.state()["tables"].values())
    assert len(list((tmp_path / "store" / "data").glob("*/_bucket=*"))) <= 2 * live


def test_call_times_carry_over_batches(spark, tmp_path):
    schema = "project_id long, stage string, outcome string, created_at timestamp"
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    batches = [[(1, "llm_request", "ok", at(5)), (1, "llm_done", "", at(9))], [(1, "llm_request", "ok", at(3))], [(1, "llm_request", "error", at(30)), (1, "llm_request", "ok", at(20)), (2, "llm_call", "", at(1))]]
    table = sk.KeyedTable(spark, str(tmp_path / "t"), ["project_id"])
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        next((tmp_path / f"b{i}").glob("part-*.parquet")).rename(folder / f"{i}.parquet")
        stream = st.call_timing_stream(st.file_stream(spark, str(folder), "*.parquet", spark.createDataFrame([], schema).schema))
        st.run_available(stream, st.latest_into(table, ["project_id"], ["start_us", "end_us"]), str(tmp_path / "ck"), "update")
    us = lambda s: int(dt.datetime(2024, 1, 1, 0, 0, s, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert {tuple(r) for r in table.read().select("project_id", "start_us", "end_us").collect()} == {(1, us(20), us(9)), (2, -1, us(1))}


def test_name_pairs_equal_all_pairs(spark):
    names = ["Vendor", "vendor_name", "VENDOR NAME", "vend", "total", "Total Amount", "amount", "a", "", " ", "totals", "tota lamount", "invoice-no", "invoices", "no"]
    df = spark.createDataFrame([(t, n) for t in (1, 2) for n in names] + [(3, "vendor")], "type_id int, l string")
    other = df.withColumnRenamed("l", "r")
    every = df.distinct().join(other.distinct(), "type_id").withColumn("tier", dr.match_tier(F.col("l"), F.col("r"))).where("tier IS NOT NULL")
    rows = lambda x: {tuple(r) for r in x.select("type_id", "l", "r", "tier").collect()}
    assert rows(dr.name_pairs(df, other, "l", "r")) == rows(every)
