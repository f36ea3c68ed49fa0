"""Lines that many documents share, found through levelled sorted runs of line hashes. Only DataFrame functions: no Python on the executors.

A run is an immutable table of line hashes with the number of documents that hold the line, bucketed and sorted by hash. Each batch
of documents is reduced to its distinct hashes, merge-anti-joined with the hashes that the runs already hold often enough, and the
rest becomes a run of its own on level 0. When a level has ``FAN`` runs they are merged into one run of the next level, so a hash is
rewritten once per level. Hashes do not compress, so runs are written plain. All runs of a store have the same buckets, so the joins with a batch do not shuffle the runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.session import scratch_path, written

#: Runs of one level that are merged into a run of the next.
FAN = 4
#: Hashes per bucket that the number of buckets is chosen for (24 bytes each).
PER_BUCKET = 1_000_000
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text, cut at line feeds; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text: Column) -> Column:
    """The lines' keys: blanks stripped at both ends, A to Z in lower case."""
    return F.transform(lines_of(F.translate(text, _UPPER, _LOWER)), lambda x: F.btrim(x, F.lit(_BLANKS)))


def hash_of(key: Column) -> list[Column]:
    """128 bits of a key, as two longs of differently seeded hashes."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x51ED), key).alias("h2")]


def line_counts(docs: DataFrame, *by: Column, min_chars: int = 1) -> DataFrame:
    """Distinct line hashes with the number of documents that hold them (columns ``by``, h1, h2, n).

    A line that a document repeats counts once; every row is a document of its own, also with a null or repeated id. Counts are
    combined before the shuffle, so a line of a third of all documents is one row per task.
    """
    each = docs.select(*by, F.explode(F.array_distinct(keys_of(F.col("text")))).alias("_key"))
    names = each.columns[:-1]
    return (each.where(F.length("_key") >= min_chars).select(*names, *hash_of(F.col("_key")))
            .groupBy(*names, *_HASH).agg(F.count(F.lit(1)).alias("n")))


class LineRuns:
    """Levelled runs of line hashes in one folder, for batches that arrive one after the other.

    ``limit`` is the number of documents from which a line counts as frequent. A batch records no hash that one run already has
    ``limit`` times, and no run counts further than that, so counts are exact below the limit and at least the limit above it; with a
    limit of 1 the runs are the set of lines seen. The folder's newest manifest names the runs and batches. It is written last, as one file: a batch that fails leaves
    the store as it was, and a batch that is given again under the same name is skipped. Replaced runs stay until ``retire``.
    """

    def __init__(self, spark: SparkSession, path: str, limit: int, buckets: int = 16, fan: int = FAN):
        self.spark, self.path, self.limit, self.fan = spark, path.rstrip("/"), limit, fan
        self.version, self.buckets, self.runs, self.batches, self.replaced = 0, buckets, [], [], []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineRuns:
        """A store from its newest manifest."""
        row = spark.read.parquet(f"{path.rstrip('/')}/manifest").orderBy(F.desc("version")).first()
        out = cls(spark, path, row.run_limit, row.buckets, row.fan)
        out.version, out.batches = row.version, list(row.batches)
        out.runs = [(r.level, r.name) for r in row.runs]
        return out

    def _commit(self, runs: list[tuple[int, str]], batches: list[str]) -> None:
        of = lambda items, kind: F.array(*items).cast(kind)
        row = self.spark.range(1).select(
            F.lit(self.version + 1).alias("version"), F.lit(self.limit).alias("run_limit"), F.lit(self.buckets).alias("buckets"), F.lit(self.fan).alias("fan"),
            of([F.struct(F.lit(x).alias("level"), F.lit(n).alias("name")) for x, n in runs], "array<struct<level:int,name:string>>").alias("runs"),
            of([F.lit(b) for b in batches], "array<string>").alias("batches"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.replaced += [r for r in self.runs if r not in runs]
        self.version, self.runs, self.batches = self.version + 1, runs, batches

    def _table(self, name: str) -> DataFrame:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h1 BIGINT, h2 BIGINT, n INT) USING parquet CLUSTERED BY (h1, h2) "
                       f"SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        capped = rows.select(*_HASH, F.least("n", F.lit(self.limit)).cast("int").alias("n"))
        (capped.write.format("parquet").option("compression", "none").bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", f"{self.path}/{name}").saveAsTable(name))
        return name

    def add(self, counts: DataFrame, batch: str) -> None:
        """Add a batch (columns h1, h2, n; distinct hashes) as a run and merge the levels that are full."""
        if batch in self.batches:
            return
        new = counts.select(*_HASH, "n").repartition(self.buckets, *_HASH)
        for _, name in self.runs:
            new = new.join(self._table(name).where(F.col("n") >= self.limit).hint("merge"), _HASH, "left_anti")
        self._commit([*self.runs, (0, self._write(new))], [*self.batches, batch])
        while full := [x for x in {x for x, _ in self.runs} if sum(x == y for y, _ in self.runs) >= self.fan]:
            self._merge(min(full))

    def _merge(self, level: int) -> None:
        old = [r for r in self.runs if r[0] == level]
        run = self._write(self._sum([name for _, name in old]))
        self._commit([*(r for r in self.runs if r not in old), (level + 1, run)], self.batches)

    def _sum(self, names: list[str]) -> DataFrame:
        # Read as plain files: Spark 4.1 takes a union of equally bucketed scans for bucketed and leaves out the shuffle, but does not
        # bring the buckets together where the union is columnar, which would leave a hash in several groups.
        both = self.spark.read.schema("h1 long, h2 long, n int").parquet(*(f"{self.path}/{name}" for name in names))
        return both.groupBy(*_HASH).agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        """All hashes with their counts; a store without batches has none."""
        if not self.runs:
            return self.spark.range(0).select(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("n"))
        return self._sum([name for _, name in self.runs])

    def frequent(self) -> DataFrame:
        """The hashes of lines that ``limit`` documents or more hold."""
        return self.counts().where(F.col("n") >= self.limit).select(*_HASH)

    def retire(self) -> None:
        """Delete the runs that newer ones have replaced. For the time when nobody reads them any more."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for _, name in self.replaced:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = hadoop.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.replaced = []


def without_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = 1) -> DataFrame:
    """The documents with the lines of ``frequent`` hashes (h1, h2) left out of ``text``, and n_lines and n_dropped (long) added.

    Null texts become empty. Input columns named n_lines or n_dropped are replaced; other columns stay as they are. Positions to
    drop are found per distinct text, as one row per line and a join that Spark can split at hot lines; the texts move once.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    row = docs.select(whole.alias("row"), F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("id"))
    places = (row.select("id", F.posexplode(keys_of(F.col("row.text"))).alias("at", "key")).where(F.length("key") >= min_chars)
              .select("id", "at", *hash_of(F.col("key"))))
    gone = places.join(frequent, _HASH).groupBy("id").agg(F.collect_set("at").alias("gone"))
    lines = F.col("lines")
    # by set difference of positions: linear, where a lookup per line would be quadratic for long texts
    kept = F.when(F.col("gone").isNull(), text_of("row.text")).otherwise(F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i)), "\n"))
    done = row.join(gone, "id", "left").withColumn("lines", lines_of(F.col("row.text")))
    new = {"text": kept, "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    done = done.select("row", F.struct(*(x.alias(c) for c, x in new.items())).alias("new"))  # apart, so that no input name is taken for one of these
    return done.select(*(F.col("new" if c in new else "row").getField(c).alias(c) for c in [*docs.columns, *(c for c in new if c not in docs.columns)]))


def drop_frequent_lines(docs: DataFrame, limit: int = 10, min_chars: int = 1, batches: int = 4, buckets: int | None = None) -> DataFrame:
    """Drop the lines whose key has at least ``min_chars`` code points and is found in at least ``limit`` documents.

    The rows are dealt into ``batches`` by a hash, which go through the levelled runs one after the other; neither the number of
    batches nor of buckets changes the result. Every row is a document, also without an id or with a repeated one or a repeated text; an
    empty table gives an empty result. Lines are told apart by 128 bits of hash.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64(text_of()), F.lit(batches)).alias("batch")
    path = scratch_path(spark, "line_batches")
    line_counts(docs, batch, min_chars=min_chars).write.partitionBy("batch").option("compression", "none").parquet(path)
    staged = spark.read.schema("h1 long, h2 long, n long, batch long").parquet(path)
    if buckets is None:
        want = staged.count() // PER_BUCKET + 1
        buckets = min(1 << 16, max(8, 1 << (want - 1).bit_length()))
    runs = LineRuns(spark, scratch_path(spark, "line_runs"), limit, buckets)
    for i in range(batches):
        runs.add(staged.where(F.col("batch") == i), str(i))
    return without_lines(docs, written(runs.frequent(), "frequent_lines"), min_chars)


def line_digests(docs: DataFrame, limit: int = 10) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the digest of the text that is left."""
    return drop_frequent_lines(docs.select("doc_id", "text"), limit).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key AS often FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(often) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE often IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = often GROUP BY r
"""
