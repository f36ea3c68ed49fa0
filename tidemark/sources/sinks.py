"""Writers: append, write-once and replace of keyed tables on plain files."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import scratch_path, written


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """The path on a file system that driver and executors have mounted; None where it lies on any other kind of storage."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def new_only(incoming: DataFrame, existing: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Rows to write: those whose key is not stored yet, or all of them with ``force``."""
    return incoming if force else incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def write_new(df: DataFrame, path: str, keys: list[str], *, force: bool = False, dry_run: bool = False,
              partition: list[str] = (), order: list[str] | None = None) -> None:
    """Write artifacts that do not exist yet; ``force`` replaces those that do, ``dry_run`` writes nothing.

    One row per key is written: of incoming rows with one key the smallest by ``order`` and then by its other columns. A forced write leaves other artifacts alone: it
    rewrites only the partitions that hold a forced key, before or after, from their other rows and the incoming ones. The
    merged rows are written beside the table first, so that no file is read while it is replaced.
    """
    if dry_run:
        return
    spark = df.sparkSession
    rest = [x for x in df.columns if x not in keys]
    first = F.struct(*(order or []), *[x for x in rest if x not in (order or [])])
    df = df.groupBy(*keys).agg(F.min(first).alias("_f")).select(*[F.col(x) if x in keys else F.col(f"_f.{x}").alias(x) for x in df.columns])
    if not exists(spark, path):
        (df.write.partitionBy(*partition) if partition else df.write).parquet(path)
        return
    stored = spark.read.parquet(path)
    if not force:
        df = new_only(df, stored, keys)
        (df.write.mode("append").partitionBy(*partition) if partition else df.write.mode("append")).parquet(path)
        return
    if partition:
        replaced = stored.join(df.select(*keys), keys, "left_semi")
        touched = replaced.select(*partition).union(df.select(*partition)).distinct()
        same = [stored[p].eqNullSafe(touched[p]) for p in partition]
        others = stored.join(touched, same, "left_semi")
    else:
        replaced, others = None, stored
    merged = written(others.join(df.select(*keys), keys, "left_anti").select(*df.columns).unionByName(df), "merged")
    if not partition:
        merged.write.mode("overwrite").parquet(path)
        return
    # a partition that only held forced keys which move elsewhere has no row left to overwrite it with
    kept = [merged[p].eqNullSafe(touched[p]) for p in partition]
    emptied = touched.join(merged.select(*partition).distinct(), kept, "left_anti").collect()
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
    for row in emptied:
        folder = "/".join(f"{p}={row[p]}" if row[p] is not None else f"{p}=__HIVE_DEFAULT_PARTITION__" for p in partition)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of Parquet from which a bucket is split.
BUCKET_BYTES = 64 << 20


class TableStore:
    """Keyed tables in one folder, each in buckets of its keys' hash; a commit makes changes of several tables visible together.

    Buckets grow by extendible hashing: a bucket of depth d holds the rows whose hash ends in its d bits, and a bucket that would pass
    ``bound`` bytes is written as its 2, 4, ... children. So a merge of k keys rewrites at most k buckets, each of bounded size (a
    single key's rows stay together). The manifest, one small file per version, names the bucket folders of all tables, a row per
    ``bound`` bytes; a version counts once its file is there, under its final name. Until then nothing has changed: a lost executor or
    a failed commit leaves all tables as they were, and the commit can be run again. Folders that a version replaces are deleted by
    the version after it, so readers of the one before keep theirs. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, bound: int = BUCKET_BYTES):
        self.spark, self.path, self.bound = spark, path.rstrip("/"), bound
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def state(self) -> dict:
        """The newest manifest."""
        versions = sorted(x for x in self._names("manifest") if x.endswith(".json"))
        if not versions:
            return {"version": 0, "tables": {}, "replaced": []}
        stream = self._fs.open(self._path(f"manifest/{versions[-1]}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, state: dict) -> None:
        name = f"manifest/{state['version']:010d}.json"
        out = self._fs.create(self._path(name + ".tmp"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(self._path(name + ".tmp"), self._path(name)):
            raise OSError(f"version {state['version']} is there already")

    def _open(self, buckets: list[list]) -> DataFrame | None:
        paths = [f"{self.path}/{folder}" for _, _, folder, _ in buckets if folder]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, table: str) -> DataFrame | None:
        """All rows of a table; None where nothing is stored."""
        return self._open(self.state()["tables"].get(table, {"buckets": []})["buckets"])

    def begin(self) -> Commit:
        return Commit(self)


class Commit:
    """Changes to the tables of a store, seen by nobody before ``done``."""

    def __init__(self, store: TableStore):
        self.store, self.state = store, store.state()
        self.doomed, self.replaced = self.state["replaced"], []

    def _located(self, rows: DataFrame, keys: list[str], buckets: list[list]) -> DataFrame:
        """Add _h, the keys' hash, and the depth and number (_d, _p) of the bucket that holds it."""
        hashed = rows.withColumn("_h", F.xxhash64(*keys))
        depths = sorted({d for d, *_ in buckets})
        low = lambda d: F.col("_h").bitwiseAND(F.shiftleft(F.lit(1).cast("long"), d) - 1)
        if len(depths) == 1:
            return hashed.withColumn("_d", F.lit(depths[0])).withColumn("_p", low(depths[0]))
        spark = self.store.spark
        known = spark.createDataFrame([(d, p) for d, p, *_ in buckets], "_d int, _p long")
        tries = F.inline(F.array(*(F.struct(F.lit(d).alias("_d"), low(d).alias("_p")) for d in depths)))
        return hashed.select("*", tries).join(known, ["_d", "_p"], "left_semi")

    def merge(self, table: str, keys: list[str], incoming: DataFrame, combine) -> DataFrame | None:
        """Replace the rows of the incoming keys' buckets by ``combine(current, incoming)``, which must work key by key.

        Gives the rows of those buckets after the merge, None where nothing came in. The first merge of a key starts from an empty table.
        """
        store = self.store
        held = self.state["tables"].get(table, {"keys": keys, "buckets": [[0, 0, "", 0]]})
        if held["keys"] != list(keys):
            raise ValueError(f"{table} is keyed by {held['keys']}")
        path = scratch_path(store.spark, "incoming")
        incoming.write.parquet(path)
        incoming = store.spark.read.schema(incoming.schema).parquet(path)
        scratch = store._hadoop.Path(path)
        size = scratch.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(scratch).getLength()
        buckets = held["buckets"]
        if len(buckets) == 1:
            touched = {(0, 0)} if not incoming.isEmpty() else set()
        else:
            touched = {(r["_d"], r["_p"]) for r in self._located(incoming, keys, buckets).select("_d", "_p").distinct().collect()}
        if not touched:
            return None
        old = [b for b in buckets if (b[0], b[1]) in touched]
        current = store._open(old)
        merged = combine(incoming.where(F.lit(False)) if current is None else current, incoming)
        # children of each touched bucket, by the bytes it will have
        deeper = {(d, p): max(0, math.ceil(math.log2(max(1, (held_bytes + size / 2 ** d) / store.bound)))) for d, p, _, held_bytes in old}
        located = self._located(merged, keys, old if len(buckets) == 1 else buckets)
        if len(set(deeper.values())) == 1:
            depth = F.col("_d") + next(iter(deeper.values()))
        else:
            grow = self.store.spark.createDataFrame([(d, p, j) for (d, p), j in deeper.items()], "_d int, _p long, _j int")
            located = located.join(grow, ["_d", "_p"], "left")
            depth = F.col("_d") + F.coalesce("_j", F.lit(0))
        number = F.col("_h").bitwiseAND(F.expr("shiftleft(1L, _to)") - 1)
        placed = located.withColumn("_to", depth).withColumn("_bucket", F.concat_ws("-", "_to", number)).select(*merged.columns, "_bucket")
        folder = f"data/{table}-{self.state['version'] + 1}-{uuid.uuid4().hex}"
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{store.path}/{folder}")
        there = {x.split("=", 1)[1] for x in store._names(folder) if x.startswith("_bucket=")}
        new = []
        for (d, p), j in deeper.items():
            for i in range(2 ** j):
                name = f"{d + j}-{p + (i << d)}"
                at = f"{folder}/_bucket={name}" if name in there else ""
                new.append([d + j, p + (i << d), at, store._fs.getContentSummary(store._path(at)).getLength() if at else 0])
        if len(there) != sum(bool(b[2]) for b in new):
            raise ValueError("combine gave rows of other keys than it got")
        self.replaced += [b[2] for b in old if b[2]]
        self.state["tables"][table] = {"keys": list(keys), "buckets": [b for b in buckets if (b[0], b[1]) not in touched] + new}
        rows = store._open(new)
        return rows if rows is not None else merged.where(F.lit(False))

    def done(self) -> None:
        """Make the changes visible, all at once; then delete what the version before had replaced."""
        store = self.store
        if not self.replaced and store.state()["tables"] == self.state["tables"]:
            return
        self.state = {**self.state, "version": self.state["version"] + 1, "replaced": self.replaced}
        store._save(self.state)
        for folder in self.doomed:
            store._fs.delete(store._path(folder), True)
            parent = store._path(folder).getParent()
            if store._fs.exists(parent) and not any(x.getPath().getName().startswith("_bucket=") for x in store._fs.listStatus(parent)):
                store._fs.delete(parent, True)
        for name in sorted(store._names("manifest"))[:-2]:
            store._fs.delete(store._path(f"manifest/{name}"), True)


class KeyedTable:
    """One table of a store, changed by commits of its own."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bound: int = BUCKET_BYTES):
        self.store, self.keys = TableStore(spark, path, bound), list(keys)

    def read(self) -> DataFrame | None:
        return self.store.read("rows")

    def merge(self, incoming: DataFrame, combine) -> None:
        commit = self.store.begin()
        commit.merge("rows", self.keys, incoming, combine)
        commit.done()


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON documents."""
    df.write.mode("overwrite").json(path)
