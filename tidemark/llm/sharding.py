"""Sharding by a hierarchical weighted hash tree: regions, racks, shards.

A document descends from the root. On each level every child of the node makes a draw -ln(u)/w, where u in (0, 1) is a
hash of the document's key and the child's label and w the weight of the child (the sum of the shard weights under it);
the smallest draw wins. A child's draw does not depend on its siblings, so when weights change, a document moves only
into a subtree whose weight grew or out of one whose weight fell, and nothing moves within subtrees that stayed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

#: Blocks of a shard that are numbered one by one. The table of their counts has shards x BLOCKS rows, whatever the data.
BLOCKS = 4096


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def standard_tree(n_shards: int, regions: int = 4, racks: int = 2, per_rack: int = 2, base: int | None = None) -> list[Leaf]:
    """Shards 0 .. n-1 of weight 1: the ``base`` first ones in blocks of regions x racks x per_rack, every further shard a region of its own.

    With the same base, a further shard only ever draws documents into itself. Without one the base is a single block, or nothing
    where there are fewer shards than that.
    """
    block = regions * racks * per_rack
    base = (block if n_shards >= block else 0) if base is None else base
    if base > n_shards or base % block:
        raise ValueError(f"a base of {base} is not whole blocks of {block} among {n_shards} shards")
    out = []
    for s in range(n_shards):
        if s < base:
            b, i = divmod(s, block)
            region, rest = divmod(i, racks * per_rack)
            out.append(Leaf(f"b{b}r{region}", f"b{b}r{region}k{rest // per_rack}", s))
        else:
            out.append(Leaf(f"s{s}", f"s{s}k", s))
    return out


def _levels(tree: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    """For each level: parent label -> child label -> weight."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for leaf in tree:
        if leaf.weight < 0:
            raise ValueError(f"negative weight of shard {leaf.shard}")
        if leaf.weight == 0:
            continue
        path = ["", leaf.region, leaf.rack, str(leaf.shard)]
        for level in range(3):
            children = levels[level].setdefault(path[level], {})
            children[path[level + 1]] = children.get(path[level + 1], 0.0) + leaf.weight
    if not levels[0]:
        raise ValueError("no shard has weight")
    return levels


def descend(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key, by one weighted draw per level."""
    if len({leaf.shard for leaf in tree}) < len(tree):
        raise ValueError("a shard is in the tree twice")
    place = {"": 0}  # of each node among those of its level
    node = F.lit(0)
    for level, parents in enumerate(_levels(tree)):
        labels = [label for children in parents.values() for label in children]
        below = sorted(parents, key=place.__getitem__)
        place = {label: i for i, label in enumerate(labels)}
        children = F.array(*(F.array(*(F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight"),
                                                F.lit(int(label) if level == 2 else place[label]).alias("place"))
                                       for label, weight in parents[p].items())) for p in below))

        named = F.concat_ws("|", key, F.lit(str(level)))

        def draw(child: Column) -> Column:
            bits = F.shiftrightunsigned(F.xxhash64(F.concat_ws("|", named, child["label"])), 11)
            u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
            return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["place"].alias("place"))

        node = F.array_min(F.transform(F.get(children, node), draw))["place"]  # noqa: B023 (built at once)
    return node


def assign(df: DataFrame, tree: list[Leaf], key: str = "doc_id", column: str = "shard") -> DataFrame:
    """Add each row's shard. A null key draws as the empty string; a column of that name is replaced."""
    return df.withColumn(column, descend(F.coalesce(F.col(key).cast("string"), F.lit("")), tree))


def numbered(df: DataFrame, group: str, key: str, order: list[str], column: str = "slot", blocks: int = BLOCKS) -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    Rows are dealt into blocks by a hash of ``key``; block counts give each block its first number, and rows are
    numbered within (group, block). No task sees a whole group.
    """
    block = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("block")), F.lit(blocks)).cast("int")
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(F.col(group).alias("_g"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_g", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(group, "_block").orderBy(*order)
    return (rows.withColumn("_own", F.row_number().over(own) - 1)
            .join(first, (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b")))
            .withColumn(column, F.col("_first") + F.col("_own"))
            .drop("_block", "_own", "_g", "_b", "_first"))


def shard_documents(docs: DataFrame, n_shards: int = 16, tree: list[Leaf] | None = None, base: int = 0) -> DataFrame:
    """Every document with its shard, its place there, and its shard if one more were added.

    The first ``base`` shards form blocks of the tree, all others are regions of their own. As long as the base stays, n + 1 shards
    differ from n by the rows that the new shard takes. A ``tree`` of one's own gets the further shard as a region.
    size is the UTF-8 length of the text plus 1, text_crc32 its checksum; a null text counts as empty. Rows with a null or
    repeated doc_id keep their own slots. Extra columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    grown = [*tree, Leaf("_new", "_newk", 1 + max(x.shard for x in tree))] if tree else standard_tree(n_shards + 1, base=base)
    tree = tree or standard_tree(n_shards, base=base)
    rows = docs.select(F.col("doc_id"), (F.octet_length(text_of()).cast("long") + 1).alias("size"),
                       F.crc32(text_of().cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign(assign(rows, tree), grown, column="grown_shard")
    out = numbered(rows, "shard", "doc_id", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
