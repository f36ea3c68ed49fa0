"""Hard negatives by exact search in a multiway tree of split points.

The tree is fitted on a bounded sample: a node has up to ``FAN`` split points far from each other, and a vector goes to the child of
its nearest one (the cells are cut by hyperplanes). All rows are then placed in the leaves, and for every pair of siblings the range
of distances from one's split point to the other's rows is taken from all rows. A search asks for scores in a window. With the norms
in a child that is an annulus around the anchor; a child is eliminated if, seen from any sibling's split point, its range of
distances cannot meet the annulus. The rows of the leaves that are left are scored exactly, in blocks of bounded size.

An anchor looks twice for its positives (its own leaf first, which bounds the score that a further leaf must reach) and twice for
the negatives of all its positives, each with a window of its own. Nothing is left to chance: the results are those of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.bitkmeans import scaled, usable
from tidemark.session import written

#: Rows that the split points are chosen from; the tree, which every task gets, is bounded by it.
SAMPLE = 4096
#: Split points of a node, and rows of the sample under which a node is a leaf.
FAN, LEAF = 8, 48
#: Rows and anchors that are scored against each other at once.
BLOCK_ROWS, BLOCK_ANCHORS = 16_384, 4_096
#: Components after scaling are below this, so that squared distances of 2 ** 12 components fit a long.
TOO_LARGE = 1 << 24
_FAR = (1 << 62) - 1
_ASK = "vec_id long, mark long, label int, v binary, w array<int>, lo array<long>, hi array<long>"


@dataclass
class Node:
    """Split points (n x d integers) and children; a child is a node or, as a number, a leaf."""
    points: np.ndarray
    children: list = field(default_factory=list)
    number: int = 0


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)
    leaves: int = 0


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of two sets of integer vectors."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * products(a, b)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of two sets of integer vectors: by doubles where every sum is below 2 ** 53, else by longs."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def fit(sample: np.ndarray, fan: int = FAN, leaf: int = LEAF) -> Tree:
    """The split points of a tree over (n, d) sample vectors; a sample without two different vectors gives a single leaf."""
    tree = Tree()

    def grow(rows: np.ndarray):
        if len(rows) >= leaf:
            chosen = [int(_squared(rows, rows[:1]).argmax())]
            nearest = _squared(rows, rows[chosen])[:, 0]
            while len(chosen) < fan and nearest.max() > 0:
                chosen.append(int(nearest.argmax()))
                nearest = np.minimum(nearest, _squared(rows, rows[chosen[-1:]])[:, 0])
            if len(chosen) > 1:
                node = Node(rows[chosen], number=len(tree.nodes))
                tree.nodes.append(node)
                at = _squared(rows, node.points).argmin(1)
                node.children = [grow(rows[at == i]) for i in range(len(chosen))]
                return node
        tree.leaves += 1
        return tree.leaves - 1

    grow(sample)
    return tree


def _descend(tree: Tree, vectors: np.ndarray):
    """Leaf of each vector, and per node passed: (node, rows, squared distances to its points, child taken)."""
    leaf, passed = np.zeros(len(vectors), np.int32), []
    todo = [(tree.nodes[0], np.arange(len(vectors)))] if tree.nodes else []
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        d = _squared(vectors[rows], node.points)
        at = d.argmin(1)
        passed.append((node, rows, d, at))
        for i, child in enumerate(node.children):
            if isinstance(child, Node):
                todo.append((child, rows[at == i]))
            else:
                leaf[rows[at == i]] = child
    return leaf, passed


def _vectors(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), -1).astype(np.int64)


def _place(tree: Tree):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=_descend(tree, _vectors(pdf["v"]))[0] if len(pdf) else np.zeros(0, np.int32))
    return run


def _ranges(tree: Tree):
    """Per batch: for node, point i and child j the least and greatest squared distance and squared norm of the child's rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            vectors = _vectors(pdf["v"])
            norms, out = (vectors * vectors).sum(1), []
            for node, rows, d, at in _descend(tree, vectors)[1]:
                for j in np.unique(at):
                    mine = at == j
                    n = norms[rows[mine]]
                    out += [(node.number, i, int(j), d[mine, i].min(), d[mine, i].max(), n.min(), n.max()) for i in range(d.shape[1])]
            yield pd.DataFrame(out, columns=["node", "i", "j", "near", "far", "small", "large"])
    return run


def _reachable(tree: Tree, ranges: dict, anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(anchor rows, leaf) pairs whose leaf may hold a score in one of the windows; window k belongs to anchor owner[k].

    Squared distances d to a row of squared norm n are |a|^2 + n - 2 score. All bounds have a margin, so no leaf is lost.
    """
    out: list[tuple[np.ndarray, int]] = []
    own = (anchors * anchors).sum(1)
    todo = [(tree.nodes[0], np.arange(len(owner)))] if tree.nodes else []
    if not tree.nodes:
        return [(np.unique(owner), 0)]
    while todo:
        node, ks = todo.pop()
        if not len(ks):
            continue
        who = np.unique(owner[ks])
        back = np.searchsorted(who, owner[ks])
        d = np.sqrt(_squared(anchors[who], node.points).astype(np.float64))[back]
        for j, child in enumerate(node.children):
            if (node.number, 0, j) not in ranges:  # no rows there
                continue
            small, large = map(float, ranges[node.number, 0, j][2:])
            inner, reach = own[owner[ks]] + small - 2.0 * hi[ks], own[owner[ks]] + large - 2.0 * lo[ks]
            size = own[owner[ks]] + large  # the slack is far beyond what rounding can do
            inner = np.sqrt(np.maximum(0.0, inner - 1.0 - 1e-9 * (size + 2.0 * np.abs(hi[ks]))))
            slack = 1.0 + 1e-9 * (size + 2.0 * np.abs(lo[ks]))
            ok, outer = reach >= -slack, np.sqrt(np.maximum(0.0, reach + slack))
            for i in range(len(node.points)):
                near, far = ranges[node.number, i, j][:2]
                near, far = np.sqrt(float(near)) * (1 - 1e-9), np.sqrt(float(far)) * (1 + 1e-9)
                ok &= (d[:, i] - outer <= far) & (d[:, i] + outer >= near) & (d[:, i] + far >= inner)
            if isinstance(child, Node):
                todo.append((child, ks[ok]))
            elif ok.any():
                out.append((np.unique(owner[ks[ok]]), child))
    return out


def _flat(asks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the anchors: the anchor's place, lower and upper end."""
    owner = np.repeat(np.arange(len(asks)), [len(x) for x in asks["w"]])
    return owner, np.concatenate(list(asks["lo"])).astype(np.int64), np.concatenate(list(asks["hi"])).astype(np.int64)


def _asked(tree: Tree, ranges: dict, home: bool):
    """Anchors with the leaves to look into: their own one, or all that their windows reach."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            vectors = _vectors(pdf["v"])
            if home:
                yield pdf.assign(leaf=_descend(tree, vectors)[0])
                continue
            owner, lo, hi = _flat(pdf)
            for rows, leaf in _reachable(tree, ranges, vectors, lo.astype(np.float64), hi.astype(np.float64), owner):
                yield pdf.iloc[rows].assign(leaf=np.int32(leaf))
    return run


def _scored(k: int, same: bool):
    """One block of rows of a leaf against one block of anchors: the best k rows per anchor and window."""
    def run(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(rows):
            ids, labels, vectors = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _vectors(rows["v"])
            step = max(1, (1 << 21) // len(rows))  # windows per step, so that a table of scores has 2 ** 21 cells
            for begin in range(0, len(asks), step):
                part = asks.iloc[begin:begin + step]
                scores = products(_vectors(part["v"]), vectors)
                fits = (labels[None, :] == part["label"].to_numpy()[:, None]) == same
                fits &= ids[None, :] != part["vec_id"].to_numpy()[:, None]
                owner, lo, hi = _flat(part)
                w = np.concatenate(list(part["w"]))
                for one in range(0, len(owner), step):
                    who = owner[one:one + step]
                    of = scores[who]
                    at, row = np.nonzero(fits[who] & (of >= lo[one:one + step, None]) & (of <= hi[one:one + step, None]))
                    score = of[at, row]
                    order = np.lexsort((ids[row], -score, at))
                    at, row, score = at[order], row[order], score[order]
                    best = np.arange(len(at)) - np.searchsorted(at, at) < k
                    at, row, score = at[best], row[best], score[best]
                    mine = part.iloc[who[at]]
                    out.append(pd.DataFrame({"anchor_id": mine["vec_id"].to_numpy(), "mark": mine["mark"].to_numpy(), "w": w[one:one + step][at],
                                             "id": ids[row], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor_id", "mark", "w", "id", "score")})
    return run


class Index:
    """A placed and measured table: (vec_id, label, v) rows in leaves, with the tree and its ranges."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, fan: int = FAN, leaf: int = LEAF, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS):
        picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").select("v").limit(sample).collect()
        self.tree = fit(_vectors(pd.Series([r.v for r in picked])) if picked else np.zeros((0, 1), np.int64), fan, leaf)
        placed = rows.select("vec_id", "label", "v").mapInPandas(_place(self.tree), "vec_id long, label int, v binary, leaf int")
        self.rows = written(placed.withColumn("place", F.monotonically_increasing_id()), "placed")
        parts = self.rows.select("v").mapInPandas(_ranges(self.tree), "node int, i int, j int, near long, far long, small long, large long")
        least = parts.groupBy("node", "i", "j").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.min("small").alias("small"), F.max("large").alias("large"))
        self.ranges = {(r.node, r.i, r.j): (r.near, r.far, r.small, r.large) for r in least.collect()}  # bounded by the tree
        self.blocks = {r.leaf: -(-r["count"] // block_rows) for r in self.rows.groupBy("leaf").count().collect()}
        self.block_anchors = block_anchors

    def _number(self, counts: dict[int, int]) -> Column:
        """How many blocks a leaf has."""
        return F.coalesce(F.get(F.array(*(F.lit(counts.get(i, 1)) for i in range(self.tree.leaves))), F.col("leaf")), F.lit(1))

    def search(self, asks: DataFrame, k: int, same: bool, home: bool = False) -> DataFrame:
        """The best k rows per anchor and window (anchor_id, mark, w, id, score, n): of the same label or of others.

        ``asks`` has vec_id, mark, label, v and the windows' numbers and ends (w, lo, hi). With ``home`` only the anchor's own leaf is looked into.
        """
        asked = written(asks.mapInPandas(_asked(self.tree, self.ranges, home), f"{_ASK}, leaf int"), "asked")
        chunks = {r.leaf: -(-r["count"] // self.block_anchors) for r in asked.groupBy("leaf").count().collect()}
        blocks, parts = self._number(self.blocks), self._number(chunks)
        left = asked.withColumns({"part": F.pmod(F.xxhash64("vec_id", "mark"), parts).cast("int"), "block": F.explode(F.sequence(F.lit(0), blocks - 1))})
        wanted = F.array(*(F.lit(i in chunks) for i in range(self.tree.leaves)))
        right = self.rows.where(F.get(wanted, F.col("leaf"))).withColumns(
            {"block": F.pmod(F.xxhash64("place"), blocks).cast("int"), "part": F.explode(F.sequence(F.lit(0), parts - 1))})
        keys = ["leaf", "block", "part"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_scored(k, same), "anchor_id long, mark long, w int, id long, score long")
        order = W.partitionBy("anchor_id", "mark", "w").orderBy(F.desc("score"), "id")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def _floors(asks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The asks with each window's lower end raised to the k-th score that was found in it."""
    kth = found.where(F.col("n") == k).groupBy(F.col("anchor_id").alias("vec_id"), "mark").agg(F.collect_list(F.struct("w", "score")).alias("kth"))
    known = lambda w: F.get(F.filter("kth", lambda x: x["w"] == w), F.lit(0))["score"]
    raised = F.zip_with("w", "lo", lambda w, lo: F.greatest(lo, known(w)))
    return asks.join(kth, ["vec_id", "mark"], "left").withColumn("lo", raised).drop("kth")


def pack(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of (vec_id, label, values): the integers as bytes, shorter vectors filled up with zeros."""
    size = rows.agg(F.max(F.size("values"))).first()[0] or 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = []
            for x in pdf["values"]:
                if len(x) and np.abs(x).max() >= TOO_LARGE:
                    raise ValueError(f"a component is beyond {TOO_LARGE}; distances might not fit a long")
                packed.append(np.pad(np.asarray(x, "<i4"), (0, size - len(x))).tobytes())
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "v": packed})
    return rows.select("vec_id", "label", "values").mapInPandas(run, "vec_id long, label int, v binary")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), **sizes: int) -> DataFrame:
    """Hard negatives of (vec_id, label, v) rows: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best other rows of the same label, a positive's negatives the best rows of other labels whose score
    lies between the two percentages of the positive's. Scores are inner products; ties go to the smaller id. Rows with the id of
    the anchor are never its positives or negatives; other repeated rows count each; an anchor that is there twice is answered once
    per different row. Positives without a negative give no row. An empty table, or one without anchors, gives an empty result.
    """
    index = Index(rows, **sizes)
    anchors = index.rows.where(is_anchor).select("vec_id", "label", "v").distinct().withColumn("mark", F.xxhash64("label", "v"))
    whole = {"w": F.array(F.lit(0)), "lo": F.array(F.lit(-_FAR)), "hi": F.array(F.lit(_FAR))}
    names = ["vec_id", "mark", "label", "v", "w", "lo", "hi"]
    anchors = written(anchors, "anchors")
    asks = anchors.withColumns(whole).select(names)
    near = index.search(asks, positives, True, home=True)
    best = written(index.search(_floors(asks, near, positives).select(names), positives, True), "positives")
    part = lambda p: (F.lit(p) * F.col("score")).cast("decimal(38,0)") / F.lit(100)
    ends = {"lo": F.ceil(part(percent[0])).cast("long"), "hi": F.floor(part(percent[1])).cast("long")}
    windows = (best.withColumns(ends).where("lo <= hi").groupBy(F.col("anchor_id").alias("vec_id"), "mark")
               .agg(F.collect_list(F.struct(F.col("n").alias("w"), "lo", "hi")).alias("all")))
    asks = written(anchors.join(windows.select("vec_id", "mark", "all.w", "all.lo", "all.hi"), ["vec_id", "mark"]).select(names), "windows")
    close = index.search(asks, negatives, False, home=True)
    found = index.search(_floors(asks, close, negatives).select(names), negatives, False)
    kept = best.select("anchor_id", "mark", F.col("n").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return kept.join(found.withColumnsRenamed({"id": "negative_id", "score": "negative_score", "n": "rank"}), ["anchor_id", "mark", "w"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def labelled(table: DataFrame, factor: int = 256, moved: int = 7, labels: int = 10) -> DataFrame:
    """The rows that take part, packed: id, label and vector there, all components finite; ids divisible by ``moved`` get the next label.

    Vectors of different lengths count as filled up with zeros. Components of 2 ** 24 and more after scaling are an error.
    """
    vector = F.col("embedding")
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("int")
    some = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(vector))
    return pack(some.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), scaled(vector, factor).alias("values")))


def hard_negatives(table: DataFrame, every: int = 50, **sizes: int) -> DataFrame:
    """Hard negatives for the rows of (vec_id, embedding, label) whose id is divisible by ``every``, against all rows. Other columns are ignored."""
    return mine(labelled(table), F.col("vec_id") % every == 0, **sizes)


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, unnest(embedding) AS f, generate_subscripts(embedding, 1) AS place FROM v),
bad AS (SELECT vec_id FROM u WHERE f IS NULL OR NOT isfinite(f)),
e AS (SELECT vec_id, place, CAST(floor(256 * CAST(f AS DOUBLE)) AS BIGINT) AS x FROM u WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM e AS a JOIN e AS b ON a.place = b.place
      WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
t AS (SELECT s.*, x.label = y.label AS same FROM s JOIN v AS x ON s.a = x.vec_id JOIN v AS y ON s.b = y.vec_id),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM t WHERE same) AS r WHERE n <= 5),
n AS (SELECT p.a, p.b AS p, t.b AS n, p.score AS ps, t.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY t.score DESC, t.b) AS rank
      FROM p JOIN t ON p.a = t.a AND NOT t.same AND 50 * p.score <= 100 * t.score AND 100 * t.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""
