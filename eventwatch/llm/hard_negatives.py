"""Hard-negative mining by a multiway hyperplane tree (operator 12).

Vectors get one more coordinate, so that all rows have the same length and a high inner product with
an anchor is a small distance: a window of scores is an annulus around the anchor. A node of the tree
has up to `FANOUT` split points; a row belongs to the nearest one, and the node stores for each pair of a
split point and a child the range of distances from that point to all rows of the child. A child is
left out when, for any of the split points, its range misses the annulus (triangle inequality). What remains are
leaves, searched exactly.

The tree is fitted on at most `SAMPLE` rows, which also give a first bound: the k-th best answer among
them narrows every window before the search. All rows are indexed. Rows of a leaf lie in chunks of about
`CHUNK` rows, whatever the leaf's size; anchors are sent to the chunks of the leaves that remain, and a task
holds one chunk while the anchors stream past it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventwatch.llm.text_arrays import lists
from eventwatch.session import materialize

#: Rows the tree is fitted on, and their size at most; both bound what is collected and sent to tasks.
SAMPLE, SAMPLE_BYTES = 8_192, 16 << 20
FANOUT = 16
#: A node is split when more rows than this are expected below it.
LEAF_ROWS = 4_096
CHUNK = 4_096
#: Squared lengths below which sums of products are exact in the float types.
EXACT_SINGLE, EXACT_DOUBLE = 1 << 24, 1 << 53
#: Score bounds that stand for "none": beyond any exact score.
NO_BOUND = 1 << 60


@dataclass
class Node:
    points: np.ndarray  # split points, with the added coordinate
    children: list  # a Node or the number of a leaf
    low: np.ndarray = field(default=None)  # [point, child]: least distance to a row of the child
    high: np.ndarray = field(default=None)

    def __post_init__(self):
        k = len(self.children)
        self.low, self.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)


@dataclass
class Tree:
    """`length2` is the largest squared length of a row, `kind` the float type that is exact for it."""

    dim: int
    length2: int
    root: object
    leaves: int
    ids: np.ndarray  # the sample, by id
    labels: np.ndarray
    sample: np.ndarray

    @property
    def kind(self) -> type:
        return float_type(self.length2)

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return lift(v, self.length2)

    def nodes(self) -> list[Node]:
        found, todo = [], [self.root]
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                found.append(x)
                todo += x.children
        return found

    def leaf_of(self, v: np.ndarray, seen: Callable[[Node, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
        """Leaf of each row; `seen` is told of (node, distances to its points, child) on the way."""
        x, out = self.lifted(v), np.zeros(len(v), np.int32)

        def go(node, at: np.ndarray) -> None:
            if not isinstance(node, Node):
                out[at] = node
                return
            d = distances(x[at], node.points)
            child = d.argmin(axis=1)
            if seen:
                seen(node, d, child)
            for j, below in enumerate(node.children):
                if (mine := at[child == j]).size:
                    go(below, mine)

        go(self.root, np.arange(len(v)))
        return out

    def remaining(self, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, anchors whose windows it may hold rows of); `low`, `high`: scores, one column per window."""
        own = (v.astype(np.float64) ** 2).sum(axis=1)
        x = np.c_[v.astype(np.float64), np.zeros(len(v))]
        gone = low > high
        # a score s lies at distance sqrt(|a|² + L² - 2 s); windows without a bound reach everything
        slack = 1e-6 * (np.sqrt(self.length2) + 1)
        base = (own + self.length2)[:, None]
        near = np.sqrt(np.maximum(base - 2.0 * np.minimum(high, NO_BOUND), 0)) - slack
        far = np.where(low <= -NO_BOUND, np.inf, np.sqrt(np.maximum(base - 2.0 * np.maximum(low, -NO_BOUND), 0))) + slack
        out: list[tuple[int, np.ndarray]] = []

        def go(node, at: np.ndarray) -> None:
            if not isinstance(node, Node):
                out.append((node, at))
                return
            d = np.sqrt(np.maximum(own[at][:, None] + self.length2 - 2 * (x[at] @ node.points.T), 0))
            for j, below in enumerate(node.children):
                alive = np.zeros(len(at), bool)
                # distances from the anchor to rows of the child, as all points see them
                least = np.maximum(node.low[:, j] - d, d - node.high[:, j]).max(axis=1)
                most = (d + node.high[:, j]).min(axis=1)
                for w in range(low.shape[1]):
                    alive |= ~gone[at, w] & (least <= far[at, w]) & (most >= near[at, w])
                if alive.any():
                    go(below, at[alive])

        go(self.root, np.flatnonzero(~gone.all(axis=1)))
        return out


def float_type(length2: int) -> type:
    return np.float32 if length2 < EXACT_SINGLE else np.float64


def lift(v: np.ndarray, length2: int) -> np.ndarray:
    v = v.astype(np.float64)
    return np.c_[v, np.sqrt(np.maximum(length2 - (v * v).sum(axis=1), 0))]


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Between lifted rows and lifted points."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * (x @ points.T), 0))


def matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    """Rows of a binary column of packed components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not dim:
        return np.zeros((len(column), 0), kind)
    _, _, data = column.buffers()
    at = column.offset * dim * np.dtype(kind).itemsize
    return np.frombuffer(data, kind, len(column) * dim, at).reshape(-1, dim)


def packed(v: np.ndarray) -> pa.Array:
    width = v.shape[1] * v.itemsize
    at = pa.array(np.arange(len(v) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(v), [None, at.buffers()[1], pa.py_buffer(np.ascontiguousarray(v).tobytes())])


def split_points(x: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: the first, then always the one farthest from those taken."""
    some = x[: 8 * count]
    taken = [0]
    gap = distances(some, some[:1])[:, 0]
    while len(taken) < count:
        k = int(gap.argmax())
        if gap[k] <= 1e-9 * (1 + np.abs(some).max()):
            break
        taken.append(k)
        gap = np.minimum(gap, distances(some, some[k:k + 1])[:, 0])
    return some[taken]


def grow(ids: np.ndarray, labels: np.ndarray, sample: np.ndarray, length2: int, rows: int) -> Tree:
    """The tree over a sample of `rows` rows; distance ranges are filled in by `measure`."""
    x, leaves = lift(sample, length2), [0]
    share = rows / max(len(sample), 1)

    def build(at: np.ndarray):
        if len(at) * share > LEAF_ROWS and len(at) > FANOUT:
            points = split_points(x[at], FANOUT)
            child = distances(x[at], points).argmin(axis=1)
            if len(points) > 1 and len(np.unique(child)) > 1:
                return Node(points, [build(at[child == j]) for j in range(len(points))])
        leaves[0] += 1
        return leaves[0] - 1

    root = build(np.arange(len(sample)))
    return Tree(sample.shape[1], length2, root, leaves[0], ids, labels, sample)


def whole_numbers(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, embedding with floor(scale * x) for each component; rows with a null or non-finite one go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & finite).withColumn(
        "embedding", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)))


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part: no nulls, one row per id."""
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                        F.col("embedding").cast("array<bigint>").alias("embedding"))
    whole = whole.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
                         & F.forall("embedding", lambda x: x.isNotNull()))
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    return one.select("vec_id", "r.label", "r.embedding")


def pack(batches: Iterator[pa.RecordBatch], dim: int, kind: type) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with its vectors, shorter ones filled up with zeros."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("embedding"))
        sizes = np.diff(column.offsets.to_numpy())
        v = np.zeros((len(sizes), dim), kind)
        v[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        yield batch, v


def build(rows: DataFrame, sample_rows: int = SAMPLE) -> tuple[Tree, DataFrame] | None:
    """(tree, rows as vec_id, label, leaf, v) or None for an empty table; two passes over the rows."""
    rows = materialize(prepared(rows), "vectors")
    length2 = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: a + x * x)
    n, dim, top = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.max(length2)).first()
    if not n:
        return None
    if top > EXACT_DOUBLE:
        raise ValueError("squared length of a vector exceeds 2**53: inner products would not be exact")
    kind = float_type(top)
    limit = max(FANOUT, min(sample_rows, SAMPLE_BYTES // max(1, dim * np.dtype(kind).itemsize)))
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(limit).toArrow().combine_chunks()
    _, sample = next(pack(iter(got.to_batches()), dim, kind))
    tree = grow(got["vec_id"].to_numpy(), got["label"].to_numpy(), sample, int(top), n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v in pack(batches, dim, kind):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tree.leaf_of(v)), packed(v)],
                                             ["vec_id", "label", "leaf", "v"])

    placed = materialize(rows.mapInArrow(place, "vec_id bigint, label bigint, leaf int, v binary"), "placed")
    measure(tree, placed)
    return tree, placed


def measure(tree: Tree, placed: DataFrame) -> None:
    """Fill in every node's distance ranges from all rows; one row per node and pair comes back."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = tree.nodes()
        number = {id(x): k for k, x in enumerate(nodes)}
        low, high = [np.full_like(x.low, np.inf) for x in nodes], [np.full_like(x.high, -np.inf) for x in nodes]

        def seen(node: Node, d: np.ndarray, child: np.ndarray) -> None:
            k = number[id(node)]
            for j in np.unique(child):
                mine = d[child == j]
                low[k][:, j] = np.minimum(low[k][:, j], mine.min(axis=0))
                high[k][:, j] = np.maximum(high[k][:, j], mine.max(axis=0))

        for batch in batches:
            tree.leaf_of(matrix(batch.column(0), tree.dim, tree.kind), seen)
        for k in range(len(nodes)):
            i, j = np.nonzero(np.isfinite(low[k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), k)), pa.array(i), pa.array(j), pa.array(low[k][i, j]), pa.array(high[k][i, j])],
                ["node", "i", "j", "low", "high"])

    found = placed.select("v").mapInArrow(ranges, "node bigint, i bigint, j bigint, low double, high double")
    nodes = tree.nodes()
    for r in found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        nodes[r.node].low[r.i, r.j], nodes[r.node].high[r.i, r.j] = r.low, r.high


QUERY = "vec_id bigint, label bigint, v binary, low array<bigint>, high array<bigint>"


def narrowed(tree: Tree, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """The queries with each window's lower end raised to its k-th best score among the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2), tree.dim, tree.kind)
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            low, high = windows_of(batch, 3), windows_of(batch, 4)
            s = (v @ tree.sample.T).astype(np.int64)
            fits = ((labels[:, None] == tree.labels) == same) & (ids[:, None] != tree.ids)
            low = low.copy()
            for w in range(low.shape[1]):
                inside = np.where(fits & (s >= low[:, w:w + 1]) & (s <= high[:, w:w + 1]), s, -NO_BOUND)
                if inside.shape[1] >= k:
                    low[:, w] = np.maximum(low[:, w], -np.partition(-inside, k - 1, axis=1)[:, k - 1])
            sizes = np.full(len(ids), low.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(low.ravel(), sizes), batch.column(4)],
                                             ["vec_id", "label", "v", "low", "high"])

    return queries.mapInArrow(run, QUERY)


def windows_of(batch: pa.RecordBatch, place: int) -> np.ndarray:
    column = batch.column(place)
    return column.flatten().to_numpy().reshape(len(column), -1)


def routed(tree: Tree, queries: DataFrame) -> DataFrame:
    """Each query once for every leaf that remains for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2), tree.dim, tree.kind)
            for leaf, at in tree.remaining(v, windows_of(batch, 3), windows_of(batch, 4)):
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), leaf, np.int32))],
                                                 [*batch.schema.names, "leaf"])

    return queries.mapInArrow(run, QUERY + ", leaf int")


def search(tree: Tree, placed: DataFrame, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """vec_id, window, found_id, score, rank: each query's first k rows in each of its score windows.

    `queries` has the columns of QUERY, with as many windows in every row; rows of the same label
    (`same`) or of other labels answer, never the query's own row. Higher scores come first, then smaller ids.
    """
    sizes = placed.groupBy("leaf").count().withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int"))
    sizes = F.broadcast(materialize(sizes.select("leaf", "chunks"), "leaf-sizes"))  # at most a row per sampled row
    none = F.lit(None)
    held = placed.join(sizes, "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("query"), "vec_id", "label", "v",
        none.cast("array<bigint>").alias("low"), none.cast("array<bigint>").alias("high"))
    asked = routed(tree, narrowed(tree, queries, same, k)).join(sizes, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("query"), "vec_id", "label",
        "v", "low", "high")
    met = held.unionByName(asked).repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "query", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            leaf, chunk, query = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(chunk) != 0) | (np.diff(query) != 0)) + 1
            for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(leaf)]):
                part = batch.slice(i, j - i)
                if now != (leaf[i], chunk[i]):
                    now, parts, block = (leaf[i], chunk[i]), [], None
                v = matrix(part.column(5), tree.dim, tree.kind)
                if not query[i]:
                    parts.append((part.column(3).to_numpy(), part.column(4).to_numpy(), v))
                elif parts:
                    if block is None:
                        block = tuple(np.concatenate(x) for x in zip(*parts))
                    for a in range(0, j - i, 512):
                        few = part.slice(a, 512)
                        yield answers(few, v[a:a + 512], block, same, k)

    found = met.mapInArrow(run, "vec_id bigint, window int, found_id bigint, score bigint")
    order = Window.partitionBy("vec_id", "window").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def answers(part: pa.RecordBatch, v: np.ndarray, block: tuple, same: bool, k: int) -> pa.RecordBatch:
    """The k first rows of one chunk for each query and window."""
    ids, labels, low, high = part.column(3).to_numpy(), part.column(4).to_numpy(), windows_of(part, 6), windows_of(part, 7)
    s = v @ block[2].T
    fits = ((labels[:, None] == block[1]) == same) & (ids[:, None] != block[0])
    q, x = np.nonzero(fits & (s >= low.min(axis=1)[:, None]) & (s <= high.max(axis=1)[:, None]))
    score, out = s[q, x].astype(np.int64), []
    order = np.lexsort((block[0][x], -score, q))
    q, x, score = q[order], x[order], score[order]
    for w in range(low.shape[1]):
        inside = np.flatnonzero((score >= low[q, w]) & (score <= high[q, w]))
        mine = q[inside]
        place = np.arange(len(mine)) - np.searchsorted(mine, mine)
        keep = inside[place < k]
        out.append((ids[q[keep]], np.full(len(keep), w, np.int32), block[0][x[keep]], score[keep]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["vec_id", "window", "found_id", "score"])


OUTPUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         sample_rows: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has vec_id, label and embedding with integer components; scores are exact inner products. An
    anchor's positives are its first rows of the same label; for each of them come the first rows of other
    labels whose score is `low` to `high` per cent of the positive's. Higher scores come first, ties by
    smaller vec_id. Rows with a null id, label, vector or component take no part; of rows that share an id
    the one with the smallest label, then vector, counts; shorter vectors are filled up with zeros, so that an
    empty one scores 0; other columns are ignored; no rows or no anchors give no rows. A squared length over 2**53 is an
    error.
    """
    built = build(rows, sample_rows)
    if built is None:
        return rows.sparkSession.createDataFrame([], OUTPUT)
    tree, placed = built
    bound = lambda x: F.array(F.lit(x).cast("long"))
    anchors = materialize(placed.filter(is_anchor).select("vec_id", "label", "v", bound(-NO_BOUND).alias("low"), bound(NO_BOUND).alias("high")), "anchors")
    best = materialize(search(tree, placed, anchors, True, positives), "positives")
    # one window per positive, none (low over high) where an anchor has fewer
    window = F.array_sort(F.collect_list(F.struct("rank", "score")))
    asked = anchors.select("vec_id", "label", "v").join(best.groupBy("vec_id").agg(window.alias("p")), "vec_id")
    # score * low <= 100 * negative <= score * high, in whole numbers
    ends = [(F.expr(f"-((-get(p, {i}).score * {low} - pmod(-get(p, {i}).score * {low}, 100)) div 100)"),
             F.expr(f"(get(p, {i}).score * {high} - pmod(get(p, {i}).score * {high}, 100)) div 100")) for i in range(positives)]
    asked = asked.select("vec_id", "label", "v",
                         F.array(*[F.coalesce(lo, F.lit(1)).cast("long") for lo, _ in ends]).alias("low"),
                         F.array(*[F.coalesce(hi, F.lit(0)).cast("long") for _, hi in ends]).alias("high"))
    found = search(tree, placed, materialize(asked, "windows"), False, negatives)
    pairs = best.select(F.col("vec_id").alias("anchor_id"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"),
                        (F.col("rank") - 1).alias("window"))
    return found.select(F.col("vec_id").alias("anchor_id"), "window", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
                        F.col("score").alias("negative_score")).join(pairs, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
