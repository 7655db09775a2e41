"""Hard negatives from STR-packed R-trees searched best-first by integer inner products.

Rows are dealt by ranges of (width, label, widest coordinate, id) into cells of bounded size, so equal vectors are split by their ids and a large
label lies in many cells. A task packs what it reads: rows of a label are sorted and tiled along their coordinates, the one that
varies most first, into leaves, and the leaves, in this order, into nodes. Every node keeps the least and the greatest value of each
coordinate, between which the inner product with a query lies: the interval's ends are sums of the better and of the worse end of each
coordinate's. A queue takes the node with the greatest upper end first. A node is left out where its interval misses the score windows
that are open, or its upper end is strictly below the last of a full list; on a tie a smaller id can still enter.

Queries (anchors) go in blocks to the cells: first to those that hold their label, for positives, then to all, for negatives in the windows of
their positives. Each meeting of a block and a cell gives at most ``k`` rows for each list, and these are ranked together, so the result is that of
comparing every anchor with every row. What is shuffled is the table once for each block, and the anchors once for each cell.

Defined results: rows with a null label or vector, an empty vector, or a null or non-finite component take no part; vectors of different lengths are not
compared; other rows are rows with another id; rows that repeat id, label and vector count once; a null id counts as the smallest and is given back as null;
an anchor without positives or a positive without negatives has no rows; equal positives have equal lists; components beyond 64 bits when they are scaled, and
scores beyond 64 bits, count as the nearest number within; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, store, with_columns

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
LEAF, FANOUT = 128, 16
CELL_ROWS, CELL_BYTES, BLOCK_ROWS = 1 << 16, 1 << 25, 1 << 14
SAMPLE = 20_000  # rows, by least hash, whose spread picks the coordinate that cells are cut by
NO_ID = -(1 << 63)
TOP = (1 << 63) - 1
EXACT = 1 << 53  # whole numbers below this are exact in double precision
_L = T.LongType()
_LEAVES = "cell long, label string, width int, ids array<long>, vectors array<long>, low array<long>, high array<long>"


def scaled(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id``, ``label``, ``q`` of the rows that take part: components times ``scale``, rounded down."""
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("label").isNotNull() & (F.coalesce(F.size("v"), F.lit(0)) > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(sound).select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("q"))


def tiled(x: np.ndarray, ids: np.ndarray, axes: list[int], leaf: int = LEAF) -> np.ndarray:
    """The order of rows whose consecutive runs of ``leaf`` are tiles: slabs along the first axis, each tiled along the others."""
    n = len(x)
    if n <= leaf or not axes:
        return np.arange(n)
    leaves = math.ceil(n / leaf)
    slabs = max(2, math.ceil(leaves ** (1 / len(axes)) - 1e-9))
    size = math.ceil(leaves / slabs) * leaf
    order = np.lexsort((ids, x[:, axes[0]]))
    return np.concatenate([part[tiled(x[part], ids[part], axes[1:], leaf)] for part in (order[a:a + size] for a in range(0, n, size))])


def packed(rows: DataFrame, cells: int, axis: Column) -> DataFrame:
    """Leaves of the rows (vec_id, label, q), in tiling order within a cell and a label."""
    schema = T.StructType.fromDDL(_LEAVES)
    arrow_batch = 256

    def leaves(cell, label, ids, x):
        once = np.ones(len(ids), bool)  # repeats lie side by side
        once[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
        ids, x = ids[once], x[once]
        some = max(1, math.ceil(len(ids) / LEAF)).bit_length()
        axes = np.argsort(-x.astype(np.float64).var(axis=0), kind="stable")[:some].tolist()
        order = tiled(x, ids, axes)
        for at in range(0, len(order), LEAF):
            part = order[at:at + LEAF]
            yield cell, label, x.shape[1], ids[part], x[part].ravel(), x[part].min(axis=0), x[part].max(axis=0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        cell, held, waiting, most, last = TaskContext.get().partitionId() % cells, None, [], 0, None

        def out(found):
            found = list(found)
            for at in range(0, len(found), arrow_batch):
                columns = zip(*found[at:at + arrow_batch])
                yield with_columns(None, schema, {f.name: pa.array(list(c), f.type) for f, c in zip(_arrow(schema), columns)})

        def built():
            label, _ = held
            return out(leaves(cell, label, np.concatenate([i for i, _ in waiting]), np.concatenate([x for _, x in waiting])))

        for batch in batches:
            labels, widths = np.array(batch.column("label").to_pylist(), object), batch.column("q").value_lengths().to_numpy()
            ids, flat = batch.column("vec_id").to_numpy(), batch.column("q").flatten().to_numpy()
            ends = np.append(0, np.cumsum(widths))
            cuts = [0, *(np.flatnonzero((labels[1:] != labels[:-1]) | (widths[1:] != widths[:-1])) + 1).tolist(), len(ids)] if len(ids) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if (labels[a], widths[a]) != held or most >= CELL_ROWS:
                    if waiting:
                        yield from built()
                    last = (waiting[-1][0][-1], waiting[-1][1][-1]) if (labels[a], widths[a]) == held else None
                    held, waiting, most = (labels[a], widths[a]), [], 0
                x = flat[ends[a]:ends[b]].reshape(b - a, -1)
                while last is not None and a < b and ids[a] == last[0] and (x[0] == last[1]).all():  # repeats on both sides of a cut
                    a, x = a + 1, x[1:]
                if a < b:
                    waiting.append((ids[a:b], x))
                    most += b - a
                    last = None
        if waiting:
            yield from built()
    size, order = F.size("q"), F.xxhash64("q")
    dealt = rows.repartitionByRange(cells, size, "label", axis, "vec_id", order).sortWithinPartitions(size, "label", axis, "vec_id", order)
    return dealt.mapInArrow(work, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


class Tree:
    """The nodes over the leaves of one label in a cell: boxes level by level, leaves first."""

    def __init__(self, label: str, ids: list[np.ndarray], vectors: list[np.ndarray], low: np.ndarray, high: np.ndarray):
        self.label, self.ids, self.vectors = label, ids, vectors
        lows, highs, self.children = [low], [high], [None] * len(low)
        first, n = 0, len(low)
        while n > 1:
            cuts = np.arange(0, n, FANOUT)
            lows.append(np.minimum.reduceat(lows[-1], cuts, axis=0))
            highs.append(np.maximum.reduceat(highs[-1], cuts, axis=0))
            self.children += [range(first + a, first + min(a + FANOUT, n)) for a in cuts.tolist()]
            first, n = first + n, len(cuts)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.size = max(int(np.abs(self.low.astype(np.float64)).max()), int(np.abs(self.high.astype(np.float64)).max()))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of every node's inner products with every row of ``q`` (doubles that are whole)."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        low, high = self.low.astype(np.float64), self.high.astype(np.float64)
        return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Lists:
    """The best ``k`` of (score, id) in each of some score windows."""

    def __init__(self, windows: list[tuple[int, int]], k: int):
        self.low, self.high = [w[0] for w in windows], [w[1] for w in windows]
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64) for _ in windows], [np.zeros(0, np.int64) for _ in windows]
        self.floor = list(self.low)  # what can still enter a list scores this at least
        self.least, self.most = min(self.floor), max(self.high)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.max() < self.least or scores.min() > self.most:
            return
        for w, floor in enumerate(self.floor):
            fit = np.flatnonzero((scores >= floor) & (scores <= self.high[w]))
            if not len(fit):
                continue
            s, i = np.append(self.scores[w], scores[fit]), np.append(self.ids[w], ids[fit])
            best = np.lexsort((i, -s))[:self.k]
            self.scores[w], self.ids[w] = s[best], i[best]
            if len(best) == self.k:
                self.floor[w] = int(self.scores[w][-1])
        self.least = min(self.floor)

    def misses(self, lower: float, upper: float) -> bool:
        return all(upper < floor or lower > high for floor, high in zip(self.floor, self.high))


def search(trees: list[Tree], q: np.ndarray, own: int, lists: Lists, bounds: list[tuple[np.ndarray, np.ndarray]] | None) -> None:
    """Fill the lists from the trees; without bounds (numbers too large for them) all leaves are read, in whole numbers of any size."""
    if bounds is None:
        whole = [int(x) for x in q]
        for tree in trees:
            for ids, x in zip(tree.ids, tree.vectors):
                scores = np.array([max(-TOP, min(TOP, sum(a * b for a, b in zip(row, whole)))) for row in x.astype(np.int64).tolist()], np.int64)
                lists_take(lists, scores, ids, own)
        return
    doubles = q.astype(np.float64)
    queue = [(-float(high[-1]), t, len(high) - 1) for t, (_, high) in enumerate(bounds)]
    heapq.heapify(queue)
    while queue:
        best, t, node = heapq.heappop(queue)
        if -best < lists.least:
            break
        low, high = bounds[t]
        if lists.misses(low[node], high[node]):
            continue
        tree, below = trees[t], trees[t].children[node]
        if below is None:
            lists_take(lists, (tree.vectors[node] @ doubles).astype(np.int64), tree.ids[node], own)
            continue
        for child in below:
            if high[child] >= lists.least and low[child] <= lists.most:
                heapq.heappush(queue, (-float(high[child]), t, child))


def lists_take(lists: Lists, scores: np.ndarray, ids: np.ndarray, own: int) -> None:
    if own in ids:
        scores, ids = scores[ids != own], ids[ids != own]
    if len(ids):
        lists.take(scores, ids)


def _windows(scores: list[int] | None, low: int, high: int) -> list[tuple[int, int]]:
    """From low % of each score, rounded up, to high % of it, rounded down; without scores everything."""
    return [(-TOP - 1, TOP)] if scores is None else [(-(-low * s // 100), high * s // 100) for s in scores]


def _met(asks: DataFrame, leaves: DataFrame, parts: int, same: bool, k: int, low: int, high: int) -> DataFrame:
    """``ask``, ``list``, ``score``, ``vec_id``: the best k for each ask and list in each meeting of a block and a cell."""
    schema = T.StructType.fromDDL("ask long, list int, score long, vec_id long")

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held = asked.combine_chunks(), held.combine_chunks()
        rows = {n: [] for n in schema.names}
        by_tree: dict = {}
        for label, width, ids, x, lo, hi in zip(*[held.column(c).to_pylist() for c in ("label", "width")], *[_arrays(held.column(c)) for c in ("ids", "vectors", "low", "high")]):
            by_tree.setdefault((width, label), []).append((ids, x.reshape(-1, width), lo, hi))
        trees: dict = {}
        for (width, label), of in by_tree.items():
            tree = Tree(label, [i for i, *_ in of], [x for _, x, _, _ in of], np.stack([lo for *_, lo, _ in of]), np.stack([hi for *_, hi in of]))
            if tree.size * tree.size * width < EXACT:
                tree.vectors = [x.astype(np.float64) for x in tree.vectors]
            trees.setdefault(width, []).append(tree)
        q_all, names = _arrays(asked.column("q")), asked.column("label").to_pylist()
        keys, own = asked.column("ask").to_pylist(), asked.column("vec_id").to_pylist()
        scores = asked.column("scores").to_pylist()
        order = sorted(range(len(keys)), key=lambda n: (len(q_all[n]), names[n]))
        at = 0
        while at < len(order):  # a run of asks of one width and label, for which the same trees count
            width, label = len(q_all[order[at]]), names[order[at]]
            run = [n for n in order[at:at + 512] if len(q_all[n]) == width and names[n] == label]
            at += len(run)
            of = [t for t in trees.get(width, ()) if (t.label == label) == same]
            if not of:
                continue
            q = np.stack([q_all[n] for n in run])
            size = max(int(np.abs(q.astype(np.float64)).max()), max(t.size for t in of))
            exact = size * size * width < EXACT
            bounds = [t.bounds(q.astype(np.float64)) for t in of] if exact else None
            for r, n in enumerate(run):
                windows = _windows(scores[n], low, high)
                different = sorted({w for w in windows if w[0] <= w[1]})
                if not different:
                    continue
                lists = Lists(different, k)
                search(of, q_all[n], own[n], lists, [(lo[r], hi[r]) for lo, hi in bounds] if exact else None)
                for w, window in enumerate(windows):
                    if window not in different:
                        continue
                    d = different.index(window)
                    found = len(lists.ids[d])
                    rows["ask"] += [keys[n]] * found
                    rows["list"] += [w] * found
                    rows["score"] += lists.scores[d].tolist()
                    rows["vec_id"] += lists.ids[d].tolist()
        return pa.table({f.name: pa.array(rows[f.name], f.type) for f in _arrow(schema)})

    both = asks.repartition(parts, "cell", "block").groupBy("cell", "block"), leaves.repartition(parts, "cell", "block").groupBy("cell", "block")
    return both[0].cogroup(both[1]).applyInArrow(work, schema)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask", "list").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id",
         label_col: str = "label", vector_col: str = "embedding", cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``; ``anchor`` says of ``vec_id`` which rows are anchors."""
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, label_col, vector_col, scale)
    total, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    within = max(1, min(cell_rows, CELL_BYTES // (8 * (width or 1))))
    cells = max(1, math.ceil(total / within), min(parallel, math.ceil(total / 1024)))
    sample = rows.orderBy(F.xxhash64("q", "vec_id")).limit(SAMPLE).select(F.size("q").alias("width"), F.posexplode("q").alias("at", "x"))
    spread = sample.groupBy("width", "at").agg(F.var_pop("x").alias("var"), F.count("*").alias("n")).groupBy("width").agg(F.max("n").alias("n"), F.max_by("at", F.struct("var", -F.col("at"))).alias("at"))
    axis = F.lit(0)
    for r in spread.orderBy(F.desc("n"), "width").limit(16).collect():
        axis = F.when(F.size("q") == r.width, F.lit(r.at)).otherwise(axis)
    leaves, leaves_path = store(packed(rows, cells, F.get("q", axis)))

    chosen = rows.filter((F.col("vec_id") != NO_ID) & anchor).distinct().withColumn("ask", F.monotonically_increasing_id())
    chosen, chosen_path = store(chosen)
    blocks = max(1, math.ceil(chosen.count() / block_rows))
    asks = chosen.withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks)))
    parts = max(1, min(cells * blocks, 20_000))
    spread_leaves = leaves.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    none = F.lit(None).cast("array<long>").alias("scores")
    where = leaves.select("label", F.col("cell").alias("place")).distinct().withColumnRenamed("place", "cell")
    near = _met(asks.join(where, "label").select("cell", "block", "ask", "vec_id", "label", "q", none), spread_leaves, parts, True, positives, low, high)
    good, good_path = store(_best(near, positives).select("ask", (F.col("rank") - 1).alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    of_ask = good.groupBy("ask").agg(F.transform(F.sort_array(F.collect_list(F.struct("list", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    open_ = asks.join(of_ask, "ask").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    far = _met(open_.select("cell", "block", "ask", "vec_id", "label", "q", "scores"), spread_leaves, parts, False, negatives, low, high)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    hard = _best(far, negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    named = hard.join(good, ["ask", "list"]).join(chosen.select("ask", F.col("vec_id").alias("anchor_id")), "ask")
    out, _ = store(named.select("anchor_id", real("positive_id").alias("positive_id"), "rank", real("negative_id").alias("negative_id"), "positive_score", "negative_score"))
    drop(spark, leaves_path, chosen_path, good_path)
    return out
