"""Connected groups of similar sets from banded buckets, without a pair for every two members of a bucket.

1. Nodes that share a bucket, directly or through others, form a cluster; a link can only lie within one.
2. Each node is checked with the least node of each of its buckets, which joins most of a bucket of near copies at once.
3. Where a cluster still falls into several groups, every node outside its largest group is compared with every node of
   the cluster, inside tasks that hold one block of either and put out spanning links only.

Links within the largest group join nothing new, so the groups are those of comparing all pairs of a cluster.

Where buckets meet by chance often (short texts), clusters grow far beyond them, and step 3 takes each bucket of up to ``PAIRED`` nodes by itself (``in_buckets``): of one whose nodes,
but for the least, still fall into several groups, those outside the largest are compared with all. Larger buckets, which copies of a text share many of, form clusters as before.
The groups are those of comparing all pairs of a bucket. Chance meetings grow with the square of the nodes, so ``narrowed`` takes them out of such buckets before any text
travels: it bounds the similarity of two nodes by sketches of some bytes each (exact: no link is lost).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, drop, store, with_columns
from .textarrays import mix

BLOCK = 512
#: Sets of hashes: where each begins (one more entry than sets), and the values, distinct within a set.
Sets = tuple[np.ndarray, np.ndarray]


def shared(rows: DataFrame) -> tuple[DataFrame, str]:
    """The ``rows(key, node)`` whose key has another row, stored. The keys are written first, so that a key with very many rows
    joins between two plain shuffles, which Spark can split."""
    keys, path = store(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    out, out_path = store(rows.join(keys, "key"))
    drop(rows.sparkSession, path)
    return out, out_path


#: Pairs of key and node sorted at once (in a task); nodes whose keys go to one bucket of keys; times that a key is met at once and its pairs are dealt evenly.
SORTED, NODES, OFTEN = 1 << 19, 50_000, 8
_LISTS = ("keys", "nodes", "known", "sure_keys", "sure_nodes")


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """64-bit numbers as binary values, one for each ``values[cuts[i]:cuts[i+1]]``."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def packed_rows(rows: np.ndarray) -> pa.Array:
    """The rows of a table of bytes as binary values."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binary values, and how many each has."""
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[cuts[0]:cuts[-1]].copy().view(np.uint64), np.diff(cuts) // 8


def _dealt_keys(held: list[tuple[np.ndarray, np.ndarray]], buckets: int, schema: T.StructType) -> pa.RecordBatch:
    """A row for each bucket of keys: keys met less than OFTEN times here and their nodes, keys met more often, and an even share of the pairs of the latter."""
    key, node = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(key)
    key, node = key[order], node[order]
    first = np.append(True, key[1:] != key[:-1])
    times = np.diff(np.append(np.flatnonzero(first), len(key)))
    alone = np.repeat(times < OFTEN, times)
    edges = (np.arange(1, buckets, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets) << np.uint64(32)

    def between(keys):
        return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
    once, known = key[alone], key[first & ~alone]
    even = np.arange(buckets + 1) * int((~alone).sum()) // buckets
    return with_columns(None, schema, {"bucket": np.arange(buckets, dtype=np.int32), "keys": packed(once, between(once)), "nodes": packed(node[alone], between(once)),
                                       "known": packed(known, between(known)), "sure_keys": packed(key[~alone], even), "sure_nodes": packed(node[~alone], even)})


def shared_keys(rows: DataFrame) -> tuple[DataFrame, str]:
    """``key``, ``node`` of ``rows(node, keys)`` (``packed``), for keys that are there more than once, stored; nodes are numbers. Keys travel in lists, by
    their range, and are sorted where they arrive. A key that a task meets OFTEN is shared: only its name goes to its range, and
    the pairs are dealt evenly, so a key with very many nodes stays small there. ``many`` has the rows of a key, 0 for those."""
    spark = rows.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // NODES)
    dealt = T.StructType([T.StructField("bucket", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in _LISTS])
    pairs = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("many", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            keys, many = unpacked(batch.column("keys"))
            held.append((keys, np.repeat(batch.column("node").to_numpy(), many)))
            n += len(held[-1][0])
            if n >= SORTED:
                yield _dealt_keys(held, buckets, dealt)
                held, n = [], 0
        if n:
            yield _dealt_keys(held, buckets, dealt)

    def met(held: list[dict]) -> pa.RecordBatch:
        keys, nodes, known, sure_keys, sure_nodes = (np.concatenate([x[c] for x in held]) for c in _LISTS)
        whole = np.concatenate((keys, known))
        order = np.argsort(whole)
        of = np.cumsum(np.append(False, whole[order[1:]] != whole[order[:-1]]))[:len(order)]
        real = order < len(keys)
        many, often = np.bincount(of[real], minlength=len(order) + 1)[of], np.bincount(of[~real], minlength=len(order) + 1)[of] > 0
        out = real & (often | (many > 1))
        at, many = order[out], np.where(often, 0, many)[out]
        return with_columns(None, pairs, {"key": np.concatenate((keys[at], sure_keys)).view(np.int64), "node": np.concatenate((nodes[at], sure_nodes)).view(np.int64),
                                          "many": np.concatenate((many, np.zeros(len(sure_keys), np.int64)))})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for i, b in enumerate(batch.column("bucket").to_pylist()):
                if held and b != bucket:
                    yield met(held)
                    held = []
                held.append({c: unpacked(batch.column(c).slice(i, 1))[0] for c in _LISTS})
                bucket = b
        if held:
            yield met(held)
    return store(rows.mapInArrow(deal, dealt).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, pairs))


def _groups(links: DataFrame) -> tuple[DataFrame, list[str]]:
    return components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links)


def _common(x: Sets, y: Sets) -> np.ndarray:
    """Size of the overlap of each pair of sets."""
    n = len(x[0]) - 1
    owner = np.concatenate([np.repeat(np.arange(n), np.diff(s[0])) for s in (x, y)])
    values = np.concatenate((x[1], y[1]))
    if n < 1 << 16 and len(values) and values.dtype == np.uint64 and int(values.max()) < 1 << 48:  # owner and value in one number sort at once
        both = owner.astype(np.uint64) << np.uint64(48) | values
        both.sort(kind="stable")  # two sorted runs, if sets are
        return np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(48)).astype(np.int64), minlength=n)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    return np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (values[1:] == values[:-1])], minlength=n)


def _take(sets: Sets, rows: np.ndarray) -> Sets:
    """The sets of some rows."""
    offsets, values = sets
    size = np.diff(offsets)[rows]
    ends = np.append(0, np.cumsum(size))
    return ends, values[np.repeat(offsets[:-1][rows] - ends[:-1], size) + np.arange(int(ends[-1]))]


PLACES, SKETCH = 256, 65  # ranges of counts; bytes of a sketch


def _counts(sets: Sets) -> np.ndarray | None:
    """How many values of each set fall into each of PLACES ranges of a hash; None where one has more than fit."""
    n = len(sets[0]) - 1
    at = np.repeat(np.arange(n) * PLACES, np.diff(sets[0])) + (mix(sets[1], 70) >> np.uint64(56)).astype(np.int64)
    counts = np.bincount(at, minlength=n * PLACES)
    return counts.astype(np.uint8).reshape(n, PLACES) if not len(at) or counts.max() < 256 else None


def _may_be_alike(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs whose sets can be alike: the overlap is at most the sum of the smaller counts (``sizes``: of both sets of a pair together)."""
    most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    return most >= similarity * (sizes - most)


def _alike(sets: Sets, i: np.ndarray, j: np.ndarray, similarity: float, values: int = 1 << 20) -> np.ndarray:
    """Whether the sets of each pair of rows are alike, about so many values at a time."""
    size = np.diff(sets[0])
    out = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
    left = np.flatnonzero(out)
    counts = _counts(sets) if len(left) else None
    if counts is not None:
        for part in np.array_split(left, len(left) // AT_ONCE + 1):
            out[part] = _may_be_alike(counts[i[part]], counts[j[part]], size[i[part]] + size[j[part]], similarity)
        left = np.flatnonzero(out)
    cuts = np.searchsorted(np.cumsum(size[i[left]] + size[j[left]]), np.arange(values, int((size[i[left]] + size[j[left]]).sum()) + values, values))
    for some in np.split(left, np.minimum(cuts, len(left))):
        for part in np.array_split(some, len(some) // 60_000 + 1):
            if len(part):
                common = _common(_take(sets, i[part]), _take(sets, j[part]))
                out[part] = common >= similarity * (size[i[part]] + size[j[part]] - common)
    return out


def _rows_of(column: pa.Array) -> np.ndarray:
    """Binary values of one length, as ``packed_rows`` makes them, as the rows of a table of bytes."""
    cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[cuts[0]:cuts[-1]].reshape(len(column), -1)


def sketched(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of some sets, ``count`` hashes each, repeated ones among them: the least number of distinct hashes that it has, and its sketch: how many hashes fall into
    each of PLACES // 2 ranges, rounded up to fifteen steps of a power of two, which is the first byte. Only the upper 32 bits of a hash are looked at."""
    n, half = len(count), PLACES // 2
    of = np.repeat(np.arange(n, dtype=np.uint64), count)
    bits = 32 - (n - 1).bit_length()
    tags = (of << np.uint64(bits) | hashes >> np.uint64(64 - bits)).astype(np.uint32)
    tags.sort()
    size = np.add.reduceat(np.append(True, tags[1:] != tags[:-1]), np.cumsum(count) - count, dtype=np.int64)
    held = np.bincount((of * np.uint64(half) + (hashes >> np.uint64(57))).view(np.int64), minlength=n * half).reshape(n, half).astype(np.int32)
    most, step = held.max(axis=1), np.zeros(n, np.int32)
    while (more := most > 15 << step).any():
        step += more
    steps = (-(-held >> step[:, None]) if step.any() else held).astype(np.uint8)
    out = np.empty((n, SKETCH), np.uint8)
    out[:, 0], out[:, 1:] = step, steps[:, :half // 2] | steps[:, half // 2:] << 4
    return size, out


def _most(sketches: np.ndarray) -> np.ndarray:
    """The most hashes that can fall into each range."""
    held = np.concatenate((sketches[:, 1:] & 15, sketches[:, 1:] >> 4), axis=1)
    return held.astype(np.int64) << sketches[:, :1].astype(np.int64) if sketches[:, 0].any() else held


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row reachable by pairs of ``n`` rows."""
    to = np.arange(n)
    while True:
        least, before = np.minimum(to[i], to[j]), to
        to = to.copy()
        np.minimum.at(to, i, least)
        np.minimum.at(to, j, least)
        to = to[to]
        if (to == before).all():
            return to


def narrowed(rows: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """``key``, ``node``, ``least``, ``many``, ``near`` of ``rows(key, node, many)``, for ``connect``: a row for each node of a bucket but its least. Buckets of up to PAIRED nodes are cut
    into what ``sketches(node, size, sketch)`` leave connected, named by its nodes, so that what several bands tell comes once; what is alone then goes.
    ``near`` tells nodes that can be alike with the least. Larger ones stay whole."""
    small = rows.filter(F.col("many").between(1, PAIRED))
    large = rows.filter(~F.col("many").between(1, PAIRED)).select("key", "node")
    least = large.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("many"))
    whole = large.join(least, "key").filter("node <> least").select("key", "node", "least", "many", F.lit(True).alias("near"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in whole.schema])

    def cut(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(part))))
        node, size = (part.column(c).to_numpy() for c in ("node", "size"))
        order = np.lexsort((node, of))
        node, size = node[order], size[order]
        sketch = part.column("sketch").combine_chunks()
        held = _most(_rows_of(sketch.chunk(0) if isinstance(sketch, pa.ChunkedArray) else sketch))[order]
        i, j = _pairs(starts, len(part))
        may = np.concatenate([np.zeros(0, bool), *(_may_be_alike(held[i[at:at + AT_ONCE]], held[j[at:at + AT_ONCE]], size[i[at:at + AT_ONCE]] + size[j[at:at + AT_ONCE]], similarity)
                                                   for at in range(0, len(i), AT_ONCE))])
        i, j = i[may], j[may]
        root = _joined(len(part), i, j)
        near = np.zeros(len(part), bool)
        near[j[root[j] == i]] = True
        out = np.flatnonzero(root != np.arange(len(part)))
        if not len(out):
            return None
        first, name = root[out], np.zeros(len(part), np.uint64)
        np.add.at(name, root, mix(node, 71))
        return with_columns(None, schema, {"key": mix(name[first], 72).view(np.int64), "node": node[out], "least": node[first], "many": np.bincount(root)[first], "near": near[out]})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_groups(batches, ("key",)):
            if out := cut(part, starts):
                yield out
    met = small.join(sketches, "node").select("key", "node", "size", "sketch").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(work, schema).distinct().unionByName(whole)


def similar(pairs: DataFrame, bodies: DataFrame, sets: Callable[[pa.Array], Sets], similarity: float, rows: int = 64) -> DataFrame:
    """The ``pairs(a, b)`` whose bodies' sets have a Jaccard similarity of at least ``similarity``."""
    if "n" in bodies.columns:  # sizes too far apart need no texts
        size = bodies.select("node", "n")
        pairs = (pairs.join(size.withColumnsRenamed({"node": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"node": "b", "n": "nb"}), "b")
                 .filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb")).select("a", "b"))
    text = bodies.select("node", "body")
    both = pairs.join(text.withColumnsRenamed({"node": "b", "body": "y"}), "b").join(text.withColumnsRenamed({"node": "a", "body": "x"}), "a").select("a", "b", "x", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                left = batch.column("x").dictionary_encode()  # pairs of a node come one after the other
                x, y = _take(sets(left.dictionary), left.indices.to_numpy()), sets(batch.column("y"))
                common = _common(x, y)
                yield batch.select(["a", "b"]).filter(pa.array(common >= similarity * (np.diff(x[0]) + np.diff(y[0]) - common)))
    return both.mapInArrow(work, both.select("a", "b").schema)


def _spanning(labels: np.ndarray, asking: np.ndarray, offsets: np.ndarray, values: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join groups: each row of ``asking`` against all rows. Rows are sets ``values[offsets[i]:offsets[i+1]]``."""
    n, size = len(labels), np.diff(offsets)
    token = np.unique(values, return_inverse=True)[1]
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    posting, first = owner[order], np.append(0, np.cumsum(np.bincount(token)))
    root = np.unique(labels, return_inverse=True)[1]
    links = []
    for i in asking.tolist():
        t = token[offsets[i]:offsets[i + 1]]
        counts = first[t + 1] - first[t]
        at = np.repeat(first[t] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        common = np.bincount(posting[at], minlength=n)
        for j in np.flatnonzero((common >= similarity * (size[i] + size - common)) & (root != root[i])).tolist():
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


#: Rows of a group whose pairs are listed at once (in a task); larger ones go by postings. Rows compared at a time.
PAIRED, AT_ONCE = 64, 4096


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of AT_ONCE of them or more, which groups of ``keys`` do not cross, and where groups begin."""
    def cut(held: list) -> tuple[pa.Table, np.ndarray]:
        whole = pa.Table.from_batches(held)
        key = np.stack([whole.column(c).to_numpy() for c in keys], axis=1)
        return whole, np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < AT_ONCE:
            continue
        whole, starts = cut(held)
        if len(starts) > 1:  # the last group may go on
            yield whole.slice(0, int(starts[-1])), starts[:-1]
            held = whole.slice(int(starts[-1])).to_batches()
    if held:
        yield cut(held)


def _pairs(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every two rows of a group, for groups of up to PAIRED rows; groups begin at ``starts``."""
    size = np.diff(np.append(starts, n))
    row = np.arange(n)
    after = np.where(np.repeat(size, size) <= PAIRED, np.repeat(starts + size, size) - row - 1, 0)
    i = np.repeat(row, after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def _compared(rows: DataFrame, sets: Callable[[pa.Array], Sets], similarity: float) -> DataFrame:
    """Spanning links of blocks: ``rows(cluster, ask, block, node, label, asks, body)``, one group for each (cluster, ask, block)."""
    node = rows.schema["node"].dataType
    schema = T.StructType([T.StructField("a", node), T.StructField("b", node)])
    keys = ("cluster", "ask", "block")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def found(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        column = {c: part.column(c).combine_chunks() for c in ("node", "label", "asks", "body")}
        column = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in column.items()}
        label, asks, held = column["label"].to_numpy(), column["asks"].to_numpy(zero_copy_only=False), sets(column["body"])
        ends = np.append(starts[1:], len(label))
        i, j = _pairs(starts, len(label))
        open_ = (label[i] != label[j]) & (asks[i] | asks[j])
        i, j = i[open_], j[open_]
        yes = _alike(held, i, j, similarity)
        links = [(i[yes], j[yes])]
        for low, high in zip(starts.tolist(), ends.tolist()):
            if high - low > PAIRED:
                mine = np.arange(low, high)
                spanning = _spanning(label[low:high], np.flatnonzero(asks[low:high]), *_take(held, mine), similarity)
                if spanning:
                    links.append(tuple(low + np.array(x) for x in zip(*spanning)))
        a, b = (pa.array(np.concatenate(x)) for x in zip(*links))
        return with_columns(None, schema, {"a": column["node"].take(a), "b": column["node"].take(b)}) if len(a) else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_groups(batches, keys):
            if out := found(part, starts):
                yield out
    return dealt.mapInArrow(work, schema)


def _mixed(rows: DataFrame, block: int) -> DataFrame:
    """Clusters of ``rows(cluster, node, label)`` in which there are several labels: the largest one, and numbers of blocks."""
    counts = rows.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main")).filter("n > main.n")
    return mixed.select("cluster", F.col("main.label").alias("main"), F.ceil(F.col("n") / block).alias("blocks"), F.ceil((F.col("n") - F.col("main.n")) / block).alias("asks"))


def _dealt(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of mixed clusters, each with the meetings of blocks that it takes part in."""
    spread = rows.join(mixed, "cluster").withColumn("own", F.xxhash64("node", F.lit("block")))
    zero, one = F.lit(0).cast("long"), F.col("label") != F.col("main")
    small = (F.col("blocks") == 1) & (F.col("asks") == 1)
    whole = spread.filter(small).select("cluster", zero.alias("ask"), zero.alias("block"), "node", "label", one.alias("asking"))
    every = spread.filter(~small).select("cluster", F.explode(F.sequence(zero, F.col("asks") - 1)).alias("ask"), F.pmod("own", "blocks").alias("block"), "node", "label", F.lit(False).alias("asking"))
    asking = spread.filter(~small & one).select("cluster", F.pmod("own", "asks").alias("ask"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"),
                                                "node", "label", F.lit(True).alias("asking"))
    return whole.unionByName(every).unionByName(asking).withColumnRenamed("asking", "asks")


def connect(rows: DataFrame, bodies: DataFrame, sets: Callable[[pa.Array], Sets], similarity: float, block: int = BLOCK, in_buckets: bool = False) -> DataFrame:
    """Groups ``(node, component)`` of the nodes of ``rows(key, node)``, those alone left out: nodes of a cluster are linked if
    their sets are alike. ``bodies(node, body)`` has each node's text, and if ``n``, the size of its set; texts travel, and ``sets``
    turns them into sets where they are compared. Both tables are stored ones; ``rows`` can be those of ``narrowed``."""
    spark = rows.sparkSession
    rest, rest_path, near = rows, None, F.col("near") if "near" in rows.columns else F.lit(True)
    if "least" not in rows.columns:
        least = rows.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("many"))
        rest = rows.select("key", "node").join(least, "key").filter("node <> least")
        if in_buckets:
            rest, rest_path = store(rest)
    star = [F.col("least").alias("a"), F.col("node").alias("b")]
    stars, stars_path = store(rest.filter(near).select(*star).distinct())
    large = F.col("many") > PAIRED
    clusters, cluster_paths = _groups(rest.filter(large).select(*star).distinct() if in_buckets else stars)
    links, _ = store(similar(stars, bodies, sets, similarity))
    groups, paths = _groups(links)
    named = clusters.select(F.xxhash64("component").alias("cluster"), "node")
    if in_buckets:
        named = named.unionByName(rest.filter(~large & (F.col("many") > 2)).select(F.col("key").alias("cluster"), "node"))
    named = named.join(groups, "node", "left").select("cluster", "node", F.xxhash64(F.coalesce("component", "node")).alias("label"))
    named, named_path = store(named)
    drop(spark, stars_path, *cluster_paths, *([rest_path] if rest_path else []))
    mixed, mixed_path = store(_mixed(named, block))
    dealt = _dealt(named, mixed).join(bodies.select("node", "body"), "node")
    more, _ = store(_compared(dealt, sets, similarity))
    drop(spark, named_path, mixed_path)
    if more.isEmpty():
        return groups
    drop(spark, *paths)
    return _groups(links.unionByName(more))[0]
