"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, exact cosines.

A hash turns a vector by three rounds of random signs and the fast Walsh-Hadamard transform and takes its nearest signed axis; a table
joins K hashes, K growing with the logarithm of the table so that unlike vectors stay about one to a bucket, and the number of tables
follows from K for a recall of 1 - MISS at the threshold. Each vector lies in its own bucket of a table and in the K buckets in which one
hash takes its second nearest axis. Pairs in a bucket, one of them at home there, are compared by cosine in double precision inside the task
that holds the bucket, and none leaves it: a pair is counted in the least of all buckets in which it meets, which both vectors'
keys tell, and each task puts out a count and one spanning link per vector. Equal vectors are one node with a weight. A bucket of
more than BLOCK vectors is dealt over pairs of blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths do not link; a null id counts as the smallest; rows that repeat id and vector are one vector and get the same answer; an empty
table gives no rows; other columns are not read.
"""
from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, drop, store, with_columns
from .links import shared
from .textarrays import mix

COSINE, BLOCK, MISS = 0.95, 1024, 1e-5
#: Shares of pairs at cosine 0.95 that agree in a hash, and in its first or the other's second axis, up to 64 dimensions; wider ones are simulated.
FIRST, SECOND = 0.60, 0.87
NO_ID = -(1 << 63)
_L = T.LongType()


@functools.cache
def agreement(width: int) -> tuple[float, float]:
    """FIRST and SECOND at a width: of seeded pairs at the threshold, less two standard errors."""
    if width <= 64:
        return FIRST, SECOND
    random, pairs, first, second = np.random.default_rng(width), 20_000, 0, 0
    at_once = max(1, (1 << 21) // width)
    for at in range(0, pairs, at_once):
        # in random directions, rotated ones are as good as normal ones
        x, z = random.normal(size=(2, min(at_once, pairs - at), width))
        y = COSINE * x + math.sqrt(1 - COSINE ** 2) * z
        ax, ay = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1)
        row = np.arange(len(x))
        same = (ax == ay) & (x[row, ax] * y[row, ay] > 0)
        rest = np.abs(y)
        rest[row, ay] = -1
        by = rest.argmax(axis=1)
        back = np.abs(x)
        back[row, ax] = -1
        bx = back.argmax(axis=1)
        near = (ax == by) & (x[row, ax] * y[row, by] > 0) | (bx == ay) & (x[row, bx] * y[row, ay] > 0)
        first, second = first + int(same.sum()), second + int((same | near).sum())
    low = lambda n: n / pairs - 2 * math.sqrt(n / pairs * (1 - n / pairs) / pairs)
    return min(FIRST, low(first)), min(SECOND, low(second))


def tables(hashes: int, miss: float = MISS, width: int = 64) -> int:
    """How many tables of so many hashes at a width lose no more than ``miss`` of the pairs at the threshold."""
    first, second = agreement(width)
    meet = first ** hashes + hashes * first ** (hashes - 1) * (second - first)
    return math.ceil(math.log(miss) / math.log(1 - meet))


def _rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of signs and Walsh-Hadamard transform of rows whose length is a power of two."""
    n = x.shape[1]
    for turn in range(3):
        x = x * np.where(mix(np.arange(n, dtype=np.uint64), seed * 3 + turn) & np.uint64(1), 1.0, -1.0)
        step = 1
        while step < n:
            y = x.reshape(len(x), -1, 2, step)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
            step *= 2
        x = x / math.sqrt(n)
    return x


def codes(unit: np.ndarray, hashes: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each row in each table (rows x count), and its further buckets (rows x count x hashes)."""
    n, d = unit.shape
    width = 1 << max(1, math.ceil(math.log2(d)))
    x = np.zeros((n, width))
    x[:, :d] = unit
    home, probes = np.empty((n, count), np.uint64), np.empty((n, count, hashes), np.uint64)
    row = np.arange(n)
    for t in range(count):
        one, two = [], []
        for k in range(hashes):
            y = _rotated(x, t * hashes + k + 1)
            size = np.abs(y)
            a = size.argmax(axis=1)
            size[row, a] = -1
            b = size.argmax(axis=1)
            one.append(a * 2 + (y[row, a] < 0))
            two.append(b * 2 + (y[row, b] < 0))
        base = 2 * width + 1
        salt = (t * 1_000_003 + d) << 20

        def key(parts):
            out = np.full(n, salt, np.uint64)
            for p in parts:
                out = mix(out * np.uint64(base) + p.astype(np.uint64), t)
            return out

        home[:, t] = key(one)
        for k in range(hashes):
            probes[:, t, k] = key([*one[:k], two[k], *one[k + 1:]])
    return home, probes


def _coded(classes: DataFrame, hashes: int, count: int) -> DataFrame:
    schema = T.StructType([classes.schema["node"], classes.schema["weight"], T.StructField("vec", T.ArrayType(T.DoubleType())),
                           T.StructField("home", T.ArrayType(_L)), T.StructField("probes", T.ArrayType(_L))])

    def flat(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]).astype(np.int32)), pa.array(a.ravel()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                part = whole.slice(at, 2048)
                lengths = part.column("vec").value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(lengths):
                    batch = part.take(pa.array(np.flatnonzero(lengths == d)))
                    x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    top = np.abs(x).max(axis=1, keepdims=True)  # large components must not overflow when squared
                    unit = x / top / np.linalg.norm(x / top, axis=1, keepdims=True)
                    home, probes = codes(unit, hashes, count)
                    yield with_columns(batch, schema, {"node": batch.column("node"), "weight": batch.column("weight"), "vec": flat(unit),
                                                       "home": flat(home.view(np.int64)), "probes": flat(probes.reshape(len(x), -1).view(np.int64))})
    return classes.mapInArrow(work, schema)


def _bucket(key: int, x: np.ndarray, home: np.ndarray, probes: np.ndarray, weight: np.ndarray, block: np.ndarray, within: bool, cosine: float):
    """Weighted links of each row counted in this bucket, and for each row the first row it hangs together with here."""
    n = len(x)
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tables_, per = home.shape[1], probes.shape[1] // home.shape[1]
    at_home = (home == key).any(axis=1)
    p = probes.reshape(n, tables_, per)
    top = np.iinfo(np.int64).max
    for low in range(0, n, 64):
        rows = np.arange(low, min(low + 64, n))
        close = x[rows] @ x.T >= cosine
        close &= np.arange(n)[None, :] > rows[:, None]
        close &= at_home[rows][:, None] | at_home[None, :]
        if not within:
            close &= block[rows][:, None] != block[None, :]
        i, j = np.nonzero(close)
        i += low
        for cut in range(0, len(i), 8192):
            a, b = i[cut:cut + 8192], j[cut:cut + 8192]
            ha, hb = home[a], home[b]
            same = ha == hb
            least = np.minimum(np.where(same | (p[b] == ha[:, :, None]).any(axis=2), ha, top), np.where(same | (p[a] == hb[:, :, None]).any(axis=2), hb, top)).min(axis=1)
            mine = least == key
            a, b = a[mine], b[mine]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            for u, v in zip(a.tolist(), b.tolist()):
                u, v = find(u), find(v)
                if u != v:
                    root[max(u, v)] = min(u, v)
    return links, np.array([find(i) for i in range(n)])


def _counted(rows: DataFrame, cosine: float) -> DataFrame:
    node = rows.schema["node"].dataType
    schema = T.StructType([T.StructField("node", node), T.StructField("links", _L), T.StructField("root", node)])
    names = ("node", "weight", "vec", "home", "probes", "block")

    def emit(key, group):
        key, low, high = key
        part = pa.concat_tables(group).combine_chunks()
        column = {n: part.column(n).combine_chunks() if part.column(n).num_chunks != 1 else part.column(n).chunk(0) for n in names}
        matrix = {n: column[n].flatten().to_numpy().reshape(part.num_rows, -1) for n in ("vec", "home", "probes")}
        links, root = _bucket(key, matrix["vec"], matrix["home"], matrix["probes"], column["weight"].to_numpy(), column["block"].to_numpy(), low == high, cosine)
        some = pa.array(np.flatnonzero(links))
        return with_columns(None, schema, {"node": column["node"].take(some), "links": links[links > 0], "root": column["node"].take(pa.array(root[links > 0]))})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[a].tolist())
                if key != held:
                    if group:
                        yield emit(held, group)
                    held, group = key, []
                group.append(pa.Table.from_batches([batch.slice(a, b - a).select(list(names))]))
        if group:
            yield emit(held, group)
    return rows.mapInArrow(work, schema)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, miss: float = MISS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    sound = (F.coalesce(F.size("vec"), F.lit(0)) > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("c", F.when(sound, F.xxhash64("vec"))).withColumn("c2", F.when(sound, F.xxhash64(F.lit(1), "vec")))
    classes, _ = store(rows.filter("c is not null").groupBy("c", "c2").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("weight"), F.first("vec").alias("vec"))
                       .select(F.struct("id", "c", "c2").alias("node"), "weight", "vec"))
    total = max(classes.count(), 1)
    axes = 2 * (1 << max(1, math.ceil(math.log2(max(classes.agg(F.max(F.size("vec"))).first()[0] or 2, 2)))))
    hashes = max(1, round(math.log(total) / math.log(axes)))
    coded, coded_path = store(_coded(classes, hashes, tables(hashes, miss, axes // 2)))
    keys, keys_path = shared(coded.select("node", F.explode(F.concat("home", "probes")).alias("key")))
    homes = coded.select(F.explode("home").alias("key")).distinct()
    sizes, sizes_path = store(keys.groupBy("key").agg(F.count("*").alias("n")).join(homes, "key", "left_semi"))
    block_no = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")
    dealt = keys.join(sizes.select("key", F.ceil(F.col("n") / block).cast("long").alias("blocks")), "key").withColumn("block", block_no)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    parts = dealt.join(coded, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    counted, counted_path = store(_counted(parts.select("key", "low", "high", "node", "weight", "vec", "home", "probes", "block"), cosine))
    drop(spark, coded_path, keys_path, sizes_path)
    linked = counted.groupBy("node").agg(F.sum("links").alias("links"))
    groups, paths = components(linked.select("node"), counted.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named, _ = store(classes.select("node", "weight").join(linked, "node", "left").join(groups, "node", "left").select(
        F.col("node.c").alias("c"), F.col("node.c2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component.id", "node.id").alias("component_id")))
    drop(spark, counted_path, *paths)
    out = rows.select("vec_id", "c", "c2").join(named, ["c", "c2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                                                                 F.coalesce("component_id", "vec_id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(real("vec_id"), "n_links", real("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))
