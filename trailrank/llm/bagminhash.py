"""Near-duplicate documents by BagMinHash: signatures of weighted sets, banding, exact multiset overlap.

A document is the multiset of its runs of SHINGLE words. A shingle of weight w owns the stretch [0, w) of a discretised weight
axis, cut into [0,1), [1,2), [2,4), [4,8), ...; on each piece runs a Poisson process of points whose rate is the piece's
length, drawn from the shingle's hash alone, so two documents see the same points wherever both weights reach. A piece that w covers in part
is halved along its points' dyadic places: points beyond w are passed over. Each point falls in one of the signature's components,
which keeps its first: two documents agree in a component with the probability of their weighted Jaccard similarity. Work per
document is one draw per piece and about m log m points, however large the weights.

Signatures are banded; equal multisets are one class; pairs of classes that share a band are checked by exact multiset overlap
(intersection over union at least SIMILARITY), and linked classes form the groups (``links.connect``).

Defined results: null or wordless text is in no group; fewer than SHINGLE words are one shingle; a null id counts as the smallest;
the kept document of a group is the one with the least id; repeated rows are all marked alike; an empty table gives no rows; other columns are
not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, drop, store, whole_rows, with_columns
from .links import connect, shared
from .textarrays import byte_hash, give_back, mix, range_hash, slices, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5  # a pair at the threshold shares a band with probability 0.99993
_L = T.LongType()
_SIGNED = lambda x: x.view(np.int64)
NO_ID = -(1 << 63)


def bags(part, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of every distinct shingle of the texts of a slice, by text and hash."""
    starts, ends, firsts = words(part)
    h = byte_hash(part.data, starts, ends, 21)
    count = np.diff(firsts)
    doc = np.repeat(np.arange(len(count)), count)
    n = max(len(h) - shingle + 1, 0)
    full = np.flatnonzero(doc[:n] == doc[len(doc) - n:]) if n else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < shingle))
    at = np.concatenate((full, firsts[:-1][short]))
    stop = np.concatenate((full + shingle, firsts[1:][short]))
    hashes, of = range_hash(h, at, stop, 22), doc[at] if len(at) else at
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    return of[new], hashes[new], np.diff(np.append(new, len(of)))


def signatures(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures (docs x m) of bags given as text number, hash and weight; rows without shingles are infinite."""
    sign = np.full(docs * m, np.inf)
    total = np.bincount(doc, weights=weight, minlength=docs)
    pieces = [(doc, mix(hashes, 31), np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64), weight)]
    level = 1
    while True:
        low = 1 << (level - 1)
        more = np.flatnonzero(weight > low)
        if not len(more):
            break
        size = np.full(len(more), low, np.int64)
        pieces.append((doc[more], mix(hashes[more], 31 + level), size, size, weight[more]))
        level += 1
    of, seed, low, size, reach = (np.concatenate(x) for x in zip(*pieces))
    until = m * (np.log(m) + 5) / np.maximum(total, 1)
    time, draw, point = np.zeros(len(of)), np.zeros(len(of), np.uint64), np.zeros(len(of), np.uint64)

    def advance(at):
        draw[at] += np.uint64(1)
        point[at] = x = mix(seed[at] ^ (draw[at] * np.uint64(0xD6E8FEB86659FD93)), 1)
        time[at] -= np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / size[at]

    advance(np.arange(len(of)))
    live = np.flatnonzero(time < until[of])
    while True:
        while len(live):  # every piece holds its next point; those before the document's horizon are taken
            x = point[live]
            inside = low[live] + (mix(x, 2) & (size[live] - 1).astype(np.uint64)).astype(np.int64) < reach[live]
            at = live[inside]
            np.minimum.at(sign, of[at] * m + (mix(x[inside], 3) % np.uint64(m)).astype(np.int64), time[at])
            advance(live)
            live = live[time[live] < until[of[live]]]
        short = (total > 0) & np.isinf(sign.reshape(docs, m)).any(axis=1)
        if not short.any():
            break
        until[short] *= 2
        live = np.flatnonzero(short[of] & (time < until[of]))
    return sign.reshape(docs, m)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, ``c1``, ``c2`` (hash of the multiset, null without words), ``bands``."""
    schema = T.StructType([T.StructField(n, _L) for n in ("doc_id", "text_key", "n_shingles", "c1", "c2")] + [T.StructField("bands", T.ArrayType(_L))])
    m = bands * rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                here, n = batch.slice(part.first, part.last - part.first), part.last - part.first
                doc, hashes, weight = bags(part, shingle)
                values = np.ascontiguousarray(signatures(doc, hashes, weight, n, m).astype(np.float32)).view(np.uint32).ravel().astype(np.uint64)
                at = np.arange(0, n * m, rows)
                keys = mix(range_hash(values, at, at + rows, 23) + np.tile(np.arange(bands, dtype=np.uint64), n), 24).reshape(n, bands)
                some = np.bincount(doc, minlength=n) > 0
                first = np.searchsorted(doc, np.flatnonzero(some))
                c = np.zeros((2, n), np.uint64)
                if len(doc):
                    for i in range(2):
                        c[i, some] = np.add.reduceat(mix(mix(hashes, 25 + i) + weight.astype(np.uint64), 27), first)
                none = ~some
                yield with_columns(here, schema, {
                    "doc_id": here.column("doc_id"), "text_key": here.column("text_key"), "n_shingles": np.bincount(doc, weights=weight, minlength=n).astype(np.int64),
                    "c1": pa.array(_SIGNED(c[0]), mask=none), "c2": pa.array(_SIGNED(c[1]), mask=none),
                    "bands": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some * bands)).astype(np.int32)), pa.array(_SIGNED(keys[some].ravel())))})
        give_back()
    return docs.mapInArrow(work, schema)


def occurrences(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text, each occurrence as one number, so that set overlap is multiset overlap."""
    sizes, values = [], []
    for part in slices(column):
        doc, hashes, weight = bags(part, shingle)
        each = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
        values.append(mix(np.repeat(hashes, weight) + each.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 28))
        sizes.append(np.bincount(doc, weights=weight, minlength=part.last - part.first).astype(np.int64))
    return np.append(0, np.cumsum(np.concatenate(sizes))), np.concatenate(values)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id``, ``text_key``, ``n_shingles``, ``class_id`` (least id with the same multiset), ``component_id`` (least id
    of the group), ``kept``."""
    spark = docs.sparkSession
    docs = documents(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    signed, _ = store(sign(docs, bands, rows, shingle))
    classes, _ = store(signed.filter("c1 is not null").groupBy("c1", "c2").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .select("c1", "c2", F.struct(F.col("first.doc_id").alias("id"), F.col("c1").alias("c")).alias("node"), F.col("first.text_key").alias("text_key"), "n", "bands"))
    candidates, candidates_path = shared(classes.select("node", F.explode("bands").alias("key")))
    nodes = classes.join(candidates.select("node").distinct(), "node", "left_semi").select("node", "n", F.col("node.id").alias("n_id"), F.col("text_key").alias("n_key"))
    bodies, bodies_path = store(docs.join(nodes, (docs["doc_id"] == nodes["n_id"]) & (docs["text_key"] == nodes["n_key"])).select("node", "n", F.col("text").alias("body")))
    groups, _ = store(connect(candidates, bodies, lambda column: occurrences(column, shingle), similarity))
    drop(spark, candidates_path, bodies_path)
    named, _ = store(classes.select("c1", "c2", "node").join(groups, "node", "left").select(
        "c1", "c2", F.col("node.id").alias("class_id"), F.coalesce("component.id", "node.id").alias("component_id")))
    out = signed.join(named, ["c1", "c2"], "left").select("doc_id", "text_key", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
                                                          F.coalesce("component_id", "doc_id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).select(real("doc_id"), "text_key", "n_shingles", real("class_id"), real("component_id"), "kept")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows and columns of ``docs``, one row of each group; of rows that repeat id and text one stays."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **parameters).filter("kept").select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key"))
    rows = whole_rows(docs, id_col, text_col).select("row", "doc_id", "text_key")
    stay = rows.join(kept, rows["doc_id"].eqNullSafe(kept["k_id"]) & (rows["text_key"] == kept["k_key"]), "left_semi").dropDuplicates(["doc_id", "text_key"])
    return stay.select(*[F.col("row")[c].alias(c) for c in docs.columns])
