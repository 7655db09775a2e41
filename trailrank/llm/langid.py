"""Language identification: averaged hashed subword embeddings under a linear softmax, with rejection.

A text's subwords are its runs of one to three characters (white space folded to one mark); each falls in one of
``BUCKETS`` rows of an embedding table, the mean of the rows goes through a linear softmax. Table and softmax are
trained together by stochastic gradient descent in numpy on a bounded sample; a held-back fifth of the sample
sets the softmax temperature and the score below which a prediction is rejected.

Defined results: null text, or text without a letter, is ``und`` with score 0 and rejected; rows without a label or text
teach nothing; where nothing can be learned every text is ``und``, and only those without letters are rejected;
repeated rows get equal answers; of two labels with equal scores the first by name is told; a null id is kept as it is; an empty table gives no
rows; other columns are not read. A text is held whole, with some 30 bytes for each of its bytes.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns
from .textarrays import LETTER, SPACE, Slice, classes, code_points, give_back, slices

BUCKETS, WIDTH, ORDERS = 8192, 16, 3
#: Bounds of the training sample: rows of each language, and of all; many languages have fewer rows each, one at least.
SAMPLE_ROWS, SAMPLE_ALL = 600, 30_000
#: Texts told at a time, and counted at a time: a row of BUCKETS shares or counts each, however short they are.
TEXTS, FEW = 256, 32
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    logits: np.ndarray  # BUCKETS x labels: the embedding table times the softmax weights
    bias: np.ndarray
    temperature: float
    least: float  # a lower score is rejected


def _bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice of texts: the share of each bucket in a text's subwords by (text, bucket), and whether each text has a letter."""
    for part in slices(column, rows=TEXTS):
        docs = len(part.offsets) - 1
        shares, letter = np.empty((docs, BUCKETS), np.float32), np.empty(docs, bool)
        for at in range(0, docs, FEW):
            to = min(at + FEW, docs)
            low, high = part.offsets[at], part.offsets[to]
            counts, letter[at:to] = _counts(Slice(at, to, part.data[low:high], part.offsets[at:to + 1] - low))
            shares[at:to] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        yield shares, letter


def _counts(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Counts by (text, bucket), and whether each text has a letter."""
    points, firsts = code_points(part)
    n, docs = len(points), len(firsts) - 1
    kind = classes()[points]
    doc = np.repeat(np.arange(docs), np.diff(firsts))
    letter = np.zeros(docs, bool)
    letter[doc[kind == LETTER]] = True
    code = np.where(kind == SPACE, np.uint32(32), points).astype(np.uint32)
    counts = np.zeros(docs * BUCKETS, np.int64)
    rolled = np.zeros(n, np.uint32)
    for order in range(ORDERS):
        if order >= n:
            break
        rolled = (rolled[:n - order] if order == 0 else rolled[:-1]) * np.uint32(0x01000193) ^ code[order:]
        spread = (rolled + np.uint32(order)) * np.uint32(0x9E3779B1)
        inside = doc[:n - order] == doc[order:]
        counts += np.bincount(doc[:n - order][inside] * BUCKETS + (spread[inside] >> np.uint32(19)), minlength=docs * BUCKETS)
    return counts.reshape(docs, BUCKETS), letter


def _packed(shares: np.ndarray) -> bytes:
    """The buckets of a text that have a share, two bytes each, and their shares."""
    at = np.flatnonzero(shares)
    return at.astype(np.uint16).tobytes() + shares[at].tobytes()


def _rows(bags: list[bytes], chosen: np.ndarray) -> np.ndarray:
    """The chosen packed texts as rows of BUCKETS shares."""
    out = np.zeros((len(chosen), BUCKETS), np.float32)
    for i, n in enumerate(chosen.tolist()):
        size = len(bags[n]) // 6
        out[i, np.frombuffer(bags[n], np.uint16, size)] = np.frombuffer(bags[n][2 * size:], np.float32)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(bags: list[bytes], y: np.ndarray, labels: list[str], epochs: int = 40, batch: int = 32, rate: float = 20.0, seed: int = 7) -> Model:
    """Train on packed subword shares and label numbers ``y``; only a batch of texts is ever spread over BUCKETS columns."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(y))
    back, train = order[:len(y) // 5], order[len(y) // 5:]
    # a label whose rows are all held back is learned from its first one
    alone = [np.flatnonzero(y[back] == i)[0] for i in np.setdiff1d(y[back], y[train])]
    train, back = np.append(train, back[alone]) if alone else train, np.delete(back, alone) if alone else back
    table = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = random.normal(0, 0.3, (WIDTH, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        random.shuffle(train)
        for at in range(0, len(train), batch):
            rows = train[at:at + batch]
            x = _rows(bags, rows)
            hidden = x @ table
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            to_table = x.T @ (error @ weights.T)
            weights -= 0.05 * step * hidden.T @ error
            bias -= 0.01 * step * error.sum(axis=0)
            table -= 10 * step * to_table
    logits = table @ weights
    if not len(back):
        return Model(labels, logits, bias, 1.0, 0.0)
    z, truth = np.concatenate([_rows(bags, back[at:at + TEXTS]) @ logits + bias for at in range(0, len(back), TEXTS)]), y[back]
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    p = _softmax(z / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    # one right answer in a thousand may be rejected, and never one that beats all others together
    least = min(0.5, float(right[len(right) // 1000])) if len(right) else 0.0
    return Model(labels, logits, bias, temperature, least)


def train(docs: DataFrame, learn: Column | None = None, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Fit on a bounded sample of the labelled rows that meet ``learn``: at most SAMPLE_ROWS of each language, none left out,
    chosen by a hash of the id. Executors reduce each sampled text, read whole, to the buckets it has and their shares."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = (rows if learn is None else rows.filter(learn)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                                                                  F.xxhash64(F.col(id_col), F.lit("sample")).alias("draw"))
    sizes = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    labels = sorted(lang for lang, _ in sizes)
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    each = min(SAMPLE_ROWS, max(1, SAMPLE_ALL // len(labels)))
    # half as many again as are wanted (and a few, so that none of a language is not drawn by chance), then exactly the first ones by the hash
    share = F.create_map(*[F.lit(v) for lang, n in sizes for v in (lang, min(1.0, (1.5 * each + (0 if each == SAMPLE_ROWS else 50)) / n))])
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("draw", T.LongType()), T.StructField("bag", T.BinaryType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for shares, _ in _bags(batch.column("text")):
                here = batch.slice(at, len(shares))
                at += len(shares)
                yield with_columns(here, schema, {"lang": here.column("lang"), "draw": here.column("draw"), "bag": [_packed(r) for r in shares]})

    drawn = rows.filter((F.col("draw").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))) < share[F.col("lang")])
    from pyspark.sql import Window
    first = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))).filter(F.col("nth") <= each)
    got = first.select("lang", "text", "draw").mapInArrow(count, schema).toArrow().sort_by([("lang", "ascending"), ("draw", "ascending"), ("bag", "ascending")])
    number = {v: i for i, v in enumerate(labels)}
    y = np.array([number[v] for v in got.column("lang").to_pylist()])
    bags = got.column("bag").to_pylist()
    del got
    return fit(bags, y, labels)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` and ``rejected``, from whole texts alone."""
    source = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("said"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.labels, UNKNOWN], object)
        for batch in batches:
            at = 0
            for shares, letter in _bags(batch.column(batch.num_columns - 1)):
                here = batch.slice(at, len(shares))
                at += len(shares)
                if model.labels:
                    p = _softmax((shares @ model.logits + model.bias).astype(np.float64) / model.temperature)
                    best, score = p.argmax(axis=1), p.max(axis=1)
                else:
                    best, score = np.zeros(len(shares), np.int64), np.zeros(len(shares))
                best = np.where(letter & bool(model.labels), best, len(model.labels))
                score = np.where(letter, score, 0.0)
                rejected = ~letter | (bool(model.labels) & (score < model.least))
                yield pa.RecordBatch.from_arrays([*here.columns[:-1], pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)],
                                                 names=[f.name for f in schema])
        give_back()
    return source.mapInArrow(work, schema)
