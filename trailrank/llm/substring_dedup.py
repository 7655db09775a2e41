"""Substring deduplication by suffix automata over shards of the reference.

The reference is the whole table: a window of WINDOW words goes where its words also start in a document with a smaller id.
Streaming every document past every shard would be quadratic, so windows are grouped first: of the ANCHOR-word runs in a
window the one with the least hash is its anchor, equal windows have equal anchors, and the neighbouring windows of a
document with one anchor form a passage. The passages of one anchor are a shard of the reference, and only they are matched with it:

1. equal passages are one row with the least id that has them: in every later document they go whole;
2. where an anchor has several different passages, these are streamed, by ascending id, past the suffix automaton of
   the earlier ones: a matching statistic of WINDOW words or more marks a window, and the marks join to maximal spans;
3. an anchor with more than HOT different passages would be one large task: these passages are cut again by anchors of LONG
   words, which tell more apart, and points 1 and 2 hold for the pieces;
4. what is still hot then has LONG words in common: its pieces are cut into single windows, and equal windows are brought together by
   hash like the passages of point 1.

Defined results: words are the runs of characters other than 0x20 and 0x09-0x0D; null text has none; windows are judged on
the input; equal or null ids never remove from each other (null counts as the smallest id); repeated rows get the same answer; documents
shorter than a window stay whole; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, drop, store, with_columns
from .textarrays import byte_hash, range_hash, slices, words

WINDOW, ANCHOR, LONG, HOT = 50, 8, 40, 128
KEY = ["anchor", "h1", "h2"]
_L, _I = T.LongType(), T.IntegerType()
PASSAGES = T.StructType([T.StructField(n, t) for n, t in (("doc_id", _L), ("text_key", _L), ("start", _I), ("windows", _I), ("anchor", _L), ("h1", _L), ("h2", _L))])
SPANS = T.StructType([T.StructField(n, t) for n, t in (("anchor", _L), ("h1", _L), ("h2", _L), ("begin", _I), ("stop", _I))])
KEPT = T.StructType([T.StructField(n, t) for n, t in (("doc_id", _L), ("n_words", _L), ("n_removed", _L),
                    ("spans", T.ArrayType(T.StructType([T.StructField("begin", _I), T.StructField("stop", _I)]))), ("kept", T.StringType()))])
_SIGNED = lambda x: x.view(np.int64)


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _clone(self, p: int, symbol, q: int) -> int:
        """A copy of state q for the substrings that are no longer than those through p."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, symbol, q)
                continue
            new = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, symbol, q)
            last = new

    def statistics(self, sequence) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        out, state, n = [], 0, 0
        following, link, length = self.next, self.link, self.length
        for symbol in sequence:
            to = following[state].get(symbol)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = following[state].get(symbol)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


def _word_hashes(part) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, firsts = words(part)
    return byte_hash(part.data, starts, ends, 11), firsts


def _cut(h: np.ndarray, firsts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in sequences of word hashes that lie end to end: first word, windows, sequence, anchor."""
    width = window - anchor + 1
    grams = range_hash(h, np.arange(len(h) - anchor + 1), np.arange(anchor, len(h) + 1), 12)
    low = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)  # ties: the first place
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:len(low) - step], low[step:])
        step *= 2
    low = np.minimum(low[:len(low) - (width - step)], low[width - step:]) if width > step else low
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    whole = of[:len(place)] == of[window - 1:]
    begins = whole & np.append(True, (place[1:] != place[:-1]) | ~whole[:-1] | (of[1:len(place)] != of[:len(place) - 1]))
    at = np.flatnonzero(begins)
    counted = np.append(0, np.cumsum(whole))
    count = counted[np.append(at[1:], len(whole))] - counted[at]
    return at, count, of[at], grams[place[at]]


def _hashes(h: np.ndarray, at: np.ndarray, stop: np.ndarray) -> dict[str, np.ndarray]:
    return {"h1": _SIGNED(range_hash(h, at, stop, 13)), "h2": _SIGNED(range_hash(h, at, stop, 14))}


def passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Every window of every document, in runs with one anchor: first word, windows, anchor, hash of all their words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                h, firsts = _word_hashes(part)
                if len(h) < window:
                    continue
                at, count, of, anchors = _cut(h, firsts, window, anchor)
                row = pa.array(part.first + of)
                yield with_columns(batch, PASSAGES, {
                    "doc_id": batch.column("doc_id").take(row), "text_key": batch.column("text_key").take(row), "start": (at - firsts[of]).astype(np.int32),
                    "windows": count.astype(np.int32), "anchor": _SIGNED(anchors), **_hashes(h, at, at + count + window - 1)})
    return docs.mapInArrow(work, PASSAGES)


def _pieces(contents: DataFrame, window: int, anchor: int) -> DataFrame:
    """The passages of hot anchors cut again: ``owner`` (the passage) and, as in ``passages``, its pieces with their words."""
    owner = T.StructType([T.StructField(n, _L) for n in ("anchor", "h1", "h2")])
    schema = T.StructType([T.StructField("owner", owner), T.StructField("doc_id", _L), *PASSAGES.fields[2:], T.StructField("words", T.ArrayType(_L))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            h, firsts = lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            if not len(h):
                continue
            at, count, of, anchors = _cut(h, firsts, window, anchor)
            stop, row = at + count + window - 1, pa.array(of)
            own = pa.StructArray.from_arrays([batch.column(c).take(row) for c in owner.names], names=owner.names)
            words_of = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(stop - at)).astype(np.int32)), pa.array(_SIGNED(np.concatenate([h[a:b] for a, b in zip(at, stop)]))))
            yield with_columns(batch, schema, {"owner": own, "doc_id": batch.column("doc_id").take(row), "start": (at - firsts[of]).astype(np.int32),
                                               "windows": count.astype(np.int32), "anchor": _SIGNED(anchors), **_hashes(h, at, stop), "words": words_of})
    return contents.mapInArrow(work, schema)


def _contents(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The word hashes of the passages ``wanted`` (content key, and where it first stands), fetched from the texts."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("anchor", _L), ("h1", _L), ("h2", _L), ("doc_id", _L), ("hot", T.BooleanType()), ("words", T.ArrayType(_L)))])
    asked = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "h1", "h2", "start", "windows", "hot")).alias("asked"))
    asked = asked.withColumnsRenamed({"doc_id": "a_id", "text_key": "a_key"})
    both = docs.join(asked, (docs["doc_id"] == asked["a_id"]) & (docs["text_key"] == asked["a_key"])).select("doc_id", "text", "asked")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                h, firsts = _word_hashes(part)
                h, here = _SIGNED(h), batch.slice(part.first, part.last - part.first)
                lists = here.column("asked")
                flat = lists.flatten()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                start = firsts[row] + flat.field("start").to_numpy()
                stop = start + flat.field("windows").to_numpy() + window - 1
                offsets = np.append(0, np.cumsum(stop - start)).astype(np.int32)
                values = np.concatenate([h[a:b] for a, b in zip(start, stop)]) if len(start) else h[:0]
                yield with_columns(here, schema, {**{c: flat.field(c) for c in ("anchor", "h1", "h2", "hot")}, "doc_id": here.column("doc_id").take(pa.array(row)),
                                                  "words": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})
    return both.mapInArrow(work, schema)


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _matched(contents: DataFrame, window: int) -> DataFrame:
    """Windows (begin to stop, counted in the passage) of each passage that a passage of a smaller id has too."""
    rows = contents.select("anchor", "doc_id", "h1", "h2", "words").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "h1", "h2")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, waiting, of = None, SuffixAutomaton(), [], None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("anchor", "doc_id", "h1", "h2", "words")]
            for anchor, doc, h1, h2, sequence in zip(*columns):
                if anchor != shard:
                    shard, automaton, waiting, of = anchor, SuffixAutomaton(), [], doc
                elif doc != of:
                    for w in waiting:
                        automaton.add(w)
                    waiting, of = [], doc
                if len(automaton.next) > 1:
                    marks = np.array(automaton.statistics(sequence)[window - 1:]) >= window
                    out += [(anchor, h1, h2, a, b) for a, b in _runs(marks)]
                waiting.append(sequence)
            if out:
                yield with_columns(batch, SPANS, dict(zip(SPANS.names, map(list, zip(*out)))))
    return rows.mapInArrow(work, SPANS)


def _hot_windows(contents: DataFrame, window: int) -> DataFrame:
    """Single windows of the passages of hot anchors: their place in the passage, their own hash."""
    schema = T.StructType([*SPANS.fields[:4], T.StructField("doc_id", _L), T.StructField("w1", _L), T.StructField("w2", _L)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, first = lists.flatten().to_numpy().view(np.uint64), np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n - window + 1)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n - window + 1) - (n - window + 1), n - window + 1)
            at = first[row] + place
            take = pa.array(row)
            yield with_columns(batch, schema, {**{c: batch.column(c).take(take) for c in ("anchor", "h1", "h2", "doc_id")}, "begin": place.astype(np.int32),
                                               "w1": _SIGNED(range_hash(flat, at, at + window, 15)), "w2": _SIGNED(range_hash(flat, at, at + window, 16))})
    return contents.mapInArrow(work, schema)


def _first(found: DataFrame, place: Column) -> DataFrame:
    """One row per different passage: the least place that has it, and whether a larger id has it too (``copied``)."""
    return (found.groupBy(*KEY).agg(F.min(place).alias("first"), F.max("doc_id").alias("last"))
            .select(*KEY, "first.*", (F.col("last") > F.col("first.doc_id")).alias("copied")))


def _shards(distinct: DataFrame, hot: int) -> DataFrame:
    """The anchors that have different passages in different documents, and whether they have more than ``hot``."""
    counts = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return counts.filter("n > 1 and low < high").select("anchor", (F.col("n") > hot).alias("hot"))


def _verdicts(distinct: DataFrame, spans: DataFrame) -> DataFrame:
    """What goes of each passage: everything in ids above ``first_id`` if ``copied``, ``parts`` of it in ``first_id``."""
    parts = spans.groupBy(*KEY).agg(F.collect_list(F.struct("begin", "stop")).alias("parts"))
    return distinct.select(*KEY, F.col("doc_id").alias("first_id"), "copied").join(parts, KEY, "left").filter("copied or parts is not null")


def _applied(found: DataFrame, verdicts: DataFrame, *owner: str) -> DataFrame:
    """The windows that go, begin to stop, by owner of the passages."""
    whole = F.expr("array(struct(0 as begin, windows as stop))")
    part = found.join(verdicts, KEY).withColumn("part", F.explode(F.when(F.col("doc_id") > F.col("first_id"), whole).otherwise(F.col("parts"))))
    return part.select(*owner, (F.col("start") + F.col("part.begin")).alias("begin"), (F.col("start") + F.col("part.stop")).alias("stop"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, long: int = LONG, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``spans`` (words removed, begin to stop) and ``kept`` (the other words, one space
    between them)."""
    spark = docs.sparkSession
    docs = documents(docs, id_col, text_col)
    keyed = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    found, found_path = store(passages(keyed, window, anchor))
    distinct, distinct_path = store(_first(found, F.struct("doc_id", "text_key", "start", "windows")))
    contents, contents_path = store(_contents(keyed, distinct.join(_shards(distinct, hot), "anchor"), window))
    pieces, pieces_path = store(_pieces(contents.filter("hot"), window, long))
    of_pieces, of_pieces_path = store(_first(pieces, F.struct("doc_id", "words")))
    ranked, ranked_path = store(of_pieces.join(_shards(of_pieces, hot), "anchor"))
    singles, singles_path = store(_hot_windows(ranked.filter("hot"), window))
    least, least_path = store(singles.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("w1", "w2", "low"))
    same = singles.join(least, ["w1", "w2"]).filter("low < doc_id").select(*KEY, "begin", (F.col("begin") + 1).alias("stop"))
    inner, inner_path = store(_verdicts(of_pieces, _matched(ranked.filter("not hot"), window).unionByName(same)))
    again = _applied(pieces, inner, "owner").select("owner.*", "begin", "stop")
    verdicts, verdicts_path = store(_verdicts(distinct, _matched(contents.filter("not hot"), window).unionByName(again)))
    drop(spark, distinct_path, contents_path, pieces_path, of_pieces_path, ranked_path, singles_path, least_path, inner_path)
    cut = _applied(found, verdicts, "doc_id", "text_key").withColumn("stop", F.col("stop") + (window - 1))
    cuts = cut.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("cuts")).withColumnsRenamed({"doc_id": "c_id", "text_key": "c_key"})
    cuts, _ = store(cuts)
    drop(spark, found_path, verdicts_path)
    joined = keyed.join(cuts, (keyed["doc_id"] == cuts["c_id"]) & (keyed["text_key"] == cuts["c_key"]), "left").select(
        F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), "text", "cuts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(at, 256), []
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                    said = text.encode().split()  # at exactly these six white-space bytes
                    if not spans:
                        rows.append((len(said), 0, [], b" ".join(said).decode()))
                        continue
                    edges = np.zeros(len(said) + 1, np.int64)
                    np.add.at(edges, [s["begin"] for s in spans], 1)
                    np.add.at(edges, [s["stop"] for s in spans], -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    runs = _runs(gone)
                    left = b" ".join([said[i] for i in np.flatnonzero(~gone).tolist()]).decode()
                    rows.append((len(said), int(gone.sum()), [{"begin": a, "stop": b} for a, b in runs], left))
                yield with_columns(batch, KEPT, {"doc_id": batch.column("doc_id"), **dict(zip(KEPT.names[1:], map(list, zip(*rows))))})
    return joined.mapInArrow(work, KEPT)
