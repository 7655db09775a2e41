"""Concatenate and cut: token streams of all documents laid end to end and cut into fixed windows.

Two passes. The first encodes every text once and writes the ids, each row with its partition and the
tokens before it there. The partitions' totals (one small row each) give, by a prefix sum,
where each partition starts in the whole stream; the second pass adds that to each row and cuts at the
multiples of the window. Text and ids are never shuffled, and no task sees another's rows.

Defined results: an added token of the tokenizers file (a special string) that a text spells is its own id; null text is an empty document of one token, its end mark; a repeated row is
packed each time it occurs; an empty table gives no pieces; other columns are not read. Documents lie in the
order in which their partitions were read. Only the last window can be short.
"""
from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, store, with_columns
from .textarrays import give_back

IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
                    T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()),
                    T.StructField("ids", T.ArrayType(T.IntegerType()))])
PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
                      + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
_ENCODERS: dict[str, Encoder] = {}


def _unicode_bytes() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to ids as the tokenizers library gives them with add_special_tokens=False: added tokens that a text spells become
    their ids, and the stretches between them are encoded each on its own."""

    def __init__(self, spec: dict):
        import public_tokenizers
        import tiktoken
        vocab, to_byte = spec["model"]["vocab"], _unicode_bytes()
        # an added token that merges make too is an ordinary one besides, and has that one's id
        merged = {m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]}
        names = {t["content"] for t in spec["added_tokens"]} - merged - set(to_byte)
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in names}
        self.plain = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {c: t | {"id": vocab.get(c, t["id"])} for t in spec["added_tokens"] if (c := t["content"])}
        # tokens that are sought before normalization come first; the longest of those that begin at a place is taken
        self.rounds = [re.compile("|".join(re.escape(c) for c in sorted(of, key=len, reverse=True)))
                       for kind in (False, True) if (of := [c for c, t in self.added.items() if bool(t.get("normalized")) is kind])]

    def _split(self, text: str, pattern: re.Pattern) -> Iterator[str | int]:
        at = 0
        for m in pattern.finditer(text):
            token, (start, end) = self.added[m[0]], m.span()
            if token.get("single_word") and (re.match(r"\w", text[start - 1:start]) or re.match(r"\w", text[end:end + 1])):
                continue
            if token.get("lstrip"):
                start = max(at, len(text[:start].rstrip()))
            if token.get("rstrip"):
                end += len(text) - end - len(text[end:].lstrip())
            if at < start:
                yield text[at:start]
            yield token["id"]
            at = end
        if at < len(text):
            yield text[at:]

    def encode(self, text: str) -> list[int]:
        if not any(c in text for c in self.added):
            return self.plain.encode_ordinary(text)
        parts = [text]
        for pattern in self.rounds:
            parts = [y for x in parts for y in (self._split(x, pattern) if isinstance(x, str) else [x])]
        return [i for x in parts for i in (self.plain.encode_ordinary(x) if isinstance(x, str) else [x])]


def encoder(path: str) -> Encoder:
    """The byte-level vocabulary of a tokenizers file, its added tokens included."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            _ENCODERS[path] = Encoder(json.load(f))
    return _ENCODERS[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))


def encode(docs: DataFrame, tokenizer: str, end_id: int = 1, rows: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``part``, ``before`` (tokens before it in its partition), ``n_tokens``, ``ids`` with the
    end mark."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, before, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.array([end_id], np.int32)
        give_back()  # what earlier stages have left in this worker
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids = [np.concatenate((np.asarray(enc.encode(t), np.int32), end)) for t in batch.column("text").to_pylist()]
                lengths = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(lengths) - lengths
                before += int(lengths.sum())
                yield with_columns(batch, IDS, {"doc_id": batch.column("doc_id"), "part": np.full(len(ids), part, np.int32),
                                                "before": starts, "n_tokens": lengths, "ids": _lists(ids)})
        give_back()
    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(work, IDS)


def cut(batches: Iterator[pa.RecordBatch], bases: dict[int, int], window: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The pieces of the rows of ``encode``, so many rows at a time; ``bases`` has the place of each partition's first token in the whole stream."""
    for whole in batches:
        for top in range(0, whole.num_rows, rows):
            batch = whole.slice(top, rows)
            flat = batch.column("ids")
            values, offsets = flat.flatten().to_numpy(zero_copy_only=False), np.zeros(len(flat) + 1, np.int64)
            np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False), out=offsets[1:])
            at = np.array([bases[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("before").to_numpy()
            n = np.diff(offsets)
            first, pieces = at // window, (at + n - 1) // window - at // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            low = np.maximum(sequence * window, at[row])
            high = np.minimum((sequence + 1) * window, at[row] + n[row])
            start = low - at[row]
            cuts = np.append(offsets[:-1][row] + start, offsets[-1])
            packed = [values[a:b] for a, b in zip(cuts[:-1], cuts[:-1] + (high - low))]
            crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in packed]
            ids = batch.column("doc_id")
            yield with_columns(batch, PIECES, {"doc_id": ids.take(pa.array(row)), "start": start, "length": high - low, "ids_crc32": crc,
                                               "doc_tokens": n[row], "sequence_id": sequence, "offset": low - sequence * window, "ids": _lists(packed)})


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (its document's ids before it), ``length``, ``ids_crc32`` (of
    the ids as little-endian 32-bit numbers), ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``."""
    tokens, _ = store(encode(docs, tokenizer, end_id, id_col=id_col, text_col=text_col))
    # one row per input partition, however many documents there are
    totals = sorted(tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, total = {}, 0
    for part, n in totals:
        bases[part] = total
        total += n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from cut(batches, bases, window)
        give_back()
    return tokens.mapInArrow(work, PIECES)
