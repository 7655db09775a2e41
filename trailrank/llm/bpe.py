"""Byte-level BPE by prefix dynamic programming, and the way back.

Every prefix of a piece has exactly one last token that its encoding can end with: the token t for
which the encoding of the bytes before t, ended by its own last token s, stays as it is when t follows (s, t
is a stable pair). The table of last tokens is therefore all there is to an encoding: it is read from the
back, grows by appended bytes without touching what is there, and after an edit keeps everything before it.

Defined results: null text is empty and has no ids; a piece that is a token itself is that token; repeated
rows get equal ids; other columns are not read.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, with_columns
from .packing import _lists

_ENCODERS: dict[str, PrefixEncoder] = {}
KEPT = 1_000_000  # pieces, and pairs of tokens, that a worker remembers; others are worked out again


class PrefixEncoder:
    """Ranks (bytes to id) as an encoder of pieces."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT):
        self.ranks, self.kept = ranks, kept
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._stable: dict[int, bool] = {}
        self.sizes = np.array([len(self.token.get(i, b"")) for i in range(max(self.token) + 1)], np.int64)

        self.tokens = ahocorasick.Automaton()
        for b, i in ranks.items():
            if len(b) == 1 or self.parts(i) is not None:  # merging can make it
                self.tokens.add_word(self.letters(b), (i, len(b)))
        self.tokens.make_automaton()

    def letters(self, piece) -> str:
        """The units that merging starts from, one character each."""
        return piece.decode("latin-1")

    def parts(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for a single byte or a token that merging its own
        bytes never makes."""
        if t not in self._parts:
            piece, rank = self.token[t], self.ranks
            at = list(range(len(piece) + 1))
            while len(at) > 3:
                best = min(((rank.get(piece[at[i]:at[i + 2]], 1 << 40), i) for i in range(len(at) - 2)))
                if best[0] >= t:
                    break
                del at[best[1] + 1]
            self._parts[t] = (rank[piece[:at[1]]], rank[piece[at[1]:]]) if len(at) == 3 else None
        return self._parts[t]

    def stable(self, s: int, t: int) -> bool:
        """Whether s followed by t is its own encoding: unmaking the later of the merges that formed
        the two, step by step, no merge across the border comes before the ones still standing."""
        key = s << 32 | t
        if key not in self._stable:
            if len(self._stable) > self.kept:
                self._stable.clear()
            self._stable[key] = self._border(s, t)
        return self._stable[key]

    def _border(self, s: int, t: int) -> bool:
        rank, token = self.ranks, self.token
        until_s = until_t = 1 << 40  # merges across that come before these ranks break the pair
        while True:
            across = rank.get(token[s] + token[t])
            # a tie goes to the merge further left: one inside s comes before, one inside t after
            if across is not None and across < until_s and across <= until_t:
                return False
            left, right = self.parts(s), self.parts(t)
            if left is None and right is None:
                return True
            # of equal merges the right one was made last, so it is unmade first
            if right is not None and (left is None or t >= s):
                until_t, t = min(until_t, t), right[0]
            else:
                until_s, s = min(until_s, s), left[1]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Fill in ``last`` (last token of each prefix, by its length; entry 0 is -1) for the bytes of the piece
        that it does not cover yet."""
        stable, size = self._stable, self.longest
        if not last:
            last = [-1]
        done, begin = len(last), max(0, len(last) - size)
        # every token that ends at each byte, the longest first; exactly one of them follows its prefix's last token
        for end, (t, n) in self.tokens.iter(self.letters(piece), begin):
            end += 1
            if end < done:
                continue
            start = end - n
            if start:
                key = last[start] << 32 | t
                ok = stable.get(key)
                if not (self.stable(last[start], t) if ok is None else ok):
                    continue
            last.append(t)
            done = end + 1
        if len(last) <= len(piece):
            raise ValueError("the vocabulary lacks a byte")
        return last

    def read(self, last: list[int]) -> list[int]:
        """The ids of the whole piece, from its table."""
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= len(self.token[last[end]])
        return out[::-1]

    def edit(self, piece: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """The piece and its table after ``removed`` bytes at ``at`` gave way to ``added``. What lies before stays; behind, entries are worked out until as many as the longest
        token has bytes are what they were, since no later one looks further back: the rest is taken over."""
        changed = piece[:at] + added + piece[at + removed:]
        done, shift = at + len(added), len(added) - removed
        table = self.extend(changed[:done], last[:at + 1])
        while done < len(changed):
            to = min(done + self.longest, len(changed))
            table = self.extend(changed[:to], table)
            if to - done == self.longest and table[done + 1:] == last[done + 1 - shift:to + 1 - shift]:
                return changed, table + last[to + 1 - shift:]
            done = to
        return changed, table

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(self.extend(piece, []))


def prefix_encoder(path: str) -> PrefixEncoder:
    """The encoder of a rank file, one in each Python worker."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    return _ENCODERS[path]


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """``doc_id``, ``ids``: each match of the pattern encoded separately, without special tokens."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex
        find, enc, known = regex.compile(public_tokenizers.PATTERN).findall, prefix_encoder(ranks), {}
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch, out = whole.slice(at, rows), []
                for text in batch.column("text").to_pylist():
                    pieces = find(text)
                    if len(known) > KEPT:
                        known.clear()
                    for new in set(pieces).difference(known):
                        known[new] = np.array(enc.encode(new.encode()), np.int32).tobytes()
                    out.append(np.frombuffer(b"".join([known[p] for p in pieces]), np.int32))
                yield with_columns(batch, schema, {"doc_id": batch.column("doc_id"), "ids": _lists(out)})
    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(work, schema)


def decode(encoded: DataFrame, ranks: str, rows: int = 256) -> DataFrame:
    """``doc_id``, ``ids``, ``decoded`` (bytes) of a table with ``doc_id`` and ``ids``; null ids decode to nothing."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = prefix_encoder(ranks)
        token, size = enc.token, enc.sizes
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                lists = batch.column("ids")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                values = b"".join([token[i] for i in flat.tolist()])
                ends = np.append(0, np.cumsum(size[flat]))
                cuts = ends[np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))]
                yield with_columns(batch, schema, {"doc_id": batch.column("doc_id"), "ids": lists, "decoded": [values[a:b] for a, b in zip(cuts[:-1], cuts[1:])]})
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(work, schema)
