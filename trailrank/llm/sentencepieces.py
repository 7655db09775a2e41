"""Sentence pieces with their places in the text: offset-preserving encoding, and the way back.

Normalisation replaces, from left to right, the longest prefix of the rest of a text that the model's compiled character map holds, and
writes white space as the space symbol. For every byte that it puts out it records the byte of the text it came from, so
a piece, which is a run of normalised bytes, is carried back to a span of bytes of the text as it was: a space symbol put before
the text has an empty span, a ligature's letters have the span of the ligature, and the spans of a text's pieces follow
one another. A character that the vocabulary lacks is spelled in byte pieces, the last of which has its span, the others an empty one.

Pieces are merged within stretches that no piece of the vocabulary can cross (before a space symbol, around characters that
occur in no longer piece), by the table of last tokens of ``bpe``, which is linear in the length of a stretch; runs of spaces, where the
model scores them all alike, are joined last, from the left. What can be encoded are models of the
kind BPE with byte fallback, without user-defined or unused pieces; for others the constructor raises an error.

Defined results: null text is empty and has the end id only, as has a text that normalises to nothing; a text that spells a control piece is
ordinary text; null and repeated ids and repeated rows are encoded row by row; an empty table gives no rows; other columns are not read.
A text is held in a worker whole, with some 30 bytes for each of its bytes while its spans are worked out.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PrefixEncoder
from .common import documents, with_columns
from .packing import _lists

# Fixed values of the model format: the space symbol, what an unknown id is written as, kinds of pieces, field numbers.
SPACE, UNKNOWN_TEXT = "▁", " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PIECES, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
MODEL_TYPE, BPE, SUFFIX, BYTE_FALLBACK, UNKNOWN_SURFACE = 3, 2, 24, 35, 44
CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 2, 3, 4, 5

LONG = 1 << 20  # characters of a text that are looked up at a time
KEPT = 800_000  # stretches, and pairs of pieces, that a worker remembers
_MODELS: dict[str, Model] = {}


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            byte = message[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, message[at:at + size]
        at += size


def character_map(compiled: bytes) -> dict[str, str]:
    """What a compiled character map replaces: its keys lie in a double-array trie of 32-bit units, their values after it."""
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units = np.frombuffer(compiled[4:4 + size], "<u4")
    labels, offsets = units & 0x800000FF, (units >> 10) << ((units & 512) >> 6)
    values, out, open_ = compiled[4 + size:], {}, [(int(offsets[0]), b"")]
    every = np.arange(1, 256)
    while open_:
        node, key = open_.pop()
        near = node ^ every
        near, bytes_ = near[near < len(units)], every[near < len(units)]
        for at, byte in zip(near[labels[near] == bytes_].tolist(), bytes_[labels[near] == bytes_].tolist()):
            longer, below = key + bytes([byte]), at ^ int(offsets[at])
            if units[at] >> 8 & 1:
                start = int(units[below] & 0x7FFFFFFF)
                out[longer.decode()] = values[start:values.index(b"\0", start)].decode()
            open_.append((below, longer))
    return out


class _Merges(PrefixEncoder):
    """Merging by scores, over characters."""

    def letters(self, piece: str) -> str:
        return piece


class _Known(dict):
    """Encoded stretches, worked out when they are first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, said: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        self[said] = out = self.encode(said)
        return out


class Model:
    """A sentencepiece model: normaliser, encoder of stretches, decoder."""

    def __init__(self, proto: bytes):
        top = list(fields(proto))
        trainer = dict(next((fields(v) for f, v in top if f == TRAINER), ()))
        rules = dict(next((fields(v) for f, v in top if f == NORMALIZER), ()))
        pieces = [dict(fields(v)) for f, v in top if f == PIECES]
        self.text = [p.get(1, b"").decode() for p in pieces]
        self.kind = np.array([p.get(3, NORMAL) for p in pieces])
        if trainer.get(MODEL_TYPE, 1) != BPE or not trainer.get(BYTE_FALLBACK) or trainer.get(SUFFIX) or not set(self.kind) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a BPE model with byte fallback and ordinary pieces")
        if any(v for f, m in top if f == DENORMALIZER for g, v in fields(m) if g == CHARSMAP) or not rules.get(ESCAPE, 1):
            raise ValueError("models that denormalise, or keep spaces as they are, are not covered")
        self.prefix, self.squeeze = bool(rules.get(DUMMY_PREFIX, 1)), bool(rules.get(EXTRA_SPACES, 1))
        self.replaced = character_map(rules.get(CHARSMAP, b""))
        self.longest_prefix = ahocorasick.Automaton()
        for key, value in self.replaced.items():
            self.longest_prefix.add_word(key, (len(key), value))
        if self.replaced:
            self.longest_prefix.make_automaton()
        normal = np.flatnonzero(self.kind == NORMAL)
        scores = np.array([np.frombuffer(pieces[i].get(2, b"\0\0\0\0"), "<f4")[0] for i in normal])
        ordered = normal[np.argsort(-scores, kind="stable")].tolist()
        long = [i for i in ordered if len(self.text[i]) > 1]
        score = dict(zip(normal.tolist(), scores.tolist()))
        tied = [i for i in long if score[i] == score[long[-1]]] if long else []
        # runs of spaces, all of one score, may come last; other ties would make merging depend on places
        tied = tied if len(tied) > 1 else []
        self.runs = {len(self.text[i]): i for i in tied}
        if len({score[i] for i in long}) < len(long) - max(len(tied) - 1, 0) or any(SPACE * 2 in self.text[i] if i not in set(tied) else self.text[i].strip(SPACE) for i in long if tied):
            raise ValueError("pieces of equal score")
        ordered = [i for i in ordered if i not in set(tied)]
        self.merges = _Merges({self.text[i]: rank for rank, i in enumerate(ordered)}, KEPT)
        self.id_of = ordered
        self.alone = {t: i for i in normal.tolist() if len(t := self.text[i]) == 1}
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        self.end = next(i for i, t in enumerate(self.text) if t == "</s>" and self.kind[i] == CONTROL)
        inside = {c for i in long for c in self.text[i]}
        apart = "".join(chr(c) for c in range(128) if chr(c) not in inside)
        whole = any(SPACE in self.text[i].lstrip(SPACE) for i in long)  # then spaces do not part stretches
        edges = re.escape(apart)
        self.stretches = re.compile(f"[{edges}]|[^{edges}]+" if whole else f"[{edges}]|{SPACE}*[^{SPACE}{edges}]+|{SPACE}+").findall
        self.cut = None if whole else re.compile(f"[^{SPACE}]{SPACE}")  # no piece lies on both sides of the second
        self.known = _Known(self.stretch)
        self.letters = frozenset(self.alone)
        self.pair = {rank: np.array([i, len(self.text[i].encode())], np.int32).tobytes() for rank, i in enumerate(ordered)}
        # what each id is written as
        self.written = [self._written(i, trainer.get(UNKNOWN_SURFACE, UNKNOWN_TEXT.encode())) for i in range(len(pieces))]

    def _written(self, i: int, unknown: bytes) -> bytes:
        kind = self.kind[i]
        if kind == BYTE:
            return bytes([int(self.text[i][3:5], 16)])
        return b"" if kind == CONTROL else unknown if kind == UNKNOWN else self.text[i].replace(SPACE, " ").encode()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of ``text`` it comes from."""
        out, sizes, origins, at, byte = [], [], [], 0, 0

        def copy(stretch: str, start: int) -> int:  # unchanged characters, each its own origin
            here = np.frombuffer(stretch.encode(), np.uint8)
            lead = np.flatnonzero((here & 0xC0) != 0x80)
            out.append(stretch.replace(" ", SPACE))
            sizes.append(np.where(here[lead] == 32, 3, np.diff(np.append(lead, len(here)))))
            origins.append(start + lead)
            return start + len(here)

        def put(written: str, origin: int):
            out.append(written.replace(" ", SPACE))
            n = len(out[-1].encode())
            sizes.append(np.array([n]))
            origins.append(np.array([origin]))

        if not self.squeeze:
            if not text:
                return "", np.zeros(1, np.int64)
            if self.prefix:
                put(" ", 0)
            for end, (n, value) in self.longest_prefix.iter_long(text) if self.replaced else ():
                byte = copy(text[at:end + 1 - n], byte)
                put(value, byte)
                byte += len(text[end + 1 - n:end + 1].encode())
                at = end + 1
            byte = copy(text[at:], byte)
        else:  # spaces are units of their own: runs of them become one, and none is left at either end
            units = []
            for end, (n, value) in self.longest_prefix.iter_long(text) if self.replaced else ():
                units += [(s, None) for s in re.split("( )", text[at:end + 1 - n]) if s]
                units.append((text[end + 1 - n:end + 1], value))
                at = end + 1
            units += [(s, None) for s in re.split("( )", text[at:]) if s]
            first = next((i for i, (was, value) in enumerate(units) if (was if value is None else value) != " "), len(units))
            byte = sum(len(was.encode()) for was, _ in units[:first])
            if first == len(units):
                return "", np.full(1, byte)
            if self.prefix:
                put(" ", byte)
            spaced = True
            for was, value in units[first:]:
                here = was if value is None else value
                here = here.lstrip(" ") if spaced else here
                if here and value is None:
                    copy(here, byte)
                elif here:
                    put(here, byte)
                spaced = here.endswith(" ") if here else spaced
                byte += len(was.encode())
        said = "".join(out)
        origin = np.repeat(np.concatenate(origins), np.concatenate(sizes)) if origins else np.zeros(0, np.int64)
        if self.squeeze and said.endswith(SPACE):
            kept = said.rstrip(SPACE)
            size = len(origin) - len(SPACE.encode()) * (len(said) - len(kept))
            said, byte, origin = kept, int(origin[size]), origin[:size]
        return said, np.append(origin, byte)

    def stretch(self, said: str) -> bytes:
        """Ids of a stretch, each beside the number of normalised bytes that it takes."""
        if self.letters.issuperset(said) and not (self.runs and SPACE * 2 in said):
            return b"".join([self.pair[rank] for rank in self.merges.read(self.merges.extend(said, []))])
        ids, start = [], 0

        def merged(part: str):
            table = self.merges.extend(part, [])
            for rank in self.merges.read(table):
                ids.append((self.id_of[rank], len(self.merges.token[rank].encode())))

        for at, char in enumerate(said):
            if char not in self.alone:
                if start < at:
                    merged(said[start:at])
                raw = char.encode()
                ids.extend((self.bytes[b], 0) for b in raw[:-1])
                ids.append((self.bytes[raw[-1]], len(raw)))
                start = at + 1
        if start < len(said):
            merged(said[start:])
        return np.array(self._spaces(ids) if self.runs else ids, np.int32).tobytes()

    def _spaces(self, ids: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Neighbouring spaces joined, the leftmost pair that makes a piece first."""
        out, space, size, held = [], self.alone.get(SPACE), len(SPACE.encode()), 0  # the last ``held`` entries are runs of spaces, by length
        for one in ids:
            if one[0] != space:
                out[len(out) - held:] = [(self.runs.get(n, space), n * size) for n in out[len(out) - held:]]
                out.append(one)
                held = 0
                continue
            n = 1
            while held and out[-1] + n in self.runs:
                n += out.pop()
                held -= 1
            out.append(n)
            held += 1
        out[len(out) - held:] = [(self.runs.get(n, space), n * size) for n in out[len(out) - held:]]
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the end id, and the first byte and the byte after the last of each piece in the text."""
        said, origin = self.normalise(text)
        known, told, at = self.known, [], 0
        while at < len(said):
            cut = self.cut.search(said, at + LONG) if self.cut else None
            end = cut.start() + 1 if cut else len(said)
            told.append(b"".join(map(known.__getitem__, self.stretches(said, at, end))))
            at = end
        pairs = np.frombuffer(b"".join(told), np.int32).reshape(-1, 2)
        cuts = origin[np.append(0, np.cumsum(pairs[:, 1], dtype=np.int64))]
        last = len(text.encode())
        return np.append(pairs[:, 0], np.int32(self.end)), np.append(cuts[:-1], last), np.append(cuts[1:], last)

    def decode(self, ids) -> str:
        """The text of ids: byte pieces in a row are characters where they are well formed, else a replacement character a byte."""
        ids = np.asarray(ids, np.int64)
        parts = [self.written[i] for i in ids.tolist()]
        if self.prefix or self.squeeze:
            for at, i in enumerate(ids.tolist()):
                if self.kind[i] == CONTROL:
                    continue
                if self.kind[i] in (BYTE, UNKNOWN):
                    break
                spaced = parts[at].startswith(b" ")
                parts[at] = parts[at][1:] if spaced else parts[at]
                if parts[at] or spaced and not self.squeeze:
                    break
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return "".join(self._rows(ids, parts))

    def _rows(self, ids: np.ndarray, parts: list[bytes]) -> Iterator[str]:
        of_bytes = self.kind[ids] == BYTE
        cuts = [0, *(np.flatnonzero(of_bytes[1:] != of_bytes[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            raw = b"".join(parts[a:b])
            at = 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        yield raw[at:at + n].decode()
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    yield "�"
                    n = 1
                at += n


def model(path: str) -> Model:
    """The model of a file, one in each Python worker."""
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = Model(f.read())
    return _MODELS[path]


_INTS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 128, decoded: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` with the end id, ``begins`` and ``ends``: the bytes of the UTF-8 text that each piece stands for. With ``decoded`` the
    worker that has the ids at hand decodes them too, which spares another one's memory and the way there."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", _INTS), T.StructField("begins", _INTS), T.StructField("ends", _INTS),
                           *([T.StructField("decoded", T.StringType())] if decoded else [])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                told = [pieces.encode(text) for text in batch.column("text").to_pylist()]
                out = {"doc_id": batch.column("doc_id")} | {c: _lists([t[k].astype(np.int32) for t in told]) for k, c in enumerate(("ids", "begins", "ends"))}
                yield with_columns(batch, schema, out | ({"decoded": pa.array([pieces.decode(t[0]) for t in told], pa.string())} if decoded else {}))
    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str, rows: int = 256) -> DataFrame:
    """The columns of ``encoded`` (``ids`` among them; null ids decode to nothing) and ``decoded``."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                lists = batch.column("ids")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                cuts = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                said = [pieces.decode(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                yield with_columns(batch, schema, {f: batch.column(f) for f in batch.schema.names} | {"decoded": pa.array(said, pa.string())})
    return encoded.mapInArrow(work, schema)
