"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words.

A text is cut into paragraphs at line feeds; a paragraph into leaves after words whose hash is a multiple of
four, so a leaf's cuts depend on its own words alone and an edit moves no cut away from it (a text's first
words are leaves of their own, so short texts have several). A long word, or a leaf of more than LEAF_CHARS characters, is cut
again after characters that a hash of the last few picks, and where none is picked after LEAF_CHARS, so script without spaces has leaves
too and every leaf tells its true length. A section ends with an empty paragraph or one whose hash is a multiple of eight. A node's hash covers its
children's hashes. The fingerprint writes the root, each section's hash, and each leaf as its hash
and length, so it can be compared with another without the texts: equal roots for equal texts, equal
sections skipped, differing leaves with their places.

Defined results: null text is empty (one empty leaf); two fingerprints are alike by twice the common leaf
length over the sum of both, 1 for equal ones; a row's next document is the one after it by id, then text,
and the first after the last (a single row follows itself); a null id comes first; repeated rows follow each
other; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, with_columns
from .textarrays import Slice, byte_hash, mix, range_hash, slices, words

LEAF_WORDS, SECTION_PARAGRAPHS, FIRST_WORDS = 4, 8, 16  # mean words of a leaf, mean paragraphs of a section, leaves of one word
LEAF_CHARS, WORD_BYTES, LAST_CHARS = 63, 24, 3  # most characters of a leaf, bytes of a word that stays whole, characters that pick a cut
IN_WORD, IN_LEAF = 8, 32  # mean characters between the cuts in a long word, and in a long leaf of several words
_CODE = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
_BACK = np.zeros(256, np.int64)
_BACK[_CODE] = np.arange(64)


def _hex(values: np.ndarray, digits: int) -> np.ndarray:
    shifts = np.arange(4 * (digits - 1), -1, -4, dtype=np.uint64)
    return _HEX[((values[:, None] >> shifts) & np.uint64(15)).astype(np.int64)]


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first[i]:last[i] one range after another, and i of each."""
    n = np.maximum(last - first, 0)
    of = np.repeat(np.arange(len(n)), n)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def _inner_cuts(data: np.ndarray, start: np.ndarray, end: np.ndarray, w_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places inside leaves at which they are cut again, and the number of the leaf of each. They depend on the leaf's text alone."""
    wide = np.flatnonzero(end - start > WORD_BYTES)
    if not len(wide):
        return np.zeros(0, np.int64), wide
    at = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
    low, high = np.searchsorted(at, start[wide]), np.searchsorted(at, end[wide])
    one = np.searchsorted(w_start, end[wide]) - np.searchsorted(w_start, start[wide]) <= 1
    long = np.flatnonzero(one | (high - low > LEAF_CHARS))
    wide, low, high, one = wide[long], low[long], high[long], one[long]
    if not len(wide):
        return np.zeros(0, np.int64), wide
    char, of = _ranges(low + LAST_CHARS, high)
    picked = byte_hash(data, at[char - LAST_CHARS], at[char], 4)
    # a run of one character is not cut at each
    again = np.append(False, (picked[1:] == picked[:-1]) & (of[1:] == of[:-1])) if len(of) else np.zeros(0, bool)
    cut = (picked % np.where(one, np.uint64(IN_WORD), np.uint64(IN_LEAF))[of] == 0) & ~again
    # pieces that are still too long
    p_low, p_of = np.concatenate((low, char[cut])), np.concatenate((np.arange(len(low)), of[cut]))
    order = np.lexsort((p_low, p_of))
    p_low, p_of = p_low[order], p_of[order]
    p_high = np.append(p_low[1:], 0)
    closing = np.append(p_of[1:] != p_of[:-1], True)
    p_high[closing] = high[p_of[closing]]
    turn, piece = _ranges(np.ones(len(p_low), np.int64), 1 + np.maximum(p_high - p_low - 1, 0) // LEAF_CHARS)
    places = np.concatenate((char[cut], p_low[piece] + turn * LEAF_CHARS))
    return at[places], wide[np.concatenate((of[cut], p_of[piece]))]


def _leaves(part: Slice) -> tuple[np.ndarray, ...]:
    """Starts, ends, number of the text and of the paragraph of each leaf, in order; paragraphs' first leaves."""
    data, offsets = part.data, part.offsets
    breaks = np.flatnonzero(data == 0x0A)
    docs = len(offsets) - 1
    doc_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    p_doc = np.concatenate((np.arange(docs), doc_of_break))
    p_start = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((p_start, p_doc))
    p_doc, p_start = p_doc[order], p_start[order]
    p_end = np.empty_like(p_start)
    p_end[:-1] = p_start[1:] - 1
    last = np.append(p_doc[1:] != p_doc[:-1], True)
    p_end[last] = offsets[1:][p_doc[last]]
    w_start, w_end, w_first = words(part)
    early = np.arange(len(w_start)) - np.repeat(w_first[:-1], np.diff(w_first)) < FIRST_WORDS
    cut = np.flatnonzero(early[:-1] | (byte_hash(data, w_start, w_end, 3)[:-1] % np.uint64(LEAF_WORDS) == 0)) + 1 if len(w_start) else np.zeros(0, np.int64)
    # paragraphs of a text start one byte apart at least, empty ones included; texts are told apart by their number
    filled = np.flatnonzero(p_end > p_start)
    at = filled[np.searchsorted(p_start[filled], w_start[cut], side="right") - 1] if len(filled) else np.zeros(0, np.int64)
    inside = w_start[cut] > p_start[at]
    before = w_start[np.maximum(cut - 1, 0)] >= p_start[at]
    inside &= before
    l_start = np.concatenate((p_start, w_start[cut][inside]))
    l_par = np.concatenate((np.arange(len(p_start)), at[inside]))
    order = np.lexsort((l_start, l_par))
    l_start, l_par = l_start[order], l_par[order]
    first = np.append(True, l_par[1:] != l_par[:-1])
    l_end = np.append(l_start[1:], 0)
    closing = np.append(first[1:], True)
    l_end[closing] = p_end[l_par[closing]]
    inner, leaf = _inner_cuts(data, l_start, l_end, w_start)
    if len(inner):
        l_of = np.concatenate((np.arange(len(l_start)), leaf))
        n_start = np.concatenate((l_start, inner))
        order = np.lexsort((n_start, l_of))
        n_start, l_of = n_start[order], l_of[order]
        opens, closes = np.append(True, l_of[1:] != l_of[:-1]), np.append(l_of[1:] != l_of[:-1], True)
        n_end = np.append(n_start[1:], 0)
        n_end[closes] = l_end[l_of[closes]]
        l_start, l_end, l_par, first = n_start, n_end, l_par[l_of], opens & first[l_of]
    return l_start, l_end, p_doc[l_par], first, p_end > p_start


def fingerprints(column: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """The fingerprint of each text, and its leaves as numbers (24 bits of hash, 6 of length), sorted."""
    out, leaves = [], []
    for part in slices(column):
        start, end, doc, first, full = _leaves(part)
        chars = np.cumsum(np.append(0, (part.data & 0xC0) != 0x80))
        length = (chars[end] - chars[start]).astype(np.uint64)
        h = byte_hash(part.data, start, end, 5)
        p_first = np.flatnonzero(first)
        p_hash = range_hash(h, p_first, np.append(p_first[1:], len(h)), 6)
        p_doc = doc[p_first]
        closes = (~full | (p_hash % np.uint64(SECTION_PARAGRAPHS) == 0)) | np.append(p_doc[1:] != p_doc[:-1], True)
        s_first = np.flatnonzero(np.append(True, closes[:-1]))
        s_hash = range_hash(p_hash, s_first, np.append(s_first[1:], len(p_hash)), 7)
        s_doc = p_doc[s_first]
        d_first = np.searchsorted(s_doc, np.arange(len(part.offsets)))
        roots = np.hstack((_hex(range_hash(s_hash, d_first[:-1], d_first[1:], 8), 16), _hex(range_hash(mix(s_hash, 9), d_first[:-1], d_first[1:], 9), 16)))
        code = ((h >> np.uint64(40)) << np.uint64(6)) | length
        section = np.zeros(len(h), bool)
        section[p_first[s_first]] = True
        size = 5 + first.astype(np.int64) + 9 * section
        at = np.cumsum(size) - size
        text = np.zeros(int(size.sum()), np.uint8)
        text[at[section]] = ord("/")
        text[at[section][:, None] + np.arange(1, 9)] = _hex(s_hash, 8)
        at += 9 * section
        text[at[first]] = ord(":")
        at += first
        text[at[:, None] + np.arange(5)] = _CODE[((code[:, None] >> np.array([24, 18, 12, 6, 0], np.uint64)) & np.uint64(63)).astype(np.int64)]
        cuts = np.append(np.cumsum(size) - size, len(text))[np.searchsorted(doc, np.arange(len(part.offsets)))]
        for i in range(len(cuts) - 1):
            out.append(roots[i].tobytes().decode() + text[cuts[i]:cuts[i + 1]].tobytes().decode())
        bounds = np.searchsorted(doc, np.arange(len(part.offsets)))
        leaves += [np.sort(code[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return out, leaves


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the common leaf length over the sum of both; leaves count as often as they occur."""
    weight = lambda x: np.maximum(x & np.uint64(63), np.uint64(1)).astype(np.float64)
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    values, counts = np.unique(both, return_counts=True)
    in_a = np.searchsorted(a, values, side="right") - np.searchsorted(a, values)
    return float(2 * (np.minimum(in_a, counts - in_a) * weight(values)).sum() / weight(both).sum())


def read(fingerprint: str) -> list[tuple[str, list[list[tuple[int, int]]]]]:
    """Sections of a fingerprint: (hash, paragraphs of (leaf, length))."""
    out = []
    for section in fingerprint[32:].split("/")[1:]:
        paragraphs = []
        for p in section[8:].split(":")[1:]:
            codes = _BACK[np.frombuffer(p.encode(), np.uint8)].reshape(-1, 5)
            paragraphs.append([(int(c[0] << 18 | c[1] << 12 | c[2] << 6 | c[3]), int(c[4])) for c in codes])
        out.append((section[:8], paragraphs))
    return out


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1; equal roots end the comparison."""
    if a == b:
        return 1.0
    leaves = [np.sort(np.array([x << 6 | n for _, ps in read(f) for p in ps for x, n in p], np.uint64)) for f in (a, b)]
    return _alike(*leaves)


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of the first fingerprint that the second lacks; whole equal branches are skipped."""
    there = read(b)
    sections, paragraphs = {s for s, _ in there}, {tuple(p) for _, ps in there for p in ps}
    return [(i, j) for i, (s, ps) in enumerate(read(a)) if s not in sections for j, p in enumerate(ps) if tuple(p) not in paragraphs]


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents in ranges of ids, one per partition and sorted, each followed by the first document of
    the range after it (``follows``), the last by the first of all. Texts are shuffled once; the driver holds one id
    per range."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = docs.withColumn("order", key)
    ids = docs.select("order")
    bounds = np.unique(np.array(ids.approxQuantile("order", [i / parts for i in range(1, parts)], 1 / (8 * parts)), np.float64)).astype(np.int64) if parts > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def place(x):
        import pandas as pd
        return pd.Series(np.searchsorted(bounds, x.to_numpy(), side="right").astype(np.int32))

    heads = sorted((r["place"], r["head"]) for r in ids.groupBy(place("order").alias("place")).agg(F.min("order").alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def places(x):
        import pandas as pd
        own = np.searchsorted(bounds, x.to_numpy(), side="right")
        return pd.Series([[p, before[v]] if v in before else [p] for p, v in zip(own.tolist(), x.tolist())])

    dealt = docs.select("doc_id", "text", "text_key", "order", F.posexplode(places("order")).alias("follows", "place"))
    return dealt.repartitionById(max(parts, 1), "place").sortWithinPartitions("follows", "order", "text_key").select("doc_id", "text", F.col("follows").alias("follows"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """Fingerprints of every text, of its edited text (the last quarter of its characters replaced by the next
    document's first as many), and how alike they and the next document's are."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
                           T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
                           T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: its next one has not come yet
        ended = False
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids, texts, follows = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("follows").to_pylist()
                n = next((i for i, f in enumerate(follows) if f), len(follows))
                if ended:
                    continue
                ended, n = n < len(follows), min(n + 1, len(follows))
                ids, texts = ids[:n], texts[:n]
                prints, leaves = fingerprints(pa.array(texts, pa.large_string()))
                run = list(zip(ids, texts, prints, leaves))
                if held:
                    run.insert(0, held)
                held = run[-1]
                if len(run) < 2:
                    continue
                edited = [t[:len(t) - len(t) // 4] + after[1][:len(t) // 4] for (_, t, _, _), after in zip(run, run[1:])]
                e_prints, e_leaves = fingerprints(pa.array(edited, pa.large_string()))
                yield with_columns(batch, schema, {
                    "doc_id": [r[0] for r in run[:-1]], "n_chars": [len(r[1]) for r in run[:-1]],
                    "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                    "fingerprint": [r[2] for r in run[:-1]], "edited_fingerprint": e_prints,
                    "near_edited": [_alike(r[3], e) for r, e in zip(run, e_leaves)],
                    "near_next": [_alike(r[3], after[3]) for r, after in zip(run, run[1:])]})

    return _ordered(documents(docs, id_col, text_col)).mapInArrow(work, schema)
