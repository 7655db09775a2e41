"""How far the sources of a language are apart in their words, from an index built in memory block by block.

Each task reads its documents once and counts terms in a block of postings, (language, source, term) with its occurrences and
documents; a document has one source, so a language's documents of a term are the sum over its sources. A block that has grown to ``block`` entries is spilled
as a run, sorted by term, and a new one begun. Runs go to shards by the hash of language and term, where Spark's external sort merges them through a heap of its sorted
spills, and equal entries are added up into frequencies. A term that too few documents of its language hold ends there.

The distance of two sources is a sum over all kept terms, most of which neither has. So it is taken as if no source had any term, and
corrected: by what each source's own terms add against another's share of an absent term, which prefix sums over the
source's few distinct shares tell, and by what terms that both have differ from that, which is streamed over the postings of one term after the
other, added up inside the tasks. No row is made for a term that a source lacks. What goes out is one row for each two sources of a
language, as the result has, and the postings of one term are the most that a task holds.

Shares are 1 + floor(SCALE * (count + ADD) / (N + ADD * V)), in whole numbers: decimals of 38 digits while they are made, so counts may reach 10^28.

Defined results: null text, language and source are empty strings; a null or repeated id does not matter, every row is a document; a
language without kept terms has pairs of value 0 and no terms; a language with one source has no pairs; ties go by the item's bytes; an
empty table gives no rows; other columns are not read. A long text is read in slices of SLICE bytes, cut between terms.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, store, with_columns

DOCUMENTS, TERMS = 30, 50
SCALE, ADD = 1_000_000_000, 5
BLOCK, SLICE, PAIRS = 500_000, 1 << 22, 1 << 20
SMALL = 50_000  # sources (of all languages) whose totals are sent to every task; more are joined by shuffle

#: ASCII letters in lower case and all bytes of other characters stay, the rest of ASCII parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RUNS = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _slices(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > SLICE:
        folded = raw[at:at + SLICE].translate(_FOLD)
        end = folded.rfind(b" ") + 1
        size = SLICE
        while not end:  # a term longer than a slice
            size *= 2
            folded = raw[at:at + size].translate(_FOLD)
            end = folded.rfind(b" ") + 1 or (len(folded) if at + size >= len(raw) else 0)
        yield raw[at:at + end]
        at += end
    yield raw[at:]


def runs(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Spilled runs: occurrences and documents of (lang, source, term). ``docs`` has ``lang``, ``source``, ``text`` without nulls."""
    schema = T.StructType.fromDDL(_RUNS)
    of_term = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def spilled(found: dict) -> Iterator[pa.RecordBatch]:
        parts = []
        for (lang, source), (counts, held) in found.items():
            size = len(counts)
            term = pa.array(counts.keys(), pa.binary(), size=size).cast(pa.string())
            docs_of = np.fromiter(map(held.__getitem__, counts), np.int64, size)
            same = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(size, np.int32)), pa.array([x], pa.string())).cast(pa.string()) for x in (lang, source)]
            parts.append(pa.Table.from_arrays([*same, term, pa.array(np.fromiter(counts.values(), np.int64, size)), pa.array(docs_of)], schema=of_term))
        run = pa.concat_tables(parts, promote_options="none") if parts else of_term.empty_table()
        yield from run.sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")]).combine_chunks().to_batches(65_536)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                raw = text.as_buffer()
                counts, held = found.setdefault((lang, source), (Counter(), Counter()))
                before = len(counts)
                seen = set()
                for part in _slices(raw.to_pybytes()) if raw.size else ():
                    said = terms(part)
                    counts.update(said)
                    seen.update(said)
                held.update(seen)
                size += len(counts) - before
                if size >= block:
                    yield from spilled(found)
                    found, size = {}, 0
        yield from spilled(found)
    return docs.select("lang", "source", "text").mapInArrow(work, schema)


def frequencies(docs: DataFrame, documents: int = DOCUMENTS, block: int = BLOCK) -> DataFrame:
    """``lang``, ``term``, ``source``, ``n`` and ``lang_n`` (occurrences in the source and in the language) of the terms that at least
    ``documents`` documents of the language hold."""
    sorted_runs = runs(docs, block).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    merged = sorted_runs.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return (merged.withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_docs", F.sum("docs").over(term))
            .filter(F.col("lang_docs") >= documents).select("lang", "term", "source", "n", "lang_n"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + ADD) / (total + ADD * kept)), exactly; null where no term is kept."""
    wide = lambda c: c.cast("decimal(28,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + F.lit(ADD).cast("decimal(1,0)"))
    return F.when(kept > 0, F.call_function("div", above, wide(total) + F.lit(ADD).cast("decimal(1,0)") * wide(kept)) + 1)


def _corrections(postings: DataFrame) -> DataFrame:
    """``a``, ``b``, ``more``: for the sources a < b, what the terms that both have add to the sum of their separate corrections.
    ``postings`` (lang, term, g, p, zero) are sorted by (lang, term) within partitions, all of a term in one."""
    schema = T.StructType.fromDDL("a long, b long, more long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((0, 2), np.int64), np.zeros(0, np.int64)]
        waiting = []  # sums of slices, not yet added up
        size = 0

        def added() -> None:
            nonlocal size
            keys, more = np.concatenate([sums[0], *[k for k, _ in waiting]]), np.concatenate([sums[1], *[m for _, m in waiting]])
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, more = keys[order], more[order]
            first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.zeros(0, np.int64)
            sums[0], sums[1] = keys[first], np.add.reduceat(more, first) if len(first) else more
            waiting.clear()
            size = 0

        def emitted() -> pa.RecordBatch:
            out = with_columns(None, schema, {"a": sums[0][:, 0], "b": sums[0][:, 1], "more": sums[1]})
            sums[0], sums[1] = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
            return out

        def taken(g, p, zero, ends) -> Iterator[pa.RecordBatch]:
            """All pairs of postings of the same term; ``ends``: where the term of each posting ends."""
            nonlocal size
            after = ends - np.arange(len(g)) - 1
            cuts = np.searchsorted(np.cumsum(after), np.arange(0, int(after.sum()) + PAIRS, PAIRS))
            cuts = np.unique(np.append(cuts, [0, len(g)]).clip(0, len(g)))
            for low, high in zip(cuts[:-1], cuts[1:]):
                n = after[low:high]
                i = np.repeat(np.arange(low, high), n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                turn = g[i] > g[j]
                i, j = np.where(turn, j, i), np.where(turn, i, j)
                more = np.abs(p[i] - p[j]) - np.abs(p[i] - zero[j]) - np.abs(zero[i] - p[j]) + np.abs(zero[i] - zero[j])
                waiting.append((np.stack((g[i], g[j]), axis=1), more))
                size += len(i)
                if size >= 2 * PAIRS:
                    added()
                    if len(sums[0]) >= 2 * PAIRS:
                        yield emitted()

        held, name = None, None  # postings of the last term so far
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term = batch.column("lang"), batch.column("term")
            new = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.not_equal(term.slice(1), term.slice(0, len(term) - 1))).to_numpy(zero_copy_only=False)
            first = (lang[0].as_py(), term[0].as_py()) != name
            name = lang[-1].as_py(), term[-1].as_py()
            rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "p", "zero"))
            starts = np.flatnonzero(np.append(first, new))
            if held is not None:
                starts = np.append(0, starts + len(held[0]))
                rows = tuple(np.concatenate(x) for x in zip(held, rows))
            last = int(starts[-1])
            if last:
                yield from taken(*[x[:last] for x in rows], np.repeat(starts[1:], np.diff(starts)))
            held = tuple(x[last:] for x in rows)
        if held is not None:
            yield from taken(*held, np.full(len(held[0]), len(held[0])))
        added()
        if len(sums[0]):
            yield emitted()
    return postings.select("lang", "term", "g", "p", "zero").mapInArrow(work, schema)


def audit(docs: DataFrame, documents: int = DOCUMENTS, top: int = TERMS, block: int = BLOCK, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value``, ``rank``."""
    spark = docs.sparkSession
    plain = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    said = docs.select(plain(lang_col, "lang"), plain(source_col, "source"), plain(text_col, "text"))
    found, found_path = store(frequencies(said, documents, block))

    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = found.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = said.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "kept", "lang_total")], F.monotonically_increasing_id().alias("g"))
    groups, groups_path = store(groups.withColumn("zero", _share(F.lit(0), F.col("total"), F.col("kept"))))
    small = groups.count() <= SMALL
    facts = F.broadcast(groups) if small else groups

    shares = found.join(facts, ["lang", "source"]).select("lang", "term", "source", "g", "zero", "kept", "total", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
                                                          _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    shares, shares_path = store(shares)
    drop(spark, found_path)

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    said_more = (shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
                 .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))

    # the share of an absent term, and the sum of each source's own terms against it
    points = shares.groupBy("g", "p").agg(F.count("*").alias("n"))
    own = points.groupBy("g").agg(F.sum("n").alias("own_n"), F.sum(F.col("p") * F.col("n")).alias("own_p"))
    one = groups.join(own, "g", "left").na.fill(0, ["own_n", "own_p"]).select("lang", "source", "g", "kept", "zero", "own_n", "own_p")
    other = one.select("lang", *[F.col(c).alias(f"o_{c}") for c in ("source", "g", "zero", "own_n")])
    pairs, pairs_path = store((F.broadcast(other) if small else other).join(one, "lang").filter("g <> o_g"))
    asked = points.select("g", F.col("p").alias("at"), "n", (F.col("p") * F.col("n")).alias("np"), F.lit(None).cast("long").alias("o_g")).unionByName(
        pairs.filter("kept > 0").select("g", F.col("o_zero").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("np"), "o_g"))
    upto = Window.partitionBy("g").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below = asked.withColumn("low_n", F.sum("n").over(upto)).withColumn("low_p", F.sum("np").over(upto)).filter("o_g is not null").select("g", "o_g", "low_n", "low_p")

    postings = shares.select("lang", "term", "g", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = _corrections(postings).groupBy("a", "b").agg(F.sum("more").alias("more"))
    base = F.abs(F.col("zero") - F.col("o_zero"))
    # one source's terms against the other's absent ones, less what they were counted as before
    half = (F.col("o_zero") * (2 * F.col("low_n") - F.col("own_n")) + F.col("own_p") - 2 * F.col("low_p")) - F.col("own_n") * F.col("base")
    halves = pairs.withColumn("base", base).join(below, ["g", "o_g"], "left").select("lang", "source", "o_source", "kept", "base", F.coalesce(half, F.lit(0)).alias("half"),
                                                                                    F.least("g", "o_g").alias("a"), F.greatest("g", "o_g").alias("b"))
    apart = halves.groupBy("lang", "a", "b").agg(F.min(F.struct("source", "o_source")).alias("names"), F.max("kept").alias("kept"), F.max("base").alias("base"), F.sum("half").alias("half"))
    apart = apart.join(both, ["a", "b"], "left").select("lang", "names", (F.coalesce(F.col("kept") * F.col("base") + F.col("half") + F.coalesce("more", F.lit(0)), F.lit(0))).alias("value"))
    sides = apart.select("lang", F.explode(F.array(F.struct(F.col("names.source").alias("source"), F.col("names.o_source").alias("item")),
                                                   F.struct(F.col("names.o_source").alias("source"), F.col("names.source").alias("item")))).alias("s"), "value")
    differing = sides.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order))
    out, _ = store(said_more.unionByName(differing))
    drop(spark, shares_path, groups_path, pairs_path)
    return out
