"""Secret scans: fixed patterns, and a randomness test battery for the strings they do not name.

Base spans come from three patterns. Further candidates are runs of 20 or more characters of one encoding (hexadecimal,
base 32 or base 64 with its variants), or what base spans leave of them where that is as long. Each gets three p-values under uniform draws from its encoding's
alphabet: chi-squared over the alphabet's cells, runs of characters above and below the alphabet's middle, and lag-one serial
correlation. A string that fails any (Bonferroni) is no random key. For the rest the null is turned round: exp(-gain),
where gain is its log-likelihood under uniform draws less that under the frequencies of pairs of characters in plain text,
bounds the chance that plain text looks so random (Markov's inequality on the likelihood ratio). Plain text is the words of all documents that are too short for candidates, and, as far as
they are many enough to say more, all candidates that failed. Both sides take capitals for small
letters, so words are words in any case. Benjamini-Hochberg over these
p-values, within bands of length counted over all documents, controls the share of false finds. Plain DataFrame expressions
throughout; the driver holds one count per pair of characters of the alphabets and one limit per band.

Defined results: null text is empty and has no span; offsets count characters, end exclusive; repeated rows get equal
spans; a null id is kept as it is; an empty table gives no rows; other columns are kept out. Spans of the battery do not overlap base spans. A text with n matches
costs about n to the power of 1.5 steps: lists are worked on in chunks of the root of their size.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailrank.functions.columns import let

from .common import documents, store, whole_rows, with_text

# The base patterns and the least length that their matches need, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST_ACCESS, LEAST_HEX, LEAST_VALUE = 20, 24, 6

LEAST_CANDIDATE = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_CANDIDATE
#: Alphabets by inferred encoding, in the order of their digits.
ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
FOLDED = "abcdefghijklmnopqrstuvwxyz0123456789+/"  # without case
LEVEL, FALSE_SHARE = 1e-4, 1e-3  # of rejecting randomness; of false finds
BAND, LAST_BAND = 8, 63  # characters of a length band; the last one is open


def _chunked(items: Column) -> Column:
    """A list as a list of lists of about the root of its size; an empty one has none."""
    def cut(v):
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(1), F.ceil(F.size(v) / size).cast("int")), lambda i: F.slice(v, (i - 1) * size + 1, size))).otherwise(F.slice(F.array(v), 1, 0))
    return let(items, cut)


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value) in characters: the pieces between them and their own
    lengths add up, within chunks and then from chunk to chunk."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    lengths = F.transform(found, lambda x: F.length(x))
    both = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), lengths.alias("len"), found.alias("value"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + x["len"]).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["value"].alias("value"))).alias("out"))

    def after(acc, part):
        return F.struct((acc["at"] + part["at"]).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("by"), part["out"].alias("part"))).alias("out"))

    placed = F.transform(_chunked(both), lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), empty.alias("out")), step))
    none = F.expr("cast(array() as array<struct<by:int,part:array<struct<start:int,end:int,value:string>>>>)")
    chunks = F.aggregate(placed, F.struct(F.lit(0).alias("at"), none.alias("out")), after, lambda acc: acc["out"])
    ran = F.flatten(F.transform(chunks, lambda c: F.transform(c["part"], lambda x: F.struct((x["start"] + c["by"]).alias("start"), (x["end"] + c["by"]).alias("end"), x["value"].alias("value")))))
    return F.when(text.rlike(pattern), ran).otherwise(empty)


def _as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _upper_normal(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic form, good to a few 1e-4, tails kept above zero)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z)))


def _battery(value: Column) -> Column:
    """(encoding, n, chi-squared, runs and serial-correlation p-values) of one string."""
    body = F.translate(F.rtrim(value, F.lit("=")), "-_", "+/")
    kind = (F.when(body.rlike("^[0-9a-f]+$"), "hex").when(body.rlike("^[0-9A-F]+$"), "HEX").when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64"))
    alphabet = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])[kind]
    return F.struct(kind.alias("kind"), alphabet.alias("alphabet"), F.length(alphabet).cast("double").alias("cells"), F.length(body).cast("double").alias("n"), body.alias("body"))


def score(candidates: DataFrame, value_col: str = "value") -> DataFrame:
    """The candidates with ``p_chi``, ``p_runs``, ``p_serial`` under uniform draws, ``looks_random``, ``n``, ``encoding``."""
    d = candidates.withColumn("_b", _battery(F.col(value_col))).select("*", "_b.*").drop("_b").withColumnRenamed("kind", "encoding")
    d = d.withColumn("_x", F.expr("transform(filter(split(body, ''), c -> c <> ''), c -> cast(instr(alphabet, c) - 1 as double))"))
    # few characters for many cells: neighbouring cells are joined until each expects about five
    d = d.withColumn("_g", F.greatest(F.lit(2.0), F.least(F.col("cells"), F.floor(F.col("n") / 5))))
    d = d.withColumn("_cell", F.expr("transform(_x, x -> cast(floor(x * _g / cells) as int))"))
    d = d.withColumn("_sq", F.expr("""aggregate(sequence(0, cast(_g as int) - 1), cast(0 as double), (a, g) -> a + pow(size(filter(_cell, c -> c = g)) -
        n * (ceil((g + 1) * cells / _g) - ceil(g * cells / _g)) / cells, 2) / (n * (ceil((g + 1) * cells / _g) - ceil(g * cells / _g)) / cells))"""))
    df = F.col("_g") - 1
    # Wilson-Hilferty: the cube root of a chi-squared value over its degrees is close to normal
    d = d.withColumn("p_chi", _upper_normal((F.pow(F.col("_sq") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))))
    d = d.withColumn("_up", F.expr("transform(_x, x -> if(x >= cells / 2, 1, 0))"))
    d = d.withColumn("_n1", F.expr("cast(aggregate(_up, 0, (a, u) -> a + u) as double)")).withColumn("_n0", F.col("n") - F.col("_n1"))
    d = d.withColumn("_runs", F.expr("1D + aggregate(sequence(1, cast(n as int) - 1), 0, (a, i) -> a + if(_up[i] <> _up[i - 1], 1, 0))"))
    mean = 2 * F.col("_n0") * F.col("_n1") / F.col("n") + 1
    var = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    d = d.withColumn("p_runs", F.when(var > 0, 2 * _upper_normal(F.abs(F.col("_runs") - mean) / F.sqrt(var))).otherwise(0.0))
    d = d.withColumn("_m", F.expr("aggregate(_x, cast(0 as double), (a, x) -> a + x) / n"))
    d = d.withColumn("_v", F.expr("aggregate(_x, cast(0 as double), (a, x) -> a + (x - _m) * (x - _m))"))
    d = d.withColumn("_r", F.when(F.col("_v") > 0, F.expr("aggregate(sequence(1, cast(n as int) - 1), cast(0 as double), (a, i) -> a + (_x[i] - _m) * (_x[i - 1] - _m)) / _v")).otherwise(1.0))
    d = d.withColumn("p_serial", 2 * _upper_normal(F.abs((F.col("_r") + 1 / F.col("n")) * F.sqrt("n"))))
    d = d.withColumn("looks_random", F.least("p_chi", "p_runs", "p_serial") >= LEVEL / 3)
    return d.drop("_x", "_g", "_cell", "_sq", "_up", "_n1", "_n0", "_runs", "_m", "_v", "_r", "alphabet")


def _reaches(base: Column) -> Column:
    """The sorted base spans in chunks, each with the stretch of text that it reaches over."""
    return F.transform(_chunked(base), lambda part: F.struct(F.array_min(F.transform(part, lambda b: b["start"])).alias("low"),
                                                             F.array_max(F.transform(part, lambda b: b["end"])).alias("high"), part.alias("part")))


def _outside(x: Column, reaches: Column) -> Column:
    """The parts of a candidate outside the base spans that are long enough for candidates of their own."""
    def part(start, end):
        return F.struct(start.alias("start"), end.alias("end"), F.substring(x["value"], start - x["start"] + 1, F.greatest(end - start, F.lit(0))).alias("value"))

    near = F.flatten(F.transform(F.filter(reaches, lambda c: (c["low"] < x["end"]) & (x["start"] < c["high"])), lambda c: c["part"]))
    return let(F.filter(near, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])), lambda touching: _parts(x, touching, part))


def _parts(x: Column, touching: Column, part: Callable[[Column, Column], Column]) -> Column:
    ran = F.aggregate(touching, F.struct(x["start"].alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out")),
                      lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.array_append(acc["out"], part(acc["at"], b["start"])).alias("out")),
                      lambda acc: F.array_append(acc["out"], part(acc["at"], x["end"])))
    return F.when(F.size(touching) == 0, F.array(x)).otherwise(F.filter(ran, lambda p: F.length(F.rtrim(p["value"], F.lit("="))) >= LEAST_CANDIDATE))


def _pair_costs(counts: dict[int, int], words: dict[int, int]) -> tuple[list[float], list[float]]:
    """Negative logarithms of the shares of characters, and of pairs among those that begin alike, in candidates that failed (``counts``), shrunk to those in
    words, which are shrunk to the characters' shares. Counts are of character c at -1 - c, of characters a, b at a * len(FOLDED) + b."""
    k = len(FOLDED)

    def shares(found, one_before, two_before):
        n = Counter(found)
        total = sum(n[-1 - c] for c in range(k)) + k
        one = [(n[-1 - c] + k * one_before[c]) / total for c in range(k)]
        begun = [sum(n[a * k + b] for b in range(k)) for a in range(k)]
        return one, [(n[a * k + b] + k * (two_before[a * k + b] if two_before else one[b])) / (begun[a] + k) for a in range(k) for b in range(k)]

    one, two = shares(counts, *shares(words, [1 / k] * k, None))
    return [-math.log(x) for x in one], [-math.log(x) for x in two]


def _word_pairs(docs: DataFrame) -> DataFrame:
    """``p``, ``n``: how often characters begin words and pairs stand in words, over all texts: words are counted first, so each is taken apart once."""
    k = len(FOLDED)
    words = docs.select(F.explode(F.split("text", "[^A-Za-z0-9+/]+")).alias("w")).groupBy("w").agg(F.count("*").alias("times")).filter(F.length("w").between(1, LEAST_CANDIDATE - 1))  # a longer one may be a key
    codes = words.select("times", F.expr(f"transform(filter(split(lower(w), ''), c -> c <> ''), c -> instr('{FOLDED}', c) - 1)").alias("c"))
    pairs = F.when(F.size("c") > 1, F.expr(f"transform(sequence(1, size(c) - 1), i -> c[i - 1] * {k} + c[i])")).otherwise(F.expr("cast(array() as array<int>)"))
    return codes.select("times", F.explode(F.concat(F.transform("c", lambda c: -1 - c), pairs)).alias("p")).groupBy("p").agg(F.sum("times").alias("n"))


def _searched(docs: DataFrame) -> DataFrame:
    """One row per document, without its text: base spans, and the candidates outside them."""
    text = F.col("text")
    d = docs.select("doc_id", "text_key",
                    F.filter(_matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= LEAST_VALUE).alias("_assign"),
                    F.filter(_matches(text, ACCESS), lambda x: x["end"] - x["start"] >= LEAST_ACCESS).alias("_access"),
                    # runs are greedy and do not overlap, so those that are long enough are the ones a lower bound finds
                    _matches(text, HEX.replace("+", "{%d,}" % LEAST_HEX)).alias("_hex"),
                    _matches(text, CANDIDATE).alias("_more"))
    d = d.select("doc_id", "text_key", "_more", F.array_sort(F.concat(_as_spans(F.col("_assign"), 0), _as_spans(F.col("_access"), 1), _as_spans(F.col("_hex"), 2))).alias("base"))
    return d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", "base",
                    F.flatten(let(_reaches(F.col("base")), lambda reaches: F.transform("_more", lambda x: _outside(x, reaches)))).alias("more"))


def _discoveries(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates that are held to be random keys; ``words``: counts of characters and pairs in the words of all texts."""
    k = len(FOLDED)
    candidates = candidates.withColumn("_c", F.expr(f"transform(filter(split(lower(body), ''), c -> c <> ''), c -> instr('{FOLDED}', c) - 1)"))
    pairs = F.expr(f"transform(sequence(1, size(_c) - 1), i -> _c[i - 1] * {k} + _c[i])")
    said = candidates.filter("not looks_random").select(F.explode(F.concat(F.transform("_c", lambda c: -1 - c), pairs)).alias("p"))
    one, two = _pair_costs({r["p"]: r["n"] for r in said.groupBy("p").agg(F.count("*").alias("n")).collect()}, {r["p"]: r["n"] for r in words.collect()})
    first, then = (F.expr(f"array({','.join(f'{x!r}D' for x in costs)})") for costs in (one, two))
    cost = F.aggregate(pairs, first[F.col("_c")[0]], lambda a, p: a + then[p])
    # under uniform draws from base 64 a letter of either case comes twice as often as another character
    twice = F.when(F.col("encoding") == "base64", F.length(F.regexp_replace("body", "[^A-Za-z]", ""))).otherwise(0)
    gain = cost - F.col("n") * F.log("cells") + twice * math.log(2)
    scored = candidates.filter("looks_random").withColumn("step", F.floor(gain * 10)).withColumn("band", F.least(F.floor(F.col("n") / BAND), F.lit(LAST_BAND)))
    tested = candidates.groupBy(F.least(F.floor(F.col("n") / BAND), F.lit(LAST_BAND)).alias("band")).agg(F.count("*").alias("tested"))
    # step-up limits from counts by band and tenths of gain, a table that does not grow with the input
    counts = scored.groupBy("band", "step").agg(F.count("*").alias("found"))
    ranked = counts.withColumn("rank", F.sum("found").over(Window.partitionBy("band").orderBy(F.desc("step")))).join(tested, "band")
    limits = {r["band"]: r["least"] for r in ranked.filter(F.exp(-F.col("step") / 10) <= FALSE_SHARE * F.col("rank") / F.col("tested"))
              .groupBy("band").agg(F.min("step").alias("least")).collect()}
    if not limits:
        return scored.filter("false")
    return scored.filter(F.col("step") >= F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("band")])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_key``, ``base`` and ``spans``: arrays of (start, kind, end), kind by its place in KINDS. Texts are
    read once and never shuffled."""
    texts = documents(docs, id_col, text_col)
    found, _ = store(_searched(texts))
    candidates, _ = store(score(found.select("row", F.explode("more").alias("m")).select("row", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.value").alias("value"))))
    keys = _discoveries(candidates, _word_pairs(texts)).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("keys"))
    both = found.select("row", "doc_id", "text_key", "base").join(keys, "row", "left")
    return both.select("doc_id", "text_key", "base", F.when(F.col("keys").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "keys"))).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, each stretch of its text under spans replaced by ``mark``; null text stays null."""
    hits = scan(docs, id_col, text_col).filter(F.size("spans") > 0).groupBy("doc_id", "text_key").agg(F.first("spans").alias("_spans"))
    hits = hits.select(F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key"), "_spans")
    rows = whole_rows(docs, id_col, text_col)
    joined = rows.join(hits, rows["doc_id"].eqNullSafe(hits["_hit_id"]) & (rows["text_key"] == hits["_hit_key"]), "left")
    text = F.col("text")

    def step(acc, s):
        between = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.concat(acc["out"], between).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    clean = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return with_text(joined, docs.columns, F.when(F.col("_spans").isNull(), text).otherwise(clean), text_col)
