"""Column expressions shared by the operators."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and constants the results depend on.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
CAMEL_BREAK = r"([a-z0-9])([A-Z])"
TRACEBACK = r"Traceback \(most recent call last\)"
FRAME_HEAD = r'File "[^"]+", line \d+'
FRAME_LINE = r'File "[^"]+", line \d+[^\n]*'
FRAME_FULL = r'File "([^"]+)", line (\d+), in (\S+)'
LOOSE_FRAME = r"""([A-Za-z0-9_./-]+\.py)["']?,?\s*line\s*(\d+)"""
SHORT_FRAME = r"([A-Za-z0-9_./-]+\.py):(\d+)"
IN_NAME = r"\bin\s+([A-Za-z_][A-Za-z0-9_]*)"
RAISES = r"pytest\.raises|assertRaises|with\s+raises|\.raises\("
RAISES_ALT = r"pytest\.raises|assertRaises|assert_raises"
ERROR_NAME = r"\b\w+Error\b|\b\w+Exception\b"
EXCEPTION_TYPE = r"\b([A-Z][A-Za-z0-9_]*(?:Error|Exception|Warning))\b"
ERROR_LINE = r"(?m)^([A-Za-z_][\w.]*(?:Error|Exception|Warning|Exit)):?\s*(.*)$"
ERROR_CHARS = 200
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
ASSERTION_KEY = r"assert|raises|expect|==|!=|approx|isclose|pytest|with .*:"
HASH_FACTOR = 2654435761
HASH_RANGE = 4294967296
SEED_FACTOR = 2246822519
BRANCH_HEAD = r"^(if|elif|else)\b"
CONTROL_TRANSFER = r"^(return|raise|break|continue|pass|yield)\b"


def hash_order(item: Column) -> Column:
    """Tie-break value that does not follow the item order, for items of any size."""
    return _times(item, HASH_FACTOR)


def _times(x: Column, factor: int) -> Column:
    """``x * factor`` modulo 2^32. x is reduced first and multiplied in halves of 16 bits, so no
    64-bit product overflows."""
    x = F.pmod(x.cast("bigint"), F.lit(HASH_RANGE))
    high, low = F.shiftright(x, 16), x.bitwiseAND(F.lit(0xFFFF))
    return (high * F.lit(factor) % F.lit(1 << 16) * F.lit(1 << 16) + low * F.lit(factor)) % F.lit(HASH_RANGE)


def _xor_shift(h: Column, bits: int) -> Column:
    return h.bitwiseXOR(F.shiftright(h, bits))


def hash_seeded(item: Column, seed: Column) -> Column:
    """Uniform draw in [0, 2^32) from (item, seed) by integer arithmetic, so that every engine and
    every retry draws the same, for items and seeds of any size."""
    h = (_times(item, HASH_FACTOR) + _times(seed, SEED_FACTOR)) % F.lit(HASH_RANGE)
    h = (_xor_shift(h, 15) * F.lit(1103515245) + F.lit(12345)) % F.lit(HASH_RANGE)
    h = (_xor_shift(h, 13) * F.lit(1664525) + F.lit(1013904223)) % F.lit(HASH_RANGE)
    return _xor_shift(h, 16)


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """``num/den`` with a fixed value where the denominator is zero or null."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(empty).cast("double"))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), 0)


def tokens(text: Column) -> Column:
    """Distinct lower-case identifier tokens: whole identifiers and their camelCase /
    snake_case parts, three characters or longer."""
    whole = identifiers(text)
    parts = F.flatten(F.transform(whole, lambda w: F.split(
        F.translate(F.regexp_replace(w, CAMEL_BREAK, "$1 $2"), "_", " "), " ")))
    every = F.transform(F.concat(parts, whole), F.lower)
    return F.array_distinct(F.filter(every, lambda w: F.length(w) >= 3))


def is_code(text: Column) -> Column:
    """Neither blank nor a comment."""
    body = strip(text)
    return (body != "") & ~body.startswith("#")


def split_lines(text: Column) -> Column:
    """Lines of a text; a line break at its end begins no further line, and an empty text has none."""
    def ended(parts):
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    # the pieces are bound to a name: written into a condition, the text would be split once for each mention
    return F.element_at(F.transform(F.array(F.split(text, LINE_BREAK, -1)), ended), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 10, stepped back to x; for x >= 1."""
    return let(x, _log_gamma)


def _log_gamma(x: Column) -> Column:
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    back = F.log(x)
    for i in range(1, 10):
        back = back + F.log(x + i)
    return series - back


def uniform(item: Column, seed: Column) -> Column:
    """``hash_seeded`` as a number strictly between 0 and 1."""
    return (hash_seeded(item, seed) + 0.5) / F.lit(float(HASH_RANGE))


def _quantile(u: Column, low: Column, high: Column, first: Column, ratio_: Callable[[Column], Column]) -> Column:
    """How many terms from ``low`` on their running sum needs to pass ``u``, plus ``low``: ``first`` is the term at low, ``ratio_(k)`` the term at
    k + 1 over that at k."""
    def step(acc, k):
        total = acc["total"] + acc["term"]
        return F.struct((acc["term"] * ratio_(k.cast("double"))).alias("term"), total.alias("total"), (acc["n"] + F.when(total <= u, 1).otherwise(0)).alias("n"))

    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    return low + F.aggregate(F.sequence(low, high), start, step, lambda acc: acc["n"])


def binomial_quantile(n: Column, p: Column, u: Column) -> Column:
    """The value of a binomial variable at ``u``, by inverse transform over twelve standard deviations to either side, outside which
    terms are zero in double precision: the steps grow with the square root of n."""
    def drawn(x):
        size, part, low = x["size"], x["part"], x["low"]
        at = low.cast("double")
        first = F.exp(log_gamma(size + 1) - log_gamma(at + 1) - log_gamma(size - at + 1) + at * F.log(part) + (size - at) * F.log(1 - part))
        return F.least(_quantile(x["u"], low, x["high"], first, lambda k: (size - k) / (k + 1) * (part / (1 - part))), size.cast("bigint"))

    def window(x):
        mean, spread = x["size"] * x["part"], F.sqrt(x["size"] * x["part"] * (1 - x["part"])) * 12 + 12
        low, high = F.greatest(F.lit(0.0), F.floor(mean - spread).cast("double")), F.least(x["size"], F.ceil(mean + spread).cast("double"))
        return F.struct(x["size"].alias("size"), x["part"].alias("part"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), x["u"].alias("u"))

    def of(x):
        return (F.when((x["size"] == 0) | (x["part"] <= 0), F.lit(0).cast("bigint")).when(x["part"] >= 1, x["size"].cast("bigint"))
                .otherwise(let(window(x), drawn)))
    return let(F.struct(n.cast("double").alias("size"), p.alias("part"), u.alias("u")), of)


def poisson_quantile(mean: Column, u: Column) -> Column:
    """The value of a Poisson variable at ``u``, likewise."""
    def drawn(x):
        rate, at = x["rate"], x["low"].cast("double")
        first = F.exp(at * F.log(rate) - rate - log_gamma(at + 1))
        return _quantile(x["u"], x["low"], F.ceil(rate + F.sqrt(rate) * 12 + 12).cast("bigint"), first, lambda k: rate / (k + 1))

    rate = mean.cast("double")
    low = F.greatest(F.lit(0.0), F.floor(rate - F.sqrt(rate) * 12 - 12).cast("double")).cast("bigint")
    return let(F.struct(rate.alias("rate"), low.alias("low"), u.alias("u")), drawn)


def mcnemar_p(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial p-value on discordant pairs. Terms are summed in log space from
    the largest, C(n, k) / 2^n, downward; past 100 standard deviations they are zero in double
    precision, so the number of terms grows with the square root of n only."""
    n = (wins + losses).cast("double")
    k = F.least(wins, losses).cast("bigint")
    last = F.least(k, (F.sqrt(n) * 50 + 200).cast("bigint"))
    top = log_gamma(n + 1) - log_gamma(k + F.lit(1.0)) - log_gamma(n - k + 1) - n * F.log(F.lit(2.0))

    def step(acc, j):
        i = (k - j).cast("double")
        return F.struct((acc["term"] + F.log(i) - F.log(n - i + 1)).alias("term"), (acc["total"] + F.exp(acc["term"])).alias("total"))

    start = F.struct(top.alias("term"), F.lit(0.0).alias("total"))
    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), last), start, step, lambda acc: acc["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))


def wilson_bound(k: Column, n: Column, sign: int, z: float = 1.96) -> Column:
    """Lower (sign=-1) or upper (sign=+1) Wilson score bound in percent."""
    share = k.cast("double") / n
    centre = share + z * z / (2 * n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return F.when(n == 0, F.lit(0.0)).otherwise(100 * (centre + sign * half) / (1 + z * z / n))


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                           F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))
