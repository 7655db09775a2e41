"""Distances and terms of sources against plain counting, with small blocks, hot terms, odd rows."""
import re
from collections import Counter, defaultdict

import pytest

from trailrank.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _brute(rows, documents=30, top=50):
    """Rows are (lang, source, text)."""
    n, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        n[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, c in held[lang].items() if c >= documents)
        of = {s: n[lang, s] for g, s in groups if g == lang}
        whole = Counter()
        for c in of.values():
            whole.update(c)

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (total + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in of.items()}, share(whole)
        for s in of:
            far = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in of if o != s]
            more = [(q[t] - p[s][t], t.encode()) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(far)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(items, 1)]
    return sorted(out)


def _got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def _rows():
    words = "alpha Beta gamma delta épée ÉPÉE été 中文 naïve tail rare once Zeta eta theta iota".split()
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        said = [words[(i * i + j * (i % 5 + 1)) % (len(words) - i % 3)] for j in range(i % 23)] + ["the"] * (i % 4)
        rows.append((["en", "fr", None][i % 5 % 3], source, " -1x\0".join(said) + "." * (i % 2)))
    rows += [("en", "empty", None), ("en", None, "alpha the"), ("de", "s1", "zwei Worte"), ("de", "s2", ""), ("de", "", "Worte"), ("xx", "alone", "the the")]
    return rows + rows[:9]


@pytest.mark.parametrize("block,documents", [(divergence.BLOCK, 30), (7, 30), (40, 1)])
def test_audit(spark, block, documents):
    rows = _rows()
    table = spark.createDataFrame([(t, g, s, 5, 5) for g, s, t in rows], "text string, lang string, source string, term int, g int").repartition(5)
    assert _got(divergence.audit(table, documents=documents, block=block)) == _brute(rows, documents)


def test_shuffled_totals_and_slices(spark, monkeypatch):
    """Totals joined by shuffle, many small slices of pairs, texts longer than a slice."""
    rows = _rows()
    for name, value in (("SMALL", 0), ("PAIRS", 3)):
        monkeypatch.setattr(divergence, name, value)
    table = spark.createDataFrame([(t, g, s) for g, s, t in rows], "text string, lang string, source string")
    assert _got(divergence.audit(table)) == _brute(rows)
    text = ("Ünï code words, " * 9 + "x" * 200 + " ").encode()
    monkeypatch.setattr(divergence, "SLICE", 50)
    assert [t for part in divergence._slices(text) for t in divergence.terms(part)] == divergence.terms(text)


def test_edges(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).collect() == []
    rows = [("en", "a", None), ("en", "b", ""), ("en", "c", "word")]
    assert _got(divergence.audit(spark.createDataFrame([(t, g, s) for g, s, t in rows], schema))) == _brute(rows)
    huge = spark.sql("SELECT cast(9000000000000 AS bigint) n, cast(90000000000000 AS bigint) total, cast(7 AS bigint) kept")
    assert huge.select(divergence._share(huge.n, huge.total, huge.kept)).first()[0] == 1 + 10**9 * (9000000000000 + 5) // (90000000000000 + 35)


def test_query(spark):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert _got(queries.op13_divergence(spark, "/root/testdata/sf0.01")) == _brute(rows)
