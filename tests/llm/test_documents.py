"""Operators on documents against plain versions: edge rows, other columns, empty tables, sf0.001."""
import random

import brute
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from trailrank.llm import bagminhash, bpe, langid, line_dedup, merkle, packing, queries, secrets, substring_dedup

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("hot", [128, 1])
def test_substrings(docs, texts, hot):
    want = brute.substring_dedup(texts, 50)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, hot=hot).collect()}
    assert {d: (r.n_words, r.n_removed, r.kept) for d, r in got.items()} == want
    for r in got.values():
        assert sum(s.stop - s.begin for s in r.spans) == r.n_removed


def test_substrings_of_equal_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(None, text), (5, text), (5, text), (5, "x " + text), (6, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(rows).collect())
    assert got == [(0, 60, 0), (5, 60, 60), (5, 60, 60), (5, 61, 60), (6, 0, 0)]


def test_suffix_automaton():
    random.seed(3)
    for _ in range(40):
        known, automaton = [], substring_dedup.SuffixAutomaton()
        for _ in range(4):
            known.append([random.randrange(3) for _ in range(random.randrange(1, 25))])
            automaton.add(known[-1])
        asked = [random.randrange(4) for _ in range(30)]
        runs = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        want = [max([n for n in range(1, i + 2) if tuple(asked[i + 1 - n:i + 1]) in runs], default=0) for i in range(len(asked))]
        assert automaton.statistics(asked) == want


def test_query_substrings(spark, small):
    want = brute.substring_dedup(small, 50)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op1_substring_dedup(spark, SMALL).collect()}
    assert got == {d: (n, m, brute.sha(k)) for d, (n, m, k) in want.items()}


def test_merkle(docs, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in merkle.compare_edited(docs).collect()}
    assert set(got) == set(texts)
    for d, after in zip(order, order[1:] + order[:1]):
        t, u = texts[d] or "", texts[after] or ""
        edited = t[:len(t) - len(t) // 4] + u[:len(t) // 4]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited))
        assert r.near_edited == pytest.approx(merkle.likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(merkle.likeness(r.fingerprint, got[after].fingerprint))
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited) and 0 <= r.near_edited <= 1
    assert got[5].fingerprint == got[6].fingerprint and got[5].near_next == 1 and got[5].near_edited > 0.7
    assert len({r.fingerprint for r in got.values()}) == len({t or "" for t in texts.values()})


def test_merkle_places_of_edits():
    import pyarrow as pa
    paragraphs = [f"paragraph {i} has some words of its own {i * 7919}" for i in range(40)]
    other = [*paragraphs[:17], "another one", *paragraphs[18:]]
    a, b = merkle.fingerprints(pa.array(["\n".join(paragraphs), "\n".join(other)]))[0]
    flat = [(i, j) for i, (_, ps) in enumerate(merkle.read(a)) for j, _ in enumerate(ps)]
    assert len(flat) == 40 and merkle.differing(a, b) == [flat[17]] and 0.9 < merkle.likeness(a, b) < 1


def test_merkle_text_without_spaces():
    """Long words are cut by content: an edit of the last quarter leaves the rest alike and has its place, and leaves tell their lengths."""
    import pyarrow as pa
    random.seed(4)
    chinese = "".join(chr(random.randrange(0x4E00, 0x9000)) for _ in range(1200))
    base64 = "".join(random.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(5000))
    texts = [chinese, base64, chinese[:60], "a" * 1000 + " b", " " * 500 + "x", "word " * 400, "é" * 70, "x\n" + chinese[:300] + "\n\n" + base64[:30], chinese[7:], "ab" * 300]
    edited = [t[:len(t) - len(t) // 4] + (base64[::-1] if t is chinese else chinese)[:len(t) // 4] for t in texts]
    texts += [f"a{i} is {'w' * 6} of many more" * 9 for i in range(4)] + ["short words only " * 3]
    edited += texts[len(edited):]
    prints, leaves = merkle.fingerprints(pa.array(texts))
    changed, _ = merkle.fingerprints(pa.array(edited))
    for t, f, a in zip(texts, prints, leaves):
        lengths = [n for _, ps in merkle.read(f) for p in ps for _, n in p]
        assert max(lengths) <= 63 and sum(lengths) == len(t.replace("\n", "")) and len(lengths) == len(a)
        for n in range(0, 200, 9):  # starts of the texts, each alone
            merkle.fingerprints(pa.array([t[:n]]))
        assert merkle.fingerprints(pa.array([t]))[0] == [f]
    for i in (0, 1):
        assert 0.7 < merkle.likeness(prints[i], changed[i]) < 0.8 and merkle.likeness(prints[0], prints[1]) < 0.01
    assert merkle.likeness(prints[2], changed[2]) > 0.4 and merkle.likeness(prints[0], prints[8]) > 0.95


def test_merkle_single_row_and_parallel_ranges(spark):
    one = spark.createDataFrame([(7, "abcd efgh")], "doc_id long, text string")
    assert merkle.compare_edited(one).first().edited_sha256 == brute.sha("abcd efab")
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text")).repartition(7)
    got = merkle.compare_edited(many).collect()
    assert len(got) == 500 and all(r.edited_sha256 == brute.sha((t := f"text number {r.doc_id}")[:len(t) - len(t) // 4] + "text"[:len(t) // 4]) for r in got)


def test_secrets(docs, texts):
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        assert [tuple(s) for s in r.base] == brute.base_spans(texts[d] or "")
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_secrets_battery(spark):
    """Random keys are found in both alphabets, words, paths and numbers are not; redaction masks and keeps the rest."""
    random.seed(5)
    b64 = "".join(random.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(48)) + "7"
    upper = "".join(random.choice("0123456789ABCDEF") for _ in range(64))
    plain = ["see /usr/local/share/documents/version2/chapter3/contents", "donaudampfschifffahrtsgesellschaft1", "1111111111zzzzzzzzzz2222222222yyyyyyyyyy",
             "abcdefghijklmnopqrstuvwxyz0123456789"]
    rows = [(1, f"start {b64} end"), (2, f"ünder {upper}."), *[(10 + i, p) for i, p in enumerate(plain)], (30, None), (31, "password=letmein99 x"), (32, f"é {b64}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("_spans", F.lit(1))
    spans = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secrets.scan(docs).collect()}
    assert spans[1] == [(6, 3, 6 + len(b64))] and spans[2] == [(6, 3, 70)] and spans[32] == [(2, 3, 2 + len(b64))]
    assert not any(spans[10 + i] for i in range(len(plain))) and spans[30] == []
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    said = {r.doc_id: r for r in clean.collect()}
    assert said[1].text == "start [SECRET] end" and said[31].text == "[SECRET] x" and said[30].text is None and said[1].n_chars == len("start [SECRET] end")
    assert all(said[10 + i].text == p for i, p in enumerate(plain))


def test_secrets_without_digits(spark):
    """Keys without a digit, and the parts of keys outside base spans, among long words, identifiers, rules and numbers."""
    random.seed(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    stems = "inter national communi cation trans forma tional bundes ausbildungs förderungs gesetz respons ability docu mentation extra ordinary distri bution".split()
    words = ["".join(random.choice([x for x in stems if x.isascii()]) for _ in range(4)) for _ in range(300)]
    long = [w for w in words if len(w) >= 20]
    plain = [*long, *(w.upper() for w in long[:40]), *("".join(x.title() for x in (w[:7], w[7:13], w[13:])) for w in long[40:80]),
             *("_".join((w[:7], w[7:13], w[13:])).upper() for w in long[80:120]), "-" * 40, "=" * 30, "_" * 25]
    mixed = ["".join(random.choice(letters) for _ in range(40)) for _ in range(8)]
    upper = ["".join(random.choice(letters[:26]) for _ in range(40)) for _ in range(4)]
    half = "".join(random.choice(letters + "0123456789") for _ in range(40))
    cut = f"{half}_AKIA{'Q7' * 10}"  # the base span ends the run
    keys = [*mixed, *upper]
    rows = [*((i, p) for i, p in enumerate(plain)), *((1000 + i, f"see {k}.") for i, k in enumerate(keys)), (2000, f"see {cut}"), (2001, f"token={half[:30]} x")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[1000 + i] == [(4, 3, 4 + len(k))] for i, k in enumerate(keys))
    assert not any(got[i] for i in range(len(plain)))
    assert got[2000] == [(4, 3, 4 + 41), (45, 1, 45 + 24)] and got[2001] == [(0, 0, 36)]


def test_near_duplicates(docs, texts):
    want = brute.near_duplicates(texts)
    rows = bagminhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and len(rows) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    kept = bagminhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d in texts if want[d] == d)


def test_near_duplicates_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(3, t), (3, t), (None, t), (4, "other words"), (4, "a second text")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in bagminhash.deduplicated(docs).collect()) == [(0, t), (4, "a second text"), (4, "other words")]


def test_weighted_similarity_is_unbiased():
    import numpy as np
    draw = np.random.default_rng(0)
    h = np.sort(draw.integers(0, 2 ** 63, 300).astype(np.uint64))
    a = draw.integers(1, 70, 300)
    b = np.maximum(1, a + draw.integers(-20, 21, 300))
    sign = bagminhash.signatures(np.repeat([0, 1], 300), np.concatenate((h, h)), np.concatenate((a, b)), 2, 4000)
    assert (sign[0] == sign[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


@pytest.mark.parametrize("block", [512, 7])
def test_large_bucket_with_stragglers(spark, block):
    """Chains in one bucket whose ends are alike only through the nodes between them, and nodes that are alone."""
    import numpy as np
    from trailrank.llm.common import store
    from trailrank.llm.links import connect
    sets = {i: set(range(i * 5, i * 5 + 95)) for i in range(40)} | {i: set(range(i * 5 + 5000, i * 5 + 5095)) for i in range(40, 60)} | {i: {i * 1000 + j for j in range(90, 140)} for i in range(60, 70)}
    rows, _ = store(spark.createDataFrame([(1, i) for i in sets], "key long, node long"))
    table, _ = store(spark.createDataFrame([(i, len(s), " ".join(map(str, sorted(s)))) for i, s in sets.items()], "node long, n long, body string"))

    def numbers(column):
        found = [np.array(t.split(), np.uint64) for t in column.to_pylist()]
        return np.append(0, np.cumsum([len(x) for x in found])), np.concatenate(found)

    groups = brute.Union()
    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                groups.join(a, b)
    got = {r.node: r.component for r in connect(rows, table, numbers, 0.8, block=block).collect()}
    assert {i: got.get(i, i) for i in sets} == {i: groups.find(i) for i in sets} and len(set(got.values())) == 2


def test_language(spark):
    """Held-out accuracy on the table, letterless and null texts, nothing learned from held-out rows or other columns."""
    rows = queries.op5_langid(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98 and not any(r.rejected for r in rows)
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs):
    train = spark.createDataFrame([(i, "der die und nicht ist " * 5, "de") for i in range(40)] + [(100 + i, "the and of that with " * 5, "en") for i in range(40)]
                                  + [(200, None, "de"), (201, "quoi", None)], "doc_id long, text string, lang string")
    model = langid.train(train)
    asked = spark.createDataFrame([(1, "und die nicht"), (2, "that of the"), (3, None), (4, "12 !?"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("de", "en")
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (3, 4, 5))
    nothing = langid.train(docs)  # no labels at all
    told = langid.predict(docs, nothing).collect()
    assert {r.lang_pred for r in told} == {"und"} and {r.doc_id for r in told if r.rejected} == {1, 2, 3, 20}


def test_every_language_is_learned(spark):
    """Rare labels behind 220 frequent ones, one row each."""
    rows = [(3 * i + k, f"{chr(0x4E00 + i)} und {i} die", f"noise{i}") for i in range(220) for k in range(2)] + [(9000 + i, chr(0x3041 + i) * 9, f"rare{i}") for i in range(10)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == sorted({r[2] for r in rows}) and model.logits.shape[1] == 230
    got = langid.predict(spark.createDataFrame(rows[-10:], "doc_id long, text string, lang string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {r[0]: r[2] for r in rows[-10:]}


def test_lines(docs, texts):
    want = brute.line_dedup(texts)
    rows = line_dedup.remove_lines(docs).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in rows} == want and len(rows) == len(texts)


def test_query_lines(spark, small):
    want = brute.line_dedup(small)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries.op8_line_dedup(spark, SMALL).collect()}
    assert got == {d: (n, m, brute.sha(k)) for d, (n, m, k) in want.items()}


def _ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.JSON_50K)
    t.encode_special_tokens = True
    return {d: x.ids + [1] for d, x in zip(texts, t.encode_batch([t or "" for t in texts.values()], add_special_tokens=False))}


def test_packing(spark, docs, texts, small):
    brute.check_packing(packing.pack(docs, queries.JSON_50K).collect(), _ids(texts))
    brute.check_packing(packing.pack(docs, queries.JSON_50K, window=64).collect(), _ids(texts), 64)
    brute.check_packing(queries.op7_packing(spark, SMALL).collect(), _ids(small))


@pytest.mark.parametrize("flags", [{}, {"lstrip": True, "rstrip": True}, {"single_word": True}, {"normalized": True, "lstrip": True}])
def test_packing_added_tokens(spark, tmp_path, flags):
    """Special strings in a text, against a Tokenizer left at its defaults; one more token overlaps the first."""
    import json

    from tokenizers import Tokenizer
    spec = json.load(open(queries.JSON_50K, encoding="utf-8"))
    plain = dict.fromkeys(("single_word", "lstrip", "rstrip", "normalized"), False)
    if flags:
        spec["added_tokens"] += [{"id": 50257, "content": "<|endoftext|>s", "special": False} | plain | flags, {"id": 50258, "content": "mark", "special": True} | plain | flags]
    path = str(tmp_path / "tokenizer.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    end = "<|endoftext|>"
    said = [f"a {end} b", end, f"{end}{end}", f"x\n {end}\t\n{end}s  mark y marks remark mark", f"<|endoftext |> {end[:-1]}", f"é{end}sé \u3000mark\u00a0mark", f"  {end}  ", "no such token"]
    texts = dict(enumerate(said))
    reference = Tokenizer.from_file(path)
    ids = {d: x.ids + [1] for d, x in zip(texts, reference.encode_batch(said, add_special_tokens=False))}
    assert ids[0] == [64, 220, 50256, 275, 1] or flags
    brute.check_packing(packing.pack(brute.table(spark, texts), path, window=16).collect(), ids, 16)


def test_bpe(spark, docs, texts, small):
    import tiktoken
    path = queries.MULTI_50K
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.prefix_encoder(path).ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert {d: list(r.ids) for d, r in got.items()} == {d: enc.encode_ordinary(t or "") for d, t in texts.items()}
    assert {d: bytes(r.decoded) for d, r in got.items()} == {d: (t or "").encode() for d, t in texts.items()}
    for r in queries.op10_byte_bpe(spark, SMALL).collect():
        ids = enc.encode_ordinary(small[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(small[r.doc_id] or ""))


def test_bpe_appends_and_edits():
    import tiktoken
    enc = bpe.prefix_encoder(queries.MULTI_50K)
    ref = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=enc.ranks, special_tokens={})
    random.seed(2)
    for _ in range(300):
        piece = "".join(random.choice("thenationéà .") for _ in range(random.randrange(1, 25))).encode()
        last = enc.extend(piece, [])
        more = piece + b"ings"
        grown = enc.extend(more, list(last))
        assert grown[:len(last)] == last
        at = random.randrange(len(piece))
        edited, table = enc.edit(piece, last, at, 1, b"x")
        for p, t in ((piece, last), (more, grown), (edited, table)):
            if p not in enc.ranks and (s := p.decode("utf-8", "ignore")).encode() == p:
                assert enc.read(t) == ref.encode_ordinary(s)


def test_bpe_edits_stop_where_the_tables_agree(monkeypatch):
    """Edits of a long piece: the table of the whole, from a look at little more than the edit."""
    enc = bpe.prefix_encoder(queries.MULTI_50K)
    random.seed(3)
    piece = "".join(random.choice("thenationéà .") for _ in range(4000)).encode()
    last, read = enc.extend(piece, []), []
    plain = bpe.PrefixEncoder.extend
    monkeypatch.setattr(bpe.PrefixEncoder, "extend", lambda self, p, t: read.append(len(p) + 1 - max(len(t), 1)) or plain(self, p, t))
    for _ in range(20):
        at, removed, added = random.randrange(len(piece)), random.randrange(4), random.choice([b"", b"x", b"ing the", b"  "])
        read.clear()
        changed, table = enc.edit(piece, last, at, removed, added)
        assert table == plain(enc, changed, []) and sum(read) < len(piece) / 2 + 4 * enc.longest
    assert sum(read) <= len(added) + 6 * enc.longest or at > len(piece) - 6 * enc.longest


@pytest.mark.parametrize("operator", [
    substring_dedup.remove_repeats, merkle.compare_edited, secrets.scan, secrets.redact, bagminhash.near_duplicates, bagminhash.deduplicated, line_dedup.remove_lines,
    lambda d: packing.pack(d, queries.JSON_50K), lambda d: bpe.decode(bpe.encode(d, queries.MULTI_50K), queries.MULTI_50K),
    lambda d: langid.predict(d, langid.train(d))])
def test_empty_table(docs, operator):
    assert operator(docs.filter("false")).collect() == []
