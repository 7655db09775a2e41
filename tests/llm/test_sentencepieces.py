"""Ids, byte spans and decoded texts against the sentencepiece library, with the model's own character map and with a compiled one."""
import random

import brute
import pytest
import sentencepiece

from trailrank.llm import queries, sentencepieces

LETTERS = "aàé the in on\n\t 0123▁中文字😀ﬁ½①ｶﾞ́ 　.,<s></s><0x0A>\0 ABCſ"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES_32K)


def _spans(library, text):
    """(id, begin, end) of the library's own message, and the end mark."""
    pieces = [dict(sentencepieces.fields(v)) for f, v in sentencepieces.fields(library.encode(text, out_type="serialized_proto")) if f == 2]
    last = len(text.encode())
    return [(p.get(2, 0), p.get(4, 0), p.get(5, 0)) for p in pieces] + [(2, last, last)]


def _same(model, library, text):
    ids, begins, ends = model.encode(text)
    assert list(zip(ids.tolist(), begins.tolist(), ends.tolist())) == _spans(library, text), text
    assert ids.tolist() == library.encode(text, add_eos=True) and model.decode(ids) == library.decode(ids.tolist()), text


def _length(n):
    return bytes([n & 127 | 128]) + _length(n >> 7) if n > 127 else bytes([n])


def _message(parts):
    return b"".join(bytes([f << 3 | 2]) + _length(len(v)) + v if isinstance(v, bytes) else bytes([f << 3, v]) for f, v in parts)


def test_random_texts(library):
    model = sentencepieces.model(queries.PIECES_32K)
    draw = random.Random(1)
    for i in range(1500):
        _same(model, library, "".join(draw.choice(LETTERS) for _ in range(draw.randrange(30))))
    for n in (1, 2, 3, 15, 16, 17, 31, 33, 250):
        for text in (" " * n, "x" + " " * n + "y", "▁" * n + " ", "\n" * n, "a" * n, "中文" * n, "ab" * n + " " * n):
            _same(model, library, text)


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_compiled_map(prefix, squeeze):
    rules = next(v for f, v in sentencepieces.fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()) if f == 3)
    compiled = dict(sentencepieces.fields(rules))[2]
    parts = [(f, v) for f, v in sentencepieces.fields(open(queries.PIECES_32K, "rb").read()) if f != 3]
    proto = _message([*parts, (3, _message([(1, b"own"), (2, compiled), (3, prefix), (4, squeeze)]))])
    model, library = sentencepieces.Model(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    draw = random.Random(2)
    for i in range(1500):
        _same(model, library, "".join(draw.choice(LETTERS + "    ") for _ in range(draw.randrange(30))))


def test_any_ids_decode(library):
    model = sentencepieces.model(queries.PIECES_32K)
    draw = random.Random(3)
    some = [0, 1, 2, 3 + 0xE4, 3 + 0xB8, 3 + 0xAD, 3 + 0xFF, 3 + 0x41, 29871, 15043, 259]
    for i in range(1500):
        ids = [draw.choice(some) for _ in range(draw.randrange(1, 9))]
        assert model.decode(ids) == library.decode(ids), ids


def test_long_text(library):
    text = ("one two  three\nfour 中文 " * 9 + "x" * 40) * 12000  # over two windows of look-up
    model = sentencepieces.model(queries.PIECES_32K)
    ids, begins, ends = model.encode(text)
    assert ids.tolist() == library.encode(text, add_eos=True) and (begins[1:] == ends[:-1])[ends[:-1] > begins[:-1]].all() and ends[-1] == len(text.encode())


def test_tables(spark, docs, texts, library):
    rows = sentencepieces.decode(sentencepieces.encode(docs, queries.PIECES_32K), queries.PIECES_32K).collect()
    assert {r.doc_id: list(zip(r.ids, r.begins, r.ends)) for r in rows} == {d: _spans(library, t or "") for d, t in texts.items()} and len(rows) == len(texts)
    assert {r.doc_id: r.decoded for r in rows} == {d: t or "" for d, t in texts.items()}
    at_once = sentencepieces.encode(docs, queries.PIECES_32K, decoded=True).collect()
    assert {r.doc_id: r.decoded for r in at_once} == {r.doc_id: r.decoded for r in rows} and {r.doc_id: r.ends for r in at_once} == {r.doc_id: r.ends for r in rows}
    assert sentencepieces.encode(docs.filter("false"), queries.PIECES_32K).collect() == []


def test_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES_32K)
    said = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_bytes) for r in queries.op12_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for d, text in said.items():
        ids = library.encode(text, add_eos=True)
        assert got[d] == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids)), len(text.encode()))
