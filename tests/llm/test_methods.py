"""What the methods promise beyond the contracts: recall of keys by length, of lines by similarity, bounded memory, pages of several templates."""
import base64
import random
import time
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from trailrank.llm import bagminhash, html_extract, langid, line_dedup, links, packing, secrets, textarrays
from trailrank.llm.html_extract import main_text

ALPHABETS = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "HEX": "0123456789ABCDEF"}


@pytest.mark.parametrize("length", [24, 32, 40, 64])
def test_random_keys_are_found(spark, length):
    """Sixty random keys of each encoding among a thousand documents: nine in ten, and nothing else."""
    draw = random.Random(length)
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    planted = {}
    for kind, letters in ALPHABETS.items():
        for _ in range(60):
            n = draw.randrange(len(docs))
            while n in planted:
                n = draw.randrange(len(docs))
            planted[n] = kind, "".join(draw.choice(letters) for _ in range(length))
    rows = [(d, f"{t} The value is {planted[n][1]} here." if n in planted else t) for n, (d, t) in enumerate(docs)]
    found = {r.doc_id: [s for s in r.spans if s.kind == 3] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = dict.fromkeys(ALPHABETS, 0)
    wrong = 0
    for n, (d, text) in enumerate(rows):
        said = [text[s.start:s.end] for s in found[d]]
        if n in planted:
            kind, key = planted[n]
            hits[kind] += any(key in s or s in key and len(s) >= length - 2 for s in said)
        else:
            wrong += len(said)
    assert all(h >= 54 for h in hits.values()), hits
    assert wrong <= 2


def test_many_matches_in_one_text(spark):
    draw = random.Random(1)
    text = "\n".join("%032x token=%s" % (draw.getrandbits(128), base64.b64encode(draw.randbytes(18)).decode()) for _ in range(8000))
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secrets.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    at = time.time()
    row = secrets.scan(table).collect()[0]
    assert sum(s.kind == 0 for s in row.base) == 8000 and sum(s.kind == 2 for s in row.base) == 8000
    assert all(text[s.start:s.end] for s in row.base) and [s.start for s in row.base] == sorted(s.start for s in row.base)
    assert time.time() - at < 20


def _line(draw, n):
    return "".join(draw.choice("abcdefghij klmnop") for _ in range(n))


def test_similar_lines_share_a_band():
    """Pairs at a similarity of 0.8 and a little more, shorter and longer than LONG runs and across it."""
    draw, met, n = random.Random(4), 0, 0
    for size in (30, 60, 100, 125, 128, 135, 150, 159, 161, 200, 400):
        for _ in range(40):
            a = _line(draw, size)
            runs = lambda s: {s[i:i + 6] for i in range(len(s) - 5)}
            b = a + _line(draw, size // 3) if draw.random() < 0.5 else a
            a = a if len(b) > len(a) else a + _line(draw, size // 3)
            while len(runs(a) & runs(b)) < 0.8 * len(runs(a) | runs(b)):  # cut the longer one until they are similar
                a, b = (a, b[:-1]) if len(b) > len(a) else (a[:-1], b)
            column = pa.array([a, b])
            points, doc, _, start, stop = line_dedup._lines(next(iter(line_dedup.slices(column))))
            offsets, keys = line_dedup._bands(*line_dedup._shingles(points, start, stop, 6))
            n += 1
            met += bool(set(keys[offsets[0]:offsets[1]].tolist()) & set(keys[offsets[1]:].tolist()))
    assert met / n > 0.985


def test_bins_estimate_similarity():
    draw = np.random.default_rng(5)
    common, own = draw.integers(0, 1 << 63, size=400, dtype=np.uint64), draw.integers(0, 1 << 63, size=(2, 50), dtype=np.uint64)
    agree = []
    for turn in range(60):
        sets = [np.unique(line_dedup.mix(np.concatenate((common, o)), turn)) for o in own]
        least = line_dedup._binned(np.concatenate(sets), np.array([len(s) for s in sets]))
        agree.append((least[0] == least[1]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02


@pytest.mark.parametrize("block,paired", [(512, 64), (3, 64), (4, 2)])  # the last one: most buckets are large
def test_links_in_buckets(spark, monkeypatch, block, paired):
    """Groups by comparing all pairs of a bucket, against doing so plainly."""
    draw = random.Random(11)
    sets, base = {}, [[draw.randrange(40) for _ in range(10)] for _ in range(8)]
    for i in range(90):
        sets[i] = sorted({draw.randrange(40) if draw.random() < 0.06 else x for x in base[i % 8]})
    keys = {(k, i) for i in sets for k in (i % 8, 20 + sets[i][0], 90 + i % 3 if i < 40 else 200 + i)}
    monkeypatch.setattr(links, "PAIRED", paired)

    def numbers(column):
        found = [np.array(sorted(map(int, t.split())), np.uint64) for t in column.to_pylist()]
        return np.append(0, np.cumsum([len(x) for x in found])), np.concatenate(found)
    rows = spark.createDataFrame(list(keys), "key long, node long")
    bodies = spark.createDataFrame([(i, " ".join(map(str, s))) for i, s in sets.items()], "node long, body string")
    groups = brute.Union()
    for k in {k for k, _ in keys}:
        mine = [i for h, i in keys if h == k]
        for a in mine:
            for b in mine:
                x, y = set(sets[a]), set(sets[b])
                if a < b and len(x & y) >= 0.8 * len(x | y):
                    groups.join(a, b)
    got = {r.node: r.component for r in links.connect(rows, bodies, numbers, 0.8, block=block, in_buckets=True).collect()}
    if paired == 64:
        assert {i: got.get(i, i) for i in sets} == {i: groups.find(i) for i in sets}
    else:  # pairs of a cluster without a common bucket may be linked too
        whole = brute.Union()
        for a in sets:
            for b in sets:
                if a < b and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b])):
                    whole.join(a, b)
        assert all(got.get(i, i) == got.get(groups.find(i), groups.find(i)) and whole.find(i) == whole.find(got.get(i, i)) for i in sets)


def test_powers_kept_are_as_long_as_texts_ask(monkeypatch):
    """A worker keeps powers for every seed: not much longer than the longest slice, and with the same hashes after they grew."""
    monkeypatch.setattr(textarrays, "_POWERS", {})
    values = np.arange(200_000, dtype=np.uint64)
    short = textarrays.range_hash(values[:1000], np.array([0, 10]), np.array([10, 1000]), 5)
    assert sum(x.nbytes for x in textarrays._POWERS[5]) <= 1 << 20
    long = textarrays.range_hash(values, np.array([0, 10, 0]), np.array([10, 1000, 200_000]), 5)
    assert sum(x.nbytes for x in textarrays._POWERS[5]) <= 16 * 300_000
    up, down = textarrays._POWERS[5]
    assert (up * down == 1).all() and long[:2].tolist() == short.tolist()
    assert textarrays.range_hash(np.concatenate((values[:7], values[:7])), np.array([0, 7]), np.array([7, 14]), 5).tolist() == [textarrays.range_hash(values, np.array([0]), np.array([7]), 5)[0]] * 2


def test_short_texts_are_counted_a_few_at_a_time():
    import tracemalloc
    column = pa.array(["hi there"] * 10_000)
    tracemalloc.start()
    n = sum(len(letter) for _, letter in langid._bags(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and peak < 200 << 20


def _peak(work):
    import tracemalloc
    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak >> 20


def test_shares_of_texts_need_little_beside_them():
    """One slice of TEXTS texts: its shares are 8 MB."""
    texts = [f"text {i} of many words " * 80 for i in range(langid.TEXTS)]
    (shares, letter), peak = _peak(lambda: next(langid._bags(pa.array(texts))))
    assert peak < 24 and letter.all()
    for i in (0, 31, 32, 200, 255):
        (alone, _), = langid._bags(pa.array([texts[i]]))
        assert (alone[0] == shares[i]).all()


def test_signatures_are_made_in_small_slices(monkeypatch):
    """The shingles of a large batch are taken a slice at a time, and powers are made for no more."""
    monkeypatch.setattr(textarrays, "_POWERS", {})
    column = pa.array([f"w{i} and w{i + 1} or " * 120 for i in range(1000)])
    (first, values), peak = _peak(lambda: bagminhash.occurrences(column))
    assert peak < 60
    for i in (0, 500, 999):
        assert (bagminhash.occurrences(column.slice(i, 1))[1] == values[first[i]:first[i + 1]]).all()


def test_a_worker_gives_memory_back():
    """Free memory that small arrays have left between kept ones, and the tables of powers, do not stay in the worker."""
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) >> 10
    textarrays.byte_hash(np.zeros(1 << 20, np.uint8), np.array([0]), np.array([9]), 5)
    some = [np.ones(64 << 7) for _ in range(2000)]  # 64 kB each, 125 MB in all
    kept = some[::100]
    del some
    before = held()
    textarrays.give_back()
    assert not textarrays._POWERS and held() < before - 80 and len(kept) == 20


def test_pieces_leave_a_few_rows_at_a_time():
    """However many rows of ids Spark hands over at once, pieces of no more than ``rows`` of them go back together; they are the same."""
    sizes = np.array([1, 40, 16, 3, 100, *[9] * 45])
    ids = pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))
    whole = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([2] * 50, pa.int32()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), ids], names=packing.IDS.fieldNames())
    few = list(packing.cut(iter([whole, whole.slice(50)]), {2: 5}, 16, rows=7))
    assert [len(set(b.column("doc_id").to_pylist())) for b in few] == [7] * 7 + [1]
    pieces = [r for b in few for r in b.to_pylist()]
    assert pieces == [r for b in packing.cut(iter([whole]), {2: 5}, 16) for r in b.to_pylist()]
    stream = np.concatenate([np.arange(n) for n in sizes]).tolist()
    assert [i for r in pieces for i in r["ids"]] == stream
    assert pieces[0] | {"ids": 0, "ids_crc32": 0} == {"doc_id": 0, "start": 0, "length": 1, "ids_crc32": 0, "doc_tokens": 1, "sequence_id": 0, "offset": 5, "ids": 0}


# ---- pages -------------------------------------------------------------------------------------

PART = "Some text, of the article, with commas, and words that go on and on, to make it long enough to be scored as the main part of the page. " * 3
OTHER = "Buy this thing, now, because it is cheap, good, and long enough to be over three hundred characters, surely, when it is said. " * 4
WRAPS = ['<div class="content">%s</div>', "<main>%s</main>", "<article>%s</article>", '<div id="wrap"><div class="post-body entry">%s</div></div>']


@pytest.mark.parametrize("wrap", WRAPS)
@pytest.mark.parametrize("label", ['class="sidebar"', 'class="cookie-notice"', 'class="comments"', 'class="advertisement"', 'id="sidebar"', 'class="related-posts"', 'class="ad-container"',
                                   'class="newsletter-box"', 'id="comments"', 'class="share-buttons"', 'role="complementary"', 'class="site-footer"'])
@pytest.mark.parametrize("said", [OTHER[:350], OTHER, "<h3>More</h3><p>Buy it.</p>"])
def test_labelled_parts_go_whatever_their_length(wrap, label, said):
    page = wrap % f"<h1>Title</h1><p>{PART}</p><div {label}>{said}</div><p>{PART}</p><p>{PART}</p>"
    text = main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}<footer>Foot</footer></body></html>")
    assert text.count("Some text") == 9 and "Buy" not in text and "Home" not in text and text.startswith("Title")


@pytest.mark.parametrize("wrap", WRAPS)
@pytest.mark.parametrize("keep", ['<section id="data-sharing"><h2>X</h2><p>KEEP this, text</p></section>', '<div id="advertising-in-the-1920s"><p>KEEP this</p></div>', '<h2 id="comments">KEEP</h2>',
                                  '<section id="discussion"><h2>Discussion</h2><p>KEEP me</p></section>', '<section><header><h2>A</h2><p>KEEP intro</p></header><p>x</p></section>',
                                  '<p>See <span id="Social_structure">KEEP</span>, too.</p>', '<section class="advertising-history"><p>KEEP, of course.</p></section>',
                                  "<h2>References</h2><ul><li><a href=a>KEEP first paper</a></li><li><a href=b>second paper</a></li></ul>",
                                  '<ol class="references"><li><a href=a>KEEP first paper</a></li><li><a href=b>second paper</a></li></ol>'])
def test_texts_about_such_things_stay(wrap, keep):
    assert "KEEP" in main_text("<html><body>" + wrap % f"<p>{PART}</p>{keep}<p>{PART}</p>" + "</body></html>")


def test_headers_of_articles_stay_and_of_pages_go():
    head = "<header><h1>Title</h1><p>By someone, with an intro.</p></header>"
    assert main_text(f"<body><header><p>Site</p></header><article>{head}<p>{PART}</p><p>{PART}</p></article></body>").split("\n")[:2] == ["Title", "By someone, with an intro."]
    assert main_text(f'<body><main><div class="header"><h1>Title</h1></div><p>{PART}</p><p>{PART}</p></main></body>').startswith("Title")


@pytest.mark.parametrize("wrap", WRAPS[:2])
def test_menus_of_long_links_go(wrap):
    menu = "<ul>" + "".join(f"<li><a href=x{i}>A rather long menu entry of words {i:03d}</a></li>" for i in range(6)) + "</ul>"
    text = main_text("<html><body>" + wrap % f"{menu}<p>{PART}</p><p>{PART}</p>" + "</body></html>")
    assert "menu entry" not in text and text.count("Some text") == 6


def test_what_holds_most_of_a_page_is_its_text():
    for label in ('class="side"', 'class="content-sidebar-wrap"', 'id="comments"', 'class="banner"'):
        assert main_text(f"<html><body><div {label}><p>{PART}</p><p>{PART}</p></div><p>Foot.</p></body></html>").count("Some text") == 6


def test_letters_whose_small_form_is_longer():
    assert main_text("<article><p>İstanbul, a city.</p><SCRIPT>var x = '</p>';</SCRIPT><p>İ more text</p></article>") == "İstanbul, a city.\nİ more text"
    assert html_extract.main_text("<p>a</p><script>x") == "a"


def test_shared_keys(spark, monkeypatch):
    """Keys that several nodes have, with all of their nodes: met in one list, in lists of one task, in several tasks."""
    monkeypatch.setattr(links, "SORTED", 40)
    draw = random.Random(3)
    keys = {n: [draw.randrange(-400, 400) << 54 for _ in range(6)] + [7, n + (1 << 40)] for n in range(200)}  # one key of all nodes, one of each
    flat = pa.array([np.array(k, np.int64).tobytes() for k in keys.values()], pa.binary())
    assert links.unpacked(flat.slice(3, 2))[0].view(np.int64).tolist() == keys[3] + keys[4]
    rows = spark.createDataFrame([(n, bytearray(b.as_py())) for n, b in zip(keys, flat)], "node long, keys binary").repartition(5)
    many = Counter(k for ks in keys.values() for k in ks)
    got = [(r.key, r.node) for r in links.shared_keys(rows)[0].collect()]
    assert sorted(got) == sorted((k, n) for n, ks in keys.items() for k in ks if many[k] > 1)


def test_lines_without_their_blanks():
    """Long runs of white space at either end, blank lines, lines of one character in texts beside each other."""
    texts = ["", " \n", "a\n\n b \t", " " * 100 + "x y" + "\t" * 90 + "\n" + " " * 200, "q", "r", "\u00fc\n \u00f6\u00f6", "z" * 300 + "\r"]
    points, doc, line, start, stop = line_dedup._lines(next(iter(line_dedup.slices(pa.array(texts)))))
    want = [(d, i, x.strip(" \t\n\r\x0b\x0c")) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    assert [(d, i, points[a:b].tobytes().decode("utf-32-le")) for d, i, a, b in zip(doc.tolist(), line.tolist(), start.tolist(), stop.tolist())] == want


def test_unlike_sets_are_told_by_counts():
    """Counts of values by range rule out unlike sets only."""
    draw = np.random.default_rng(8)
    base = draw.integers(0, 1 << 48, size=400, dtype=np.uint64)
    rows = [np.unique(np.concatenate((base[:n], draw.integers(0, 1 << 48, size=400 - n, dtype=np.uint64)))) for n in (400, 390, 370, 360, 350, 300, 200, 0)]
    sets = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows)
    i, j = np.triu_indices(len(rows), 1)
    like = [len(np.intersect1d(rows[a], rows[b])) >= 0.8 * len(np.union1d(rows[a], rows[b])) for a, b in zip(i, j)]
    assert links._alike(sets, i, j, 0.8).tolist() == like
    counts, size = links._counts(sets), np.diff(sets[0])
    maybe = links._may_be_alike(counts[i], counts[j], size[i] + size[j], 0.8)
    assert (maybe >= np.array(like)).all() and not maybe[-1]


def test_sketches_lose_no_pair():
    """The least number of different runs and the bound of sketches, for repeated runs, one run, very long lines; pairs that cannot be alike are told."""
    draw = random.Random(9)
    texts = [("abc def ghi" * 60)[:n] for n in range(1, 400, 7)] + [_line(draw, n) for n in (1, 6, 7, 40, 300, 300, 300, 40_000)]
    texts += [t[:-1 - draw.randrange(len(t) // 8)] + "zz" for t in texts if len(t) > 20]
    column = pa.array(texts)
    points, firsts = textarrays.code_points(next(iter(textarrays.slices(column))))
    size, sketch = line_dedup._sketches(*line_dedup._shingles(points, firsts[:-1], firsts[1:], 6))
    sets = line_dedup.shingle_sets(column)
    assert (size <= np.diff(sets[0])).all() and (size >= 0.99 * np.diff(sets[0])).all()
    i, j = np.triu_indices(len(texts), 1)
    most, like = links._most(links._rows_of(links.packed_rows(sketch))), links._alike(sets, i, j, 0.8)
    may = links._may_be_alike(most[i], most[j], size[i] + size[j], 0.8)
    assert like.any() and not (like & ~may).any()
    unlike = [n for n, t in enumerate(texts) if len(t) == 300 and "abc def" not in t]
    assert len(unlike) == 3 and not may[np.isin(i, unlike) & np.isin(j, unlike)].any()


def test_chance_meetings_stay_without_texts(spark):
    """Buckets of unlike nodes go, copies stay with all that may be alike, equal buckets come once, and a bucket of more than PAIRED nodes stays whole."""
    draw = random.Random(12)
    lines = {n: _line(draw, 300) for n in range(400)}
    lines |= {1000 + n: lines[n][:290] for n in range(100)}  # copies
    column = pa.array(list(lines.values()))
    points, firsts = textarrays.code_points(next(iter(textarrays.slices(column))))
    size, sketch = line_dedup._sketches(*line_dedup._shingles(points, firsts[:-1], firsts[1:], 6))
    sketches = spark.createDataFrame([(n, int(s), bytearray(x)) for n, s, x in zip(lines, size, sketch)], "node long, size long, sketch binary")
    buckets = [[n, (n + 1) % 400, (n + 2) % 400] for n in range(400)] + [[n, 1000 + n, 200 + n] for n in range(100)] + [[300 + n, n, 1000 + n] for n in range(100)] + [list(range(100))]
    rows = spark.createDataFrame([(k, n, len(b)) for k, b in enumerate(buckets) for n in b], "key long, node long, many long")
    got = [r.asDict() for r in links.narrowed(rows, sketches, 0.8).collect()]
    assert sorted((r["node"], r["least"], r["many"], r["near"]) for r in got) == sorted([(1000 + n, n, 2, True) for n in range(100)] + [(n, 0, 100, True) for n in range(1, 100)])
