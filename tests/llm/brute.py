"""Plain versions of the operators' contracts, for small tables."""
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

from pyspark.sql import Row

BLANK = " \t\n\r\x0b\x0c"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, window):
    """{id: (words, removed, kept)} of {id: text}."""
    said = {d: re.findall("[^\x20\x09-\x0D]+", docs[d] or "") for d in sorted(docs)}
    first, out = {}, {}
    for d, w in said.items():
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), d)
    for d, w in said.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out[d] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)
    return out


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def near_duplicates(docs, similarity=0.8):
    """{id: least id of its group} by multisets of five words."""
    bags = {}
    for d in sorted(docs):
        w = (docs[d] or "").encode().split()
        if w:
            bags[d] = Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))
    groups, where = Union(), defaultdict(list)
    for d, bag in bags.items():
        common = Counter()
        for s, n in bag.items():
            for e, m in where[s]:
                common[e] += min(n, m)
            where[s].append((d, n))
        for e, c in common.items():
            if c >= similarity * (sum(bag.values()) + sum(bags[e].values()) - c):
                groups.join(d, e)
    return {d: groups.find(d) for d in docs}


def line_dedup(docs, similarity=0.8, width=6):
    """{id: (lines that are not blank, removed, kept text)}."""
    first = {}
    for d in sorted(docs):
        for i, line in enumerate((docs[d] or "").split("\n")):
            if line.strip(BLANK):
                first.setdefault(line.strip(BLANK), (d, i))
    sets = {first[x]: {x[i:i + width] for i in range(max(1, len(x) - width + 1))} for x in first}
    groups, nodes = Union(), sorted(sets)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                groups.join(a, b)
    out = {}
    for d in docs:
        lines = (docs[d] or "").split("\n")
        stay = [x for i, x in enumerate(lines) if not x.strip(BLANK) or first[x.strip(BLANK)] == (d, i) == groups.find((d, i))]
        out[d] = sum(bool(x.strip(BLANK)) for x in lines), len(lines) - len(stay), "\n".join(stay)
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def check_packing(rows, ids, window=2048):
    """Pieces rebuild every document and fill every window; ids: {key: [ids of each row]} of rows in any order."""
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s, parts in windows.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or s == max(windows)
    assert set(pieces) == set(ids)
    for d, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            cut = ids[d][at:at + r.length]
            assert (r.start, r.doc_tokens) == (at, len(ids[d])) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))
            at += r.length
        assert at == len(ids[d])


def table(spark, texts, lang=None):
    rows = [Row(text=t, doc_id=d, lang=lang and lang.get(d), source="s", n_chars=len(t or ""), row="clash", kept=True, bands=1, text_key="x", node=None) for d, t in texts.items()]
    return spark.createDataFrame(rows, "text string, doc_id long, lang string, source string, n_chars long, row string, kept boolean, bands int, text_key string, node string")
