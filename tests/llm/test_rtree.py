"""Hard negatives against a plain search of all rows: ties, copies, odd rows, several cells and blocks, large numbers."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailrank.llm import queries, rtree


def _brute(rows, anchors, k=5, m=5, low=80, high=100, scale=256):
    """Rows are (id, label, vector)."""
    sound = {(i, str(lab), tuple(math.floor(scale * float(x)) for x in v)) for i, lab, v in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, lab, q in sound:
        if a is None or not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), -1 << 63 if i is None else i, i, other) for i, other, v in sound if len(v) == len(q) and i != a)
        for p in [s for s in scored if s[3] == lab][:k]:
            fit = [s for s in scored if s[3] != lab and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:m]
            out += [(a, p[2], r, s[2], -p[0], -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=str)


def _got(df):
    return sorted([tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()], key=str)


def _rows(n=420, d=6):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(4, d))
    rows = [(int(i), int(i % 4) if i % 5 else int((i + 1) % 4), (centres[i % 4] + draw.normal(size=d) * 0.4).tolist()) for i in range(n)]
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(60)]  # one vector many times, all ties
    rows += [(2000 + i, 0, [0.25, 0.5] + [0.0] * (d - 2)) for i in range(10)] + [(20, 0, rows[3][2])]  # an id that occurs twice
    rows += [rows[11], rows[11], (None, 1, rows[3][2]), (3000, None, rows[1][2]), (3010, 1, None), (3020, 1, []), (3030, 2, [float("nan")] + [0.0] * (d - 1)),
             (3040, 2, [None] + [1.0] * (d - 1)), (3050, 2, [float("inf")] + [1.0] * (d - 1)), (3060, 1, [1.0, 2.0]), (3070, 1, [1.0, 1.0]), (3080, 2, [1.0, 1.5]), (3090, 9, [0.0] * d)]
    return rows


@pytest.mark.parametrize("cell_rows,block_rows", [(1 << 16, 1 << 14), (50, 10)])
def test_mining(spark, cell_rows, block_rows):
    rows = _rows()
    table = spark.createDataFrame([(v, lab, i, "x", 1) for i, lab, v in rows], "embedding array<double>, label int, vec_id long, cell string, ask int").repartition(3)
    got = _got(rtree.mine(table, F.col("vec_id") % 10 == 0, cell_rows=cell_rows, block_rows=block_rows))
    assert got == _brute(rows, lambda i: i % 10 == 0) and len(got) > 200


def test_large_numbers(spark):
    """Whole numbers past the exact range of doubles."""
    draw = np.random.default_rng(6)
    rows = [(i, i % 2, (draw.integers(-3, 9, size=3) * 10.0 ** (i % 3 + 4) + 0.5).tolist()) for i in range(80)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert _got(rtree.mine(table, F.col("vec_id") % 4 == 0)) == _brute(rows, lambda i: i % 4 == 0)


def test_tree_bounds():
    """Every interval holds the inner products below it, and boxes do get left out."""
    draw = np.random.default_rng(7)
    x = np.concatenate([draw.integers(-20, 20, size=(2000, 4)) + c for c in ([200, 0, 0, 0], [0, -200, 0, 0], [0, 0, 200, 50])]).astype(np.int64)
    order = rtree.tiled(x, np.arange(len(x)), [0, 1, 2, 3])
    assert sorted(order.tolist()) == list(range(len(x)))
    parts = [order[a:a + rtree.LEAF] for a in range(0, len(order), rtree.LEAF)]
    tree = rtree.Tree("a", parts, [x[p].astype(float) for p in parts], np.stack([x[p].min(axis=0) for p in parts]), np.stack([x[p].max(axis=0) for p in parts]))
    q = np.array([9, 1, -2, 3])
    low, high = (b[0] for b in tree.bounds(q[None].astype(float)))
    read = []

    class Counted(rtree.Lists):
        def take(self, scores, ids):
            read.append(len(ids))
            super().take(scores, ids)
    for node, below in enumerate(tree.children):
        if below is None:
            s = x[parts[node]] @ q
            assert low[node] <= s.min() and s.max() <= high[node]
        else:
            assert all(low[node] <= low[c] and high[c] <= high[node] for c in below)
    lists = Counted([(-rtree.TOP, rtree.TOP)], 5)
    rtree.search([tree], q, -1, lists, [(low, high)])
    assert lists.scores[0].tolist() == sorted((x @ q).tolist())[::-1][:5] and sum(read) < len(x) / 3


def test_no_vectors(spark):
    for rows in ([], [(1, 1, None)], [(0, 1, [1.0])], [(0, None, [1.0]), (100, 1, [2.0])]):
        table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        assert rtree.mine(table, F.col("vec_id") % 100 == 0).collect() == []


def test_query(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    rows = [(i, (lab + 1) % 10 if lab is not None and i % 7 == 0 else lab, v) for i, lab, v in rows]
    assert _got(queries.op11_hard_negatives(spark, "/root/testdata/sf0.001")) == _brute(rows, lambda i: i % 100 == 0)
