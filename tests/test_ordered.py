"""Sliced plans give the same rows as plain windows, also with one dominating group."""
import random

import pytest
from pyspark.sql import functions as F

from trailrank.functions import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(20)}", i, rng.randrange(9), rng.choice([None, rng.randrange(50)])) for i in range(3000)]
    return spark.createDataFrame(data, "g string, id int, v int, x int")


def order():
    return [F.desc("v"), F.asc("id")]


def brute(rows):
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append(r)
    out = {}
    for g, rs in groups.items():
        last = None
        for n, r in enumerate(sorted(rs, key=lambda r: (-r.v, r.id)), 1):
            if r.x is not None:
                last = r.x
            out[r.id] = (n, last)
    return out


@pytest.mark.parametrize("sliced", [False, True])
def test_both(spark, rows, sliced):
    want = brute(rows)
    n = {r.id: r.pos for r in O.number_rows(rows, ["g"], order(), sliced=sliced).collect()}
    l = {r.id: r.l for r in O.running_last(rows, ["g"], order(), "x", "l", sliced=sliced).collect()}
    assert {i: (n[i], l[i]) for i in n} == want


def test_measure_switches(spark, rows):
    assert not O.needs_slices(rows, ["g"])
    spark.conf.set(O.MAX_GROUP_ROWS_CONF, "500")
    try:
        assert O.needs_slices(rows, ["g"])
        hot = O.number_rows(rows, ["g"], order()).filter("g = 'hot'")
        assert hot.agg(F.max("pos"), F.count_distinct("pos")).first()[0] == hot.count()
    finally:
        spark.conf.unset(O.MAX_GROUP_ROWS_CONF)


def test_global_numbering_and_null_keys(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, v int")
    got = {(r.g, r.v): r.pos for r in O.number_rows(df, ["g"], [F.asc("v")], sliced=True).collect()}
    assert got == {(None, 1): 1, (None, 3): 2, ("a", 2): 1}
    assert sorted(r.pos for r in O.number_rows(df, [], [F.asc("v")], sliced=True).collect()) == [1, 2, 3]


def test_first_k_beyond_group_cut(spark, rows, monkeypatch):
    monkeypatch.setattr(O, "GROUP_CUT", 3)
    a = O.first_k(rows, ["g"], order(), 5).count()
    monkeypatch.setattr(O, "GROUP_CUT", 1000)
    assert a == O.first_k(rows, ["g"], order(), 5).count()


def test_operators_with_a_hot_instance(spark):
    """A third of all votes in one instance: fusion and metrics equal plain Python."""
    from trailrank.operators import rank as R
    rng = random.Random(9)
    raw = [(0 if rng.random() < 0.34 else rng.randrange(1, 30), rng.randrange(5), rng.randrange(200)) for _ in range(4000)]
    raw = sorted(set(raw))
    seen, votes = {}, []
    for i, s, line in sorted(raw, key=lambda r: (r[0], r[1], r[2] * 7919 % 211)):
        rank = seen.get((i, s), 0)
        seen[(i, s)] = rank + 1
        votes.append((i, s, rank, line))
    df = spark.createDataFrame(votes, "instance_id int, sample int, rank int, line int")
    mass, counts, first = {}, {}, {}
    for i, s, r, line in votes:
        mass[i, line] = mass.get((i, line), 0) + 1 / (1 + r)
        counts[i, line] = counts.get((i, line), 0) + 1
        first[i, line] = min(first.get((i, line), (9, 9)), (s, r))
    want = {}
    for inst in {i for i, _ in mass}:
        items = [k for k in mass if k[0] == inst]
        score = dict.fromkeys(items, 0.0)
        for signal in (lambda k: -round(mass[k], 6), lambda k: -counts[k]):
            for n, k in enumerate(sorted(items, key=lambda k: (signal(k), first[k]))):
                score[k] += 1 / (20 + n)
        for n, k in enumerate(sorted(items, key=lambda k: (-score[k], first[k])), 1):
            want[k] = n
    spark.conf.set(O.MAX_GROUP_ROWS_CONF, "100")
    try:
        items = R.vote_mass(df, ["instance_id"], ["line"])
        fused = R.rrf_fuse(items, ["instance_id"], [[F.desc("mass")], [F.desc("counts")]], [F.asc("first_seen")])
        assert {(r.instance_id, r.line): r.pos for r in fused.collect()} == want
    finally:
        spark.conf.unset(O.MAX_GROUP_ROWS_CONF)
