"""Resampling, exact tests and corrections over paired per-instance outcomes."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailrank.functions.columns import (HASH_FACTOR, HASH_RANGE, SEED_FACTOR, binomial_quantile, hash_seeded, let, log_gamma, mcnemar_p, poisson_quantile, uniform,
                                         wilson_bound)
from trailrank.functions.ordered import frozen, number_rows

# Cumulative Poisson(1) probabilities; a draw counts the thresholds it passes.
POISSON_STEPS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
                 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
                 0.999998874797402, 0.9999998885745217]


def pair_arms(metrics: DataFrame, a: str, b: str, keys: list[str], value: str, arm: str = "arm") -> DataFrame:
    """Values of two arms on the rows both have: one aggregation, no self-join."""
    wide = metrics.filter(F.col(arm).isin(a, b)).groupBy(*keys).agg(
        F.max(F.when(F.col(arm) == a, F.col(value))).alias("a"), F.max(F.when(F.col(arm) == b, F.col(value))).alias("b"))
    return wide.filter("a is not null and b is not null")


def _interval(means: DataFrame, by: list[str], replicates: int) -> DataFrame:
    """Order statistics ``sorted[int(p*B)]`` over the B resamples that drew anything; a group holds one
    row per replicate."""
    at = F.row_number().over(W.partitionBy(*by).orderBy("m")) - 1
    drawn = F.count(F.lit(1)).over(W.partitionBy(*by))
    lo, hi = F.floor(0.025 * F.col("_b")), F.floor(0.975 * F.col("_b"))
    return (means.filter("m is not null").withColumn("_b", drawn).withColumn("_i", at).groupBy(*by)
            .agg(F.max(F.when(F.col("_i") == lo, F.col("m"))).alias("lo"), F.max(F.when(F.col("_i") == hi, F.col("m"))).alias("hi"),
                 F.avg((F.col("m") > 0).cast("double")).alias("p_gt0")))


#: Values, or blocks of values, that one row of a replicate spreads its draws over.
FAN = 256


def _spread(drawn, replicates_seed, items):
    """Draws dealt to the items of an array (at, weight, value) one after the other: a binomial of what is left, with the item's part of the
    weight that is left. Returns the array of counts in a struct with the sum of count x value."""
    whole = F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + x["weight"])

    def step(acc, x):
        share = x["weight"].cast("double") / acc["weight"]
        return let(binomial_quantile(acc["left"], share, uniform(x["at"], replicates_seed)), lambda n: F.struct(
            (acc["left"] - n).alias("left"), (acc["weight"] - x["weight"]).alias("weight"), (acc["total"] + n * x["value"]).alias("total"),
            F.concat(acc["counts"], F.array(n)).alias("counts")))

    none = F.array().cast("array<bigint>")
    start = F.struct(drawn.cast("bigint").alias("left"), whole.alias("weight"), F.lit(0.0).alias("total"), none.alias("counts"))
    return F.aggregate(items, start, step)


#: Rows that are drawn at a time, and numbered values that meet the draws of every replicate in one group.
DRAWS, BLOCK = 1 << 21, 1 << 14


def _picked(slots: np.ndarray, b: int, n: int) -> np.ndarray:
    """``hash_seeded(slot, b) % n`` for an array of slots (uint32, which wraps at 2^32)."""
    h = slots * np.uint32(HASH_FACTOR) + np.uint32(b * SEED_FACTOR % HASH_RANGE)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(1103515245) + np.uint32(12345)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(1664525) + np.uint32(1013904223)
    h = h ^ (h >> np.uint32(16))
    return h % np.uint32(n) if n < HASH_RANGE else h


def _row_draws(values: DataFrame, by: list[str], unit: str, value: str, replicates: int) -> DataFrame:
    """Means of resamples that draw n of the n rows one by one: slot and replicate give the number of a row, rows are numbered by ``unit``.

    A task makes the draws of ``DRAWS`` slots of a replicate and hands them on as counts for each block of ``BLOCK`` row numbers; the values of a block meet the
    counts of all replicates. No draw is a row of a shuffle, and neither the values nor the draws of a replicate are ever in one place."""
    block = BLOCK
    numbered = number_rows(values.select(*by, unit, F.col(value).cast("double").alias("value")), by, [F.col(unit).asc_nulls_last()], "at", start=0)
    placed = numbered.select(*by, F.floor(F.col("at") / block).alias("block"), (F.col("at") % block).cast("int").alias("place"), "value")
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    asked = (sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / DRAWS))))
             .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("from", F.col("part") * DRAWS)
             .withColumn("to", F.least(F.col("n"), (F.col("part") + 1) * DRAWS)).select(*by, "b", "n", "from", "to").repartition(*by, "b", "from"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.select(*by).schema)

    def draw(batches):
        for batch in batches:
            for i, (b, n, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("b", "n", "from", "to")))):
                at = np.sort(_picked(np.arange(low, high, dtype=np.uint64).astype(np.uint32), b, n))
                blocks, starts = np.unique(at // np.uint32(block), return_index=True)
                ends = np.append(starts[1:], len(at))
                for first in range(0, len(blocks), 256):
                    out, places = [], []
                    for k, s, e in zip(blocks[first:first + 256].tolist(), starts[first:first + 256].tolist(), ends[first:first + 256].tolist()):
                        place = (at[s:e] - np.uint32(k * block)).astype(np.uint16)
                        counts = np.bincount(place, minlength=block) if 2 * len(place) >= block else None  # few draws are written as they are
                        if counts is not None and counts.max() < 256:
                            places.append((counts.astype(np.uint8).tobytes(), True))
                        else:
                            places.append((place.tobytes(), False))
                        out.append(k)
                    same = pa.array([i] * len(out))
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(same) for c in by], pa.array([b] * len(out), pa.int32()), pa.array(out, pa.int64()),
                         pa.array([p for p, _ in places], pa.binary()), pa.array([d for _, d in places], pa.bool_())], [*by, "b", "block", "draws", "dense"])

    drawn = asked.mapInArrow(draw, f"{keys}, b int, block bigint, draws binary, dense boolean")

    def meet(key, rows, draws):
        held, known = np.zeros(block), np.zeros(block)
        place, value = rows.column("place").to_numpy(), rows.column("value")
        valid = value.is_valid().to_numpy()
        held[place[valid]], known[place[valid]] = value.drop_null().to_numpy(), 1.0
        total, n = [], []
        for raw, dense in zip(draws.column("draws").to_pylist(), draws.column("dense").to_pylist()):
            counts = np.frombuffer(raw, np.uint8) if dense else np.bincount(np.frombuffer(raw, np.uint16), minlength=block)
            drew = counts > 0  # a value that was not drawn takes no part, finite or not
            total.append(float((counts[drew] * held[drew]).sum()))
            n.append(float(counts @ known))
        same = [pa.array([k.as_py()] * len(n), k.type) for k in key[:len(by)]]
        return pa.table([*same, draws.column("b"), pa.array(total, pa.float64()), pa.array(n, pa.float64())], [*by, "b", "total", "n"])

    sums = (placed.groupBy(*by, "block").cogroup(drawn.groupBy(*by, "block")).applyInArrow(meet, f"{keys}, b int, total double, n double"))
    return sums.groupBy(*by, "b").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))


def bootstrap_means(values: DataFrame, by: list[str], unit: str, value: str, replicates: int, method: str = "multinomial") -> DataFrame:
    """Mean of every resample: (by, b, m). Rows of equal value are interchangeable, so a resample is how often it drew each distinct value.

    ``multinomial`` draws n of n with replacement: the counts are dealt to the values in ascending order, each a binomial of
    what is left. More than ``FAN`` values are dealt to blocks of ``FAN`` values first, so a row holds an array of that size at most. ``poisson`` gives
    every row an independent Poisson(1) weight, which add up to a Poisson of its count for each value. Either way a replicate has rows by distinct values, not by rows.

    ``rows`` and ``poisson_rows`` do the same work row by row: n rows are drawn one at a time by hash (``_row_draws``), or each row gets a Poisson(1) weight of its own
    in every replicate, in one pass with map-side combine."""
    if method == "rows":
        return _row_draws(values, by, unit, value, replicates)
    b = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    if method == "poisson_rows":
        rows = values.select(*by, unit, value).withColumn("b", b).withColumn("_u", hash_seeded(F.col(unit), F.col("b")) / F.lit(float(HASH_RANGE)))
        rows = rows.withColumn("_w", sum((F.when(F.col("_u") >= s, 1).otherwise(0) for s in POISSON_STEPS), F.lit(0)))
        return rows.groupBy(*by, "b").agg((F.sum(F.col("_w") * F.col(value)) / F.nullif(F.sum("_w"), F.lit(0))).alias("m"))
    counted = values.groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("weight"))
    if method == "poisson":
        at = number_rows(frozen(counted), by, [F.col("value")], "at", start=0)
        drawn = at.withColumn("b", b).withColumn("n", poisson_quantile(F.col("weight"), uniform(F.col("at"), F.col("b"))))
        return drawn.groupBy(*by, "b").agg((F.sum(F.col("n") * F.col("value")) / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    level = frozen(number_rows(frozen(counted), by, [F.col("value")], "at", start=0))
    levels = []
    while True:  # values, blocks of values, blocks of blocks, ... up to one block for each group
        item = F.struct("at", "weight", "value")
        blocks = (level.withColumn("block", F.floor(F.col("at") / FAN)).groupBy(*by, "block")
                  .agg(F.sum("weight").alias("weight"), F.sort_array(F.collect_list(item)).alias("items")))
        levels.append(blocks)
        if not level.filter(F.col("at") >= FAN).limit(1).count():
            break
        level = frozen(blocks.select(*by, F.col("block").alias("at"), "weight", F.lit(0.0).alias("value")))
    drawn = levels[-1].select(*by, "block", F.col("weight").alias("n")).withColumn("b", b).repartition(*by, "b")
    for depth in range(len(levels) - 1, -1, -1):
        seed = F.col("b") + depth * replicates
        dealt = drawn.join(levels[depth].select(*by, "block", "items"), [*by, "block"]).withColumn("_s", _spread(F.col("n"), seed, F.col("items")))
        if depth:
            each = F.explode(F.arrays_zip(F.col("items.at").alias("block"), F.col("_s.counts").alias("n")))
            drawn = frozen(dealt.select(*by, "b", each.alias("_e")).select(*by, "b", "_e.block", "_e.n").filter("n > 0"))
    sums = dealt.groupBy(*by, "b").agg(F.sum("_s.total").alias("total"), F.sum("n").alias("n"))
    return sums.select(*by, "b", (F.col("total") / F.col("n")).alias("m"))


def bootstrap_ci(values: DataFrame, by: list[str], unit: str, value: str, replicates: int = 5000, method: str = "multinomial") -> DataFrame:
    """Mean with the 95 % percentile interval; a single value gives a degenerate interval. The values
    are read several times, so they are checkpointed once instead of being computed again."""
    values = frozen(values.select(*by, unit, value))
    means = bootstrap_means(values, by, unit, value, replicates, method)
    base = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    joined = base.join(_interval(means, by, replicates), by)
    one = F.col("n") == 1
    return joined.select(*by, "n", F.round("mean", 6).alias("mean"),
                         F.round(F.when(one, F.col("mean")).otherwise(F.col("lo")), 6).alias("lo"),
                         F.round(F.when(one, F.col("mean")).otherwise(F.col("hi")), 6).alias("hi"), F.round("p_gt0", 6).alias("p_gt0"))


def paired_bootstrap(pairs: DataFrame, by: list[str], unit: str, replicates: int = 5000, method: str = "multinomial") -> DataFrame:
    """``bootstrap_ci`` of a - b with P(delta > 0) and whether the interval excludes zero."""
    diff = pairs.withColumn("d", (F.col("a") - F.col("b")).cast("double"))
    ci = bootstrap_ci(diff, by, unit, "d", replicates, method)
    return ci.withColumn("sig", ((F.col("lo") > 0) | (F.col("hi") < 0)) & (F.col("n") > 1))


def mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Wins, losses, discordant pairs and the exact two-sided p of 0/1 pairs."""
    counted = pairs.groupBy(*by).agg(F.count_if(F.expr("a = 1 and b = 0")).alias("wins"), F.count_if(F.expr("a = 0 and b = 1")).alias("losses"))
    return counted.select(*by, "wins", "losses", (F.col("wins") + F.col("losses")).alias("discordant"),
                          F.round(mcnemar_p(F.col("wins"), F.col("losses")), 6).alias("p"))


def paired_report(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Both rates, wins, losses and the exact p from one aggregation of the pairs."""
    counted = pairs.groupBy(*by).agg(F.round(100 * F.avg("a"), 6).alias("rate_a"), F.round(100 * F.avg("b"), 6).alias("rate_b"),
                                     F.count_if(F.expr("a = 1 and b = 0")).alias("wins"), F.count_if(F.expr("a = 0 and b = 1")).alias("losses"))
    return counted.withColumn("p", F.round(mcnemar_p(F.col("wins"), F.col("losses")), 6))


def wilson(counts: DataFrame, k: str, n: str) -> DataFrame:
    return counts.withColumns({"lo": F.round(wilson_bound(F.col(k), F.col(n), -1), 6), "hi": F.round(wilson_bound(F.col(k), F.col(n), 1), 6)})


def holm_adjust(tests: DataFrame, family: list[str], name: str, p: str = "p") -> DataFrame:
    """Step-down correction: running maximum of min(1, (m - rank) p). A family is a list of
    hypotheses, one row each."""
    w = W.partitionBy(*family)
    ranked = tests.withColumn("_m", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(p, name)) - 1)
    raw = F.least(F.lit(1.0), (F.col("_m") - F.col("_r")) * F.col(p))
    run = F.max("_raw").over(w.orderBy(p, name).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("_raw", raw).withColumn("p_adj", F.round(run, 6)).drop("_m", "_r", "_raw")


def random_tie_control(items: DataFrame, gold: DataFrame, keys: list[str], item: str, primary: str | None, tops: list[int]) -> DataFrame:
    """Probability that all gold of a group is inside the top N when ties under ``primary`` are ordered at random (``primary=None``: the whole
    order is random): (keys, n_top, prob).

    Blocks of equal ``primary`` that end above N are inside, those that begin below it are not, and of the s tied items that lie across the
    cut, r go in: m gold items among them are all inside with probability C(s-m, r-m) / C(s, r). Rows are one for each distinct value of a group."""
    by = F.col(primary) if primary else F.lit(0)
    blocks = items.groupBy(*keys, by.alias("_p")).agg(F.count(F.lit(1)).alias("_s"))
    above = F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("_above", above)
    wanted = gold.select(*keys, item).distinct()
    where = items.select(*keys, item, by.alias("_p"))
    held = wanted.join(where, [*keys, item], "left").groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_m"))
    rows = held.join(placed, [*keys, "_p"], "left").withColumn("n_top", F.explode(F.array(*[F.lit(n) for n in tops])))
    s, m, r = (F.col(c).cast("double") for c in ("_s", "_m", "_r"))
    some = F.exp(log_gamma(r + 1) - log_gamma(r - m + 1) - log_gamma(s + 1) + log_gamma(s - m + 1))
    inside = (F.when(F.col("_s").isNull(), 0.0).when(F.col("_r") >= F.col("_s"), 1.0).when(F.col("_r") < F.col("_m"), 0.0).otherwise(some))
    rows = rows.withColumn("_r", F.col("n_top") - F.col("_above"))
    # at most one block of a group lies across the cut, so the least factor is the product
    return rows.groupBy(*keys, "n_top").agg(F.round(F.min(inside), 6).alias("prob"))


def seeded_tie_control(items: DataFrame, keys: list[str], item: str, gold: str, primary: str | None, tops: list[int], seeds: int) -> DataFrame:
    """Share of seeds for which all gold of a group is inside the top N when ties under ``primary`` (a number) are ordered by a seeded draw (``primary=None``:
    the whole order is drawn): (keys, n_top, prob). ``items`` holds one row per (keys, item), ``gold`` is its 0/1 column; an item that is null has no place.

    Each seed orders every item of a group, and all gold is inside the top N when its last item is. The place of that one is the number of
    items up to it, so the orders are counted and nothing is sorted for a seed; all steps keep to one partitioning by ``keys``."""
    order = ([(-F.col(primary)).alias("p")] if primary else []) + [F.coalesce(hash_seeded(F.col(item), F.col("_seed")), F.lit(HASH_RANGE)).alias("h"), F.col(item).alias("i")]
    wanted = items.filter(F.col(gold) == 1)
    draws = F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))
    last = (wanted.withColumn("_seed", draws).groupBy(*keys, "_seed")
            .agg(F.max(F.when(F.col(item).isNotNull(), F.struct(*order))).alias("_at"), (F.count(F.lit(1)) == F.count(item)).alias("_whole"))
            .groupBy(*keys).agg(F.collect_list(F.struct("_seed", "_at", "_whole")).alias("_last")))
    met = items.join(last, keys).select(*keys, *([primary] if primary else []), item, F.explode("_last").alias("_l")).select("*", "_l.*")
    places = met.groupBy(*keys, "_seed").agg(F.count_if(F.struct(*order) <= F.col("_at")).alias("_pos"), F.min("_whole").alias("_whole"))
    inside = places.groupBy(*keys).agg(*[F.count_if(F.col("_whole") & (F.col("_pos") <= n)).alias(f"_top{n}") for n in tops])
    nameless = wanted.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).select(*keys).distinct()  # their items meet no ranking
    inside = inside.unionByName(nameless.select(*keys, *[F.lit(0).cast("bigint").alias(f"_top{n}") for n in tops]))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n_top"), F.col(f"_top{n}").alias("ok")) for n in tops]))
    return inside.select(*keys, each.alias("_e")).select(*keys, "_e.n_top", (F.col("_e.ok") / F.lit(float(seeds))).alias("prob"))


def win_loss(flags: DataFrame, control: DataFrame, keys: list[str], tau: float = 0.5) -> DataFrame:
    """Win: the tie-breaker holds the gold and chance does not (prob < tau); loss: the reverse."""
    j = flags.join(control, keys)
    return j.select(*keys, ((F.col("flag") == 1) & (F.col("prob") < tau)).cast("int").alias("win"),
                    ((F.col("flag") == 0) & (F.col("prob") > 1 - tau)).cast("int").alias("loss"))


def cluster_net_sign(outcomes: DataFrame, by: list[str], instance: str = "instance_id") -> DataFrame:
    """Exact test on the net direction of each instance over models, beside naive pooling."""
    net = outcomes.groupBy(*by, instance).agg(F.sum("win").alias("w"), F.sum("loss").alias("l"))
    counted = net.groupBy(*by).agg(
        F.sum("w").alias("naive_wins"), F.sum("l").alias("naive_losses"),
        F.count_if(F.col("w") > F.col("l")).alias("cluster_wins"), F.count_if(F.col("l") > F.col("w")).alias("cluster_losses"))
    return counted.withColumns({"naive_p": F.round(mcnemar_p(F.col("naive_wins"), F.col("naive_losses")), 6),
                                "cluster_p": F.round(mcnemar_p(F.col("cluster_wins"), F.col("cluster_losses")), 6)})


def verdict(report: DataFrame) -> DataFrame:
    """GREEN: n >= 60, interval above zero, at least 8 discordant pairs, p < .05. RED: enough
    discordance and an interval that holds zero. AMBER: anything else."""
    enough = F.col("discordant") >= 8
    green = (F.col("n") >= 60) & F.col("sig") & (F.col("lo") > 0) & enough & (F.col("p") < 0.05)
    return report.withColumn("verdict", F.when(green, "GREEN").when(enough & ~F.col("sig"), "RED").otherwise("AMBER"))


def sign_stability(pairs: DataFrame, run: str) -> DataFrame:
    """Net wins per run and whether all runs point the same way."""
    net = pairs.groupBy(run).agg(F.sum(F.col("a") - F.col("b")).alias("net"))
    return net.agg(F.count(F.lit(1)).alias("runs"), F.sum("net").alias("total"), F.min("net").alias("low"), F.max("net").alias("high"),
                   F.when(F.min("net") > 0, "positive").when(F.max("net") < 0, "negative").otherwise("flips").alias("stability"))


def pair_flip_test(answers: DataFrame, keys: list[str], control: str, treated: str, by: list[str], arm: str = "arm", ans: str = "ans") -> DataFrame:
    """NO to YES against YES to NO between two probe arms on the same item."""
    wide = answers.groupBy(*by, *keys).agg(F.max(F.when(F.col(arm) == control, F.col(ans))).alias("c"),
                                           F.max(F.when(F.col(arm) == treated, F.col(ans))).alias("t"))
    both = wide.filter("c is not null and t is not null")
    counted = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("c = 'NO' and t = 'YES'")).alias("no_yes"),
                                    F.count_if(F.expr("c = 'YES' and t = 'NO'")).alias("yes_no"))
    return counted.withColumn("p", F.round(mcnemar_p(F.col("no_yes"), F.col("yes_no")), 6))
