"""Ranking-quality metrics. Instances come from the gold table, so an instance without a
ranking counts as a miss and an instance without gold is skipped."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailrank.functions.columns import ratio
from trailrank.functions.ordered import first_k, median_of, value_counts


def flag(col: Column) -> Column:
    return F.coalesce(col.cast("int"), F.lit(0))


# ---- ranked lists ---------------------------------------------------------------------

def first_gold(ranking: DataFrame, gold: DataFrame, keys: list[str], item: list[str], instance: str = "instance_id") -> DataFrame:
    """Position of the first gold item of every ranking that has one."""
    gold_items = gold.select(instance, *item).distinct()
    return ranking.join(gold_items, [instance, *item], "left_semi").groupBy(*keys).agg(F.min("pos").alias("first"))


def instance_arms(gold: DataFrame, arms: list[str], instance: str = "instance_id") -> DataFrame:
    """Every (instance with gold, arm) pair; the arms are a literal array."""
    return gold.select(instance).distinct().withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))


def expect(first: DataFrame, expected: DataFrame | None, keys: list[str]) -> DataFrame:
    """First positions of the expected rankings, null where there is none; without ``expected``, ``first`` holds them all already."""
    return first if expected is None else expected.join(first, keys, "left")


def hit_at_k(first: DataFrame, expected: DataFrame | None, keys: list[str], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(keys, k, hit) for every expected ranking."""
    return (expect(first, expected, keys).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
            .select(*keys, "k", flag(F.col("first") <= F.col("k")).alias("hit")))


def recall_at_k(hits: DataFrame, by: list[str]) -> DataFrame:
    return hits.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg("hit"), 6).alias("recall"))


def reciprocal_rank(first: DataFrame, expected: DataFrame | None, keys: list[str]) -> DataFrame:
    return expect(first, expected, keys).select(*keys, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def exam(ranking: DataFrame, first: DataFrame, expected: DataFrame | None, keys: list[str]) -> DataFrame:
    """Share of the list read before the first gold item; 1 when there is none."""
    sizes = ranking.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (expect(first, expected, keys).join(sizes, keys, "left")
            .select(*keys, F.coalesce(F.col("first") / F.col("n"), F.lit(1.0)).alias("exam")))


# ---- sets -----------------------------------------------------------------------------

def overlap(pred: DataFrame, gold: DataFrame, keys: list[str], item: list[str], instance: str = "instance_id") -> DataFrame:
    """(keys, n_pred, hits): one pass over the predictions with a gold flag."""
    marked = gold.select(instance, *item).distinct().withColumn("_g", F.lit(1))
    return (pred.select(*keys, *item).distinct().join(marked, [instance, *item], "left")
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"), F.count("_g").alias("hits")))


def gold_sizes(gold: DataFrame, item: list[str], instance: str = "instance_id") -> DataFrame:
    return gold.select(instance, *item).distinct().groupBy(instance).agg(F.count(F.lit(1)).alias("n_gold"))


def set_prf(pred: DataFrame, gold: DataFrame, expected: DataFrame, keys: list[str], item: list[str],
            instance: str = "instance_id") -> DataFrame:
    counted = (expected.join(gold_sizes(gold, item, instance), instance)
               .join(overlap(pred, gold, keys, item, instance), keys, "left").fillna(0, ["n_pred", "hits"]))
    recall = ratio(F.col("hits"), F.col("n_gold"))
    precision = ratio(F.col("hits"), F.col("n_pred"))
    return counted.select(*keys, "n_gold", "n_pred", "hits", F.round(recall, 6).alias("recall"),
                          F.round(precision, 6).alias("precision"),
                          F.round(ratio(2 * precision * recall, precision + recall), 6).alias("f1"))


def superset_any(pred: DataFrame, gold: DataFrame, expected: DataFrame, keys: list[str], item: list[str],
                 instance: str = "instance_id") -> DataFrame:
    """Does the predicted set hold all / any of the gold, and how large is it."""
    counted = (expected.join(gold_sizes(gold, item, instance), instance)
               .join(overlap(pred, gold, keys, item, instance), keys, "left").fillna(0, ["n_pred", "hits"]))
    return counted.select(*keys, flag(F.col("hits") == F.col("n_gold")).alias("superset"),
                          flag(F.col("hits") > 0).alias("any_hit"), F.col("n_pred").alias("loc"))


def summarize_sets(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg("superset"), 6).alias("superset"),
                                   F.round(100 * F.avg("any_hit"), 6).alias("any_hit"), F.round(F.avg("loc"), 6).alias("loc"))


def sweep_curve(ranking: DataFrame, gold: DataFrame, item: list[str], grid: list[int], window: int | None = None,
                length: str | None = None, instance: str = "instance_id", line: str = "line", parts: int | None = None) -> DataFrame:
    """Superset / any / size of the top-N cut for every N of a grid. Without a window an item enters
    the curve once, at the first grid value that admits it: counts per step, then a running sum over
    the (short) grid. With a window the dilated cuts overlap, so each line enters at the smallest
    position that reaches it, and meets the gold in one aggregate by instance, over ``parts`` tasks where given."""
    cut = ranking.filter(F.col("pos") <= max(grid))
    if window is not None:
        low = F.greatest(F.lit(1), F.col(line) - window)
        high = F.col(line) + window if length is None else F.least(F.col(length), F.col(line) + window)
        cut = cut.withColumn(line, F.explode(F.when(high >= low, F.sequence(low, high)))).groupBy(instance, *item).agg(F.min("pos").alias("pos"))
    marked = gold.select(instance, *item).distinct().withColumn("_g", F.lit(1))
    step = F.explode(F.filter(F.array(*[F.lit(n) for n in grid]), lambda n: n >= F.col("pos")))
    if window is None:
        flagged = cut.join(marked, [instance, *item], "left")
    else:  # lines are there once
        both = cut.unionByName(marked.dropna(subset=item), allowMissingColumns=True)
        both = both.repartition(parts, instance) if parts else both.repartition(instance)
        flagged = both.groupBy(instance, *item).agg(F.min("pos").alias("pos"), F.max("_g").alias("_g")).filter("pos is not null")
    per_cut = (flagged.groupBy(instance, "pos").agg(F.count(F.lit(1)).alias("c"), F.count("_g").alias("g"))
               .withColumn("n_top", step).groupBy(instance, "n_top").agg(F.sum("c").alias("n_pred"), F.sum("g").alias("hits")))
    expected = (gold_sizes(gold, item, instance).withColumn("n_top", F.explode(F.array(*[F.lit(n) for n in grid])))
                .join(per_cut, [instance, "n_top"], "left").fillna(0, ["n_pred", "hits"]))
    return expected.groupBy("n_top").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(100 * F.avg(flag(F.col("hits") == F.col("n_gold"))), 6).alias("superset"),
        F.round(100 * F.avg(flag(F.col("hits") > 0)), 6).alias("any_hit"), F.round(F.avg("n_pred"), 6).alias("loc"))


def _beside(curve: DataFrame, baseline: DataFrame) -> DataFrame:
    """The curve with the baseline's size and superset; several rows of the baseline count as their mean, so what is sent to the tasks is one row."""
    one = baseline.agg(F.avg("loc").alias("base_loc"), F.avg("superset").alias("base_superset"))
    return curve.join(F.broadcast(one))


def matched_operating_point(curve: DataFrame, baseline: DataFrame) -> DataFrame:
    """Grid point whose size is nearest the baseline's (one row each; ties go to the smaller cut).
    The curve has one row per grid value."""
    near = _beside(curve, baseline)
    best = F.min_by(F.struct("n_top", "superset", "any_hit", "loc", "base_loc", "base_superset"),
                    F.struct(F.abs(F.col("loc") - F.col("base_loc")), F.col("n_top")))
    return near.agg(best.alias("b")).select("b.*")


def pareto_best(curve: DataFrame, baseline: DataFrame) -> DataFrame:
    """Points at least as good as the baseline on both axes and better on one; the best by superset
    gain plus ten times the relative size saving."""
    near = _beside(curve, baseline)
    gain = F.col("superset") - F.col("base_superset")
    saving = F.col("base_loc") - F.col("loc")
    good = near.filter((gain >= 0) & (saving >= 0) & ((gain > 0) | (saving > 0)))
    scored = good.withColumn("gain", F.round(gain + 10 * saving / F.greatest(F.col("base_loc"), F.lit(1.0)), 6))
    best = F.max_by(F.struct("n_top", "superset", "loc", "gain"), F.struct(F.col("gain"), -F.col("n_top")))
    return scored.agg(best.alias("b")).filter("b is not null").select("b.*")


def vote_threshold_curve(counts: DataFrame, gold: DataFrame, item: list[str], thresholds: list[int],
                         instance: str = "instance_id") -> DataFrame:
    """Quality of the set of items with at least t votes, for each t."""
    rows = counts.withColumn("t", F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col("counts"))))
    expected = gold.select(instance).distinct().withColumn("t", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    per = set_prf(rows, gold, expected, [instance, "t"], item, instance)
    return per.groupBy("t").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "f1", "n_pred")])


def per_sample_vs_merged(samples: DataFrame, gold: DataFrame, item: list[str], instance: str = "instance_id",
                         sample: str = "sample") -> DataFrame:
    """Superset / any / size averaged over the samples of an instance and for their union."""
    per_keys = [instance, sample]
    listed = samples.join(gold.select(instance).distinct(), instance, "left_semi").select(*per_keys).distinct()
    one = superset_any(samples, gold, listed, per_keys, item, instance)
    one = one.groupBy(instance).agg(*[F.avg(c).alias(c) for c in ("superset", "any_hit", "loc")])
    merged = superset_any(samples, gold, gold.select(instance).distinct(), [instance], item, instance)
    both = one.withColumn("view", F.lit("per_sample")).unionByName(
        merged.select(instance, *[F.col(c).cast("double") for c in ("superset", "any_hit", "loc")], F.lit("merged").alias("view")))
    return summarize_sets(both, ["view"])


def loose_metrics(pred: DataFrame, gold: DataFrame, hunks: DataFrame, spans: DataFrame, keys: list[str], line: str = "line",
                  tolerance: int = 2) -> DataFrame:
    """Recall within a tolerance, share of hunks hit, share of gold functions hit (null without any)
    and over-prediction. ``hunks``: (keys, hunk, line); ``spans``: (keys, name, line). ``loose_summary`` averages them."""
    cols = [*keys, line]
    p = pred.select(*cols).distinct()
    g = gold.select(*cols).distinct()
    near = (p.withColumn(line, F.explode(F.sequence(F.col(line) - tolerance, F.col(line) + tolerance))).distinct())
    loose = (g.join(near.withColumn("_n", F.lit(1)), cols, "left").join(p.withColumn("_p", F.lit(1)), cols, "left")
             .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gold"), F.count("_p").alias("hits"), F.count("_n").alias("near")))
    sizes = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"))
    hunk = (hunks.join(p.withColumn("_p", F.lit(1)), cols, "left").groupBy(*keys, "hunk").agg(F.max("_p").alias("h"))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hunk"), F.count("h").alias("hunk_hits")))
    gold_f = spans.join(g, cols, "left_semi").select(*keys, "name").distinct()
    pred_f = spans.join(p, cols, "left_semi").select(*keys, "name").distinct().withColumn("_f", F.lit(1))
    func = (gold_f.join(pred_f, [*keys, "name"], "left").groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_func"), F.count("_f").alias("func_hits")))
    joined = loose.join(sizes, keys, "left").join(hunk, keys, "left").join(func, keys, "left").fillna(0, ["n_pred", "hunk_hits", "n_hunk"])
    return joined.select(*keys, *[F.round(c, 6).alias(n) for n, c in (
        ("exact", F.col("hits") / F.col("n_gold")), ("precision", ratio(F.col("hits"), F.col("n_pred"))),
        ("loose", F.col("near") / F.col("n_gold")), ("hunk_hit", ratio(F.col("hunk_hits"), F.col("n_hunk"))),
        ("func_hit", F.col("func_hits") / F.col("n_func")), ("over", F.col("n_pred") / F.col("n_gold")))])


def loose_summary(metrics: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Means of ``loose_metrics`` over all instances, function hits over those with a gold function, and the answers that could not be
    parsed. ``parsed``: (keys, parsed); an instance without a row there has no answer, which counts as not parsed."""
    told = parsed.groupBy(*keys).agg(F.max("parsed").alias("_ok"))
    rows = metrics.join(told, keys, "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("_ok", F.lit(False))).alias("parse_fail"),
                    *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("exact", "precision", "loose", "hunk_hit", "func_hit", "over")])


def ceilings(region: DataFrame, voted: DataFrame, covered: DataFrame, gold: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """Per group (file): share of gold inside the region and among the voted items, then the mean of
    both; beside them the pooled share of gold covered (ratio of sums)."""
    cols = [*group, *item]
    g = gold.select(*cols).distinct()
    for name, part in (("r", region), ("v", voted), ("c", covered)):
        g = g.join(part.select(*cols).distinct().withColumn(f"_{name}", F.lit(1)), cols, "left")
    per = g.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.count(f"_{x}").alias(x) for x in "rvc"])
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg(F.col("r") / F.col("n")), 6).alias("region_ceiling"),
                   F.round(F.avg(F.col("v") / F.col("n")), 6).alias("voted_ceiling"),
                   F.round(F.sum("c") / F.sum("n"), 6).alias("covered_recall"))


def recall_given_found(pred: DataFrame, gold: DataFrame, found: DataFrame, item: list[str], file: str = "file", instance: str = "instance_id") -> DataFrame:
    """Per instance: share of all gold that is predicted, and of the gold in files that were found (0 where none was).
    ``pred`` and ``gold``: (instance, file, item); ``found``: (instance, file)."""
    cols = [instance, file, *item]
    g = gold.select(*cols).distinct().join(pred.select(*cols).distinct().withColumn("_p", F.lit(1)), cols, "left")
    g = g.join(found.select(instance, file).distinct().withColumn("_f", F.lit(1)), [instance, file], "left")
    per = g.groupBy(instance).agg(F.count(F.lit(1)).alias("n_gold"), F.count("_f").alias("gold_in_found"), F.count("_p").alias("hits"))
    return per.select(instance, "n_gold", "gold_in_found", "hits", F.round(F.col("hits") / F.col("n_gold"), 6).alias("recall"),
                      F.round(ratio(F.col("hits"), F.col("gold_in_found")), 6).alias("recall_given_found"))


def region_quality(regions: DataFrame, gold: DataFrame, item: list[str], instance: str = "instance_id") -> DataFrame:
    """Per arm: gold-hit percent, median and mean region size, density = percent per median line."""
    sized = overlap(regions, gold, [instance, "arm"], item, instance)
    rows = value_counts(sized.select("arm", "n_pred", "hits"), ["arm"], "n_pred", hit=flag(F.col("hits") > 0))
    n = F.sum("_c")
    return rows.groupBy("arm").agg(
        n.alias("n"), F.round(100 * F.sum("hit") / n, 6).alias("gold_hit"), median_of("n_pred").alias("median_size"),
        F.round(F.sum(F.col("_c") * F.col("n_pred")) / n, 6).alias("mean_size")
    ).withColumn("density", F.round(F.col("gold_hit") / F.greatest(F.col("median_size"), F.lit(1.0)), 6))


def prune_loss(base: DataFrame, kept: DataFrame, gold: DataFrame, item: list[str], arms: list[str],
               instance: str = "instance_id") -> DataFrame:
    """Gold of the base list that each pruning arm drops. ``kept``: (instance, arm, item)."""
    cols = [instance, *item]
    gold_base = base.select(*cols).distinct().join(gold.select(*cols).distinct(), cols, "left_semi")
    rows = gold_base.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    marked = rows.join(kept.select(*cols, "arm").distinct().withColumn("_k", F.lit(1)), [*cols, "arm"], "left")
    return marked.groupBy("arm").agg(F.count(F.lit(1)).alias("n_gold"), F.count_if(F.col("_k").isNull()).alias("lost"),
                                     F.round(F.avg(flag(F.col("_k").isNull())), 6).alias("loss_rate"))


def executed_function_lines(items: DataFrame, spans: DataFrame, executed: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Items kept by function-level pruning: some line of their function (or the line) was executed.
    ``spans``: (keys, name, line)."""
    cols = [*keys, line]
    live = spans.join(executed.select(*cols).distinct(), cols, "left_semi").select(*keys, "name").distinct()
    in_live = spans.join(live, [*keys, "name"], "left_semi").select(*cols)
    alive = in_live.unionByName(executed.select(*cols)).distinct()
    return items.join(alive, cols, "left_semi")


def invariant_equal_sets(rankings: DataFrame, arms: list[str], item: list[str], instance: str = "instance_id") -> DataFrame:
    """Items that are missing from some arm, per instance; empty when all arms hold the same set."""
    seen = rankings.groupBy(instance, *item).agg(F.count_distinct("arm").alias("n_arms"))
    return (seen.filter(F.col("n_arms") < len(arms)).groupBy(instance).agg(F.count(F.lit(1)).alias("differing")))


def coverage_stratum(gold: DataFrame, executed: DataFrame, strata: DataFrame, item: list[str], instance: str = "instance_id") -> DataFrame:
    """Per stratum: mean share of gold executed, share of instances with any, median executed size.
    Instances without gold or without coverage are skipped."""
    sizes = executed.select(instance, *item).distinct().groupBy(instance).agg(F.count(F.lit(1)).alias("n_exec"))
    counted = gold_sizes(gold, item, instance).join(sizes, instance)
    hit = (gold.select(instance, *item).distinct().join(executed.select(instance, *item).distinct(), [instance, *item], "left_semi")
           .groupBy(instance).agg(F.count(F.lit(1)).alias("hits")))
    per = counted.join(hit, instance, "left").fillna(0, ["hits"]).join(strata, instance)
    rows = value_counts(per, ["stratum"], "n_exec", share=F.col("hits") / F.col("n_gold"), any_=flag(F.col("hits") > 0))
    n = F.sum("_c")
    return rows.groupBy("stratum").agg(n.alias("n"), F.round(100 * F.sum("share") / n, 6).alias("gold_exec_rate"),
                                       F.round(100 * F.sum("any_") / n, 6).alias("any_gold_rate"), median_of("n_exec").alias("exec_median"))


def stratified_table(values: DataFrame, dimensions: list[str], value: str) -> DataFrame:
    """Mean of a metric by bucket, several dimensions stacked: every row is exploded once per
    dimension, so there is one aggregation whatever their number."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket")) for d in dimensions]))
    return (values.select(value, pairs.alias("_d")).select(value, "_d.*").filter("bucket is not null")
            .groupBy("dimension", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(value), 6).alias("mean")))


def mix_counts(rows: DataFrame, group: list[str], category: str) -> DataFrame:
    """Counts by category with their share of the group. Totals come from the counts."""
    counts = rows.groupBy(*group, category).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    return counts.join(totals, group).withColumn("share", F.round(F.col("n") / F.col("total"), 6))


def rate_by_role_category(answers: DataFrame) -> DataFrame:
    """YES share by (role, category) with a total per role; only rows that have captured values."""
    rolled = answers.filter("has_value").rollup("role", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ans") == "YES").alias("yes"), F.grouping_id().alias("_g"))
    return (rolled.filter("_g < 3").select("role", F.when(F.col("_g") == 1, "total").otherwise(F.col("category")).alias("category"),
                                           "n", "yes", F.round(100 * F.col("yes") / F.col("n"), 6).alias("rate")))


def overall_gold_drop(records: DataFrame, nested: str) -> DataFrame:
    """False-drop rate of an elimination test over the known gold elements of nested records:
    array<array<struct<element, false_drop>>>."""
    element = records.select(F.explode(nested).alias("_f")).select(F.explode("_f").alias("_e")).select("_e.*")
    return element.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("false_drop"), 6).alias("drop_rate"))


def file_recall(ranking: DataFrame, gold_files: DataFrame, file: str = "file", ks: tuple[int, ...] = (1, 5, 10),
                top: int = 10, instance: str = "instance_id") -> DataFrame:
    """Gold-file recall in the first ``top``, hits at k, all-found flag and rank of the first hit (0 if
    missing)."""
    g = gold_files.select(instance, file).distinct()
    found = g.join(ranking.filter(F.col("pos") <= top).select(instance, file, "pos"), [instance, file], "left")
    per = found.groupBy(instance).agg(F.count(F.lit(1)).alias("n_gold"), F.count("pos").alias("n_found"), F.min("pos").alias("first"))
    return per.select(instance, F.round(F.col("n_found") / F.col("n_gold"), 6).alias("recall"),
                      flag(F.col("n_found") == F.col("n_gold")).alias("all_found"), F.coalesce("first", F.lit(0)).alias("hit_rank"),
                      *[flag(F.col("first") <= k).alias(f"r{k}") for k in ks])


def fixed_summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean and median over non-null values."""
    rows = value_counts(values, by, value)
    mean = F.sum(F.col("_c") * F.col(value)) / F.nullif(F.sum("_c"), F.lit(0))
    return rows.groupBy(*by).agg(F.sum("_c").alias("n"), F.round(mean, 6).alias("mean"), F.round(median_of(value), 6).alias("median"))


# ---- arms and settings ----------------------------------------------------------------

def arm_table(metrics: DataFrame, mapping: list[tuple[str, str, str]], metric: str, ks: list[int]) -> DataFrame:
    """Mean metric per display name in wide form. ``mapping``: (display, run, arm) literals."""
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("display"), F.lit(r).alias("run"), F.lit(a).alias("arm")) for d, r, a in mapping]))
    spark = metrics.sparkSession
    table = spark.range(1).select(rows.alias("m")).select("m.*")
    named = metrics.join(table, ["run", "arm"])
    return named.groupBy("display").pivot("k", ks).agg(F.round(100 * F.avg(metric), 6))


def ablation_delta(metrics: DataFrame, by: list[str], value: str, variant: str = "arm", full: str = "full") -> DataFrame:
    """Difference of every variant to the full setting."""
    base = metrics.filter(F.col(variant) == full).select(*by, F.col(value).alias("_full"))
    return metrics.join(base, by).select(variant, *by, value, F.round(F.col(value) - F.col("_full"), 6).alias("delta"))


def best_setting(metrics: DataFrame, setting: str, value: str, target: float) -> DataFrame:
    """The best value over all settings, and the first setting (in order) that reaches a target,
    else the best."""
    top = F.max_by(F.struct(setting, value), F.struct(F.col(value), -F.col(setting)))
    first = F.min(F.when(F.col(value) >= target, F.struct(setting, value)))
    return (metrics.agg(top.alias("t"), first.alias("f"))
            .select(F.col(f"t.{setting}").alias("best"), F.col(f"t.{value}").alias("best_value"),
                    F.coalesce(F.col(f"f.{setting}"), F.col(f"t.{setting}")).alias("chosen"),
                    F.coalesce(F.col(f"f.{value}"), F.col(f"t.{value}")).alias("chosen_value")))


def promotions(first_a: DataFrame, first_b: DataFrame, instance: str = "instance_id") -> DataFrame:
    """Instances whose first gold moved to rank 1, or into the first ten, from arm a to arm b."""
    a = first_a.select(instance, F.col("first").alias("rank_a"))
    b = first_b.select(instance, F.col("first").alias("rank_b"))
    kind = (F.when((F.col("rank_a") > 1) & (F.col("rank_b") == 1), "to_top1")
            .when((F.col("rank_a") > 10) & (F.col("rank_b") <= 10), "to_top10"))
    return a.join(b, instance).withColumn("kind", kind).filter("kind is not null")


def examples(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return first_k(rows, by, order, n, "example")


def oracle_union(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Upper bound over a fleet: an instance hits when any arm does."""
    return hits.groupBy(*keys).agg(F.max("hit").alias("hit"))


def miss_recovery(hits_a: DataFrame, reached_b: DataFrame, instance: str = "instance_id") -> DataFrame:
    """Of the instances arm a misses, how many b reaches, and the ceiling of the union."""
    joined = hits_a.select(instance, "hit").join(reached_b.select(instance, "reached"), instance, "left").fillna(0, ["reached"])
    miss = F.col("hit") == 0
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(miss).alias("missed"),
                      F.count_if(miss & (F.col("reached") == 1)).alias("recovered"),
                      F.round(100 * F.avg(flag((F.col("hit") == 1) | (F.col("reached") == 1))), 6).alias("union_ceiling"))


def recovery_audit(gold: DataFrame, base: DataFrame, added: DataFrame, reachable: DataFrame, cols: list[str],
                   instance: str = "instance_id") -> DataFrame:
    """Instances with missed gold: how many a second pass touches or completes, and how many could
    be recovered at all (every missed item reachable)."""
    g = gold.select(*cols).distinct()
    for name, part in (("b", base), ("a", added), ("r", reachable)):
        g = g.join(part.select(*cols).distinct().withColumn(f"_{name}", F.lit(1)), cols, "left")
    missed = F.col("_b").isNull()
    per = g.groupBy(instance).agg(
        F.count_if(missed).alias("missed"), F.count_if(missed & F.col("_a").isNotNull()).alias("touched"),
        F.count_if(missed & F.col("_r").isNotNull()).alias("reach")).filter("missed > 0")
    new = (added.select(*cols).distinct().join(base.select(*cols).distinct(), cols, "left_anti")
           .select(instance).distinct().withColumn("_new", F.lit(1)))
    per = per.join(new, instance, "left")
    recoverable = F.col("reach") == F.col("missed")
    touched, flipped = F.col("touched") > 0, F.col("touched") == F.col("missed")
    return per.agg(F.count(F.lit(1)).alias("miss_instances"), F.count("_new").alias("with_additions"),
                   F.count_if(touched).alias("touched"), F.count_if(flipped).alias("flipped"),
                   F.count_if(recoverable).alias("recoverable"), F.count_if(recoverable & touched).alias("recoverable_touched"),
                   F.count_if(recoverable & flipped).alias("recoverable_flipped"))


def pool_health(expected: DataFrame, pools: DataFrame, by: list[str], most: float = 0.1, instance: str = "instance_id") -> DataFrame:
    """Per run: instances that should have a pool of votes, how many pools are empty or missing, and whether that is few enough to go on.
    ``expected``: (by, instance); ``pools``: (by, instance, ...), any number of rows for a pool that is not empty."""
    cols = [*by, instance]
    held = pools.select(*cols).distinct().withColumn("_h", F.lit(1))
    per = expected.select(*cols).distinct().join(held, cols, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_h").isNull()).alias("empty"))
    return per.withColumn("share", F.round(F.col("empty") / F.col("n"), 6)).withColumn("healthy", F.col("empty") <= most * F.col("n"))


def label_flips(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """Items whose re-derived label is not the stored one, and how: ``flip`` between two labels, ``added`` or ``dropped`` where only one labelling
    holds the item (or gives it a label)."""
    o = old.groupBy(key).agg(F.max(label).alias("old_label"))
    n = new.groupBy(key).agg(F.max(label).alias("new_label"))
    change = F.when(F.col("old_label").isNull(), "added").when(F.col("new_label").isNull(), "dropped").otherwise("flip")
    return o.join(n, key, "full_outer").filter(~F.col("old_label").eqNullSafe(F.col("new_label"))).withColumn("change", change)


def relabel_summary(labels: DataFrame, subsets: list[str]) -> DataFrame:
    """Counts of a second labelling against the first over (key, subset, crash, onpath_old, onpath_new, error): rows without error, crashes confirmed and not, flips of
    ``onpath``, and members that leave each subset. A null label is unknown and counts for neither side."""
    ok = F.col("error").isNull()
    flipped = ok & F.col("onpath_new").isNotNull() & ~F.col("onpath_new").eqNullSafe(F.col("onpath_old"))
    denied = ok & (F.col("crash") == F.lit(False))
    return labels.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_err"), F.count_if(ok & F.col("crash")).alias("crash_confirmed"),
                      F.count_if(denied).alias("crash_denied"), F.count_if(flipped).alias("onpath_flips"),
                      *[F.count_if(ok & (F.col("subset") == s)).alias(f"n_{s}") for s in subsets],
                      *[F.count_if((denied | flipped) & (F.col("subset") == s)).alias(f"changed_{s}") for s in subsets])


def rule_disagreements(stored: DataFrame, derived: DataFrame, key: str, rule: str = "rule") -> DataFrame:
    """How often each stored rule meets each derived one: (stored, derived, n, agrees). Items of one side only have a null on the other."""
    s, d = stored.select(key, F.col(rule).alias("stored")), derived.select(key, F.col(rule).alias("derived"))
    both = s.join(d, key, "full_outer").groupBy("stored", "derived").agg(F.count(F.lit(1)).alias("n"))
    return both.withColumn("agrees", F.col("stored").eqNullSafe(F.col("derived")))
