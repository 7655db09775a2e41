"""Scoring, rank fusion and ordered cuts.

Rankings are long tables: one row per (keys..., item...) with a 1-based ``pos``. ``keys``
name the ranking (instance, arm), ``item`` the thing that is ranked (file, line).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailrank.functions.columns import cosine, hash_order, hash_seeded, tokens
from trailrank.functions.ordered import first_k, frozen, needs_slices, number_rows

Signal = list[Column]


# ---- text relevance -------------------------------------------------------------------

def line_tokens(lines: DataFrame, text: str = "text") -> DataFrame:
    """One row per (line, distinct token). De-duplicated inside the row, so no shuffle."""
    return lines.withColumn("token", F.explode(tokens(F.col(text)))).drop(text)


def inverse_frequency(token_rows: DataFrame, sizes: DataFrame, scope: list[str], n: str) -> DataFrame:
    """``idf = ln(1 + N/df)`` per (scope, token); ``sizes`` holds N per scope in column ``n``.
    ``token_rows`` must be distinct per (scope, unit, token)."""
    df = token_rows.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("df"))
    return (df.join(sizes, scope)
            .select(*scope, "token", "df", F.log1p(F.col(n) / F.col("df")).alias("idf")))


def token_relevance(token_rows: DataFrame, idf: DataFrame, query_tokens: DataFrame, scope: list[str],
                    query: list[str], unit: list[str]) -> DataFrame:
    """Sum of idf over the tokens a unit shares with the query. ``query_tokens`` carries
    (query..., scope..., token): a query only meets the units of the scopes it names."""
    wanted = query_tokens.select(*query, *scope, "token").distinct().join(idf, [*scope, "token"])
    return (token_rows.join(wanted, [*scope, "token"])
            .groupBy(*query, *scope, *unit).agg(F.round(F.sum("idf"), 6).alias("rel")))


def line_score(signals: DataFrame, alpha: float = 1.0, beta: float = 0.6, gamma: float = 1.2,
               delta: float | Column = 0.8, decay: float | None = None, use_coverage: bool = True) -> DataFrame:
    """``alpha*rel + beta*prox + gamma*slice + delta*covered``, rows with a positive score.

    Needs ``rel``, ``prox``, ``hops`` (null outside the slice) and ``covered`` (0/1). The slice
    term is 0/1, or ``decay^hops`` when ``decay`` is given."""
    inside = F.when(F.col("hops").isNull(), 0.0)
    sliced = inside.otherwise(1.0) if decay is None else inside.otherwise(F.pow(F.lit(decay), F.col("hops")))
    covered = F.coalesce(F.col("covered"), F.lit(0)) if use_coverage else F.lit(0)
    delta_col = delta if isinstance(delta, Column) else F.lit(delta)
    score = (alpha * F.coalesce("rel", F.lit(0.0)) + beta * F.coalesce("prox", F.lit(0.0))
             + gamma * sliced + delta_col * covered)
    return signals.withColumn("score", F.round(score, 6)).filter(F.col("score") > 0)


def score_sweep(signals: DataFrame, deltas: list[float], **weights) -> DataFrame:
    """One scored copy of every row per coverage weight; the grid is a literal array."""
    grid = signals.withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    return line_score(grid, delta=F.col("delta"), **weights)


def rank_lines(scores: DataFrame, keys: list[str], item: list[str], top: int | None = None,
               score: str = "score") -> DataFrame:
    order = [F.col(score).desc(), *[F.col(c) for c in item]]
    return first_k(scores, keys, order, top) if top else number_rows(scores, keys, order)


def rank_functions(functions: DataFrame, line_scores: DataFrame, covered: DataFrame, named: DataFrame,
                   keys: list[str], top: int = 6) -> DataFrame:
    """Rank functions (keys, name, start, end) by the line scores inside their span, +1.5 if a
    line was covered and +2.0 if the issue names them. A group without a positive score falls
    back to its first functions with score 0."""
    spans = functions.withColumn("line", F.explode(F.sequence("start", "end")))
    hit = spans.join(line_scores.select(*keys, "line", "score"), [*keys, "line"], "left")
    hit = hit.join(covered.select(*keys, "line").distinct().withColumn("_cov", F.lit(1)), [*keys, "line"], "left")
    summed = (hit.groupBy(*keys, "name", "start", "end")
              .agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("s"), F.max("_cov").alias("_cov")))
    summed = summed.join(named.select(*keys, "name").distinct().withColumn("_named", F.lit(1)), [*keys, "name"], "left")
    total = (F.col("s") + F.when(F.col("_cov") == 1, 1.5).otherwise(0.0)
             + F.when(F.col("_named") == 1, 2.0).otherwise(0.0))
    scored = summed.select(*keys, "name", "start", "end", F.round(total, 6).alias("score"))
    # one ranking for both: functions with a score first, the others in the order of the file behind them
    good = F.col("score") > 0
    order = [F.desc(good), F.when(good, F.col("score")).desc(), F.asc("start"), F.when(good, F.col("end")).asc(), F.when(~good, F.col("end")).desc()]
    cut = first_k(scored, keys, order, top).withColumn("_any", F.max(good).over(W.partitionBy(*keys)))
    return cut.filter(good | ~F.col("_any")).withColumn("score", F.greatest(F.col("score"), F.lit(0.0))).drop("_any")


def entity_tokens(files: DataFrame, names: str = "names") -> DataFrame:
    """Adds the distinct tokens of a file's entity names; done once per file, before files are
    paired with issues."""
    return files.withColumn("tokens", F.array_distinct(F.flatten(F.transform(names, tokens))))


def rank_files(entities: DataFrame, issues: DataFrame, keys: list[str], file: str = "file", top: int = 10) -> DataFrame:
    """TF-IDF over the entity names of candidate files, +2.0 when a file defines a name the issue
    spells out. ``entities``: one row per (keys, file) with the arrays ``names`` and ``tokens``;
    ``issues``: (keys, issue_tokens, issue_names); N = candidate files of the group. Only tokens the
    issue shares leave the row."""
    shared = F.array_intersect("tokens", "issue_tokens")
    boost = F.when(F.arrays_overlap("names", "issue_names"), 2.0).otherwise(0.0)
    pairs = frozen(entities.join(issues, keys).select(*keys, file, boost.alias("_boost"), shared.alias("_shared")))  # read three times
    rows = pairs.select(*keys, file, "_boost", F.explode_outer("_shared").alias("token"))
    n_files = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    df = rows.filter("token is not null").groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("_df")).join(n_files, keys)
    idf = df.select(*keys, "token", F.log1p(F.col("_n") / F.col("_df")).alias("_idf"))
    scored = (rows.join(idf, [*keys, "token"], "left").groupBy(*keys, file)
              .agg(F.round(F.coalesce(F.sum("_idf"), F.lit(0.0)) + F.max("_boost"), 6).alias("score")))
    return first_k(scored, keys, [F.desc("score"), F.asc(file)], top)


def prefilter_paths(paths: DataFrame, issue_tokens: DataFrame, keys: list[str], path: str = "path",
                    most: int = 1200, head: int = 300) -> DataFrame:
    """Groups with more than ``most`` paths keep the ``most`` best by token overlap with the issue
    plus the first ``head`` in name order; smaller groups stay whole."""
    unique = paths.select(*keys, path).distinct()
    rows = unique.select(*keys, path, F.explode(tokens(F.translate(F.col(path), "/", " "))).alias("token"))
    overlap = (rows.join(issue_tokens.select(*keys, "token").distinct(), [*keys, "token"], "left_semi")
               .groupBy(*keys, path).agg(F.count(F.lit(1)).alias("overlap")))
    scored = unique.join(overlap, [*keys, path], "left").fillna(0, ["overlap"])
    best = first_k(scored, keys, [F.desc("overlap"), F.asc(path)], most).drop("pos")
    first = first_k(scored, keys, [F.asc(path)], head).drop("pos")
    return best.unionByName(first).distinct()


#: Bytes of query vectors that are sent to every task; more are joined by shuffle.
QUERY_BYTES = 64 << 20


def cosine_rank(files: DataFrame, queries: DataFrame, keys: list[str], item: str, vector: str = "embedding",
                top: int = 10) -> DataFrame:
    """Best files of each query group by cosine similarity; one query vector per group. Query vectors are counted: up to ``QUERY_BYTES``
    they go to the files, which then stay where they are, and groups are cut to ``top`` rows in each task."""
    q = frozen(queries.select(*keys, F.col(vector).alias("_query")))
    size = q.agg(F.sum(8 * F.size("_query"))).first()[0] or 0
    scored = files.join(F.broadcast(q) if size <= QUERY_BYTES else q, keys).select(*keys, item, F.round(cosine(F.col(vector), F.col("_query")), 6).alias("similarity"))
    return first_k(scored, keys, [F.desc("similarity"), F.asc(item)], top)


# ---- votes and fusion -----------------------------------------------------------------

SEEN_SHIFT = 4294967296  # first_seen = sample * SEEN_SHIFT + rank


def vote_mass(votes: DataFrame, keys: list[str], item: list[str], region: DataFrame | None = None,
              sample: str = "sample", rank: str = "rank", carry: dict[str, Column] | None = None) -> DataFrame:
    """Reciprocal-rank mass, number of samples and first appearance of every voted item.

    ``rank`` is 0-based and counted over the whole answer, before ``region`` removes items. Votes
    are aggregated per sample first, so any number of samples is counted and both steps combine on the map side. ``carry``: further
    columns of the votes as aggregates that can be taken twice (max, min)."""
    kept = votes if region is None else votes.join(region.select(*keys, *item).distinct(), [*keys, *item], "left_semi")
    more = [c.alias(n) for n, c in (carry or {}).items()]
    per_sample = kept.groupBy(*keys, *item, sample).agg(
        F.sum(F.lit(1.0) / (1 + F.col(rank))).alias("_mass"), F.min(F.col(sample).cast("bigint") * SEEN_SHIFT + F.col(rank)).alias("_seen"), *more)
    return per_sample.groupBy(*keys, *item).agg(
        F.round(F.sum("_mass"), 6).alias("mass"), F.count(F.lit(1)).alias("counts"), F.min("_seen").alias("first_seen"), *more)


def rrf_fuse(items: DataFrame, keys: list[str], signals: list[Signal], ties: Signal, k: int = 20,
             out: str = "pos", sliced: bool | None = None) -> DataFrame:
    """Reciprocal-rank fusion: sum of ``1/(k + rank)`` over the signals, ranks 0-based. Each signal
    is a list of sort columns. No row is dropped. The group size is measured once for all
    rankings; the windows share one partitioning."""
    if sliced is None:
        sliced = needs_slices(items, keys)
    ranked = items
    for i, signal in enumerate(signals):
        ranked = number_rows(ranked, keys, [*signal, *ties], f"_rank{i}", start=0, sliced=sliced)
    parts = [F.lit(1.0) / (k + F.col(f"_rank{i}")) for i in range(len(signals))]
    fused = ranked.withColumn("rrf", reduce(lambda a, b: a + b, parts)).drop(*[f"_rank{i}" for i in range(len(signals))])
    return number_rows(fused, keys, [F.desc("rrf"), *ties], out, sliced=sliced)


def rrf_grid(items: DataFrame, keys: list[str], signals: list[Signal], ties: Signal, ks: list[int], sliced: bool | None = None) -> DataFrame:
    """The same fusion for a list of constants; ranks are computed once."""
    if sliced is None:
        sliced = needs_slices(items, keys)
    ranked = items
    for i, signal in enumerate(signals):
        ranked = number_rows(ranked, keys, [*signal, *ties], f"_rank{i}", start=0, sliced=sliced)
    ranked = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    parts = [F.lit(1.0) / (F.col("k") + F.col(f"_rank{i}")) for i in range(len(signals))]
    fused = ranked.withColumn("rrf", reduce(lambda a, b: a + b, parts)).drop(*[f"_rank{i}" for i in range(len(signals))])
    return number_rows(fused, [*keys, "k"], [F.desc("rrf"), *ties], sliced=sliced)


def rank_arms(items: DataFrame, keys: list[str], arms: dict[str, Signal], sliced: bool | None = None) -> DataFrame:
    """One position column per arm (``pos_<arm>``). The windows share one partitioning, so many
    arms cost one shuffle of the items."""
    if sliced is None:
        sliced = needs_slices(items, keys)
    for name, order in arms.items():
        items = number_rows(items, keys, order, f"pos_{name}", sliced=sliced)
    return items


def stack_arms(wide: DataFrame, cols: list[str], arms: list[str]) -> DataFrame:
    """Long form of ``rank_arms``: (cols, arm, pos)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"pos_{a}").alias("pos")) for a in arms]))
    return wide.select(*cols, pairs.alias("_a")).select(*cols, "_a.arm", "_a.pos")


def rank_consensus(items: DataFrame, keys: list[str], item: str, score: str = "score", sliced: bool | None = None) -> DataFrame:
    """Sample count first, then mass, then graph score, then the hash order. ``sliced``: what the largest group of a table that bounds the
    items asks for (``needs_slices``), so that they need not be computed to be measured."""
    return number_rows(items, keys, [F.desc("counts"), F.desc("mass"), F.desc(score), hash_order(F.col(item)), F.col(item)], sliced=sliced)


def rank_coverage_tier(items: DataFrame, keys: list[str], item: str, score: str = "score", k: int = 20, sliced: bool | None = None) -> DataFrame:
    """Fusion with a fourth arm from execution: tier 3 crash-frame function, 2 executed, 1 not.
    Needs 0/1 columns ``on_frame`` and ``executed``."""
    tiered = items.withColumn("tier", F.when(F.col("on_frame") == 1, 3).when(F.col("executed") == 1, 2).otherwise(1))
    signals = [[F.desc("mass"), F.asc("first_seen")], [F.desc(score), F.asc("first_seen")],
               [F.desc("counts"), F.asc("first_seen")],
               [F.desc("tier"), F.desc("counts"), F.desc("mass"), F.asc("first_seen")]]
    return rrf_fuse(tiered, keys, signals, [hash_order(F.col(item)), F.col(item)], k, sliced=sliced)


def head_rerank(ranking: DataFrame, answer: DataFrame, keys: list[str], item: list[str], n: int) -> DataFrame:
    """Reorder only the first ``n`` rows by an external answer (keys, item, ``new_pos``). Head items
    it does not name follow in their old order, the tail is untouched, an answer that names nothing
    changes nothing. Only head rows are joined and ranked."""
    named = answer.groupBy(*keys, *item).agg(F.min("new_pos").alias("new_pos"))
    head = ranking.filter(F.col("pos") <= n).join(named, [*keys, *item], "left").withColumnRenamed("pos", "_old")
    head = number_rows(head, keys, [F.asc_nulls_last("new_pos"), F.asc("_old")], sliced=False)
    tail = ranking.filter(F.col("pos") > n)
    return head.select(*ranking.columns).unionByName(tail)


def shuffle_head(ranking: DataFrame, keys: list[str], item: str, n: int, seed: int) -> DataFrame:
    """Placebo arm: the first ``n`` rows in hash order."""
    answer = (ranking.filter(F.col("pos") <= n)
              .withColumn("new_pos", hash_seeded(F.col(item), F.lit(seed))).select(*keys, item, "new_pos"))
    head = (ranking.filter(F.col("pos") <= n).withColumnRenamed("pos", "_old").join(answer, [*keys, item]))
    head = number_rows(head, keys, [F.asc("new_pos"), F.asc("_old")], sliced=False)
    return head.select(*ranking.columns).unionByName(ranking.filter(F.col("pos") > n))


def interleave(per_file: DataFrame, keys: list[str], file_order: str, out: str = "pos", sliced: bool | None = None) -> DataFrame:
    """Round-robin merge of per-file rankings: first of each file, then second of each, and so on."""
    renamed = per_file.withColumnRenamed("pos", "file_pos")
    return number_rows(renamed, keys, [F.col("file_pos"), F.col(file_order)], out, sliced=sliced)


def interleave_distinct(lists: DataFrame, keys: list[str], item: list[str], list_order: str, sliced: bool | None = None) -> DataFrame:
    """Round-robin merge that keeps the first appearance of an item and renumbers."""
    first = lists.groupBy(*keys, *item).agg(F.min(F.col("pos") * SEEN_SHIFT + F.col(list_order)).alias("_at"))
    return number_rows(first, keys, [F.col("_at")], sliced=sliced).drop("_at")


def adjacency_tier(items: DataFrame, executed: DataFrame, keys: list[str], line: str = "line", band: int = 2) -> DataFrame:
    """2 for executed lines, 1 within ``band`` lines of one, 0 otherwise. The executed side is
    dilated and the join stays an equality join."""
    near = (executed.select(*keys, F.col(line).alias("_l")).distinct()
            .withColumn(line, F.explode(F.sequence(F.col("_l") - band, F.col("_l") + band)))
            .groupBy(*keys, line).agg(F.max(F.when(F.col(line) == F.col("_l"), 2).otherwise(1)).alias("tier")))
    return items.join(near, [*keys, line], "left").fillna(0, ["tier"])


def soft_rank(tiered: DataFrame, keys: list[str], order: Signal, top: int | None = None) -> DataFrame:
    """Reorder by tier (with any further sort columns), optionally cut; nothing is filtered by tier."""
    return first_k(tiered, keys, order, top) if top else number_rows(tiered, keys, order)


def top_executed(scores: DataFrame, executed: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    kept = scores.join(executed.select(*keys, item).distinct(), [*keys, item], "left_semi")
    return first_k(kept, keys, [F.desc("score"), F.asc(item)], k)


def base_bonus_rank(pool: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """Score plus three times the group's best score for members of the base set (``in_base``)."""
    best = pool.groupBy(*keys).agg(F.max("score").alias("_best"))
    keyed = pool.join(best, keys).withColumn("key", F.when(F.col("in_base") == 1, 3 * F.col("_best")).otherwise(0.0) + F.col("score"))
    return number_rows(keyed.drop("_best"), keys, [F.desc("key"), *[F.col(c) for c in item]])


def prune_then_add(pool: DataFrame, keys: list[str], item: list[str], base_sizes: list[int], extra_sizes: list[int]) -> DataFrame:
    """For each (nb, k) of the grid: the ``nb`` best base items by execution tier plus the ``k`` best
    other items by score. Only the largest cut of each side is ranked; the grid is exploded from a
    literal array."""
    ties = [F.col(c) for c in item]
    base = first_k(pool.filter("in_base = 1"), keys, [F.desc("tier"), *ties], max(base_sizes))
    extra = first_k(pool.filter("in_base = 0"), keys, [F.desc("score"), *ties], max(max(extra_sizes), 1))
    grid = F.explode(F.array(*[F.struct(F.lit(nb).alias("nb"), F.lit(k).alias("k")) for nb in base_sizes for k in extra_sizes]))
    rows = base.unionByName(extra).withColumn("_g", grid).select("*", "_g.nb", "_g.k").drop("_g")
    return rows.filter(((F.col("in_base") == 1) & (F.col("pos") <= F.col("nb")))
                       | ((F.col("in_base") == 0) & (F.col("pos") <= F.col("k"))))


def discovery_order(found: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """Union of rounds in the order items were first seen."""
    first = found.groupBy(*keys, *item).agg(F.min(F.col("round") * SEEN_SHIFT + F.col("seq")).alias("_first"))
    return number_rows(first, keys, [F.col("_first"), *[F.col(c) for c in item]]).drop("_first")


def graph_order(found: DataFrame, graph_rank: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """Order found items by their graph rank; items without one come last."""
    ranked = found.select(*keys, *item).distinct().join(graph_rank, [*keys, *item], "left")
    return number_rows(ranked, keys, [F.asc_nulls_last("graph_pos"), *[F.col(c) for c in item]])


def renumber(ranking: DataFrame, keys: list[str]) -> DataFrame:
    """Dense positions after a filter."""
    return number_rows(ranking.withColumnRenamed("pos", "_old"), keys, [F.asc("_old")]).drop("_old")


# ---- spectrum -------------------------------------------------------------------------

def ochiai_binary(failing: DataFrame, passing: DataFrame, element: list[str]) -> DataFrame:
    """One failing and one passing group: 1 for fail-only, 0.707 for both, 0 for pass-only."""
    f = failing.select(*element).distinct().withColumn("ef", F.lit(1))
    p = passing.select(*element).distinct().withColumn("ep", F.lit(1))
    both = f.join(p, element, "full_outer").fillna(0, ["ef", "ep"])
    den = F.sqrt((F.col("ef") + (1 - F.col("ef"))) * (F.col("ef") + F.col("ep")))
    return both.withColumn("susp", F.when(den > 0, F.col("ef") / den).otherwise(0.0))


def ochiai_per_test(coverage: DataFrame, runs: DataFrame, element: list[str], run: list[str]) -> DataFrame:
    """Full spectrum: ef, ep, nf, np over runs. ``coverage`` is distinct (run, element); ``runs``
    holds one row per run with a boolean ``failing``. The totals are one row and travel as a
    broadcast of known size."""
    counted = (coverage.join(runs, run).groupBy(*element)
               .agg(F.count_if(F.col("failing")).alias("ef"), F.count_if(~F.col("failing")).alias("ep")))
    totals = runs.agg(F.count_if(F.col("failing")).alias("_f"), F.count_if(~F.col("failing")).alias("_p"))
    all_counts = counted.join(F.broadcast(totals)).select(
        *element, "ef", "ep", (F.col("_f") - F.col("ef")).alias("nf"), (F.col("_p") - F.col("ep")).alias("np"))
    den = F.sqrt(((F.col("ef") + F.col("nf")) * (F.col("ef") + F.col("ep"))).cast("double"))
    return all_counts.withColumn("susp", F.when(den > 0, F.col("ef") / den).otherwise(0.0))


def sbfl_rank(candidates: DataFrame, suspicion: DataFrame, keys: list[str], line: str = "line",
              failing_only: bool = False) -> DataFrame:
    """Order candidates by suspiciousness, then static score, then line. ``failing_only`` keeps
    the lines the failing group executed before ranking."""
    joined = candidates.join(suspicion, [*keys, line], "inner" if failing_only else "left")
    joined = joined.fillna(0.0, ["susp"]).fillna(0, ["ef"])
    if failing_only:
        joined = joined.filter("ef = 1")
    return number_rows(joined, keys, [F.desc("susp"), F.desc("score"), F.asc(line)])
