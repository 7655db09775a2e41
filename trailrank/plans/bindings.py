"""The input tables seen as issues, lines, votes, coverage and graphs, each beside the SQL that
states the same binding for the reference engine."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailrank.functions.ordered import frozen, needs_slices, number_rows
from trailrank.functions.columns import is_code, split_lines, tokens
from trailrank.operators import rank as R
from trailrank.operators.parse import numbered_lines
from trailrank.plans.registry import cte


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by id, read by splits."""
    return table(spark, sf, "documents")


# ---- votes: instance = part, sample = line number, candidate = supplier -----------------

def vote_source(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("instance_id"), F.col("l_linenumber").alias("sample"),
                                               F.col("l_suppkey").alias("line"), "l_extendedprice", "l_quantity",
                                               "l_returnflag", "l_linestatus")


def vote_slices(spark, sf) -> bool:
    """Whether some instance has more votes than a task should hold. Ids are counted in the source, which bounds every table of
    items, votes or rankings derived from it, so none of those is computed to be measured."""
    return needs_slices(vote_source(spark, sf), ["instance_id"])


#: Votes that one task takes through all sorts and aggregates of a ranking, which hold about two kilobytes for each of them.
TASK_VOTES = 250_000


def vote_parts(spark, sf) -> int:
    """How many tasks the votes are dealt over: more votes are more tasks, not larger ones."""
    return max(spark.sparkContext.defaultParallelism, -(-vote_source(spark, sf).count() // TASK_VOTES))


def ranked_votes(spark, sf, sliced: bool | None = None) -> DataFrame:
    """Votes with their rank and, of the same rows, what the static score and the flags of an item are made of."""
    src = vote_source(spark, sf)
    sliced = vote_slices(spark, sf) if sliced is None else sliced
    if not sliced:  # instances are known to be small: one shuffle serves the aggregate, the ranks and the vote mass
        src = src.repartition(vote_parts(spark, sf), "instance_id")
    best = src.groupBy("instance_id", "sample", "line").agg(
        F.max("l_extendedprice").alias("best"), F.max("l_quantity").alias("score"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("executed"),
        F.max((F.col("l_linestatus") == "O").cast("int")).alias("passing"), F.max(F.expr("l_returnflag = 'R' AND l_quantity >= 45").cast("int")).alias("gold"))
    return number_rows(best, ["instance_id", "sample"], [F.desc("best"), F.asc("line")], "rank", 0, sliced).drop("best")


def votes(spark, sf) -> DataFrame:
    return ranked_votes(spark, sf).select("instance_id", "sample", "line", "rank")


def vote_gold(spark, sf) -> DataFrame:
    return (vote_source(spark, sf).filter("l_returnflag = 'R' AND l_quantity >= 45").select("instance_id", "line").distinct())


def vote_static(spark, sf) -> DataFrame:
    return vote_source(spark, sf).groupBy("instance_id", "line").agg(F.max("l_quantity").alias("score"))


def vote_executed(spark, sf) -> DataFrame:
    return vote_source(spark, sf).filter("l_linestatus = 'F'").select("instance_id", "line").distinct()


def vote_passing(spark, sf) -> DataFrame:
    return vote_source(spark, sf).filter("l_linestatus = 'O'").select("instance_id", "line").distinct()


def vote_rows(spark, sf, sliced: bool | None = None) -> DataFrame:
    """One wide row per voted item, from one scan and one shuffle: vote mass, counts, first_seen, static score, and 0/1 whether it was executed,
    passed and is gold."""
    flags = {c: F.max(c) for c in ("score", "executed", "passing", "gold")}
    return R.vote_mass(ranked_votes(spark, sf, sliced), ["instance_id"], ["line"], carry=flags)


def vote_items(spark, sf, sliced: bool | None = None) -> DataFrame:
    """Vote mass with the static score."""
    return vote_rows(spark, sf, sliced).drop("executed", "passing", "gold")


def seen():
    return [F.asc("first_seen")]


def fuse(items: DataFrame, sliced: bool, out: str = "pos") -> DataFrame:
    """The three-signal fusion every arm study starts from."""
    return R.rrf_fuse(items, ["instance_id"], [[F.desc("mass")], [F.desc("score")], [F.desc("counts")]], seen(), out=out, sliced=sliced)


def fused(spark, sf, items=None) -> DataFrame:
    sliced = vote_slices(spark, sf)
    return fuse(vote_items(spark, sf, sliced) if items is None else items, sliced)


ARMS = ["vote_only", "static_only", "fused", "consensus"]


def arm_positions(spark, sf) -> DataFrame:
    """Four arms from one vote pass, one position column per arm, beside the items' flags."""
    sliced = vote_slices(spark, sf)
    hashed = [R.hash_order(F.col("line")), F.asc("line")]
    wide = R.rank_arms(vote_rows(spark, sf, sliced), ["instance_id"], {
        "vote_only": [F.desc("mass"), *hashed], "static_only": [F.desc("score"), *hashed],
        "consensus": [F.desc("counts"), F.desc("mass"), F.desc("score"), *hashed]}, sliced)
    return fuse(wide, sliced, "pos_fused")


def arm_rankings(spark, sf) -> DataFrame:
    """The same in long form: (instance_id, arm, line, pos)."""
    return R.stack_arms(arm_positions(spark, sf), ["instance_id", "line"], ARMS)


def gold_positions(spark, sf) -> DataFrame:
    """Positions of the gold items only; every gold item has a vote, so the flag of its row tells."""
    return R.stack_arms(arm_positions(spark, sf).filter("gold = 1"), ["instance_id", "line"], ARMS)


cte("vbest", "SELECT l_partkey AS instance_id, l_linenumber AS sample, l_suppkey AS line, max(l_extendedprice) AS best "
             "FROM lineitem GROUP BY ALL")
cte("votes", "SELECT instance_id, sample, line, row_number() OVER (PARTITION BY instance_id, sample ORDER BY best DESC, line) - 1 AS rank "
             "FROM vbest", "vbest")
cte("gold", "SELECT DISTINCT l_partkey AS instance_id, l_suppkey AS line FROM lineitem WHERE l_returnflag='R' AND l_quantity>=45")
cte("static", "SELECT l_partkey AS instance_id, l_suppkey AS line, max(l_quantity) AS score FROM lineitem GROUP BY ALL")
cte("executed", "SELECT DISTINCT l_partkey AS instance_id, l_suppkey AS line FROM lineitem WHERE l_linestatus='F'")
cte("passing", "SELECT DISTINCT l_partkey AS instance_id, l_suppkey AS line FROM lineitem WHERE l_linestatus='O'")
cte("mass", "SELECT instance_id, line, round(sum(1.0::DOUBLE/(1+rank)),6) AS mass, count(DISTINCT sample) AS counts, "
            "min(sample::BIGINT*4294967296+rank) AS first_seen FROM votes GROUP BY ALL", "votes")
cte("items", "SELECT m.*, s.score FROM mass m JOIN static s USING (instance_id, line)", "mass", "static")
HASH = "((line*2654435761) % 4294967296)"
cte("ranks3", "SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY mass DESC, first_seen)-1 AS r0, "
              "row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, first_seen)-1 AS r1, "
              "row_number() OVER (PARTITION BY instance_id ORDER BY counts DESC, first_seen)-1 AS r2 FROM items", "items")
cte("fused", "SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY rrf DESC, first_seen) AS pos FROM "
             "(SELECT *, 1.0::DOUBLE/(20+r0)+1.0::DOUBLE/(20+r1)+1.0::DOUBLE/(20+r2) AS rrf FROM ranks3)", "ranks3")
cte("arms", f"""SELECT instance_id, 'vote_only' AS arm, line, row_number() OVER (PARTITION BY instance_id ORDER BY mass DESC, {HASH}, line) AS pos FROM items
 UNION ALL SELECT instance_id, 'static_only', line, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, {HASH}, line) FROM items
 UNION ALL SELECT instance_id, 'fused', line, pos FROM fused
 UNION ALL SELECT instance_id, 'consensus', line, row_number() OVER (PARTITION BY instance_id ORDER BY counts DESC, mass DESC, score DESC, {HASH}, line) FROM items""",
    "items", "fused")
cte("arm_first", "SELECT a.instance_id, a.arm, min(a.pos) AS first FROM arms a JOIN gold g USING (instance_id, line) GROUP BY ALL", "arms", "gold")
cte("expected", "SELECT instance_id, arm FROM (SELECT DISTINCT instance_id FROM gold), "
                "(VALUES ('vote_only'),('static_only'),('fused'),('consensus')) t(arm)", "gold")
cte("hits", "SELECT e.instance_id, e.arm, k, CASE WHEN f.first <= k THEN 1 ELSE 0 END AS hit FROM expected e "
            "LEFT JOIN arm_first f USING (instance_id, arm), (VALUES (1),(3),(5),(10)) t(k)", "expected", "arm_first")


def mix_sql(item: str, seed: str) -> str:
    """The seeded draw of ``hash_seeded`` as SQL text."""
    def shift(h, bits):
        return f"xor({h}, ({h}) >> {bits})"
    h = f"((({item})::BIGINT*2654435761 + ({seed})::BIGINT*2246822519) % 4294967296)"
    h = f"(({shift(h, 15)}*1103515245 + 12345) % 4294967296)"
    h = f"(({shift(h, 13)}*1664525 + 1013904223) % 4294967296)"
    return f"({shift(h, 16)})"


# ---- lines: document text split at newlines; issues: benchmark passages -----------------

def lines(spark, sf) -> DataFrame:
    return numbered_lines(documents(spark, sf), ["doc_id"])


def doc_sizes(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(split_lines(F.col("text"))).alias("n_lines"))


RUN = 4  # words that a passage and a text that contains it share unbroken
GRAM = 8  # characters, for passages too short to hold such a run


def _met(doc_keys: DataFrame, item_keys: DataFrame) -> DataFrame:
    """(item_id, doc_id) that share the passage's rarest key. Frequencies are counted over all documents;
    a common key of a passage is never joined where it has a rarer one."""
    hits = frozen(doc_keys.join(item_keys.select("key").distinct(), "key"))
    df = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = item_keys.join(df, "key", "left").groupBy("item_id").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    return hits.join(rarest, "key").select("item_id", "doc_id").distinct()


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents (doc_id, text) that contain an item (item_id, item), with the line range of the first
    match. An item of six words or more has a run of ``RUN`` whole words between its first and last, which a
    containing text holds unbroken; a shorter one is met by its runs of up to ``GRAM`` characters. Only ids travel
    through these joins, and candidates are compared with ``contains``. An empty item is in no document."""
    n = F.size(F.split("text", " "))
    words = F.split("text", " ")
    pairs = F.zip_with(words, F.slice(words, 2, n), lambda x, y: F.xxhash64(x, y))
    runs = F.slice(F.zip_with(pairs, F.slice(pairs, 3, n), lambda x, y: F.xxhash64(x, y)), 1, F.greatest(n - RUN + 1, F.lit(0)))
    sized = items.withColumn("_n", F.size(F.split("item", " ")))
    inner = F.slice(runs, 2, F.greatest(n - RUN - 1, F.lit(0)))
    long = sized.filter(F.col("_n") >= RUN + 2).select("item_id", F.col("item").alias("text"))
    near = _met(docs.select("doc_id", F.explode(F.array_distinct(runs)).alias("key")), long.select("item_id", F.explode(F.array_distinct(inner)).alias("key")))
    short = sized.filter((F.col("_n") < RUN + 2) & (F.col("item") != "")).select("item_id", F.col("item").alias("text"))
    if not short.isEmpty():
        wide = [r[0] for r in short.select(F.least(F.length("text"), F.lit(GRAM)).alias("w")).distinct().orderBy("w").collect()]  # GRAM values at most

        def grams(w):
            return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - w + 1), lambda i: F.substring(F.col("text"), i, F.lit(w))))

        for w in wide:
            of_docs = docs.filter(F.length("text") >= w).select("doc_id", F.explode(grams(w)).alias("key"))
            near = near.unionByName(_met(of_docs, short.filter(F.least(F.length("text"), F.lit(GRAM)) == w).select("item_id", F.explode(grams(w)).alias("key"))))
    both = near.distinct().join(items, "item_id").join(docs, "doc_id").filter(F.contains("text", "item"))
    before = F.expr("substring(text, 1, instr(text, item) - 1)")
    start = 1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    height = F.length("item") - F.length(F.replace("item", F.lit("\n"), F.lit("")))
    return both.select("item_id", "doc_id", start.alias("start"), (start + height).alias("end"))


def issue_docs(spark, sf) -> DataFrame:
    """Documents that contain an issue's passage, with the line range of the match; checkpointed, since
    callers read them several times."""
    docs = documents(spark, sf).select("doc_id", "text")
    return frozen(contained(docs, table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))))


def signals(spark, sf, pairs: DataFrame | None = None) -> DataFrame:
    """Line signals of every (issue, document) pair: relevance, proximity, slice hops, coverage."""
    pairs = issue_docs(spark, sf) if pairs is None else pairs
    near = lines(spark, sf).join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    token_rows = R.line_tokens(near)
    idf = R.inverse_frequency(token_rows, doc_sizes(spark, sf), ["doc_id"], "n_lines")
    wanted = pairs.select("item_id", "doc_id").join(table(spark, sf, "benchmark").select("item_id", F.explode(tokens(F.col("text"))).alias("token")), "item_id")
    rel = R.token_relevance(token_rows, idf, wanted, ["doc_id"], ["item_id"], ["line_no"])
    rows = near.filter(is_code(F.col("text"))).join(pairs, "doc_id").join(rel, ["item_id", "doc_id", "line_no"], "left")
    block, seed = F.floor((F.col("line_no") - 1) / 10), F.floor((F.col("start") - 1) / 10)
    away = F.abs(F.col("line_no") - F.col("start"))
    return rows.select("item_id", "doc_id", F.col("line_no").alias("line"), F.coalesce("rel", F.lit(0.0)).alias("rel"),
                       F.when(block == seed, 1.0).when(block == seed + 1, 0.4).otherwise(0.0).alias("prox"),
                       F.when(away <= 3, away).alias("hops"), (F.length("text") > 40).cast("int").alias("covered"))


def tokens_sql(col: str) -> str:
    whole = f"regexp_extract_all({col}, '[A-Za-z_][A-Za-z0-9_]*')"
    part = r"string_split(replace(regexp_replace(m, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' '), ' ')"
    both = f"list_concat({whole}, flatten(list_transform({whole}, lambda m: {part})))"
    return f"list_distinct(list_filter(list_transform({both}, lambda x: lower(x)), lambda x: length(x) >= 3))"


cte("lines", "SELECT doc_id, i AS line_no, arr[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents), unnest(range(1, len(arr)+1)) t(i)")
cte("sizes", "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents")
cte("line_tok", f"SELECT doc_id, line_no, unnest({tokens_sql('text')}) AS token FROM lines", "lines")
cte("line_idf", "SELECT doc_id, token, df, ln(1+n_lines::DOUBLE/df) AS idf FROM (SELECT doc_id, token, count(*) AS df FROM line_tok GROUP BY ALL) JOIN sizes USING (doc_id)", "line_tok", "sizes")
cte("issue_docs", """SELECT item_id, doc_id, start, start+h AS "end" FROM (SELECT item_id, doc_id, 1+length(pre)-length(replace(pre,chr(10),'')) AS start, h FROM
 (SELECT b.item_id, d.doc_id, d.text[1:instr(d.text,b.text)-1] AS pre, length(b.text)-length(replace(b.text,chr(10),'')) AS h FROM benchmark b JOIN documents d ON contains(d.text,b.text)))""")
cte("issue_tok", f"SELECT item_id, unnest({tokens_sql('text')}) AS token FROM benchmark")
cte("relevance", "SELECT item_id, doc_id, line_no, round(sum(idf),6) AS rel FROM issue_docs JOIN issue_tok USING (item_id) JOIN line_tok USING (doc_id, token) JOIN line_idf USING (doc_id, token) GROUP BY ALL",
    "issue_docs", "issue_tok", "line_tok", "line_idf")
CODE_SQL = r"regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' AND NOT starts_with(regexp_replace(text, '^\s+|\s+$', '', 'g'), '#')"
cte("sig", f"""SELECT item_id, doc_id, line_no AS line, coalesce(rel,0) AS rel, CASE WHEN (line_no-1)//10=(start-1)//10 THEN 1.0::DOUBLE WHEN (line_no-1)//10=(start-1)//10+1 THEN 0.4 ELSE 0 END AS prox,
 CASE WHEN abs(line_no-start)<=3 THEN abs(line_no-start) END AS hops, (length(text)>40)::INT AS covered FROM (SELECT * FROM lines WHERE {CODE_SQL}) JOIN issue_docs USING (doc_id) LEFT JOIN relevance USING (item_id, doc_id, line_no)""",
    "lines", "issue_docs", "relevance")
cte("score1", "SELECT * FROM (SELECT item_id, doc_id, line, round(rel+0.6*prox+1.2*(hops IS NOT NULL)::INT+0.8*covered,6)::DOUBLE AS score FROM sig) WHERE score>0", "sig")


def spans(spark, sf) -> DataFrame:
    """Functions of ten lines and outer functions of thirty, so that spans nest."""
    s = doc_sizes(spark, sf)

    def blocks(width, letter):
        i = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_lines") - 1) / width)))
        b = s.withColumn("_i", i)
        return b.select("doc_id", F.concat(F.lit(letter), F.col("_i").cast("string")).alias("name"), (F.col("_i") * width + 1).cast("int").alias("start"),
                        F.least(F.col("_i") * width + width, F.col("n_lines")).cast("int").alias("end"))
    return blocks(10, "f").unionByName(blocks(30, "g"))


cte("spans", """SELECT doc_id, 'f'||i AS name, i*10+1 AS start, least(i*10+10, n_lines) AS "end" FROM sizes, unnest(range(0,(n_lines-1)//10+1)) t(i)
 UNION ALL SELECT doc_id, 'g'||i, i*30+1, least(i*30+30, n_lines) FROM sizes, unnest(range(0,(n_lines-1)//30+1)) t(i)""", "sizes")


# ---- patches: built from document lines --------------------------------------------------

ADDED = ["if flag:", "    return", "    value = 1", "# note", "other = 2"]


def patches(spark, sf) -> DataFrame:
    """One patch per document: every 7th line removed, a line added after every 3rd; French, German
    and Spanish documents touch a second file."""
    body = F.split("text", "\n")
    kinds = F.array(*[F.lit(a) for a in ADDED])
    rows = F.transform(body, lambda x, i: F.concat(
        F.when((i + 1) % 7 == 0, "-").otherwise(" "), x,
        F.when((i + 1) % 3 == 0, F.concat(F.lit("\n+"), F.get(kinds, F.floor((i + 1) / 3).cast("int") % 5))).otherwise("")))
    head = F.format_string("--- a/docs/%d.py\n+++ b/docs/%d.py\n@@ -1,%d +1,%d @@\n", "doc_id", "doc_id", F.size(body), F.size(body))
    second = (F.when(F.col("lang") == "de", F.format_string("\n--- a/lib/%d.py\n+++ b/lib/%d.py\n@@ -5,1 +5,1 @@\n-x\n+y", "doc_id", "doc_id"))
              .when(F.col("lang") != "en", F.format_string("\n--- a/notes/%d.txt\n+++ b/notes/%d.txt\n@@ -5,1 +5,1 @@\n-x\n+y", "doc_id", "doc_id")).otherwise(""))
    return documents(spark, sf).select("doc_id", "lang", "source", "text", F.concat(head, F.array_join(rows, "\n"), second).alias("patch"))


cte("edits", """SELECT DISTINCT * FROM (SELECT doc_id, 'docs/'||doc_id||'.py' AS file, 1 AS hunk, line_no AS line, 'deleted' AS kind FROM lines WHERE line_no%7=0 AND NOT starts_with(text,'--')
 UNION ALL SELECT doc_id, 'docs/'||doc_id||'.py', 1, line_no - (CASE WHEN line_no%7=0 AND starts_with(text,'--') THEN 1 ELSE 0 END) + d, 'anchor' FROM lines, (VALUES (0),(1)) t(d) WHERE line_no%3=0
 UNION ALL SELECT doc_id, CASE WHEN lang='de' THEN 'lib/'||doc_id||'.py' ELSE 'notes/'||doc_id||'.txt' END, 2, l, k FROM documents, (VALUES (5,'deleted'),(5,'anchor'),(6,'anchor')) t(l,k) WHERE lang<>'en')""", "lines")


# ---- traces: failure text built from events ----------------------------------------------

def traces(spark, sf) -> DataFrame:
    return trace_text(table(spark, sf, "events"))


def trace_text(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    f1 = F.format_string('  File "src/%s.py", line %d, in u%d', "event_type", "k", "user_id")
    f2 = F.format_string('  File "lib/m%d.py", line %d, in step_%d', F.col("k") % 5, F.col("k") + 1, "k")
    text = (F.when(F.col("event_type") == "error", F.concat(F.format_string("Seen by u%d\nTraceback (most recent call last):\n", "user_id"), f1, F.lit("\n    run()\n"), f2,
                                                           F.format_string("\n    go()\nValueError: bad %d", "k")))
            .when(F.col("event_type") == "view", F.concat(f1, F.lit("\n"), f2))
            .when(F.col("event_type") == "click", F.format_string("raise KeyError near click.py:%d", "k"))
            .when(F.col("event_type") == "purchase", F.format_string("src/purchase.py, line %d looks wrong", "k"))
            .otherwise(F.format_string("user %d signed up", "user_id")))
    test = F.when(F.col("event_type") == "purchase", "+    with pytest.raises(ValueError):").otherwise("+    call()")
    return e.select("event_id", "user_id", "event_type", "value", "k", text.alias("text"), test.alias("test_patch"))


cte("ev", "SELECT event_id, user_id, event_type, value, ts, (props->>'$.k')::INT AS k FROM events")
cte("frames", """SELECT event_id, 0 AS ord, 'src/'||event_type||'.py' AS path, k AS line, 'u'||user_id AS func FROM ev WHERE event_type IN ('error','view')
 UNION ALL SELECT event_id, 1, 'lib/m'||(k%5)||'.py', k+1, 'step_'||k FROM ev WHERE event_type IN ('error','view')""", "ev")


# ---- graph: parts linked by consecutive lines of an order ---------------------------------

def order_rows(spark, sf) -> DataFrame:
    """Line items numbered inside their order by a total order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    return number_rows(li, ["l_orderkey"], [F.asc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], "at")


def part_edges(spark, sf, within: str | None = "p_brand") -> DataFrame:
    """Distinct links between parts of neighbouring rows; neighbours meet on (order, position)."""
    rows = order_rows(spark, sf).select("l_orderkey", "at", F.col("l_partkey").alias("src"))
    nxt = rows.select("l_orderkey", (F.col("at") - 1).alias("at"), F.col("src").alias("dst"))
    links = rows.join(nxt, ["l_orderkey", "at"]).filter("src <> dst").select("src", "dst").distinct()
    if within is None:
        return links
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("src"), F.col(within).alias("grp"))
    other = part.select(F.col("src").alias("dst"), F.col("grp").alias("_g"))
    return links.join(part, "src").join(other, "dst").filter("grp = _g").select("grp", "src", "dst")


def part_seeds(spark, sf) -> DataFrame:
    return table(spark, sf, "part").filter("p_size <= 5").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("node"))


cte("links", """SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem)
 WHERE dst IS NOT NULL AND src<>dst""")
cte("edges", "SELECT a.p_brand AS grp, src, dst FROM links JOIN part a ON a.p_partkey=src JOIN part b ON b.p_partkey=dst WHERE a.p_brand=b.p_brand", "links")
cte("both_ways", "SELECT grp, src, dst FROM edges UNION SELECT grp, dst, src FROM edges", "edges")
cte("seeds_p", "SELECT p_brand AS grp, p_partkey AS node FROM part WHERE p_size<=5")


def bfs_sql(edges: str, seeds: str, depth: int, keys: str = "grp") -> str:
    """Smallest hop count by level, as nested statements."""
    sql = f"SELECT DISTINCT {keys}, node, 0 AS hops FROM {seeds}"
    for level in range(1, depth + 1):
        sql = (f"SELECT {keys}, node, min(hops) AS hops FROM (WITH s AS MATERIALIZED ({sql}) SELECT * FROM s UNION ALL "
               f"SELECT s.{keys}, e.dst, {level} FROM s JOIN {edges} e ON e.src=s.node{'' if edges == 'all_ways' else ' AND e.grp=s.grp'}) GROUP BY ALL")
    return sql


cte("all_ways", "SELECT src, dst FROM links UNION SELECT dst, src FROM links", "links")


# ---- sources: Python text built around document lines ---------------------------------------

def python_files(spark, sf) -> DataFrame:
    """One module per document: a class with a method, then one function under each document line
    (as a comment). French documents get a line that does not parse."""
    head = "import os\nfrom pkg.mod import name\n\nclass C:\n    def m(self, a):\n        b = a\n        return b"
    block = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        F.lit("\n# "), x, F.lit("\ndef f"), i.cast("string"), F.lit("(x, y=1):\n    t = x + y\n    u = f"), (i + 1).cast("string"), F.lit("(t)\n    return u")))
    broken = F.when(F.col("lang") == "fr", "\ndef (:").otherwise("")
    return documents(spark, sf).select("doc_id", F.concat(F.lit(head), F.array_join(block, ""), broken).alias("text"))


cte("pyf", "SELECT doc_id, n_lines AS nb, i FROM sizes JOIN documents USING (doc_id), unnest(range(0, n_lines)) t(i) WHERE lang<>'fr'", "sizes")
