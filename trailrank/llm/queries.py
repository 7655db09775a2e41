"""The registered queries of the operators, their parameters, and reference SQL where SQL can say it."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, cross_polytope, divergence, html_extract, langid, line_dedup, merkle, packing, rtree, secrets, sentencepieces, substring_dedup

JSON_50K = public_tokenizers.path("byte_bpe_50k.json")
MULTI_50K = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES_32K = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


WORDS = r"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents"
#: Least id that links reach; nodes(id), links(a, b) in both directions.
REACHED = "reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a)"

ORACLES["op1_substring_dedup"] = f"""WITH w AS ({WORDS}),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) t(i)),
 least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (k) WHERE d < doc_id),
 said AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s FROM said ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
 SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
 LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)"""

ORACLES["op4_bagminhash"] = f"""WITH RECURSIVE w AS ({WORDS}),
 sh AS (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0) GROUP BY ALL),
 n AS (SELECT doc_id, sum(c)::BIGINT AS n FROM sh GROUP BY doc_id),
 over AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS m FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
 near AS (SELECT a, b, m, p.n AS na, q.n AS nb FROM over JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE m >= 0.8 * (p.n + q.n - m)),
 nodes AS (SELECT doc_id AS id FROM documents), links AS (SELECT a, b FROM near), {REACHED},
 class AS (SELECT a, min(b) AS b FROM near WHERE m = na AND m = nb GROUP BY a)
 SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, b) AS class_id, c AS component_id, doc_id = c AS kept FROM documents LEFT JOIN n USING (doc_id)
 JOIN comp ON id = doc_id LEFT JOIN class ON a = doc_id"""

ORACLES["op9_cross_polytope"] = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
 sound AS (SELECT * FROM nodes WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 links AS (SELECT x.id AS a, y.id AS b FROM sound x JOIN sound y ON x.id <> y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95), {REACHED}
 SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, id = c AS kept FROM comp LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = id"""

ORACLES["op13_divergence"] = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
 c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d),
 s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p FROM g JOIN kept k USING (lang)
  JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 l AS (SELECT lang, term, sum(n) AS n FROM p GROUP BY ALL), lt AS (SELECT lang, sum(n) AS total FROM l GROUP BY lang),
 q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q FROM l JOIN lt USING (lang) JOIN v USING (lang)),
 gaps AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
 rows_ AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps ON gaps.lang = a.lang AND gaps.source = a.source AND gaps.item = b.source
  UNION ALL SELECT p.lang, source, 'term', p.term, (p - q)::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
 SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows_ QUALIFY part = 'pair' OR rank <= 50"""

ORACLES["op11_hard_negatives"] = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
 SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), JSON_50K).drop("ids")


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), MULTI_50K), MULTI_50K)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(_table(spark, sf_dir, "documents"))


@query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    return langid.predict(docs, langid.train(docs, ~F.col("held_out")), keep=("doc_id", "held_out"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return secrets.scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query
def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sentencepieces.encode(_table(spark, sf_dir, "documents"), PIECES_32K, decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), F.element_at("ends", -1).cast("long").alias("n_bytes"))


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return rtree.mine(rows, F.col("vec_id") % 100 == 0)
