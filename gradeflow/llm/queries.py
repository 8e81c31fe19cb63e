"""The queries of this subpackage: one for each operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm.common import id_crc, table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.vptree import nearest

    vectors = table(spark, sf_dir, "embeddings")
    found = nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5, factor=1.0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.hilbert import hilbert_shards

    out = hilbert_shards(table(spark, sf_dir, "documents"), shards=8, dims=("source", "lang", "n_chars"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.hnsw import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.packing import packed_sequences, with_crc

    pieces = packed_sequences(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return with_crc(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.pii import BASE, find_pii

    found = find_pii(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), scores)


def op6_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.quality import fit_quality, with_quality

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), held_out=5)
    out = with_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(id_crc("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_jaccard_count_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op8_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.langid import fit_languages, identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit_languages(docs, id_crc("doc_id") % 3 != 1))
    return out.select("doc_id", F.coalesce(id_crc("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.urlfilter import judge_urls

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules, otherwise="allow")


#: What the mixing query aims at: nearly equal weights, of the largest entropy this part; no source more than four times.
ENTROPY, REPEATS = 0.9999, 4.0


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.mixing import mixed

    out = mixed(table(spark, sf_dir, "documents"), target_entropy=ENTROPY, most_repeats=REPEATS, budget="corpus")
    return out.withColumns({c: F.round(c, 9) for c in ("weight", "repeats")})


def op11_piece_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.pieces import encoded

    out = encoded(table(spark, sf_dir, "documents"), model=public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeflow.llm.spelling import spelling_forms, vocabulary

    return spelling_forms(vocabulary(table(spark, sf_dir, "documents"), noise=199))


def queries() -> dict:
    return {f.__name__: f for f in (op1_vantage_point_search, op2_hilbert_shards, op3_near_vectors, op4_sum_of_squares_packing, op5_private_data, op6_positive_unlabelled_quality, op7_jaccard_count_tree, op8_nearest_centroid_language, op9_url_range_join, op10_temperature_mixing, op11_piece_merge_rounds, op12_phrase_collocations, op13_spelling_variants)}


_COSINE = "list_cosine_similarity({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"
_USABLE = "SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

SQL = {
    "op1_vantage_point_search": f"""
WITH v AS ({_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, {_COSINE.format("q", "c")} AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5""",
    "op3_near_vectors": f"""
WITH RECURSIVE v AS ({_USABLE}),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND {_COSINE.format("a", "b")} >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, min(r.y) AS component_id, min(r.y) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.x = e.vec_id GROUP BY e.vec_id""",
    "op7_jaccard_count_tree": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x)
SELECT n.doc_id, n.n AS n_shingles, min(y) AS component_id FROM n JOIN reach ON reach.x = n.doc_id GROUP BY ALL""",
    "op9_url_range_join": """
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT p.page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
  FROM p JOIN r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op10_temperature_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'null') AS src, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS tokens,
  ('0x' || substr(sha256(concat_ws(':', '5', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''))), 1, 15))::BIGINT AS h FROM documents),
size AS (SELECT src, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM d GROUP BY 1),
share AS (SELECT tokens / (SELECT sum(tokens) FROM size)::DOUBLE AS s FROM size WHERE tokens > 0),
cool(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
    (SELECT ln(sum(pow(s, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(s, (lo + hi) / 2) * ln(s)) / sum(pow(s, (lo + hi) / 2)) >= {ENTROPY} * ln(count(*)) FROM share) AS ok FROM cool WHERE i < 60)),
warm(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
    (SELECT pow(min(s), (lo + hi) / 2 - 1) / sum(pow(s, (lo + hi) / 2)) <= {REPEATS} FROM share) AS ok FROM warm WHERE i < 60)),
alpha AS (SELECT greatest(CASE WHEN (SELECT -sum(s * ln(s)) >= {ENTROPY} * ln(count(*)) FROM share) THEN 1 ELSE (SELECT lo FROM cool WHERE i = 60) END,
  CASE WHEN (SELECT 1 / min(s) / count(*) <= {REPEATS} FROM share) THEN 0 ELSE (SELECT hi FROM warm WHERE i = 60) END) AS a),
w AS (SELECT src, docs, tokens, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM size)::DOUBLE, a) / (SELECT sum(pow(s, a)) FROM share) ELSE 0 END AS weight FROM size, alpha),
b AS (SELECT *, round(weight * (SELECT sum(tokens) FROM size))::BIGINT AS budget FROM w),
plan AS (SELECT *, coalesce(budget::DOUBLE / nullif(tokens, 0), 0) AS repeats, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest, greatest(1, -(-docs // 256)) AS blocks FROM b),
u AS (SELECT d.src, doc_id, h, (h % blocks)::INT AS block, sum(d.tokens)::BIGINT AS held FROM d JOIN plan USING (src) GROUP BY ALL),
t AS (SELECT src, block, row_number() OVER o AS turn, sum(held) OVER (o ROWS UNBOUNDED PRECEDING) - held AS before
  FROM (SELECT src, block, sum(held)::BIGINT AS held FROM u GROUP BY 1, 2) JOIN plan USING (src) WINDOW o AS (PARTITION BY src ORDER BY sha256(concat_ws(':', src, block, passes)), block)),
x AS (SELECT src, doc_id, h, block, turn, held, (before + sum(held) OVER (PARTITION BY src, block ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - held)::BIGINT AS start FROM u JOIN t USING (src, block))
SELECT d.doc_id, d.source, d.tokens, round(weight, 9) AS weight, round(repeats, 9) AS repeats, passes, block, turn, start, passes + (held > 0 AND start + held <= rest)::INT AS copies
FROM d JOIN x ON d.src = x.src AND d.h = x.h AND d.doc_id IS NOT DISTINCT FROM x.doc_id JOIN plan ON plan.src = d.src""",
    "op12_phrase_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS t(k)) GROUP BY ALL HAVING count(*) >= 30),
x AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS s, unnest(range(1, k)) AS j FROM c WHERE k > 1),
s AS (SELECT x.lang, x.phrase, a, l.f AS l, r.f AS r, j, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
  FROM x JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(s[1:j], ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(s[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(s[p:p + q - 1], ' ') AS phrase, max(f) AS f FROM (SELECT lang, f, k, q, string_split(phrase, ' ') AS s, unnest(range(1, k - q + 2)) AS p FROM c, (VALUES (2), (3)) AS t(q) WHERE k > q) GROUP BY ALL),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100::HUGEINT * i.f < 80::HUGEINT * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
