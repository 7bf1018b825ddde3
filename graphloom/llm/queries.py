"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, table


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_rules", "most_telling")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.lm_scores import lm_scores

    scored = lm_scores(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), vocabulary=49_408, start_id=49_406)
    return scored.select("doc_id", "n_tokens", F.round("log10_score", 6).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.repeats import removal_report

    return removal_report(table(spark, sf_dir, "documents"), length=200).drop("kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.topk import quantised, top_products

    return top_products(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, k=20)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.periodic import periodic_runs, with_planted_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic_runs(docs).drop("runs", "collapsed")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.set_join import similar_sets

    return similar_sets(table(spark, sf_dir, "documents"), percent=90, width=3)


QUERIES = {"op1_toxicity": op1_toxicity, "op2_lm_scores": op2_lm_scores, "op3_suffix_dedup": op3_suffix_dedup, "op5_decontamination": op5_decontamination, "op6_topk": op6_topk, "op4_packing": op4_packing, "op8_langid": op8_langid, "op7_warc": op7_warc, "op9_minhash": op9_minhash, "op10_sharding": op10_sharding, "op11_periodic_runs": op11_periodic_runs, "op12_ranked_search": op12_ranked_search, "op13_set_join": op13_set_join}
ORACLE: dict[str, str] = {
    "op7_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept_id
  FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(0, 8), lambda g: list_transform([15, 10, 5, 0], lambda s:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || substr(hex, CAST(g * 5 + 1 AS INTEGER), 5) AS BIGINT) >> s) & 31)]).array_to_string('')), '') AS digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = kept_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept_id THEN kept_id END AS refers_to
FROM d""",
    "op13_set_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) >= 3 THEN list_transform(range(1, len(x) - 1), lambda i: array_to_string(x[i:i + 2], ' ')) WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT r.v, l.y FROM r JOIN l ON r.c = l.x),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
SELECT v AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM m LEFT JOIN n ON n.doc_id = v""",
    "op9_minhash": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) >= 5 THEN list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')) WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT r.v, l.y FROM r JOIN l ON r.c = l.x),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
SELECT v AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, v = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = v""",
    "op12_ranked_search": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS x FROM documents
), c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(x)) AS BIGINT) AS n_terms FROM d WHERE len(x) > 0),
p AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n, unnest(x) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2.0)::DOUBLE / (2.0 * count(*) + 1.0)::DOUBLE)) AS BIGINT) AS w FROM f, c GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
