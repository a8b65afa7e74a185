"""The operators of this package as queries over the test tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, exact_dedup, minhash_join, pairwise_quality, secret_scan, sentence_spans, simhash_join, template_decontam, toxicity, url_filter, vector_codes, warc, whitening
from weftline.llm.common import table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """(rank file, split pattern); the installed package names the file's place."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup_spans(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "ok")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), *tokenizer())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.near_duplicates(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_minhash_near_dedup, op3_substring_dedup, op4_warc, op5_bpe, op6_decontamination, op7_exact_dedup, op8_quality, op9_url_filter, op10_toxicity,
        op11_whitening, op12_simhash_near_dedup, op13_vector_codes,
    )
}


def _lloyd_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The codes by full rounds over all parts, each round from nothing."""
    # the lowest of the nearest entries: distance * 256 + index is least there
    nearest = """SELECT p.vec_id, p.p, min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + b.k) AS best
                FROM part p JOIN book{r} b ON p.p = b.p GROUP BY p.vec_id, p.p"""
    steps = []
    for r in range(rounds):
        steps.append(f"near{r} AS ({nearest.format(r=r)})")
        means = ", ".join(f"CAST(floor(sum(p.x[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
        steps.append(
            f"mean{r} AS (SELECT p.p, n.best % 256 AS k, [{means}] AS x FROM near{r} n JOIN part p USING (vec_id, p) GROUP BY p.p, n.best % 256), "
            f"book{r + 1} AS (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m USING (p, k))"
        )
    return f"""
        WITH good AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
             part AS (SELECT vec_id, label, p, v[4 * p + 1 : 4 * p + 4] AS x FROM good, range({parts}) r(p)),
             first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM good ORDER BY vec_id LIMIT {entries}),
             book0 AS (SELECT p.p, f.k, p.x FROM part p JOIN first f USING (vec_id)),
             {", ".join(steps)},
             last AS ({nearest.format(r=rounds)}),
             coded AS (SELECT n.vec_id, string_agg(format('{{:02x}}', n.best % 256), '' ORDER BY n.p) AS code, CAST(sum(n.best // 256) AS BIGINT) AS error FROM last n GROUP BY n.vec_id),
             entry AS (SELECT string_agg(array_to_string(x, ','), ',' ORDER BY p, k) AS text FROM book{rounds})
        SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY g.label) AS BIGINT) AS label_error, sha256(e.text) AS codebooks_sha256
        FROM coded c JOIN good g USING (vec_id), entry e"""


ORACLE_SQL = {
    "op4_warc": """
        SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first END AS refers_to, true AS ok
        FROM (SELECT page_id, body, first, strlen(body) >= 100 AND page_id <> first AS again
              FROM (SELECT page_id, body, min(page_id) OVER (PARTITION BY body) AS first
                    FROM (SELECT page_id, coalesce(html, '') AS body FROM pages)))""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))""",
    "op13_vector_codes": _lloyd_sql(),
}
