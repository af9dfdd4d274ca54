"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    ball_search,
    byte_bpe,
    divergence,
    exact_dedup,
    host_trust,
    html_text,
    licences,
    packing,
    quality,
    secrets,
    sharding,
    simhash,
    topk,
)
from docloom.llm.common import documents


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokenizer = documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")
    return packing.packed(docs, vocabulary("byte_bpe_50k.tiktoken"), tokenizer_path=tokenizer)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_ids(simhash.near_groups(documents(spark, sf_dir)))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = F.col("matches")
    return licences.scan(documents(spark, sf_dir)).select(
        "doc_id",
        F.size(matches).cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(matches["licence"])), ",").alias("licences"),
        F.array_join(
            F.transform(matches, lambda m: F.concat_ws(":", m["licence"], m["start"], m["end"])), ","
        ).alias("spans"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.refined(
        documents(spark, sf_dir), carry={"text_sha256": exact_dedup.full_hash(F.col("text"))}
    )
    return exact_dedup.membership(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_trust.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = [
    op1_exact_top_k,
    op2_sharding,
    op3_byte_bpe,
    op4_quality_classifier,
    op5_packing,
    op6_html_extraction,
    op7_simhash_near_dedup,
    op8_licence_scan,
    op9_secret_scan,
    op10_exact_dedup,
    op11_source_divergence,
    op12_url_filter,
    op13_lexical_search,
]

ORACLES: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_exact_dedup": """
        WITH t AS (
            SELECT doc_id,
                   sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM t JOIN g USING (text_sha256)
    """,
    "op11_source_divergence": """
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
            FROM documents
        ), t AS MATERIALIZED (
            SELECT row, lang, source, unnest(terms) AS term FROM d
        ), k AS MATERIALIZED (
            SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30
        ), v AS (
            SELECT lang, count(*) AS v FROM k GROUP BY lang
        ), g AS MATERIALIZED (
            SELECT DISTINCT lang, source FROM d
        ), c AS (
            SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
        ), f AS MATERIALIZED (
            SELECT lang, source, term, coalesce(n, 0) AS n
            FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
        ), p AS MATERIALIZED (
            SELECT lang, source, term, n,
                   1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
            FROM f JOIN v USING (lang)
        ), l AS (
            SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term
        ), q AS (
            SELECT lang, term, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
            FROM l JOIN v USING (lang)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        ), far AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source
        ), rows AS (
            SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM pairs LEFT JOIN far USING (lang, source, item)
            UNION ALL
            SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
        )
        SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
    "op12_url_filter": host_trust.judge_sql(),
    "op13_lexical_search": """
        WITH i AS MATERIALIZED (
            SELECT row_number() OVER () AS row, item_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
            FROM benchmark
        ), q AS MATERIALIZED (
            SELECT row, item_id, term, count(*) AS times
            FROM (SELECT row, item_id, unnest(terms) AS term FROM i) GROUP BY row, item_id, term
        ), d AS MATERIALIZED (
            SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
            FROM documents
        ), s AS (
            SELECT count(*) AS total, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM d WHERE len(terms) > 0
        ), f AS MATERIALIZED (
            SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM d)
            WHERE term IN (SELECT term FROM q) GROUP BY doc, term
        ), w AS MATERIALIZED (
            SELECT term, CAST(floor(1000 * ln((2 * total + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s
        ), x AS (
            SELECT doc, doc_id, f.term,
                   w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * CAST(len(terms) AS BIGINT) * total) // all_terms))) AS x
            FROM f JOIN d USING (doc) JOIN w USING (term), s
        ), r AS (
            SELECT row, item_id, doc, doc_id, CAST(sum(times * x) AS BIGINT) AS score
            FROM q JOIN x USING (term) GROUP BY row, item_id, doc, doc_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS FIRST, doc) AS rank
            FROM r WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
}


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
