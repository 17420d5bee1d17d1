"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.llm import decontaminate, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, mixing, quality, secret_scan, token_counts
from limpid.llm.common import table


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the ratings: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, graded(table(spark, sf_dir, "labels")))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.12).alias("kept"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.html_extraction(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.char_length("_text").cast("long").alias("n_chars"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_contaminated(docs, table(spark, sf_dir, "benchmark"))
    clean = F.size("_items") == 0
    return out.select("doc_id", clean.alias("kept"), (~clean).alias("contaminated"), F.col("_items").alias("item_ids"), F.col("_score").alias("best_score"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(
        "doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"),
        F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_order").alias("position"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    found = language_id.language_id(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 finds in the texts as they stand, which SQL can say too."""
    return op8_secret_scans(spark, sf_dir).drop("spans")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_counts": op2_token_counts,
    "op3_html_extraction": op3_html_extraction,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secret_scans": op8_secret_scans,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "secret_base": secret_base,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SECRET = {
    "assign": r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA([A-Z0-9]+)",
    "hex": "([0-9a-f]+)",
}
_LEAST = {"assign": "length(own) >= 6", "access": "length(raw) >= 20", "hex": "length(raw) >= 24"}


def _secret_spans(rank: int, kind: str) -> str:
    p = "'" + _SECRET[kind].replace("'", "''") + "'"
    return f"""
        SELECT doc_id, '{kind}' AS kind, {rank} AS rank, pos AS a, pos + length(raw) AS b FROM (
            SELECT doc_id, raw, own, CAST(sum(length(gap) + coalesce(length(earlier), 0)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS pos FROM (
                SELECT doc_id, k, raw, own, gap, lag(raw) OVER (PARTITION BY doc_id ORDER BY k) AS earlier FROM (
                    SELECT doc_id, unnest(m) AS raw, unnest(o) AS own, unnest(g[1 : len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS k FROM (
                        SELECT doc_id, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, 1) AS o, string_split_regex(text, {p}) AS g FROM documents
                    ) WHERE len(m) > 0)))
        WHERE {_LEAST[kind]}"""


ORACLES = {
    "secret_base": f"""
        WITH s AS ({" UNION ALL ".join(_secret_spans(k, x) for k, x in enumerate(_SECRET))}), c AS (
            SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
                   string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans
            FROM s GROUP BY doc_id
        )
        SELECT documents.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
        FROM documents LEFT JOIN c ON c.doc_id = documents.doc_id
    """,
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
    "op9_line_dedup": rf"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), k AS (
            SELECT doc_id, line, pos, regexp_replace({_LOWER.replace("text", "line")}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l
        ), c AS (
            SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), m AS (
            SELECT doc_id, line, pos, c.key IS NOT NULL AND doc_id <> keep AS gone FROM k LEFT JOIN c ON k.key = c.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op10_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
        ), g AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[k : k + 2], ' ') END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM w WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), e AS (
            SELECT a, b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
            ) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
            WHERE 100 * o >= 90 * (p.n + q.n - o)
        ), r AS (
            SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
        )
        SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, least(documents.doc_id, coalesce(m, documents.doc_id)) AS component_id
        FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id
        LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = documents.doc_id
    """,
}
