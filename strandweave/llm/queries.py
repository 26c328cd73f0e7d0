"""The corpus operators applied to the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import (
    exact_dedup,
    fingerprints,
    lm_scoring,
    mixing,
    ngram_join,
    packing,
    quality_rules,
    ranked_search,
    secret_scan,
    suffix_dedup,
    token_counts,
    tokenizer_alignment,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text")
    marked = exact_dedup.mark_duplicates(docs)
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         ('0x' || substr(md5(doc_id::VARCHAR || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS hash,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key
), weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS weight FROM sources
), levelled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER below, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0))::DOUBLE AS level
  FROM weighed WINDOW below AS (ORDER BY 3 * source_size / weight::DOUBLE, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT key, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levelled
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS copies FROM goals
), ordered AS (
  SELECT s.*, source_size, target, copies, round(target)::BIGINT - copies * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY key ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         count(*) OVER (PARTITION BY key, hash) AS tied
  FROM sized s JOIN plan USING (key)
)
SELECT doc_id, size, source_size, target,
       (copies * size + greatest(0, least(size, (rest - before) // tied)))::BIGINT AS taken
FROM ordered
""")
def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text", "source")
    return mixing.mix(docs, columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents", "doc_id", "text"))


@query()
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf, "documents", "text"))


RULES = [
    url_filter.parse_rule("net/", url_filter.BLOCK),
    url_filter.parse_rule("example.net/en/", url_filter.ALLOW),
    url_filter.parse_rule("example.com/de/", url_filter.BLOCK),
    url_filter.parse_rule("org/fr/", url_filter.ALLOW),
]


@query()
def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages", "page_id", "url", "html")
    judged = url_filter.judge(pages, RULES, columns=["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def quality_model(spark: SparkSession, sf: str, docs: DataFrame) -> quality_rules.RuleEnsemble:
    """The classifier learned from the labelled rows that are not held out."""
    labels = _table(spark, sf, "labels", "doc_id", "quality")
    return quality_rules.train(docs, labels.filter(~quality_rules.held_out(F.col("doc_id"))))


@query()
def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text")
    scored = quality_rules.score(docs, quality_model(spark, sf, docs))
    held_out = quality_rules.held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


@query()
def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


@query()
def op5_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf, "documents", "doc_id", "text"))


@query()
def op10_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text")
    return ngram_join.components_by_id(docs).withColumnRenamed("id", "doc_id")


@query()
def op4_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf, "documents", "doc_id", "text"))


@query()
def op11_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text")
    marked = suffix_dedup.mark_repeats(docs, columns=["doc_id"])
    return marked.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op12_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text")
    return tokenizer_alignment.tokenizer_links(docs).withColumnRenamed("id", "doc_id")


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(f"""
WITH held AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
counted AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY doc_id, term),
sizes AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counted, total WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
lengths AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_words AS m FROM sizes, total),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""")
def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text")
    return ranked_search.search(docs, _table(spark, sf, "benchmark", "item_id", "text"))
