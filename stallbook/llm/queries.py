"""The registered queries of this part, with their production parameters."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from stallbook.config import shared_folder
from stallbook.llm import (
    decontamination,
    language_id,
    mixing,
    near_dedup,
    oracle,
    packing,
    phrases,
    quality_rules,
    run_dedup,
    toxicity,
    url_filters,
    vector_search,
    warc,
    whitening,
)

#: Allow and block list of the url filter (fixed values).
ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")
#: A host is blocked when its bad rate is surely above this.
MAX_BAD = 0.25


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every page judged by the list, else by its host's reputation.

    The number in a url's path is the document that the page shows; a page is bad when that
    document is labelled toxic or of low quality.
    """
    pages, labels = _table(spark, folder, "pages"), _table(spark, folder, "labels")
    outcomes = labels.select(F.col("doc_id").alias("outcome_key"),
                             ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(url_filters.path_of(F.col("url")), "[0-9]+", 0).try_cast("long")
    judged = url_filters.filter_urls(pages, outcomes, ALLOW, BLOCK, key=number, max_bad=MAX_BAD)
    return judged.select("page_id", "host", "path", "rule", "verdict", "labelled")


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's component of near-duplicates."""
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's words in sequences of four permitted lengths."""
    docs = _table(spark, folder, "documents")
    return packing.pack(docs, mixing.word_count(F.col("text")))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of four of five id folds."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    scored = toxicity.held_out_scores(docs, _table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of as many words as all documents takes of each, at most 3 epochs."""
    mix = mixing.mix_sources(_table(spark, folder, "documents"), seed=1, epochs=3, cycle=3)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written as a WARC record to the shared folder and read back from there."""
    to = f"{shared_folder(spark).rstrip('/')}/stallbook-{uuid.uuid4().hex}/warc"
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    manifest = warc.write_archives(warc.decide(pages), to)
    return warc.read_archives(manifest, to, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language, learned from three of four id folds."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language_id.held_out_predictions(docs).select(
        "doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op8_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 best of all vectors for every vector whose id is divisible by 50."""
    vectors = _table(spark, folder, "embeddings")
    return vector_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the runs of 40 words or more that an earlier one has too."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return run_dedup.dedup_runs(docs)


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base measures of every document and the verdict of the rule cascade."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.cascade(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """32 whitened values of every vector."""
    rows = whitening.whiten(_table(spark, folder, "embeddings"), components=32)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Each language's 2000 best phrases of two to five words."""
    return phrases.collocations(_table(spark, folder, "documents"), least=100, most=2000)


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's words in windows of the benchmark, and a digest of the items."""
    found = decontamination.contamination(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"),
                        "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {
        "op1_url_filters": op1_url_filters,
        "op2_near_dedup": op2_near_dedup,
        "op3_packing": op3_packing,
        "op4_toxicity": op4_toxicity,
        "op5_mixing": op5_mixing,
        "op6_warc": op6_warc,
        "op7_language_id": op7_language_id,
        "op8_vector_search": op8_vector_search,
        "op9_line_dedup": op9_line_dedup,
        "op10_quality_rules": op10_quality_rules,
        "op11_whitening": op11_whitening,
        "op12_phrases": op12_phrases,
        "op13_decontamination": op13_decontamination,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Check SQL of the queries that SQL can express."""
    return oracle.oracle_sql()
