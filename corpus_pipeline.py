"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame; `run` writes each
result as Parquet and reads it again for the next. All but the last return the columns of docs:
doc_id, text, lang, source and any others. Others come back as they are, whatever their names;
n_chars is that of the text as it is now.

Null and empty texts pass the first three stages and are in no mix; rows without doc_id, and equal
rows, go through each stage as its operator says. An empty table gives an empty one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.config import keep
from stallbook.llm import line_dedup, mixing, near_dedup, packing, toxicity
from stallbook.llm.carry import Carried
from stallbook.llm.sampling import fold


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, n_chars that of the text as it is now."""
    return rows.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c)
                         if c == "n_chars" else rows[c] for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside the test fold, lets pass."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    own = Carried(docs, "doc_id", "text")
    return own.back(toxicity.score(own.rows, model).where("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the runs of lines that an earlier one has."""
    own = Carried(docs, "doc_id", "text")
    return _as_documents(own.back(line_dedup.dedup_lines(own.rows)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    own = Carried(docs, "doc_id", "text")
    return own.back(near_dedup.dedup(own.rows))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents as often as the mix takes them; those without words are in no mix."""
    return _as_documents(mixing.mixed(docs, seed=1, epochs=3, cycle=3), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A row for each piece of a document: its sequence, and its span in both."""
    own = docs.select("doc_id", "text")
    return packing.pack(own, mixing.word_count(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents table in `folder`."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
