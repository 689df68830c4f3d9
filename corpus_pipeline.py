"""A training-data pipeline of five of the operators, each on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet, read again and handed to the next.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, fingerprints, language_id, line_dedup, mixing
from tarn.llm.common import read, settle, staged
from tarn.llm.entry import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if the pooled probability of its language is under this.
LEAST_SCORE = 0.3
#: Five-word shingles that near copies share, as a part of their union.
SIMILAR = 0.8


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with a row number, so that rows that repeat an id, or have none, stay apart."""
    return staged(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "stage-rows")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and of whose language the network is sure stay, with the language it predicts.

    The network learns from what ``documents`` itself labels, folds as in the query; a null id is not in a fold.  If nothing
    of the training fold is labelled there is no network: then all documents that have letters stay, with the language they have.
    """
    network = language_id.fit(docs)
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language_id.predict(docs, network, keep=("text", "source", "n_chars"))
    sure = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return sure.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line passages go; every document stays, if need be with an empty text."""
    out = line_dedup.dedup_lines(docs, keep=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (of its rows, the first).

    Near copies share SIMILAR of their five-word shingles or more; the trie and bands of least hashes find them.
    """
    rows = numbered(docs)
    order = staged(rows.select("row", "doc_id"), "stage-ids")
    groups = fingerprints.similar_groups(rows, id_col="row", words=5, least=SIMILAR)
    first = groups.select(F.col("doc_id").alias("row"), "component_id").join(order, "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x"))
    return rows.join(first.select("x.row"), "row").select(*COLUMNS)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, up to three times or not at all."""
    taken = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    times = taken.withColumn("times", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int"))
    return times.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers of every document, and the text they decode to."""
    return bpe.encode(docs, vocabulary())


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("source mix", weighted), ("BPE encoding", tokens)]

#: The network of the first stage can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        done = [settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "pipeline", *done)]
        docs = done[0].df()
    return docs
