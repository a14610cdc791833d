"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame that is the next one's docs.

The first four return the columns of documents (doc_id, text, lang, source, n_chars); n_chars follows the text. SQL cannot express the stages (a classifier,
winnowing, SimHash, packing), so ORACLE_SQL is None and tests hold them against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import lines, mixing, packing, quality, simhash
from flowloom.llm.common import Scratch, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WEIGHTS = [1, 2, 3]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, learned from all labels.

    Null and empty texts are scored as empty ones; ties do not matter; repeated rows are scored, and stay or go, each; rows of null ids are scored, not
    learned from; an empty table gives an empty table, and without labels nothing is rejected; columns beyond those of documents go.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return quality.kept(docs, quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 25 words or more that an earlier document (or place) has; no document goes, n_chars follows the text.

    Null texts stay null, empty ones (and those that lose all words) stay as empty texts; ties of id go by a hash of the text, null ids first; rows of equal id
    and text keep the same; an empty table gives an empty table; columns beyond those of documents go.
    """
    small_batches(spark)
    left = lines.deduplicated(docs.select(*COLUMNS).withColumn("__size", F.octet_length("text")), report=False)
    return left.withColumn("n_chars", F.when(F.octet_length("text") < F.col("__size"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id: linked by SimHash, checked by Jaccard similarity, what SimHash misses found exactly.

    Texts without a word (null, empty, blank) are one group; a null id counts as the largest; of rows of equal id and text one stays; an empty table gives
    an empty table; columns beyond those of documents go.
    """
    small_batches(spark)
    return simhash.deduplicated(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document of a source below its target comes again, up to three times.

    Documents without a word are never taken; a null source is one of its own, ordered last; rows of equal id and text are documents each; an empty table
    gives an empty table; columns beyond those of documents go.
    """
    small_batches(spark)
    return mixing.mixed(docs.select(*COLUMNS), WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the sequences.

    Null and empty texts are one piece, the end id; ties among equal lengths go by a hash of the row; repeated rows are documents each; an empty table gives
    an empty table; other columns play no part.
    """
    small_batches(spark)
    return packing.packed(packing.pieces(docs))


STAGES = [("quality", keep_quality), ("lines", dedup_lines), ("near_duplicates", dedup_near), ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written goes when its output is there, and that when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as outer:
        for _, stage in STAGES[:-1]:
            with Scratch(spark) as inner:
                new = inner.outlive(stage(spark, docs, sf_dir))
            outer.drop(docs)
            docs = new
        outer.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
