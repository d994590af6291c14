"""The corpus pipeline: toxicity, line dedup, SimHash near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents, with whatever columns there are beside doc_id, text and source.

In every stage a null text is an empty one, rows with null or repeated ids are rows of their own, and empty tables give empty
ones.  The stages say what they do with repeated rows and very long texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, packing, simhash, toxicity
from tessera.llm.common import delete, scratch, shared_dir, table

# Every stage's result is also a function of hashes, of a trained score or of a search that SQL can't express.
ORACLE_SQL = None


def same_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.  Texts are scored one by one and whole, so repeated rows go or stay together;
    empty texts stay.  Without labels of both kinds none goes."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return same_columns(toxicity.kept(docs, model), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; n_chars follows the text.  A document stays even where no line of it does.
    Rows alike in id and text are one document and keep the same lines; a very long text is as many rows as it has lines."""
    out = line_dedup.dedup_lines(docs, report=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return same_columns(out, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, null ids last; of rows with equal ids the first in the
    table.  Of empty texts, which are alike, one stays.  Fingerprints are of whole texts."""
    return same_columns(simhash.one_of_each(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are taken as often as their own rates say: none, one or several times, each repeated row by itself.  Empty texts count no
    tokens and are taken at the rate of their source."""
    return same_columns(mixing.taken(docs), docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences: every row's ids, an empty text's end id included, as often as the row occurs; long texts
    are cut at full windows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage leaves behind beside its
    result, and the result before it, are deleted once its own is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
