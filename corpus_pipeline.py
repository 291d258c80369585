"""The corpus pipeline: stages in order, each over all rows the one before it kept.

Toxic documents go; repeated lines go; of near-duplicate documents one stays; sources are mixed to
their target weights, documents repeated as often as they are taken; what is left is packed into
training sequences. Every stage is written as Parquet in the shared folder and read back; what it took, and the table before it, go then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import line_dedup, mixing, packing, simhash, toxicity
from strandline.llm.common import materialise, release, scratch, sheltered


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as toxic go. Null and empty texts have the score of the bias, so they stay; repeats are judged alike; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that repeat or nearly repeat, the first by key stays; n_chars follows. Null texts stay null; rows left without lines keep an empty text; no row goes."""
    rows, names = sheltered(docs)  # so that no column of the operator takes the place of one of the table
    left = _named(line_dedup.dedup_lines(rows, names["doc_id"], names["text"]), names)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays, that of the least key, null keys last; null and empty texts are one class; of repeated rows one stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, sources by code point, null last. Rows without words have no share and go; repeated rows each have theirs; an empty table stays empty."""
    rows, names = sheltered(docs)
    return _named(mixing.repeat_copies(mixing.pareto_mix(rows, names["doc_id"], names["text"], names["source"])), names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their texts and what they hold. Null and empty texts are one end token; null keys and repeated rows are packed each; an empty table gives none."""
    return packing.sequences(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: MinHash, hashed factors and greedy packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch() as keep:
            docs = keep(materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
        if before is not given:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
