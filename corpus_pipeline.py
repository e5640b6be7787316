"""A training corpus from raw documents: junk out, repeated lines out, one of each group of near copies, sources mixed, tokens.

run() applies the stages of STAGES in their order; each reads what the one before it wrote. ORACLE_SQL is None: SQL can
express neither the classifier nor the draw of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import bpe, common, line_dedup, mixing, near_dedup, quality

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, as they are."""
    scored = quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score_col="_storyloom_score")
    return scored.where("_storyloom_score >= 0.5").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more of them share but in the one of the largest id."""
    return line_dedup.deduped(docs).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies (0.8 of their shingles), and all others."""
    copies = near_dedup.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    common.collected(spark)
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    common.collected(spark)
    return bpe.encode_texts(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("minhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; all but the last result are written tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
