"""Corpus pipeline: five stages that turn ``documents`` into encoded training text.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; all but the last
return the columns of ``documents``.  ``run`` writes every stage's rows to the shared checkpoint
folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm import bpe, mixing, near_dedup, quality, suffix_dedup
from riskgrid.llm.common import documents, prepare, written

#: Words of a shingle of the near-dedup stage, and the most epochs of a source in the mixture.
SHINGLE_WORDS, MAX_REPEATS = 5, 1.25
#: The repeated passages that go: strings of this many bytes that occur elsewhere, where they make a run of over 50 words.
SPAN, PASSAGE_WORDS = suffix_dedup.PASSAGE, 51


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    prepare(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (similarity 0.8 of five-word shingles)."""
    prepare(spark)
    return near_dedup.keep_first(docs, SHINGLE_WORDS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that occur elsewhere (runs of strings of ``SPAN.bytes`` bytes that
    do); ``n_chars`` follows the text."""
    prepare(spark)
    out = suffix_dedup.without_repeats(docs, SPAN, PASSAGE_WORDS)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                          .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy in the temperature mixture.  The budget covers every source once, so that no
    document is left out; small sources are repeated up to ``MAX_REPEATS`` epochs."""
    prepare(spark)
    return mixing.mix(docs, max_repeats=MAX_REPEATS, budget="cover").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` by row."""
    prepare(spark)
    return bpe.encode_rows(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixture", source_mixture),
    ("bpe_encoding", encoded),
]

#: EM, signatures, suffix arrays and merges aren't SQL: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
