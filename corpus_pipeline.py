"""The corpus pipeline: filter, deduplicate, decontaminate, mask and tokenise documents.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; between stages the rows are written to the shared folder and read again.
All but the last return the columns of documents.

Defined cases, in every stage: an empty table gives an empty table; a null text
is kept as it is (no two null texts are duplicates; its digests are those of the
empty text); an empty text is kept once; rows are told apart by their place, so
null or repeated ids do no harm; a very long text is worked on whole; columns
beyond those of documents, whatever their names, pass through all stages but the
last, whose own columns replace them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, decontaminate, near, pii, toxicity
from docquarry.llm.registry import WORD_BPE, table, tokenizer_path
from docquarry.llm.storage import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind, n_chars counted anew."""
    masked = pii.mask(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.coalesce(length, F.col("n_chars"))).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, and digests of the ids and of the text that they decode to."""
    return bpe.bpe_digests(docs, tokenizer_path(WORD_BPE), tokens=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", tokenise),
]

#: Learned models decide in these stages; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
