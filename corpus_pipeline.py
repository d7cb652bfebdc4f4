"""A corpus pipeline: quality classifier, near-dedup, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages but the last return the columns of documents; further columns of its input, whatever their names, are dropped by the first.
Null texts count as empty ones and stay null until a stage rewrites texts (the third makes them empty ones); an empty table gives an empty result. Repeated rows are near duplicates of each other, of which one stays; rows that tie
(equal texts, equal ids) are told apart by nothing but the id, and where ids are equal too, any one stays. Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm import bpe, mix, neardup, quality, suffix
from molframe.session import discard, scratch_tables, sweep, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a string that is cut where it stands more than once, and of the anchors it is found by: passages of more than 50 words have about 280 bytes at least.
PASSAGE, GRAM = 250, 48


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of those not held out, scores at the threshold or above."""
    network = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    if network is None:  # nothing to learn from: nothing is rejected
        return docs.select(*COLUMNS)
    return quality.score_quality(docs, network, keep=COLUMNS).filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id."""
    return neardup.one_of_each(docs.select(*COLUMNS), neardup.near_duplicates(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur elsewhere too; a character that a cut leaves in part goes with it."""
    out = suffix.remove_repeats(docs, length=PASSAGE, gram=GRAM, keep=("lang", "source"), texts=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    taken = mix.mix_sources(docs, keep=("text", "lang", "n_chars"))
    return taken.select(*COLUMNS, F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int")))).alias("nth")).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, text decoded from the ids)."""
    out = bpe.bpe_encode(docs, keep=("lang", "source"), decode=True)
    return out.withColumnRenamed("decoded", "text")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix_to_targets),
    ("tokens", to_tokens),
]
#: The classifier, the sketches and the tokenizer aren't for SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage read and left in the scratch folder goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = scratch_tables()
        done = written(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, before, done)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
