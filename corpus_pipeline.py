"""The corpus pipeline: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents; n_chars follows the text that a stage leaves.

Cases: null texts have no words, so the quality rules reject them; of rows that tie or repeat, near duplicates leave one. A null
doc_id is carried like any other. An empty table stays empty through all stages. Further columns are carried, whatever their names.
Space: what a stage stages for itself is deleted when the next of the same run begins, for its result is written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.llm import mixing, nearcopies, packing, pii, quality
from tenet.llm.common import delete, documents, new_path, owned
from tenet.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text has them now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash trees over 5-word shingles, links of a similarity of 0.8 or more."""
    return nearcopies.keep_one(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return counted(pii.redact(spark, docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each time that the mix takes them; the last one of a source is cut where its budget ends."""
    return counted(mixing.mix_rows(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and place."""
    return packing.pack_documents(spark, docs, tokenizer("byte_bpe_50k.json"))


def stages() -> list[tuple[str, Stage]]:
    """The stages of one run. Each begins by deleting what the one before it in this list has staged."""
    made: list[str] = []

    def begin(stage: Stage, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, *made)
        made.clear()
        with owned(made):
            return stage(spark, docs, sf_dir)

    each = {"quality rules": quality_rules, "near duplicates": near_dedup, "personal data": personal_data, "source mix": source_mix, "best-fit packing": best_fit_packing}
    return [(name, partial(begin, stage)) for name, stage in each.items()]


#: For one run at a time; `run` has stages of its own.
STAGES = stages()

#: SQL can express neither the fits nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    *first, (_, last) = stages()
    for name, stage in first:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return last(spark, docs, sf_dir)
