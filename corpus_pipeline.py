"""From raw documents to a training mix: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. ``run`` writes each result to the shared folder
and reads it again, so that a lost executor never costs more than one stage.

Defined results of every stage: a null or repeated doc_id is no reason to lose,
merge or mix up rows; texts are read whole, however long; an empty table gives an
empty one; columns that a stage doesn't read come through, whatever their names.
What a stage does with null and empty texts, ties and repeated rows stands there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import decontaminate, jaccard_join, quality_rules, source_mix, suffix_dedup
from attesta.llm.shared import write_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the learned list rejects.

    Null and empty texts have no words, so that the base rule rejects them; repeated rows are judged alike. Labels
    without an id teach nothing; with too few labels the base rule alone decides.
    """
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Texts without a word belong to no group and stay. A null id comes after all others; of rows with the same smallest
    id that with the smallest hash of id and text stays, and of rows that agree in both, one.
    """
    return jaccard_join.keep_one(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes that an earlier document, or place, has too.

    No row goes: a text may become empty, null stays null. A null id is the smallest; different texts of one id come in
    the order of a hash; rows that agree in id and text are cut alike. ``n_chars`` follows where there is one.
    """
    return suffix_dedup.strip_repeats(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of the benchmark.

    Null and empty texts have none and stay, as does everything where the benchmark is empty; repeated rows go alike.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents until each source meets its target; ``copies`` says how often, and replaces a column of that name.

    Texts without words are never taken. A null source is a source of its own; repeated rows are taken each for itself.
    """
    return source_mix.take_mix(docs)


STAGES = [("quality rules", quality_stage), ("near copies", near_copy_stage), ("repeated strings", repeat_stage), ("benchmark leaks", leak_stage), ("source mix", mix_stage)]

#: The learned list of the first stage can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
