"""The corpus pipeline: low quality and outlying documents go, one of each group of near duplicates stays, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs; all but the last return the columns of docs. Decisions are
made on narrow tables and reach the texts by a semi-join on doc_id and a hash of the text, so
repeated rows are not multiplied and null ids are matched with themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walksieve.llm import jaccard_join, outliers, packing, rule_ensemble
from walksieve.llm.common import fold, staged, table
from walksieve.llm.queries import tokenizer_path


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of the text, and the name of that column, which docs has not."""
    name = "_mark"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())), name


def _only(docs: DataFrame, chosen: DataFrame, mark: str) -> DataFrame:
    """The marked rows whose id and mark are among the chosen ones."""
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col(mark).alias("_chosen"))
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_id"]) & (docs[mark] == chosen["_chosen"]), "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble finds likelier good than bad. It learns from the labels of two thirds of the ids."""
    marked, mark = _marked(docs)
    scored = rule_ensemble.classify(marked, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1, keep=(mark,))
    return _only(marked, scored.where("predicted = 1"), mark).drop(mark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    marked, mark = _marked(docs)
    judged = outliers.judge(marked, keep=("doc_id", mark))
    return _only(marked, judged.where("kept"), mark).drop(mark)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of the n-gram Jaccard join connect, the document with the smallest id (of equal ids, one).

    Texts without words are alone. A row without an id stands for a group only if the group has no id at all. Groups are
    told apart by their texts, so an id that stands on several texts may stand for several groups.
    """
    marked, mark = _marked(docs)
    key, group = mark + "_key", mark + "_group"
    # one name without nulls for a row's id and text serves to drop repeated rows and to choose: the texts move once
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col(mark).cast("string"))
    joined = staged(jaccard_join.join(marked, k=5, percent=80, keep=(mark,), component=group).select("doc_id", mark, group), "groups")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", mark)
    grouped = joined.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(first).alias("first")).select("first.doc_id", f"first.{mark}")
    alone = joined.where(F.col(group).isNull()).select("doc_id", mark).distinct()
    chosen = grouped.unionByName(alone).select(name.alias(key))
    return marked.withColumn(key, name).dropDuplicates([key]).join(chosen, key, "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), size=2048, end_id=1)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Fitted models and tokenizers are beyond SQL; tests compare with a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
