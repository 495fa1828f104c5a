"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs: an executor that is lost costs at most its tasks of one stage. A stage's own tables are deleted
when the next begins, as their readers have been written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, jaccard, language, mixing, suffixes
from loomspark.llm._shared import checked, free_name, release, stage, staged_now

_left: dict[str, list[str]] = {}  # by sf_dir, the tables that a stage's result still reads


def _stage(work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, [x for x in _left.pop(sf_dir, []) if x in staged_now()])
        before = staged_now()
        out = work(docs)
        _left[sf_dir] = [x for x in staged_now() if x not in before]
        return out

    return run_stage


def _known_language(docs: DataFrame) -> DataFrame:
    """Documents whose text is in a language that the model knows; null and empty texts go.

    Repeated rows stay or go together. All columns stay, whatever their names; an empty table gives an empty one.
    """
    return language.accept(docs, language.identify_documents(docs))


def _one_of_each_group(docs: DataFrame) -> DataFrame:
    """The document of least id of each group of near duplicates.

    A node of the join is an id with a text (by a 63-bit hash of both), so an id of several texts, or null, is as
    many documents. Of rows alike in both one stays. Null and empty texts have no near duplicates and stay; a null id
    counts as the least. All columns stay, whatever their names; an empty table gives an empty one.
    """
    node = free_name(docs, "_node")
    docs = docs.withColumn(node, F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    found = stage(jaccard.similar(docs, key=node), "pipeline-groups")
    ids = docs.groupBy(node).agg(F.min("doc_id").alias("_id"), F.count("*").alias("_n"))
    found = found.select(node, F.col("component_id").alias("_c")).distinct()
    nodes = stage(found.join(ids, node), "pipeline-nodes")
    heads = nodes.groupBy("_c").agg(F.min(F.struct("_id", node)).alias("_head")).select(F.col("_head")[node].alias(node))
    gone = stage(nodes.select(node).join(heads, node, "left_anti"), "pipeline-gone")
    again = stage(nodes.where("_n > 1").select(node), "pipeline-again")
    kept = docs.join(checked(gone), node, "left_anti")
    if not again.isEmpty():
        once = kept.join(checked(again), node, "left_semi").dropDuplicates([node])
        kept = kept.join(checked(again), node, "left_anti").unionByName(once)
    return kept.drop(node)


def _without_repeats(docs: DataFrame) -> DataFrame:
    """Texts without the passages of 50 words or more that stand earlier; documents of which nothing is left go.

    Null texts and texts without words stay as they are. All columns stay, whatever their names, n_chars with the new
    length; an empty table gives an empty one.
    """
    had = free_name(docs, "_had")
    cut = suffixes.cut_repeats(docs.withColumn(had, F.col("text").rlike(r"\S")))
    return cut.where(~F.coalesce(had, F.lit(False)) | F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _mixed(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix of sources reads them; a null source is a source of its own, null texts are never read.

    All columns stay, whatever their names; an empty table gives an empty one.
    """
    return mixing.mixed(docs)


def _encoded(docs: DataFrame) -> DataFrame:
    """Token ids and their digests, for each reading of a document; null texts have no tokens, an empty table gives no rows."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("language ID", _stage(_known_language)),
    ("n-gram Jaccard join", _stage(_one_of_each_group)),
    ("suffix-array dedup", _stage(_without_repeats)),
    ("mixing sources to target weights", _stage(_mixed)),
    ("BPE encoding and decoding", _stage(_encoded)),
]

#: The Bayesian model of the first stage, and the encoding of the last, are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; all but the last are written into the shared folder and read again.

    A stage's table goes when the next one is written, the last one's when the process ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        release(spark, before)
        before = staged_now()[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
