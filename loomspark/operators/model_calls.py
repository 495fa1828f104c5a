"""Calls of models: a cache on disk by content, so that nothing is asked twice, and attempts that hand the error back.

A call's key is a hash of the model's name and the text. Distinct keys that the cache does not hold are called for, in
batches, and appended as one file set; rows are joined by key, never by text. Repeated rows, later runs and attempts of
lost tasks that were already appended cost no call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.folders import keep_schema, parts_of
from loomspark.operators.graph import cut_lineage

PARTS = 16  # directories of the cache, by the first hex digit of the key
BATCH = 256  # texts handed to a call at once, at most
BROADCAST_KEYS = 400_000


class CallCache:
    """Answers at a path of a shared store: key, model, answer (of the type given when it was made)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.kind = parts_of(spark, f"{path}/answers").schema["answer"].dataType.simpleString()

    @classmethod
    def create(cls, spark: SparkSession, path: str, kind: str = "array<double>") -> CallCache:
        empty = spark.createDataFrame([], f"key string, model string, answer {kind}, part string")
        keep_schema(empty, f"{path}/answers")
        empty.write.mode("append").partitionBy("part").parquet(f"{path}/answers")
        return cls(spark, path)

    @staticmethod
    def key(model: str, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(model + "\0"), text).cast("binary"), 256)

    def answers(self, model: str) -> DataFrame:
        """key, answer; two runs that asked at one time leave one answer."""
        return parts_of(self.spark, f"{self.path}/answers").where(F.col("model") == model).groupBy("key").agg(F.min_by("answer", F.xxhash64("answer")).alias("answer"))

    def ask(self, rows: DataFrame, text: str, model: str, call: Callable[[list[str]], Sequence], out: str = "answer", key: str | None = None) -> DataFrame:
        """rows with the column out: the answer to each text, null for null texts. Only keys that are not held are called for.

        Keys are looked up without the texts; only texts that are called for are shuffled, once. With the name of a key the
        rows get such a column, and rows that have it (of this model and text) are not hashed anew, so a later call need not carry the text.
        """
        name = key or "_key"
        rows = rows if name in rows.columns else rows.withColumn(name, self.key(model, F.col(text)))
        asked = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("key"))
        new = cut_lineage(asked.distinct().join(self.answers(model).select("key"), "key", "left_anti"))
        n = new.count()
        kind = self.kind

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), BATCH):
                    part = pdf.iloc[at : at + BATCH]
                    yield pd.DataFrame({"key": part["key"].to_numpy(), "answer": list(call(part["text"].tolist()))})

        if n:
            some = F.broadcast(new) if n <= BROADCAST_KEYS else new
            wanted = rows.select(F.col(name).alias("key"), F.col(text).alias("text")).join(some, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))  # texts of one key are equal
            missing = wanted.mapInPandas(run, f"key string, answer {kind}").withColumns({"model": F.lit(model), "part": F.substring("key", 1, 1)})
            missing.select("key", "model", "answer", "part").write.mode("append").partitionBy("part").parquet(f"{self.path}/answers")  # one job: each key is called for once
        out_rows = rows.join(self.answers(model).select(F.col("key").alias(name), F.col("answer").alias(out)), name, "left")
        return out_rows.select(*rows.columns, out) if key else out_rows.drop(name)


def attempted(chunks: DataFrame, call: Callable[[list[str], list[str | None]], Sequence[str | None]], check: Callable[[Column], Column], most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Answers for chunks (doc_id, chunk_no, text), and documents to set aside.

    call gets texts and, from the second attempt on, what was wrong with the last answer; check gives for an answer what is
    wrong with it, or null. Only chunks that failed are tried again, `most` times at all. The first result has doc_id,
    chunk_no, answer, attempts, error of each chunk (a null answer and the last error if it failed); the second the
    doc_id of documents without any good chunk. A call that raises fails its chunk with the error's text, not the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH].copy()
                told = [None if pd.isna(e) else e for e in part["error"]]
                try:
                    part["answer"], part["raised"] = pd.Series(list(call(part["text"].tolist(), told)), index=part.index, dtype=object), None
                except Exception as e:  # noqa: BLE001  a model's failure is an answer of its own
                    part["answer"], part["raised"] = None, f"{type(e).__name__}: {e}"
                yield part[["doc_id", "chunk_no", "text", "answer", "raised"]]

    kinds = [chunks.schema[c].dataType.simpleString() for c in ("doc_id", "chunk_no")]
    left = chunks.select("doc_id", "chunk_no", "text", F.lit(None).cast("string").alias("error"))
    done: DataFrame | None = None
    for n in range(1, most + 1):
        said = left.mapInPandas(run, f"doc_id {kinds[0]}, chunk_no {kinds[1]}, text string, answer string, raised string")
        wrong = F.coalesce("raised", F.when(F.col("answer").isNull(), F.lit("no answer")), check(F.col("answer")))
        said = cut_lineage(said.withColumn("error", wrong))  # each attempt is made once
        last = F.lit(n == most)
        ended = said.where(F.col("error").isNull() | last).select("doc_id", "chunk_no", F.when(F.col("error").isNull(), F.col("answer")).alias("answer"), F.lit(n).alias("attempts"), "error")
        done = ended if done is None else done.unionByName(ended)
        left = said.where("error IS NOT NULL").select("doc_id", "chunk_no", "text", "error")
        if left.isEmpty():
            break
    aside = done.groupBy("doc_id").agg(F.count("answer").alias("good")).where("good = 0").select("doc_id")
    return done, aside
