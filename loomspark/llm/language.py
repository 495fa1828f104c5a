"""Language identification by Bayesian evidence fusion.

Text likelihoods come from byte trigrams of the whole text, under a model trained on a bounded sample of labelled rows.
Text that runs long repeats its evidence, so it counts as at most EVIDENCE trigrams. The other evidence is how often
text of each language declares what a row declares, and a prior of the row's host, smoothed towards its address
suffix, and that towards the whole: all grouped sums of the text posteriors over all rows, without the row's own.
Text of no known language is a class of its own, under which every trigram is as likely as any other; it takes part
in all posteriors, so other languages and junk lend a host nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._shared import BROADCAST_ROWS, arrow_batches, by_group, checked, free_name, read, stage

TRAINING_ROWS = 3000  # labelled rows that the model is trained on, about, dealt evenly to the languages
LANGUAGE_ROWS = 100  # rows that a language gets in any case, about, if it has as many
TRAINING_CHARS = 20_000  # of a text that enter the training
LEAST_LABELS = 5  # labelled rows of a language, of all, for it to be known
CELLS = 1 << 14
EVIDENCE = 150.0
UNKNOWN = 1e-3  # prior of text of no known language
STRENGTH = 20.0  # rows that the wider prior counts as
CHUNK = 1 << 18

# Bytes as trigrams see them: letters in lower case, bytes beyond ASCII as they are, anything else as a space.
_SEEN = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint32)


def _cells(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each trigram, and which trigrams count (those with a letter in the middle)."""
    seen = _SEEN[np.frombuffer(data, np.uint8)]
    cells = (seen[:-2] * np.uint32(40503) ^ seen[1:-1] * np.uint32(2654435) ^ seen[2:] * np.uint32(97561)) % np.uint32(CELLS)
    return cells.astype(np.int32), seen[1:-1] != 32


def train(texts: list[str], labels: list[str], langs: list[str]) -> np.ndarray:
    """For each cell the log probabilities under each of langs."""
    at = {x: i for i, x in enumerate(langs)}
    counts = np.full((CELLS, len(langs)), 0.5)
    for text, label in zip(texts, labels, strict=True):
        cells, counted = _cells(b" " + text.encode("utf-8", "surrogatepass") + b" ")
        counts[:, at[label]] += np.bincount(cells[counted], minlength=CELLS)
    return np.log(counts / counts.sum(0)) if langs else np.zeros((CELLS, 0))


def likelihoods(texts: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of each text under each language, held to EVIDENCE trigrams, and the number of trigrams."""
    sums, sizes = np.zeros((len(texts), model.shape[1])), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        data = b" " + t.encode("utf-8", "surrogatepass") + b" "
        for at in range(0, len(data) - 2, CHUNK):
            cells, counted = _cells(data[at : at + CHUNK + 2])
            cells = cells[counted]
            sizes[i] += len(cells)
            sums[i] += model[cells].sum(0)
    return sums * (np.minimum(sizes, EVIDENCE) / np.maximum(sizes, 1))[:, None], sizes


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """The model: the languages in order, and their table.

    Labels are counted over all rows. Each language of LEAST_LABELS rows or more gives about TRAINING_ROWS by the
    number of languages, but LANGUAGE_ROWS at least, chosen by a hash of key and text; fewer are all taken. Rows alike
    count once among them. Of long texts the first TRAINING_CHARS characters are read.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.xxhash64(key, text).alias("h"), F.substring(text, 1, TRAINING_CHARS).alias("t"), F.lower(label).alias("l"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_LABELS).collect()}
    langs = sorted(counts)
    if not langs:
        return langs, train([], [], langs)
    most = max(TRAINING_ROWS // len(langs), LANGUAGE_ROWS)
    shares = rows.sparkSession.createDataFrame([(x, min(1.0, most / n)) for x, n in counts.items()], "l string, share double")
    part = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    once = lambda df: df.groupBy("l", "h").agg(F.first("t").alias("t"))
    drawn = [(r["l"], r["t"]) for r in once(rows.join(checked(shares, len(langs)), "l").where(part < F.col("share"))).orderBy("l", "h").collect()]
    had = Counter(x for x, _ in drawn)
    for x in langs:  # a language of few texts with many copies each may have been missed
        if had[x] < LEAST_LABELS and counts[x] > most:
            drawn = [d for d in drawn if d[0] != x] + [(x, r["t"]) for r in once(rows.where(F.col("l") == x)).orderBy("h").limit(most).collect()]
    return langs, train([t for _, t in drawn], [x for x, _ in drawn], langs)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], key: str, text: str, declared: Column, host: Column, suffix: Column, least: float = 0.5) -> DataFrame:
    """Return key, text_hash, language, confidence, kept for each row.

    A row is rejected (kept false) when its text has no letters, or when no language is as likely as `least` next to
    the others and to text of no known language. Its language is then the best of the known ones all the same. Null
    and empty texts have no letters; they get the language of the other evidence. Null declarations, hosts and
    suffixes are values of their own. Ties go to the first language by name. Without languages in the model the
    language is null and nothing is kept. Repeated rows are judged alike. Other columns are ignored.
    """
    langs, table = model
    arrow_batches(rows.sparkSession)
    n = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes = likelihoods([x or "" for x in batch.column(5).to_pylist()], table)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * n), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sizes), lists], ["_key", "_th", "_d", "_h", "_s", "_n", "_ll"])

    kind = rows.schema[key].dataType.simpleString()
    plain = lambda c: F.coalesce(F.lower(c.cast("string")), F.lit(""))
    read_in = rows.select(rows[key].alias("_key"), F.xxhash64(rows[text]).alias("_th"), plain(declared).alias("_d"), plain(host).alias("_h"), plain(suffix).alias("_s"), rows[text].alias("_text"))
    known = read_in.mapInArrow(run, f"_key {kind}, _th long, _d string, _h string, _s string, _n long, _ll array<double>")
    known = stage(known, "op2-likelihoods")
    if not n:
        return known.select(F.col("_key").alias(key), F.col("_th").alias("text_hash"), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))

    ll = [F.col("_ll")[i] for i in range(n)]
    other = F.when(F.col("_n") > 0, math.log(UNKNOWN) - math.log(CELLS) * F.least("_n", F.lit(EVIDENCE))).otherwise(F.lit(-math.inf))
    top = F.greatest(F.array_max("_ll"), other)
    own = [F.when(F.col("_n") > 0, F.exp(x - top) / reduce(lambda a, b: a + b, [F.exp(y - top) for y in [*ll, other]])).otherwise(F.lit(0.0)) for x in ll]
    posts = known.withColumns({f"_p{i}": own[i] for i in range(n)})
    whole = posts.agg(*[F.sum(f"_p{i}") for i in range(n)]).first()
    whole = [x or 0.0 for x in whole]
    total = sum(whole) + n
    wide = [(x + 1) / total for x in whole]
    for by in ("_d", "_s", "_h"):
        sums = stage(known.groupBy(by).agg(F.count("*").alias("_rows"), *[F.sum(own[i]).alias(f"{by}{i}") for i in range(n)]), f"op2{by}")
        few = sums.count()
        posts = posts.join(checked(sums, few), by) if few <= BROADCAST_ROWS else by_group(posts, sums, [by], "_rows")
        posts = posts.drop("_rows")
    one = lambda by: reduce(lambda a, b: a + b, [F.col(f"{by}{i}") - F.col(f"_p{i}") for i in range(n)])

    def score(i: int) -> Column:
        rest = lambda by: F.greatest(F.lit(0.0), F.col(f"{by}{i}") - F.col(f"_p{i}"))
        by_suffix = (rest("_s") + STRENGTH * wide[i]) / (F.greatest(F.lit(0.0), one("_s")) + STRENGTH)
        by_host = (rest("_h") + STRENGTH * by_suffix) / (F.greatest(F.lit(0.0), one("_h")) + STRENGTH)
        says = (rest("_d") + 1.0) / (F.lit(whole[i]) - F.col(f"_p{i}") + 2.0)
        return F.when(F.col("_n") > 0, F.col("_ll")[i]).otherwise(F.lit(0.0)) + F.log(by_host) + F.log(says)

    scored = posts.withColumn("_score", F.array(*[score(i) for i in range(n)]))
    best = F.array_max("_score")
    ref = F.greatest(best, other)
    sure = F.exp(best - ref) / F.aggregate("_score", F.exp(other - ref), lambda a, x: a + F.exp(x - ref))
    language = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("_score", best).cast("int"))
    return scored.select(
        F.col("_key").alias(key), F.col("_th").alias("text_hash"), language.alias("language"), F.round(sure, 6).alias("confidence"), ((F.col("_n") > 0) & (sure >= least)).alias("kept"),
    )


def accept(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that were rejected; all columns stay, whatever their names.

    Rows are told by key and text (a null key is a key like any other), so repeated rows stay or go together.
    """
    bad = free_name(docs, "_bad")
    out = stage(found.where("not kept").select(F.struct(F.col(key).alias("k"), F.col("text_hash").alias("t")).alias(bad)).distinct(), "op2-rejected")
    return docs.join(checked(out), F.struct(docs[key].alias("k"), F.xxhash64(docs[text]).alias("t")).eqNullSafe(F.col(bad)), "left_anti")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents have a source, which stands for the host, and declare lang; they have no address."""
    return identify(docs, fit(docs), "doc_id", "text", docs["lang"], docs["source"], F.lit(None))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = read(spark, sf_dir, "documents")
    return identify_documents(docs).drop("text_hash")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page's main text, with its markup's declaration, its host and its address suffix."""
    from loomspark.llm.html_text import extract

    pages = read(spark, sf_dir, "pages").withColumn("declared", F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)", 1))
    rows = extract(pages, keep=("page_id", "url", "declared")).withColumn("host", F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    model = fit(read(spark, sf_dir, "documents"))
    return identify(rows, model, "page_id", "text", F.col("declared"), F.col("host"), F.regexp_extract("host", r"([^.]*)$", 1)).drop("text_hash")
