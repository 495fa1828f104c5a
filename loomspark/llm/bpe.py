"""Byte-pair encoding and decoding with a public word-end vocabulary.

A short word is held as a contiguous array of part ids and one of the ranks of adjacent pairs; the least rank is
looked for again and again, its boundary deleted, and the two neighbouring ranks refreshed. Words of over LONG parts
get the same result from a heap of pairs over a linked list, so their cost stays near linear. Words repeat, so each
task keeps the encodings of the words that it met, up to CACHE of them, and starts over beyond that.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loomspark.llm._shared import arrow_batches, read

LONG = 256
CACHE = 400_000
NO_RANK = 1 << 60
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPACE = regex.compile(r"\p{White_Space}+")
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest for U+0100 onwards in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file of merges over bytes with word ends; special strings keep their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab = told["model"]["vocab"]
        letters = byte_letters()
        self.first = [vocab[x] for x in letters]
        self.last = [vocab[x + WORD_END] for x in letters]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, told["model"]["merges"]))}
        self.token = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def word(self, word: str) -> list[int]:
        data = word.encode()
        parts = [self.first[b] for b in data]
        parts[-1] = self.last[data[-1]]
        return self._long(parts) if len(parts) > LONG else self._short(parts)

    def _rank(self, a: int, b: int) -> int:
        return self.pairs.get((a, b), (NO_RANK,))[0]

    def _short(self, parts: list[int]) -> list[int]:
        pairs, ranks = self.pairs, [self._rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = self._rank(parts[i], parts[i + 1])
            if i:
                ranks[i - 1] = self._rank(parts[i - 1], parts[i])
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(self._rank(parts[i], parts[i + 1]), i, parts[i], parts[i + 1]) for i in range(n - 1)]
        heap = [x for x in heap if x[0] < NO_RANK]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue  # the pair has gone meanwhile
            parts[i], alive[j], after[i] = self.pairs[a, b][1], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (rank := self._rank(parts[k], parts[after[k]])) < NO_RANK:
                    heapq.heappush(heap, (rank, k, parts[k], parts[after[k]]))
        return [p for p, x in zip(parts, alive, strict=True) if x]

    def words(self, text: str) -> list[str]:
        """The pieces of a text that are encoded one by one."""
        text = SPACE.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()  # a final sigma stays as any other
        return PIECE.findall(text)

    def segments(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """Special ids (with no words) and runs of words, in order."""
        for x in self.cut.split(text) if self.cut else [text]:
            if x in self.special:
                yield self.special[x], []
            elif x:
                yield None, self.words(x)

    def encode(self, text: str) -> list[int]:
        return [i for special, words in self.segments(text) for i in ([special] if special is not None else [j for w in words for j in self.word(w)])]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, as the vocabulary names no decoder."""
        return " ".join(self.token[i] for i in ids)


class _Kept(dict):
    """word: its ids and its decoded tokens, as text."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[str, str]:
        ids = self.bpe.word(word)
        out = self[word] = " ".join(map(str, ids)), self.bpe.decode(ids)
        return out


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Return key, n_tokens, ids_sha256, decoded_sha256 for each row, and the list ids if asked for.

    Null and empty texts have no tokens. Rows are handled one by one, so repeated rows give equal rows. Special
    strings in a text become their special ids. path must be readable by every executor. Other columns are ignored.
    """
    schema = f"_key {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        kept = _Kept(bpe)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for x in batch.column(1):
                told, decoded = [], []
                for special, words in bpe.segments(x.as_py() or ""):
                    if special is not None:
                        told.append(str(special))
                        decoded.append(bpe.token[special])
                    elif words:
                        both = [kept[w] for w in words]
                        told.append(" ".join([a for a, _ in both]))
                        decoded.append(" ".join([b for _, b in both]))
                if len(kept) > CACHE:
                    kept.clear()
                line = " ".join(told)
                rows[0].append(line.count(" ") + 1 if line else 0)
                rows[1].append(hashlib.sha256(line.encode()).hexdigest())
                rows[2].append(hashlib.sha256(" ".join(decoded).encode()).hexdigest())
                if ids:
                    rows[3].append(np.fromstring(line, np.int32, sep=" ") if line else np.empty(0, np.int32))
            out = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            names = ["_key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out, names = [*out, pa.array(rows[3], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    arrow_batches(docs.sparkSession)
    return docs.select(docs[key].alias("_key"), docs[text]).mapInArrow(run, schema).withColumnRenamed("_key", key)


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Return key and text, decoded from the list ids (null: empty text)."""
    schema = f"_key {encoded.schema[key].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_key", "text"])

    return encoded.select(encoded[key].alias("_key"), encoded["ids"]).mapInArrow(run, schema).withColumnRenamed("_key", key)


def op7_encode_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the word-end vocabulary of 49k tokens and decoded again."""
    import public_tokenizers

    return encode_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
