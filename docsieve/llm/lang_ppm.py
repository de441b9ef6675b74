"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes: a node is a context of 0 to ``ORDER`` bytes with counts of
the bytes that follow it, in lower-cased text. The probability of a byte blends down the tree by escapes (method C): a byte seen behind the
longest known context has count / (total + distinct); otherwise the escape, distinct / (total + distinct), multiplies
what the next shorter context says; a context that a language never saw costs nothing; order -1 is uniform over all 256
bytes. The counts are frozen, so a text's code length under each language is exact: the sum of its bytes' code lengths. The
language of the shortest code is predicted (ties: the first by name); the score is its share of the posterior under equal
priors, with code lengths per byte sharpened by the text's length up to SHARP bytes.

The trees of all languages are kept as one sparse table an order: (context and byte) to the languages that saw it and their
code lengths, and context to their escapes. So the broadcast grows with what the languages' fitted documents hold, never with
the corpus or the square of the languages. Texts are scored by blocks, whose distinct runs of bytes are resolved once.

The counts come from about ``max_fit_docs`` whole documents of each language at most (those of the smallest hashes),
never from held-out rows. All texts are scored whole.

Defined results: null or letterless text gives ``und`` with score 0; with no training rows all give ``und``; documents
without a language are scored but not learnt from; repeated rows are rows of their own; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_share, utf8

ORDER, SHARP = 3, 400
#: Positions that are scored at a time, over all languages.
BLOCK = 4_000_000
LETTER = regex.compile(r"\p{L}")


def codes(data: bytes) -> np.ndarray:
    """For each byte the number of the ORDER + 1 bytes that end in it; line ends stand before the text."""
    own = np.frombuffer(b"\n" * ORDER + data, np.uint8).astype(np.uint32)
    out = np.zeros(len(data), np.uint32)
    for k in range(ORDER + 1):
        out = out << np.uint32(8) | own[k : k + len(data)]
    return out


@dataclass
class Sparse:
    """Rows of (language, value) under sorted keys."""

    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        """From each language's keys and values."""
        key = np.concatenate([k for k, _ in parts])
        lang = np.repeat(np.arange(len(parts), dtype=np.int16), [len(k) for k, _ in parts])
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        return cls(keys, np.append(first, len(key)), lang[order], np.concatenate([v for _, v in parts])[order])

    def dense(self, keys: np.ndarray, n_langs: int, missing: float) -> np.ndarray:
        out = np.full((len(keys), n_langs), missing)
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        rows = np.flatnonzero(self.keys[at] == keys)
        at = at[rows]
        size = self.start[at + 1] - self.start[at]
        cell = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out[np.repeat(rows, size), self.lang[cell]] = self.value[cell]
        return out


class Model:
    """``counts``: for each language, numbers of ORDER + 1 bytes and how often each was seen."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.seen: list[Sparse] = []
        self.escapes: list[Sparse] = []
        for order in range(ORDER + 1 if langs else 0):
            bits, escape = [], []
            for grams, n in counts:
                mine, inverse = np.unique(grams.astype(np.int64) % 256 ** (order + 1), return_inverse=True)
                amount = np.bincount(inverse, n, len(mine))
                contexts, of, distinct = np.unique(mine >> 8, return_inverse=True, return_counts=True)
                total = np.bincount(of, amount, len(contexts)) + distinct
                bits.append((mine, np.log2(total[of] / amount)))
                escape.append((contexts, np.log2(total / distinct)))
            self.seen.append(Sparse.of(bits))
            self.escapes.append(Sparse.of(escape))

    def bits(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Code length under each language of the last byte of distinct runs of ``order`` + 1 bytes."""
        if order < 0:
            return np.full((len(grams), len(self.langs)), 8.0)
        out = self.seen[order].dense(grams, len(self.langs), np.nan)
        rows = np.flatnonzero(np.isnan(out).any(1))
        if len(rows):
            shorter, at = np.unique(grams[rows] % 256**order, return_inverse=True)
            back = self.escapes[order].dense(grams[rows] >> 8, len(self.langs), 0.0) + self.bits(shorter, order - 1)[at]
            out[rows] = np.where(np.isnan(out[rows]), back, out[rows])
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        block, owners, size, room = [], [], 0, max(1, BLOCK // max(1, len(self.langs)))

        def add() -> None:
            distinct, at = np.unique(np.concatenate(block), return_inverse=True)
            each = self.bits(distinct.astype(np.int64))[at]
            starts = np.cumsum([0] + [len(x) for x in block[:-1]])
            np.add.at(out, owners, np.add.reduceat(each, starts, axis=0))

        for k, data in enumerate(texts):
            own = codes(data)
            for at in range(0, len(own), room):
                part = own[at : at + room]
                if size + len(part) > room and block:
                    add()
                    block, owners, size = [], [], 0
                block.append(part)
                owners.append(k)
                size += len(part)
        if block:
            add()
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        got: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        some = [k for k, data in enumerate(texts) if self.langs and LETTER.search(data.decode("utf-8", "replace"))]
        for k, bits in zip(some, self.lengths([texts[k] for k in some]), strict=True):
            best, n = int(np.argmin(bits)), len(texts[k])
            odds = np.exp2(np.clip((bits[best] - bits) / n * min(n, SHARP), -60, 0))
            got[k] = (self.langs[best], float(1 / odds.sum()))
        return got


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def learn(docs: DataFrame, max_fit_docs: int = 3000) -> Model:
    """Counts contexts of the training documents in parallel; the driver gets one row a language and distinct context."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = F.when(F.col("lang") == name, hash_share(F.xxhash64("doc_id", "text"), max_fit_docs, n)).otherwise(chosen)
    some = usable.where(chosen).select("lang", F.lower("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                held.setdefault(lang, []).append(codes(data))
            for lang, parts in held.items():
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])
            held.clear()

    got = some.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    name, code, n = got.column(0).to_numpy(zero_copy_only=False), got.column(1).to_numpy(), got.column(2).to_numpy()
    langs = [x for x in sorted(sizes) if (name == x).any()]
    return Model(langs, [(code[name == x], n[name == x]) for x in langs])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = model or learn(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages and max_fit_docs, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = sent.value.predict
        for batch in batches:
            got = predict(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
