"""SentencePiece encoding and decoding by a Viterbi pass over a trie of the distinct marked words.

A text is cut where no piece can cross: before a run of spaces that follows other characters, and around line breaks and
tabs. The distinct words of a block of texts are sorted, which lists the leaves of their trie depth-first; the forward
column of a prefix is computed once and reused by all words that share it.

The forward column is the model's own criterion:

* unigram models: the best sum of piece scores (ties: the longer last piece);
* BPE models: merges by score. A sequence of pieces is the BPE result exactly if each piece is its own BPE result and
  each two neighbours are the BPE result of their concatenation, so a lattice edge is allowed only behind a compatible
  piece; then each prefix has one path, which is the library's encoding.

Characters without a piece become byte pieces (or the unknown id where the model has none). A literal U+2581, which the
library would turn into a space on decoding, is encoded as its bytes, so that decoding returns each text unchanged.

Defined results: null text stays null (null ids) in the operator; the empty text gives no ids; repeated rows are rows of
their own; further columns are passed through by ``encode`` and ``decode``, which refuse to
overwrite one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import worker_cache

SPACE = "▁"
#: Words that each of two generations of a worker's memory holds and their characters, pairs of pieces in it, and characters of
#: text that are solved together. They bound memory and change no result.
REMEMBERED, REMEMBERED_CHARS, PAIRS, BLOCK_CHARS = 120_000, 4_000_000, 300_000, 1_000_000


class PieceModel:
    """What encoding needs of a model file: pieces, scores, byte pieces, the kind."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb2

        proto = pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation that keep all white space are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that mark word ends are not supported")
        kinds = proto.SentencePiece
        self.bpe = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        if not self.bpe and proto.trainer_spec.model_type != proto.trainer_spec.UNIGRAM:
            raise ValueError("only unigram and BPE models are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            self.surface.append(b"")
            if p.type in (kinds.USER_DEFINED, kinds.UNUSED):
                raise ValueError("models with user-defined or unused pieces are not supported")
            if p.type == kinds.NORMAL:
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError("models with pieces across words are not supported")
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                self.surface[-1] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value] = i
                self.surface[-1] = bytes([value])
            elif p.type == kinds.UNKNOWN:
                self.unknown = i
                self.surface[-1] = " ⁇ ".encode()
        self.longest = max(map(len, self.ids), default=1)
        #: Lengths of the pieces that end in three given characters, the longest first.
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                lengths.setdefault(p[-3:], {2, 1}).add(len(p))
        self.tails = {tail: sorted(n, reverse=True) for tail, n in lengths.items()}
        self.alphabet = frozenset(chain.from_iterable(self.ids))
        self.least = min(self.scores.values(), default=0.0) - 10.0
        breaks = "".join(c for c in "\n\t\r" if c not in self.alphabet)
        if "▁" in breaks:
            breaks = breaks.replace(SPACE, "")
        self.words = re.compile(f" *[^ {breaks}{SPACE}]+| +|[{breaks}{SPACE}]" if breaks else f" *[^ {SPACE}]+| +|{SPACE}")

    def merged(self, s: str) -> list[str]:
        """BPE by definition: join the neighbours of the best score, the leftmost first, until none can be joined."""
        parts, scores = list(s), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def without_piece(self, c: str) -> tuple[int, ...]:
        data = c.encode()
        return tuple(self.byte_ids.get(b, self.unknown) for b in data) if self.byte_ids else (self.unknown,)


class Encoder:
    """Solves sorted words; keeps what it has learnt of words and of pairs of pieces."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.text = {i: p for p, i in model.ids.items()}
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.known_chars = 0

    def _own(self, i: int) -> bool:
        """Whether a piece is its own BPE result."""
        of = self.pairs.setdefault(-1, {})
        if i not in of:
            of[i] = self.model.merged(self.text[i]) == [self.text[i]]
        return of[i]

    def _follows(self, left: int, right: int, char: str) -> bool:
        """Whether BPE leaves ``left`` (-1: ``char``, which has no piece) and ``right`` apart."""
        if left < 0 and char not in self.model.alphabet:
            return self._own(right)
        a, b = char if left < 0 else self.text[left], self.text[right]
        ok = self._own(right) and self.model.merged(a + b) == [a, b]
        if left >= 0:
            self.n_pairs += 1
            if self.n_pairs > PAIRS:
                self.pairs.clear()
                self.n_pairs = 0
            self.pairs.setdefault(left, {})[right] = ok
        return ok

    def solve(self, words: list[str]) -> None:
        """Adds the ids of each word; ``words`` are distinct, marked and sorted."""
        m, known = self.model, self.known
        step = self._bpe_step if m.bpe else self._unigram_step
        before, size = "", {i: len(p) for p, i in m.ids.items()}
        id_at: list[int] = [-1]  # the last piece of the best path to each prefix; -1: a character without a piece
        score_at: list[float] = [0.0]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del id_at[shared + 1 :]
            del score_at[shared + 1 :]
            step(word, shared + 1, id_at, score_at)
            out: list[int] = []
            end = len(word)
            while end:
                i = id_at[end]
                if i < 0:
                    out.extend(reversed(m.without_piece(word[end - 1])))
                    end -= 1
                else:
                    out.append(i)
                    end -= size[i]
            out.reverse()
            known[word.replace(SPACE, " ")] = tuple(out)
            before = word

    def _bpe_step(self, word: str, first: int, id_at: list[int], _: list[float]) -> None:
        find, tails, short, pairs, follows = self.model.ids.get, self.model.tails, (2, 1), self.pairs, self._follows
        for end in range(first, len(word) + 1):
            best = -1
            for n in tails.get(word[end - 3 : end], short) if end > 2 else short:
                start = end - n
                if start < 0:
                    continue
                i = find(word[start:end])
                if i is None:
                    continue
                if start:
                    left = id_at[start]
                    of = pairs.get(left) if left >= 0 else None
                    ok = of.get(i) if of is not None else None
                    if ok is None:
                        ok = follows(left, i, word[start - 1])
                else:
                    ok = self._own(i)
                if ok:
                    best = i
                    break
            id_at.append(best)

    def _unigram_step(self, word: str, first: int, id_at: list[int], score_at: list[float]) -> None:
        m, tails, short = self.model, self.model.tails, (2, 1)
        for end in range(first, len(word) + 1):
            best_id, best = -1, None
            for n in tails.get(word[end - 3 : end], short) if end > 2 else short:
                piece = word[max(0, end - n) : end]
                if len(piece) == n and piece in m.ids:
                    score = score_at[end - n] + m.scores[piece]
                    if best is None or score > best:
                        best_id, best = m.ids[piece], score
            alone = score_at[end - 1] + m.least
            if best is None or (word[end - 1] not in m.ids and alone > best):
                best_id, best = -1, alone
            id_at.append(best_id)
            score_at.append(best)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """The ids of each text, solved by blocks of texts."""
        m = self.model
        split = m.words.findall
        literal = m.without_piece(SPACE)
        self.known[SPACE] = literal
        at = 0
        while at < len(texts):
            block: list[list[str] | None] = []
            size, fresh = 0, set()
            while at < len(texts) and size < BLOCK_CHARS:
                text = texts[at]
                at += 1
                if text is None:
                    block.append(None)
                    continue
                words = split(" " + text if m.dummy_prefix and text else text)
                size += len(text)
                block.append(words)
                fresh.update(words)
            if len(self.known) > REMEMBERED or self.known_chars > REMEMBERED_CHARS:
                self.older, self.known, self.known_chars = self.known, {SPACE: literal}, 0
            known, older = self.known, self.older
            fresh.difference_update(known)
            again = fresh & older.keys()
            known.update((w, older[w]) for w in again)
            fresh -= again
            fresh.discard(SPACE)
            self.known_chars += sum(map(len, fresh)) + sum(map(len, again))
            self.solve(sorted(w.replace(" ", SPACE) for w in fresh))
            get = known.__getitem__
            for words in block:
                yield None if words is None else np.fromiter(chain.from_iterable(map(get, words)), dtype=np.int32)


def worker_encoder(model: bytes) -> Encoder:
    cache = worker_cache("sentencepiece")
    if model not in cache:
        cache.clear()
        cache[model] = Encoder(PieceModel(model))
    return cache[model]


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if a is None else len(a) for a in arrays], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate([a for a in arrays if a is not None] or [np.empty(0, np.int32)]).astype(np.int32)
    mask = pa.array([a is None for a in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=mask)


def _new(docs: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name} already")


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of ``text_col``; the driver reads the model file and sends it with the job."""
    with open(model_path, "rb") as f:
        model = f.read()
    PieceModel(model)
    _new(docs, ids_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    names = [x.name for x in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = _lists(list(encoder.encode(column.slice(start, 1000).to_pylist())))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names[:-1]), ids], names=names)

    return docs.mapInArrow(run, schema)


def _text(ids: list[int], surface: list[bytes], prefix: bool) -> str:
    text = b"".join(map(surface.__getitem__, ids)).decode("utf-8", "replace")
    return text.removeprefix(" ") if prefix else text


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that ``ids_col`` stands for; ids outside the model raise."""
    with open(model_path, "rb") as f:
        model = PieceModel(f.read())
    surface, prefix = model.surface, model.dummy_prefix
    _new(docs, text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(text_col, T.StringType())])
    names = [x.name for x in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            for start in range(0, batch.num_rows, 1000):
                part, own = batch.slice(start, 1000), column.slice(start, 1000)
                texts = [None if x is None else _text(x, surface, prefix) for x in own.to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names[:-1]), pa.array(texts, pa.string())], names=names)

    return docs.mapInArrow(run, schema)


def round_trips(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, the digest of its ids as little-endian 32-bit numbers, the digest of the text decoded from
    them, and whether that is the text (null counts as empty). Encoding and decoding share one Python process."""
    with open(model_path, "rb") as f:
        model = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model)
        surface, prefix = encoder.model.surface, encoder.model.dummy_prefix
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(1).to_pylist()
                got = []
                for text, ids in zip(texts, encoder.encode(texts), strict=True):
                    back = _text(ids.tolist(), surface, prefix)
                    got.append((len(ids), sha256(ids.astype("<i4").tobytes()).hexdigest(), sha256(back.encode()).hexdigest(), back == text))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True))], names=names)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean")
