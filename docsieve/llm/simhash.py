"""SimHash near-duplicates by the generalised pigeonhole.

A text's fingerprint has 64 bits; two texts are linked at RADIUS or fewer differing bits. Equal fingerprints become one
class first. The bits are dealt into partitions, correlated bits together; if the partitions' thresholds t_i (-1 or more)
add up to RADIUS - partitions + 1, then two linked fingerprints differ in at most t_i bits of some partition i. A dynamic
programme picks the thresholds that cost least by the estimated numbers of probes and candidates: unequal, since
partitions with uneven bits collide more often. Each fingerprint is listed under its bits of each partition and, where
t_i is above 0, probes the values within t_i. Candidates that meet in a bucket are verified on all 64 bits.

No bucket emits all its pairs: larger ones give a spanning forest of their links, which keeps reachability. Buckets over
BUCKET fingerprints aren't compared pairwise at all: each member lists the values within RADIUS / 2 bits of itself, and two
members are linked exactly if they share one (which at most 2081 fingerprints can), so that work stays in proportion.

Defined results: null text counts as empty; texts without a word have fingerprint zero and link like any other; texts of
fewer words than a shingle are one shingle; repeated rows are rows of their own and link to each other; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import Workspace, join_groups, rows_kept, text_key, utf8

BITS, RADIUS, WORDS, SEED = 64, 4, 4, 42
#: Most fingerprints of a bucket that are compared with each other, and most of one that gives all its links.
BUCKET, FEW = 16_384, 12
#: Estimated seconds of a listed row and of a compared pair.
ROW_S, PAIR_S = 2e-6, 2e-8


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """The fingerprint of one text in UTF-8, unsigned."""
    parts = data.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    k = min(words, len(parts))
    starts = (ends - size)[: len(parts) - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 50_000):
        part = hashes[at : at + 50_000]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, fp): key is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, words) for t in utf8(batch.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.int64())], names=["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text").mapInArrow(run, "doc_id long, key long, fp long")


def _together(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy()
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(x)
        cell = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cell)), pa.int32()), pa.array(cell, pa.int64())], names=["cell", "n"])

    got = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for cell, n in classes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        got[cell] = n
    return int(got[-1]), got[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the bits into ``parts`` groups of like size: each starts with the most correlated bit left and takes the bits
    most correlated with it."""
    p = np.diag(together) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((together / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (r[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (r[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, most: int) -> np.ndarray:
    """Chances that two fingerprints with independent bits differ in at most 0, 1, ... ``most`` of the bits."""
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for d in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return np.cumsum(chance[: most + 1])


def allocate(costs: list[list[float]], total: int) -> tuple[list[int], float]:
    """Thresholds of least cost that add up to ``total``; costs[i][t + 1] is that of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, c in enumerate(row, start=-1):
                new = (cost + c, [*chosen, t])
                if done + t not in after or new < after[done + t]:
                    after[done + t] = new
        best = after
    cost, chosen = best[total]
    return chosen, cost


def plan(classes: DataFrame) -> list[tuple[list[int], int]]:
    """Partitions (their bits) and thresholds."""
    n, together = _together(classes)
    p = np.diag(together) / max(1, n)

    def costs(groups: list[list[int]], excess: list[float]) -> list[list[float]]:
        out = []
        for bits, more in zip(groups, excess, strict=True):
            share = within(p[bits], RADIUS)
            out.append([0.0] + [(n + 1) * ROW_S * sum(comb(len(bits), k) for k in range(t + 1)) + n * n / 2 * PAIR_S * min(1.0, share[t] * more) for t in range(RADIUS + 1)])
        return out

    choice = min((allocate(costs(g := group_bits(n, together, m), [1.0] * m), RADIUS - m + 1)[1], m, g) for m in range(2, RADIUS + 2))
    groups = choice[2]
    # How much more often the partitions' values really collide than independent bits would.
    masks = F.array(*[F.lit(_mask(g)) for g in groups])
    keyed = classes.select(F.posexplode(masks).alias("part", "mask"), "fp").groupBy("part", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).count()
    found = {r[0]: float(r[1]) for r in keyed.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).collect()}
    excess = [max(1.0, found.get(i, 0.0) / max(1e-9, n * n / 2 * within(p[g], 0)[0])) for i, g in enumerate(groups)]
    return list(zip(groups, allocate(costs(groups, excess), RADIUS - len(groups) + 1)[0], strict=True))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _flips(bits: range | list[int], most: int) -> list[int]:
    return [_mask(list(c)) for k in range(most + 1) for c in combinations(bits, k)]


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Positions of links that join whatever links join, at most one less than there are fingerprints."""
    forest, out, n = Forest(len(fps)), [], len(fps)
    step = max(1, 2_000_000 // n)
    for at in range(0, n, step):
        rows = fps[at : at + step]
        close = np.bitwise_count(rows[:, None] ^ fps[None, :]) <= RADIUS
        x, y = np.nonzero(close)
        x += at
        new = x < y
        for i, j in zip(x[new].tolist(), y[new].tolist(), strict=True):
            if forest.join(i, j):
                out.append((i, j))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (part, key); the rows come sorted."""

    def links(part: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])]))
        size = np.diff(np.append(start, len(fp)))
        a, b = [], []
        few = np.repeat(size <= FEW, size)
        run = np.repeat(np.arange(len(size)), size)
        for k in range(1, FEW):
            same = (run[k:] == run[:-k]) & few[k:]
            if not same.any():
                break
            i = np.flatnonzero(same)
            i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= RADIUS]
            a.append(fp[i])
            b.append(fp[i + k])
        for r in np.flatnonzero(size > FEW):
            own = fp[start[r] : start[r] + size[r]]
            got = np.array(spanning(own), dtype=np.int64).reshape(-1, 2)
            a.append(own[got[:, 0]])
            b.append(own[got[:, 1]])
        a, b = (np.concatenate(x or [np.empty(0, np.uint64)]).view(np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        cut = int(np.flatnonzero((held[0] == held[0][-1]) & (held[1] == held[1][-1]))[0])
        if cut:
            yield links(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield links(*held)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between rows that follow each other under the same value; the rows come sorted."""
    last = (None, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        z, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        z0, f0 = np.concatenate([[z[0] if last[0] is None else last[0]], z[:-1]]), np.concatenate([[fp[0] if last[1] is None else last[1]], fp[:-1]])
        at = np.flatnonzero((z == z0) & (fp != f0))
        last = (z[-1], fp[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[at], f0[at])), pa.array(np.maximum(fp[at], f0[at]))], names=["a", "b"])


def links(classes: DataFrame, space: Workspace, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between different fingerprints that join all that are linked, directly or through others."""
    spark = classes.sparkSession
    lists = [(i, _mask(bits), flip) for i, (bits, t) in enumerate(plan(classes)) if t >= 0 for flip in _flips(bits, t)]
    under = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(m).alias("mask"), F.lit(f).alias("flip")) for i, m, f in lists])
    rows = classes.select(F.explode(under).alias("at"), "fp").select("at.part", F.col("fp").bitwiseAND(F.col("at.mask")).bitwiseXOR(F.col("at.flip")).alias("key"), "fp")
    hot = space.keep(rows.groupBy("part", "key").count().where(F.col("count") > bucket).select("part", "key"), "hot")
    some_hot = not hot.isEmpty()
    cold = rows.join(hot, ["part", "key"], "left_anti") if some_hot else rows
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cold.repartition(n, "part", "key").sortWithinPartitions("part", "key", "fp").mapInArrow(_verify, "a long, b long")
    if some_hot:
        full = rows.join(hot, ["part", "key"], "left_semi").select("fp").distinct()
        balls = full.select(F.explode(F.array(*[F.lit(f) for f in _flips(range(BITS), RADIUS // 2)])).alias("flip"), "fp").select(F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "fp")
        found = found.union(balls.repartition(n, "z").sortWithinPartitions("z", "fp").mapInArrow(_neighbours, "a long, b long"))
    return space.keep(found, "links")


def _classes(docs: DataFrame, words: int, bucket: int) -> tuple[DataFrame, DataFrame, int]:
    """The fingerprints of all rows; of each fingerprint its rows, the first of them, as (doc_id, key), its root and
    component_id; and the number of all rows."""
    space = Workspace(docs.sparkSession, "simhash")
    prints = space.keep(fingerprints(docs, words), "prints")
    total = prints.count()
    classes = space.keep(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "key")).alias("first"), F.min("doc_id").alias("id")), "classes")
    roots = connected(links(classes.select("fp"), space, bucket), space)
    named = space.keep(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rows", "first", "id", F.coalesce("root", "fp").alias("root")), "named")
    sizes = space.keep(named.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("size")), "sizes")
    of = join_groups(named, sizes, ["root"], "size", total, written=True).select("fp", "rows", "first", "root", "component_id")
    return prints, space.keep(of, "components"), total


def near_groups(docs: DataFrame, words: int = WORDS, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    prints, of, total = _classes(docs, words, bucket)
    return join_groups(prints, of, ["fp"], "rows", total, written=True).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = WORDS, bucket: int = BUCKET) -> DataFrame:
    """The row with the smallest doc_id of each group of near-duplicates, with its columns."""
    prints, of, _ = _classes(docs, words, bucket)
    first = of.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.key").alias("first_key"))
    rows = prints.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    same = rows["doc_id"].eqNullSafe(first["id"]) & (rows["key"] == first["first_key"])
    return rows_kept(docs, rows.join(first, same, "left_semi").select("doc_id", "key", "rows"))
