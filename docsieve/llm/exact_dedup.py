"""Exact deduplication over an extendible-hash index.

The index maps a 64-bit hash of the text to a *bucket* through a directory addressed by the leading hash bits. A bucket
that holds more than ``capacity`` bytes of different texts is split; where its local depth has reached the global depth, the
directory doubles first. Consecutive buckets (a key range) belong to one *owner* task. An owner chains all texts of equal hash
and compares them byte by byte, so neither hash collisions nor truncation can merge different texts.

The driver gets one number for each of about four times as many key prefixes as there are buckets (100 TB at the default
capacity: four million), from a table of distinct (hash, size) that is written once.

Hot texts: a task sends a text with copies once and later copies of it, compared with the one it sent, as its SHA-256. Only
rows that have copies are joined with their group, hot groups by broadcast.

Defined results: null text equals the empty text; a null doc_id is smaller than any other; rows that repeat a doc_id are rows
of their own, of which one at most is kept in a group; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, join_groups, rows_kept, utf8

#: Most leading bits that the directory is addressed by.
MAX_BITS = 26
#: Bytes of texts with copies that a sending task remembers.
REMEMBERED = 32 << 20


class Directory:
    """Buckets by leading hash bits. ``sizes`` holds the bytes under each prefix of ``bits`` bits."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.bits = len(sizes).bit_length() - 1
        self.capacity = capacity
        self._upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.depth = 0
        self.slots = np.zeros(1, dtype=np.int32)
        #: Of each bucket: its prefix, local depth and bytes.
        self.buckets: list[tuple[int, int, int]] = [(0, 0, int(self._upto[-1]))]
        full = [0] if self._full(0) else []
        while full:
            if any(self.buckets[b][1] == self.depth for b in full):
                self._double()
            full = [b for old in full for b in self._split(old) if self._full(b)]

    def _full(self, bucket: int) -> bool:
        _, depth, size = self.buckets[bucket]
        return size > self.capacity and depth < self.bits

    def _double(self) -> None:
        self.slots = np.repeat(self.slots, 2)
        self.depth += 1

    def _split(self, bucket: int) -> tuple[int, int]:
        prefix, depth, _ = self.buckets[bucket]
        new = len(self.buckets)
        halves = [(p, depth + 1, self._bytes(p, depth + 1)) for p in (2 * prefix, 2 * prefix + 1)]
        self.buckets[bucket] = halves[0]
        self.buckets.append(halves[1])
        span = 1 << (self.depth - depth - 1)
        self.slots[(2 * prefix + 1) * span : (2 * prefix + 2) * span] = new
        return bucket, new

    def _bytes(self, prefix: int, depth: int) -> int:
        span = 1 << (self.bits - depth)
        return int(self._upto[(prefix + 1) * span] - self._upto[prefix * span])

    def in_order(self) -> list[tuple[int, int, int]]:
        """The buckets by key."""
        first = np.concatenate([[True], self.slots[1:] != self.slots[:-1]])
        return [self.buckets[b] for b in self.slots[first].tolist()]


def owners(buckets: list[tuple[int, int, int]], capacity: int, least: int) -> list[int]:
    """Starts of the owners' key ranges (unsigned 64-bit): consecutive buckets up to ``capacity`` or a ``least``-th part of all."""
    total = sum(n for _, _, n in buckets)
    room = max(1, min(capacity, -(-total // max(1, least))))
    starts, filled = [0], 0
    for prefix, depth, n in buckets:
        if filled and filled + n > room:
            starts.append(prefix << (64 - depth))
            filled = 0
        filled += n
    return starts


def _local_chains(starts: list[int], remembered: int = REMEMBERED):
    edges = np.array(starts, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, str], bytes] = {}
        room = remembered
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, keys, shas = (batch.column(i).to_pylist() for i in (0, 1, 2))
            texts = utf8(batch.column(3))
            chains: dict[int, list[int]] = {}
            members: dict[int, list[int]] = {}
            for i, key in enumerate(keys):
                chain = chains.setdefault(key, [])
                first = next((j for j in chain if texts[j] == texts[i]), None)
                if first is None:
                    chain.append(i)
                    members[i] = [ids[i]]
                else:
                    members[first].append(ids[i])
            firsts = list(members)
            bodies = []
            for i in firsts:
                name = (keys[i], shas[i])
                known = sent.get(name) == texts[i]
                bodies.append(None if known else texts[i])
                if not known and len(members[i]) > 1 and len(texts[i]) <= room:
                    sent[name] = texts[i]
                    room -= len(texts[i])
            owner = np.searchsorted(edges, np.array([keys[i] for i in firsts], dtype=np.int64).view(np.uint64), side="right") - 1
            for at in range(0, len(firsts), 1024):
                part = firsts[at : at + 1024]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[at : at + 1024], pa.int32()), pa.array([keys[i] for i in part], pa.int64()), pa.array([shas[i] for i in part], pa.string()), pa.array(bodies[at : at + 1024], pa.binary()), pa.array([members[i] for i in part], pa.list_(pa.int64()))],
                    names=["owner", "key", "sha", "body", "members"],
                )

    return run


def _larger(a: int | None, b: int | None) -> bool:
    return a is not None and (b is None or a > b)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of an owner's keys, a group for each different text. A group's rows are passed on as they come, but for those
    of the largest id so far; these come last, with the totals."""
    groups: dict[tuple[int, str], list[list]] = {}  # [text, largest id, its rows, all rows], in a chain of different texts
    names = ["key", "sha", "no", "members", "keep_id", "group_size"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        keys, shas, bodies, members = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
        rows = []
        for key, sha, body, ids in zip(keys, shas, bodies, members, strict=True):
            chain = groups.setdefault((key, sha), [])
            # rows without a body were compared with one of this SHA-256, which may come later
            no = 0 if body is None else next((i for i, g in enumerate(chain) if g[0] is None or g[0] == body), len(chain))
            if no == len(chain):
                chain.append([body, None, 0, 0])
            group = chain[no]
            group[0] = body if group[0] is None else group[0]
            group[3] += len(ids)
            passed = []
            for i in ids:
                if group[2] and i == group[1]:
                    group[2] += 1
                elif not group[2] or _larger(i, group[1]):
                    passed += [group[1]] * group[2]
                    group[1], group[2] = i, 1
                else:
                    passed.append(i)
            if passed:
                rows.append((key, sha, no, passed, None, None))
        if rows:
            yield table(rows)
    # the totals: the members are the kept id, once for each of its rows
    totals = ((key, sha, no, [keep] * n, keep, rows) for (key, sha), chain in groups.items() for no, (_, keep, n, rows) in enumerate(chain))
    part = []
    for row in totals:
        part.append(row)
        if len(part) == 10_000:
            yield table(part)
            part = []
    if part:
        yield table(part)


def _index(docs: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """(key, sha, no, members, keep_id, group_size): a row for each group with the rows of its kept id, and rows without
    keep_id and group_size for other members."""
    spark = docs.sparkSession
    space = Workspace(spark, "exact_dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = space.keep(docs.select(F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("size")).distinct(), "sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    bits = min(MAX_BITS, max(4, (4 * total // capacity).bit_length()))
    found = sized.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("prefix")).agg(F.sum("size").alias("size")).toArrow()
    sizes = np.zeros(1 << bits, dtype=np.int64)
    sizes[found.column(0).to_numpy()] = found.column(1).to_numpy()
    starts = owners(Directory(sizes, capacity).in_order(), capacity, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    sent = entries.mapInArrow(_local_chains(starts), "owner int, key long, sha string, body binary, members array<long>")
    return space.keep(sent.repartitionById(len(starts), F.col("owner")).mapInArrow(_compare, "key long, sha string, no int, members array<long>, keep_id long, group_size long"), "index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 128 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest id of equal texts), group_size, kept, text_sha256.

    capacity: bytes of text that a bucket, and so an owner task, holds at most (one text's copies count once there).
    """
    index = _index(docs, id_col, text_col, capacity)
    totals = index.where(F.col("group_size").isNotNull())
    kept = totals.select(F.posexplode("members").alias("nth", "doc_id"), "keep_id", "group_size", "sha").select("doc_id", "keep_id", "group_size", (F.col("nth") == 0).alias("kept"), F.col("sha").alias("text_sha256"))

    others = index.where(F.col("group_size").isNull()).select("key", "sha", "no", "members")
    groups = totals.where(F.col("group_size") > F.size("members")).select("key", "sha", "no", "keep_id", "group_size")
    total = totals.agg(F.sum("group_size")).first()[0] or 0
    found = join_groups(others, groups, ["key", "sha", "no"], "group_size", total)
    return kept.union(found.select(F.explode("members").alias("doc_id"), "keep_id", "group_size", F.lit(False).alias("kept"), F.col("sha").alias("text_sha256")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 128 << 20) -> DataFrame:
    """Of equal texts the row with the largest id, with all columns; of rows alike in id and text, one."""
    totals = _index(docs, id_col, text_col, capacity).where(F.col("group_size").isNotNull())
    return rows_kept(docs, totals.select("keep_id", "key", F.size("members").alias("rows")), id_col, text_col)
