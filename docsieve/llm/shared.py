"""Tables that several jobs of one operator read, kept where every executor sees them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one serves a local session (tests); a
    cluster has no folder that all its machines share unless it is named, so there it must be."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docsieve-"))
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


class Workspace:
    """A folder of intermediate tables. A written table cuts lineage and survives the loss of executors.

    Results are lazy and read these tables, so the folder goes when the session's JVM ends, or before by ``release`` once
    whatever reads it has been written.
    """

    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
        self._files(self.root)[0].deleteOnExit(self._files(self.root)[1])
        Workspace.opened.append(self)

    def _files(self, where: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` and read it back."""
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        """Remove a table that no later job reads."""
        files, path = self._files(self.path(table))
        files.delete(path, True)

    @classmethod
    def release(cls, spare: tuple[Workspace, ...] = ()) -> None:
        """Remove the folders of all workspaces but ``spare``; nothing that is still to be computed may read them."""
        for space in cls.opened:
            if space not in spare:
                files, path = space._files(space.root)
                files.delete(path, True)
        cls.opened[:] = spare


#: Groups of over a HOT-th part of all rows are few (at most HOT) and joined by broadcast, so that none meets in one task.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, written: bool = False) -> DataFrame:
    """``rows`` joined with the one row of ``groups`` that has their ``on``; ``size`` of these tells how many rows of the
    ``total`` have it. Of ``written`` groups it is looked up first whether any is hot, which spares the plan two joins."""
    if written and groups.where(F.col(size) > total / HOT).isEmpty():
        return rows.join(groups, on)
    hot = F.broadcast(groups.where(F.col(size) > total / HOT))
    some, rest = rows.join(hot, on), rows.join(hot.select(*on), on, "left_anti").join(groups.where(F.col(size) <= total / HOT), on)
    return some.union(rest.select(*some.columns))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text) -> F.Column:
    """With the id, what tells rows apart: a hash of the text, null as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def rows_kept(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``kept`` lists as (id, text_key, rows), nulls included; rows is how many rows there are of
    that id and text, of which one stays.

    To tell those apart takes a sort of the texts, so it is only planned where there are any.
    """
    kept = Workspace(docs.sparkSession, "kept").keep(kept.toDF("id", "key", "rows"), "rows")
    # hashing the ids of a partition spares a sort of its texts
    same = docs[id_col].cast("long").eqNullSafe(kept["id"]) & (text_key(docs[text_col]) == kept["key"])
    found = docs.join(kept.hint("shuffle_hash"), same, "left_semi")
    if kept.where(F.col("rows") > 1).isEmpty():
        return found
    key = free_name(docs, "text_key")
    return found.withColumn(key, text_key(F.col(text_col))).dropDuplicates([id_col, key]).drop(key)


def hash_share(hashed, wanted: int, total: int) -> F.Column:
    """Whether a 64-bit hash is among the smallest, so that about ``wanted`` of ``total`` rows are; all, if there are fewer."""
    bits = 62
    limit = 1 << bits if wanted >= total else (wanted << bits) // total
    return F.shiftrightunsigned(hashed, 64 - bits) < F.lit(limit)


def utf8(column, empty: bytes = b"") -> list[bytes]:
    """The values of an Arrow string column as UTF-8 bytes, nulls as ``empty``."""
    import pyarrow as pa

    return [empty if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def worker_cache(name: str) -> dict:
    """A dictionary that lasts as long as the Python process. It may only hold what can be computed again."""
    import sys
    import types

    held = sys.modules.setdefault("_docsieve_worker_cache", types.ModuleType("_docsieve_worker_cache"))
    return held.__dict__.setdefault(name, {})
