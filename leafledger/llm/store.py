"""Shared working folders, written tables and key bitmaps of bounded size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BITS = 1 << 29
_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder that ``spark.checkpoint.dir`` names.

    Only where neither that setting nor a checkpoint folder exists and the session runs
    on this machine alone (tests) is a temporary folder of it taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafledger-"))
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/leafledger-{uuid.uuid4().hex}"
    _OWN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours through Spark's file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _OWN:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; nothing depends on this
            pass


def saved(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet and read it again: cuts lineage on shared storage."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """(pyarrow file system, path in it) for a URI or a plain path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def remove_unfinished(fs, root: str) -> None:
    """Delete what broken attempts left under temporary names, once a manifest is in place."""
    from pyarrow import fs as pafs

    for f in fs.get_file_info(pafs.FileSelector(root)):
        if f.base_name.startswith("_tmp-") and f.type == pafs.FileType.File:
            fs.delete_file(f.path)


def bits_for(n: int, each: int = 16) -> int:
    """Bits of a bitmap for ``n`` keys, at which at most 1 in ``each`` other keys passes; at most ``MOST_BITS`` (64 MB)."""
    return min(MOST_BITS, 1 << max(15, (each * n - 1).bit_length()))


def key_bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of 64-bit keys: bit ``key mod bits`` is set for each.

    The result has ``bits / 8`` bytes whatever the number of keys, so it can be sent
    everywhere; a set bit only means "perhaps", and users of it keep an exact join behind it.
    """
    bit = F.pmod(F.col(column), F.lit(bits))
    rows = (
        keys.select(bit.alias("bit"))
        .groupBy(F.floor(F.col("bit") / 32768).alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("map"))
        .collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(r["map"], np.uint8)
        out[r["bucket"] * 4096 : r["bucket"] * 4096 + len(part)] = part
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For int64 ``keys``: whether each one's bit is set."""
    bit = np.mod(keys, np.int64(len(bitmap) * 8))
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 != 0
