"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay_spark.session import checkpoint_dir

#: Rows of text handled at once inside a task; bounds what Python holds.
SLICE_ROWS = 200
#: Entries a worker's word cache may hold before it starts anew.
CACHE_ENTRIES = 1_500_000
#: Power of two that bounds the bits of a membership filter (8 MB).
FILTER_BITS = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and reread it.

    Cuts the lineage so that a lost executor costs at most one stage, and lets
    several readers share one computation.  Every call has its own folder.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove the files of staged tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def membership_filter(keys: DataFrame, col: str) -> np.ndarray:
    """Bits that tell which hashes may be among ``keys`` (a bigint column of hashes): a Bloom filter.

    It has some 16 bits a key, ``FILTER_BITS`` at most, so its size is bounded
    however many keys there are; with more keys it lets more of the others pass.
    """
    n = keys.count()
    bits = 1 << min(FILTER_BITS, max(12, (16 * n).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned(col, k).bitwiseAND(F.lit(bits - 1)) for k in (0, 31)]))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return out


def may_hold(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False where a hash is surely not among the filter's keys."""
    h, ok = hashes.astype(np.int64).view(np.uint64), np.ones(len(hashes), bool)
    for k in (0, 31):
        at = (h >> np.uint64(k)) & np.uint64(len(filter_) * 64 - 1)
        ok &= (filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def worker_cache(key: str, make):
    """A value kept by a Python worker from task to task, until it needs another one.

    A job of several operators thus holds one operator's cache at a time.  The
    value belongs to the module and name of ``make``, so operators that choose
    the same key keep apart; a held value whose class ``make`` does not give is
    an error.
    """
    holder = sys.modules.get("_assay_llm_worker")
    if holder is None:
        holder = sys.modules["_assay_llm_worker"] = types.ModuleType("_assay_llm_worker")
        holder.values = {}
    owner = (make.__module__, make.__qualname__, key)
    if owner not in holder.values:
        holder.values.clear()
        holder.values[owner] = make()
    held = holder.values[owner]
    if isinstance(make, type) and type(held) is not make:
        raise TypeError(f"cache {owner} holds a {type(held)}")
    return held


def text_slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = SLICE_ROWS,
                chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into slices bounded by rows and characters.

    Yields the slice and its texts, null as ''.
    """
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        start = 0
        while start < b.num_rows:
            out, size = [], 0
            while start + len(out) < b.num_rows and len(out) < rows and size < chars:
                t = col[start + len(out)].as_py() or ""
                out.append(t)
                size += len(t)
            yield b.slice(start, len(out)), out
            start += len(out)
