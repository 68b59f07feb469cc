"""Sources and sinks.

The reference keys its split files by name (``X_test_200rec_sub1act4v3.csv``)
and loops over them; here one scan reads the whole family and the keys come
from the file path, and writes are partitioned by the same keys so a later
scan prunes partitions instead of opening files.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay_spark.functions import arrays as A

# Fixed file-name convention of the split files (kind, rec, sub, act, version):
# {X|y}_{train|test}_{rec}rec_sub{sub}act{act}v{version}.csv
# (a folder of that name, as Spark writes it, counts like a file)
CELL_NAME_PATTERN = r"([Xy])_(train|test)_([0-9]+)rec_sub([0-9]+)act([0-9]+)v([0-9]+)\.csv(?:/[^/]*)?$"


def read_wide(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              id_col: str | None = None) -> DataFrame:
    """Headered CSV with a declared schema (no inference pass).  With
    ``id_col`` missing from the file, a unique row id is added with
    ``monotonically_increasing_id`` (its values depend on how the files are
    split into tasks; write the table out once if ids must persist)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    if id_col and id_col not in df.columns:
        df = df.withColumn(id_col, F.monotonically_increasing_id())
    return df


def read_cells(spark: SparkSession, glob: str, schema: T.StructType | str | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """One scan over a family of split files; kind, split, rec, sub,
    act, version parsed from the file path.  ``columns`` prunes the scan."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(glob)
    path = F.col("_metadata.file_path")
    keys = {"kind": (1, "string"), "split": (2, "string"), "rec": (3, "int"), "sub": (4, "int"),
            "act": (5, "int"), "version": (6, "int")}
    cols = list(columns) if columns else [c for c in df.columns]
    return df.select(*cols, *[F.regexp_extract(path, CELL_NAME_PATTERN, g).cast(t).alias(k)
                              for k, (g, t) in keys.items()])


def read_matrix(spark: SparkSession, glob: str, sample_col: str = "sample", out: str = "x") -> DataFrame:
    """Headerless readout x sample matrix -> one vector per sample.

    Each line must start with its readout number (``write_matrix`` writes
    it), because line order is not kept by a distributed scan.  Line =
    ``readout,v_sample0,v_sample1,...``, or ``readout:start,v,...`` for a tile
    whose first value is that of sample ``start``.  An empty field is a null.
    """
    lines = spark.read.text(glob).filter(F.length(F.trim("value")) > 0)
    key = F.split(F.col("_p")[0], ":")
    e = lines.select(F.split(F.col("value"), ",").alias("_p")).select(
        key[0].cast("int").alias("_r"), F.coalesce(F.get(key, F.lit(1)).cast("long"), F.lit(0).cast("long")).alias("_o"),
        A.entries(F.slice("_p", 2, 1 << 30), "_s", "_v"))
    value = F.when(F.trim("_v") != "", F.col("_v").cast("double"))
    g = e.groupBy((F.col("_o") + F.col("_s")).alias("_s")).agg(F.sort_array(F.collect_list(F.struct("_r", value.alias("_v")))).alias("_l"))
    return g.select(F.col("_s").cast("long").alias(sample_col), F.transform("_l", lambda s: s["_v"]).alias(out))


def cell_name(kind: str, split, rec, sub, act, version) -> "F.Column":
    """The fixed file name of a cell, from its key columns."""
    return F.concat(F.lit(f"{kind}_"), split, F.lit("_"), rec.cast("string"), F.lit("rec_sub"), sub.cast("string"),
                    F.lit("act"), act.cast("string"), F.lit("v"), version.cast("string"), F.lit(".csv"))


def write_cell_files(df: DataFrame, path: str, name: str = "cell", mode: str = "overwrite") -> None:
    """S5 as CSV: one folder per cell name (column ``name``) below ``path``, in one
    job; ``read_cells(spark, path + "/*")`` reads the family back."""
    df.write.mode(mode).partitionBy(name).option("header", True).csv(path)


def write_cells(df: DataFrame, path: str, keys: Sequence[str] = ("act", "rec", "sub", "version"),
                fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Keyed tables, partitioned by the cell keys."""
    w = df.write.mode(mode).partitionBy(*keys)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite", keys: Sequence[str] = ()) -> None:
    """Vectors as Parquet ``array<double>`` (embeddings, outcomes, predictions)."""
    w = df.write.mode(mode)
    if keys:
        w = w.partitionBy(*keys)
    w.parquet(path)


def write_matrix(df: DataFrame, path: str, sample_col: str, vec: str, tile: int | None = None) -> None:
    """S6 as text: readout-major lines ``readout:start,v0,v1,...`` of at most
    ``tile`` samples each, samples ordered by id, nulls as empty fields;
    ``read_matrix`` reads them back."""
    from assay_spark.operators.reshape import TILE, transpose_tiles

    t = transpose_tiles(df, sample_col, vec, tile or TILE, "_r", "_o", "_v")
    values = F.array_join(F.transform("_v", lambda v: v.cast("string")), ",", "")
    t.select(F.concat(F.col("_r").cast("string"), F.lit(":"), F.col("_o").cast("string"), F.lit(","), values)).write.mode("overwrite").text(path)


def from_scores(spark: SparkSession, scores: dict, source: str | None = None) -> DataFrame:
    """A nested literal dict metric -> model -> list of scores as a one-row
    MapType table (then ``reshape.scores_long``)."""
    schema = "source string, scores map<string, map<string, array<double>>>"
    return spark.createDataFrame([(source, {m: {k: [float(x) for x in v] for k, v in d.items()}
                                            for m, d in scores.items()})], schema)
