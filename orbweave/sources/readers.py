"""Readers of point and body files as DataFrames.

Ids are ordinals of the rows that survive, in the order of files by name and of lines within a file. A row is numbered
within its block of a file, and blocks begin where the counts of those before end, so no task sees more than a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A number as text; no suffixes of other languages, and neither infinities nor NaN, which are no places.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


#: The greatest finite value of a type.
MOST = {"float": 3.4028235e38, "double": 1.7976931348623157e308}


def number(text: Column, kind: str = "float") -> Column:
    """FLOAT, or DOUBLE if ``kind`` says so, or null for what isn't a finite number."""
    trimmed = F.trim(text)
    value = F.when(trimmed.rlike(NUMBER), trimmed.try_cast(kind))
    return F.when(F.abs(value) <= MOST[kind], value)


FILE, BLOCK = "__file", "__block"
_PLACE = (FILE, BLOCK)


def _placed(raw: DataFrame, *columns) -> DataFrame:
    """The columns of a scan, with the file and the block that a row is from."""
    return raw.select(*columns, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))


def with_ordinal(df: DataFrame, within: str | None = None, name: str = "id") -> DataFrame:
    """Rows of a placed scan with an ordinal from 0; ``within`` is a column of the row's number in its block, else it is found."""
    counts = df.groupBy(*_PLACE).agg(F.count("*").alias("n")).orderBy(*_PLACE).collect()  # a row per block of input
    starts, total = [], 0
    for r in counts:
        starts.append((r[FILE], r[BLOCK], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, f"{FILE} string, {BLOCK} long, start long")
    columns = [c for c in df.columns if c not in (*_PLACE, within)]
    if within is None:
        within = "__at"
        in_order = Window.partitionBy(*_PLACE).orderBy("__row")
        df = df.withColumn("__row", F.monotonically_increasing_id()).withColumn(within, F.row_number().over(in_order) - 1)
    return df.join(offsets, list(_PLACE)).select((F.col("start") + F.col(within)).alias(name), *columns)


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return _placed(spark.read.text(path), F.split("value", ",").alias("f"))


def _triple(f: Column, first: int = 0) -> list[Column]:
    return [number(F.get(f, F.lit(first + i))).alias(c) for i, c in enumerate("xyz")]


def points_csv(spark: SparkSession, path: str, limit: int | None = None, skip: int = 0) -> DataFrame:
    """Lines ``x,y,z``: fields are trimmed, further ones ignored, lines without three numbers (headers among them) dropped.

    ``skip`` leaves out leading fields; ``limit`` keeps that many rows.
    """
    rows = with_ordinal(_fields(spark, path).select(*_triple(F.col("f"), skip), *_PLACE).where("x is not null and y is not null and z is not null"))
    return rows if limit is None else rows.where(F.col("id") < limit)


def road_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an id and three coordinates."""
    return points_csv(spark, path, skip=1)


def points_csv_with_header(spark: SparkSession, path: str) -> DataFrame:
    """The first three columns of a file with a header."""
    raw = spark.read.csv(path, header=True)
    rows = _placed(raw, *(number(F.col(f"`{c}`")).alias(n) for c, n in zip(raw.columns[:3], "xyz")))
    return with_ordinal(rows.where("x is not null and y is not null and z is not null"))


def bodies_csv(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """Lines ``x,y,z,mass``: what isn't a number is 0, lines of fewer fields and masses that aren't positive are dropped; at rest.

    As "double" places keep all digits of their text: between bodies near each other a FLOAT's rounding changes the pull.
    """
    zero = F.lit(0.0).cast(kind)
    four = [F.coalesce(number(F.get("f", F.lit(i)), kind), zero).alias(c) for i, c in enumerate(("x", "y", "z", "mass"))]
    rows = _fields(spark, path).where(F.size("f") >= 4).select(*four, *_PLACE).where(F.col("mass") > 0)
    return with_ordinal(rows).select("*", *(zero.alias(c) for c in ("vx", "vy", "vz")))


def polylines_csv(spark: SparkSession, path: str, column: str = "POLYLINE", limit: int | None = None) -> DataFrame:
    """Points of ``[[lon, lat], …]`` in a column, on the plane z = 0; empty and malformed lines have none."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    rows = with_ordinal(polyline_points(_placed(raw, column), column).drop("line"))
    return rows if limit is None else rows.where(F.col("id") < limit)


def polyline_points(df: DataFrame, column: str) -> DataFrame:
    """(line, x, y, z): the points of each text of polylines; ``line`` is the text, other columns follow."""
    others = [c for c in df.columns if c != column]
    at = df.select(F.col(column).alias("line"), *others, F.explode(F.from_json(column, "array<array<double>>")).alias("p"))
    return at.where(F.size("p") >= 2).select("line", F.col("p")[0].cast("float").alias("x"), F.col("p")[1].cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"), *others).where("x is not null and y is not null")


def points_binary(spark: SparkSession, path: str) -> DataFrame:
    """Little-endian records of four 32-bit floats of which the last is dropped; bytes after the last full record are ignored."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                xyz = np.frombuffer(data, "<f4", len(data) // 16 * 4).reshape(-1, 4)
                for low in range(0, len(xyz), 1 << 17):
                    part = xyz[low : low + (1 << 17)]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(part[:, i])) for i in range(3)), pa.array(np.arange(low, low + n)), pa.array([name] * n, pa.string()), pa.array(np.zeros(n, np.int64))], ["x", "y", "z", "__at", *_PLACE])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return with_ordinal(files.mapInArrow(run, f"x float, y float, z float, __at long, {FILE} string, {BLOCK} long"), "__at")


def neighbour_dump(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id) of lines ``Q{i}:[id, id]``; queries without neighbours have no rows."""
    line = spark.read.text(path).select(F.regexp_extract("value", r"^Q(\d+):", 1).alias("q"), F.regexp_extract("value", r"\[([^\]]*)\]", 1).alias("ids")).where("q != ''")
    rows = line.select(F.col("q").cast("bigint").alias("qid"), F.posexplode(F.split("ids", ",")).alias("at", "id"))
    return rows.select("qid", (F.col("at") + 1).cast("bigint").alias("rank"), F.trim("id").try_cast("bigint").alias("id")).where("id is not null")
