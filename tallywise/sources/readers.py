"""Readers with fixed schemas, and the result sink."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywise.functions.scalars import month_from_yyyymm, parse_us_timestamp, to_number

CARD_COLUMNS = (
    "year_month", "agency_number", "agency_name", "last_name", "first_initial", "description",
    "amount", "vendor", "txn_date", "posted_date", "mcc",
)

REGION_SCHEMA = T.StructType([
    T.StructField("province", T.StringType()),
    T.StructField("population_2015", T.LongType()),
    *[T.StructField(c, T.IntegerType()) for c in (
        "area_km2", "population_density_per_km2", "cities_regencies", "cities", "regencies")],
])

POLYGON_SCHEMA = "name string, ord int, rings array<array<struct<x:double,y:double>>>"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",",
             **options: str) -> DataFrame:
    """Delimited text with a header line."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, enforceSchema=True, **options)


def read_padded_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ";",
                    missing: str = "-") -> DataFrame:
    """Delimited text with padded fields and a sign for missing values; a byte-order mark is skipped."""
    return read_csv(spark, path, schema, sep, ignoreLeadingWhiteSpace="true",
                    ignoreTrailingWhiteSpace="true", nullValue=missing)


def read_card_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The purchase-card file with dates parsed, month as first of month and amount as money."""
    raw = read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in CARD_COLUMNS]))
    return raw.select(
        month_from_yyyymm(F.col("year_month")).alias("ym"),
        to_number(F.col("agency_number"), "bigint").alias("agency_number"),
        "agency_name", "last_name", "first_initial", "description", "vendor", "mcc",
        to_number(F.col("amount"), "decimal(18,2)").alias("amount"),
        parse_us_timestamp(F.col("txn_date")).alias("txn_ts"),
        parse_us_timestamp(F.col("posted_date")).alias("posted_ts"),
    )


def read_without_row_index(spark: SparkSession, path: str, schema: str | T.StructType,
                           line_breaks_in_fields: bool = False) -> DataFrame:
    """Delimited text whose first column is a stored row index, dropped here.

    With ``line_breaks_in_fields`` a file can't be split and is one task.
    """
    df = read_csv(spark, path, schema, quote='"', escape='"', multiLine=str(line_breaks_in_fields).lower())
    return df.drop(df.columns[0])


def read_glossary(spark: SparkSession, path: str, skip: int = 3, columns: Sequence[str] = ("Var", "description")) -> DataFrame:
    """Two columns of a glossary whose header follows ``skip`` other lines.

    A glossary names the columns of a table, so its lines are few; the header is read first, the other lines
    are parsed with its columns, quoted fields included. A record is one line.
    """
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    first = lines.select(F.get("lines", F.lit(skip)).alias("h")).first()
    header = [c.strip() for c in next(csv.reader([first["h"] if first and first["h"] else ""]))]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    body = lines.select(F.explode(F.slice("lines", skip + 2, F.size("lines"))).alias("line"))
    cells = body.where(F.length(F.trim("line")) > 0).select(
        F.from_csv("line", schema.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": '"'}).alias("r"))
    return cells.select(*[F.trim(F.col(f"r.c{header.index(c)}")).alias(c) for c in columns])


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per polygon: name, file order and rings of (x, y) points."""
    return spark.read.schema(POLYGON_SCHEMA).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed text lines."""
    return spark.read.text(path).select(F.trim("value").alias("line"))


def read_image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels ``(image_id, x, y, r, g, b)`` of an image folder, one row each.

    Spark's image source keeps one image per row as BGR bytes; pixels are cut from the bytes by
    row of the image, so that a large image is spread over many rows before it is unfolded.
    """
    image = spark.read.format("image").load(path).select("image.*")
    line = F.explode(F.sequence(F.lit(0), F.col("height") - 1))
    step = F.col("width") * F.col("nChannels")
    lines = image.select(
        F.col("origin").alias("image_id"), "width", "nChannels", line.alias("y"), "data",
    ).select(
        "image_id", "width", "nChannels", "y",
        F.substring(F.col("data"), F.col("y") * step + 1, step).alias("bytes"),
    )
    pixels = lines.select(
        "image_id", "nChannels", "y", "bytes",
        F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"),
    )

    def channel(offset: int):
        # Grey images have one channel for all three colours.
        at = F.when(F.col("nChannels") == 1, F.lit(0)).otherwise(F.lit(offset))
        # A slice of binary takes the same time wherever it is, one of text does not.
        byte = F.substring(F.col("bytes"), F.col("x") * F.col("nChannels") + at + 1, F.lit(1))
        return F.conv(F.hex(byte), 16, 10).cast("int")

    return pixels.select("image_id", "x", "y", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def rename_by_lookup(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed where the glossary knows them."""
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def write_result(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
