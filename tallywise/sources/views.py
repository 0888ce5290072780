"""Views over the test tables, each reading only the columns and tables a query asks for."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.functions.scalars import month_start


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_FROM_ORDERS = {"cardholder", "description", "ym", "txn_ts", "agency_number", "agency_name"}
_FROM_CUSTOMER = {"agency_number", "agency_name"}


def txn(spark: SparkSession, sf_dir: str, columns: Iterable[str]) -> DataFrame:
    """Card-like transactions: one row per line item, refunds with a negative amount.

    Only the tables behind the wanted columns are joined; every line item has its order and part.
    """
    wanted = list(columns)
    need = set(wanted)
    df = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    made = {
        "orderkey": F.col("l_orderkey"), "linenumber": F.col("l_linenumber"), "partkey": F.col("l_partkey"),
        "vendor": F.col("l_suppkey"), "posted_ts": F.col("l_shipdate"),
        "amount": F.when(F.col("l_returnflag") == "R", -price).otherwise(price),
        "cardholder": F.col("o_custkey"), "description": F.col("o_orderpriority"),
        "txn_ts": F.col("o_orderdate"), "ym": month_start(F.col("o_orderdate")),
        "agency_number": F.col("c_nationkey"), "agency_name": F.col("n_name"), "mcc": F.col("p_type"),
    }
    if need & _FROM_ORDERS:
        orders = table(spark, sf_dir, "orders")
        if need & _FROM_CUSTOMER:
            customer = table(spark, sf_dir, "customer")
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            nation = table(spark, sf_dir, "nation")
            orders = orders.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "mcc" in need:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return df.select(*[made[c].alias(c) for c in wanted])


# A row of ``txn`` is identified by these columns.
TXN_KEY = ("orderkey", "linenumber", "partkey", "vendor", "amount")


#: Line items of a part of the loans, or so.
LOAN_ROWS = 10_000_000


def loan_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The rows of ``loans`` in parts by order, so that joins need the disk of one part alone where they are run in turn."""
    n = 1 + table(spark, sf_dir, "lineitem").count() // LOAN_ROWS
    return [loans(spark, sf_dir, (k, n)) for k in range(n)]


def loans(spark: SparkSession, sf_dir: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Loan-like rows: four numbers, four categories (with gaps made by rule) and a 0/1 label; those of a ``part`` of so many."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    if part[1] > 1:
        own = lambda key: F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(part[1])) == part[0]
        li, orders = li.where(own("l_orderkey")), orders.where(own("o_orderkey"))
    part = table(spark, sf_dir, "part")
    customer = table(spark, sf_dir, "customer")
    # Orders meet their customers by themselves, so that the line items are shuffled for two joins, not three.
    rows = (
        li.join(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("row_id"),
        F.when(F.col("l_quantity") % 10 != 0, F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"),
        F.col("p_retailprice").alias("retail"),
        F.when(F.col("l_linenumber") != 7, F.col("p_type")).alias("kind"),
        F.col("p_brand").alias("brand"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("p_size") % 9 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


LOAN_NUMBERS = ("quantity", "price", "discount", "retail")
LOAN_CATEGORIES = ("kind", "brand", "priority", "segment")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: 0/1 outcome, score and row id."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("actual"),
        F.col("value").alias("pred"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a rating of 1 to 5."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 5 + 1).cast("int").alias("score"), "text")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with their tags as a list literal, as a file would hold them."""
    tags = F.concat(F.lit("['"), "lang", F.lit("','"), "source", F.lit("']"))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", tags.alias("tags"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel-like rows: one image per supplier, colours from the figures of its line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("image_id"),
        F.col("l_partkey").cast("int").alias("x"), F.col("l_orderkey").cast("int").alias("y"),
        (F.round(F.col("l_quantity")).cast("int") % 5 * 50).alias("r"),
        (F.round(F.col("l_discount") * 100).cast("int") * 20).alias("g"),
        (F.round(F.col("l_tax") * 100).cast("int") * 30).alias("b"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection cells: one frame per supplier; position, score and box distances from line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").alias("frame_id"),
        F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 80).cast("int").alias("col"),
    ).agg(
        F.max(F.col("l_discount") * 10).alias("score"),
        F.max(F.col("l_quantity") / 4).alias("d0"), F.max(F.col("l_quantity") / 2).alias("d1"),
        F.max(F.col("l_tax") * 100 + 2).alias("d2"), F.max(F.col("l_tax") * 200 + 3).alias("d3"),
        F.max(F.col("l_tax") * 2).alias("angle"),
    )


def cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut points ``hh:mm:ss``: one timeline per customer, a cut every so many seconds per order."""
    orders = table(spark, sf_dir, "orders")
    seconds = F.col("o_orderkey") % 43200 + 1
    part = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    text = F.concat_ws(":", part(F.floor(seconds / 3600)), part(F.floor(seconds % 3600 / 60)), part(seconds % 60))
    return orders.select(
        F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit("1:2")).otherwise(text).alias("cut"),
        F.lit(43200.0).alias("duration"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on a grid of half degrees, one per customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("place_id"),
        (F.col("c_custkey") * 7 % 400 / 2.0).cast("double").alias("lon"),
        (F.col("c_custkey") * 13 % 120 / 2.0).cast("double").alias("lat"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned regions, one per nation, some of them overlapping."""
    n = table(spark, sf_dir, "nation")
    x0 = (F.col("n_nationkey") * 7).cast("double")
    y0 = (F.col("n_nationkey") % 5 * 10).cast("double")
    corner = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(12.0, 0.0), corner(12.0, 15.0), corner(0.0, 15.0), corner(0.0, 0.0))
    return n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"), F.array(ring).alias("rings"))
