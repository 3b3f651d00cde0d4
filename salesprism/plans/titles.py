"""The ``titles`` view: a sales fact derived from order lines, one row per part and order year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.operators.cleaning import engineer_features

AS_OF_YEAR = 2002

# Brand number -> platform code, and part type -> genre. LARGE has no known genre label.
PLATFORM_OF_BRAND = (
    "PS4", "PS3", "PS2", "PS", "PSP", "NS", "Wii", "DS", "3DS", "GBA", "SNES", "XOne", "X360",
    "XB", "PC", "Linux", "OSX", "iOS", "And", "GEN", "DC", "2600", "PCE", "Arc", "Amig",
)
GENRE_OF_TYPE = {
    "ECONOMY": "Action",
    "LARGE": "Unlisted",
    "MEDIUM": "Sports",
    "PROMO": "Shooter",
    "SMALL": "Puzzle",
    "STANDARD": "Role-Playing",
}
UNIT_PRICE = 20000
# Amounts are exact to four digits; the type holds any amount an order line can have.
LINE_TYPE = "decimal(18,4)"
LINES_A_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(lines: DataFrame, orders: DataFrame, most: int = LINES_A_TASK) -> tuple[DataFrame, DataFrame]:
    """Lines and orders dealt by order, about ``most`` lines a task; as they are while each core has no more.

    What a task of the join sorts and sums is then bounded whatever the size of the table.
    """
    tasks = -(-lines.count() // most)
    if tasks <= lines.sparkSession.sparkContext.defaultParallelism:
        return lines, orders
    return lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")


def sold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with year, region and amount; dimension joins stay on the order side."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    buyers = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "r_name")
    )
    orders = (
        table(spark, sf_dir, "orders")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "o_orderdate", "r_name")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    lines, orders = dealt(lines, orders)
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_partkey").alias("title_id"),
            F.year("o_orderdate").alias("Year"),
            "o_orderdate",
            "r_name",
            "l_suppkey",
            "l_quantity",
            (F.col("l_extendedprice") * (1 - F.col("l_discount")) / UNIT_PRICE).cast(LINE_TYPE).alias("amount"),
        )
    )


def base_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales, scores and dates per part and year. Parts are joined after the aggregation."""
    in_region = {
        "NA_Sales": F.col("r_name") == "AMERICA",
        "EU_Sales": F.col("r_name") == "EUROPE",
        "JP_Sales": F.col("r_name") == "ASIA",
        "Other_Sales": F.col("r_name").isin("AFRICA", "MIDDLE EAST"),
    }
    facts = (
        sold_lines(spark, sf_dir)
        .groupBy("title_id", "Year")
        .agg(
            *[
                F.coalesce(F.sum(F.when(cond, F.col("amount"))).cast("double"), F.lit(0.0)).alias(name)
                for name, cond in in_region.items()
            ],
            F.sum("amount").cast("double").alias("Global_Sales"),
            (F.sum(F.col("l_quantity").cast("bigint")).cast("double") / F.count("*") / 5).alias("_user"),
            F.min("l_suppkey").alias("_publisher"),
            F.min("o_orderdate").cast("date").alias("Release_Date"),
        )
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    brand = F.substring("p_brand", 7, 4).cast("int")
    platforms = F.array(*[F.lit(p) for p in PLATFORM_OF_BRAND])
    genre = F.lit(None).cast("string")
    for kind, name in GENRE_OF_TYPE.items():
        genre = F.when(F.col("p_type") == kind, name).otherwise(genre)
    return facts.join(part, F.col("title_id") == F.col("p_partkey")).select(
        (F.col("title_id") * 10000 + F.col("Year")).alias(schema.INGEST_ID),
        "title_id",
        F.col("p_name").alias("Name"),
        F.element_at(platforms, brand).alias("Platform"),
        "Year",
        genre.alias("Genre"),
        F.concat(F.lit("Publisher "), F.col("_publisher").cast("string")).alias("Publisher"),
        *schema.REGIONS,
        "Global_Sales",
        F.when(F.col("title_id") % 3 != 0, F.col("p_size").cast("double") / 5).alias("Critic_Score"),
        F.when(F.col("title_id") % 5 != 0, F.col("_user")).alias("User_Score"),
        "Release_Date",
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base view with family, labels, shares, tiers and score features.

    Nothing is cached: a query reads and computes only the columns it asks for, and what a fit
    reads several times is checkpointed there.
    """
    from salesprism.operators.lookup import map_or

    base = base_titles(spark, sf_dir)
    base = map_or(base, "Platform", schema.PLATFORM_FAMILIES, "Platform_Family", F.lit(schema.UNKNOWN_FAMILY))
    return engineer_features(base, AS_OF_YEAR, genre_labels={})
