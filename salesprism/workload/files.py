"""Queries that write the titles to files and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism import jobs, schema
from salesprism.operators import market
from salesprism.plans.raw_listing import raw_listing
from salesprism.session import ensure_checkpoint_dir
from salesprism.sources import files
from salesprism.workload.cleaning import AS_OF, named, on_raw
from salesprism.workload.registry import features, on_titles, query, total

COLUMNS = ("ingest_id", "Name", "Platform", "Year", "Global_Sales", "Critic_Score", "Release_Date")
SQL = 'SELECT ingest_id, "Name", "Platform", "Year", "Global_Sales", round("Critic_Score", 6) AS "Critic_Score", CAST("Release_Date" AS VARCHAR) AS "Release_Date"'


def new_folder(df: DataFrame, name: str) -> str:
    """A new folder where the cluster's executors share files."""
    ensure_checkpoint_dir(df.sparkSession)
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@on_titles("titles_through_csv", SQL + " FROM titles")
def _(t):
    path, rows = new_folder(t, "titles-csv"), t.select(*COLUMNS)
    files.write_csv(rows, path)
    back = files.first_found([
        lambda p=p: files.read_csv(t.sparkSession, p, rows.schema) for p in (path + "-absent", path)
    ])
    return back.select(*COLUMNS)


@on_titles("titles_through_parquet", SQL + ', "Decade" FROM titles')
def _(t):
    path = new_folder(t, "titles-parquet")
    files.write_parquet(t.select(*COLUMNS, "Decade"), path)
    return t.sparkSession.read.parquet(path).select(*COLUMNS, "Decade")


@query("raw_listing_through_csv", on_raw(f"SELECT {named(schema.RAW_COLUMNS)} FROM raw"))
def _(spark, sf_dir):
    """The raw table written as CSV text and found behind a path that does not exist."""
    raw = raw_listing(spark, sf_dir).select(*schema.RAW_COLUMNS)
    path = new_folder(raw, "raw-csv")
    files.write_csv(raw, path)
    return files.raw_listing(spark, [path + "-absent", path]).select(*schema.RAW_COLUMNS)


# What the models add is not in SQL; the other columns of the clean table are.
MODELLED = ("Is_Outlier", "Outlier_Score", "PCA_Region_1", "PCA_Region_2", "Regional_Cluster", "Regional_Cluster_Label")
CHECKED = ("Rank", "Name", "Platform", "Platform_Family", "Year", "Publisher", "Developer", "Global_Sales", "Release_Date", "Last_Update", "Canonical_Name")
SQL_OF = {"Global_Sales": 'round("Global_Sales", 6)', "Release_Date": 'CAST("Release_Date" AS VARCHAR)', "Last_Update": 'CAST("Last_Update" AS VARCHAR)'}


@query(
    "clean_table_through_csv",
    on_raw(f", {features('kept', 'feats', 'coalesce(gl.label, s.Genre)', AS_OF)} SELECT "
           + ", ".join(f'{SQL_OF.get(c, c)} AS "{c}"' for c in CHECKED) + ", true AS scored FROM feats"),
)
def _(spark, sf_dir):
    """The clean job's 43 columns written as CSV and read by the contract of the clean table."""
    clean = jobs.clean_table(raw_listing(spark, sf_dir), AS_OF)
    path = new_folder(clean, "clean-csv")
    files.write_csv(clean, path)
    back = files.clean_table(spark, [path])
    scored = F.lit(True)
    for c in (*MODELLED, *schema.SCORES):
        scored = scored & F.col(c).isNotNull()
    return back.select(*CHECKED, scored.alias("scored"))


@on_titles(
    "genre_sales_through_json",
    f'SELECT "Genre", {total("Global_Sales")} AS sales FROM titles GROUP BY 1',
)
def _(t):
    path, sums = new_folder(t, "genre-json"), market.sales_by(t, ["Genre"])
    files.write_json(sums, path)
    return t.sparkSession.read.schema(sums.schema).json(path)


@on_titles("lookup_through_json", 'SELECT DISTINCT "Platform" AS code, "Platform_Family" AS family FROM titles')
def _(t):
    path = new_folder(t, "lookup-json")
    files.write_json(t.select(F.col("Platform").alias("code"), F.col("Platform_Family").alias("family")).distinct(), path)
    return files.read_lookup(t.sparkSession, path, "code", "family")
