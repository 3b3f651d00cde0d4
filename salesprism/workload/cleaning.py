"""The cleaning steps on raw listing text, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.functions import text
from salesprism.functions.sales import safe_ratio, sales_or_shipped
from salesprism.operators import cleaning
from salesprism.operators.lookup import lookup_table
from salesprism.plans.raw_listing import SELECT, raw_listing
from salesprism.workload.registry import BASE, LOOKUPS, features, query, quoted, values

AS_OF = 2003
R = schema.REGIONS


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = cleaning.trim_column_names(raw_listing(spark, sf_dir))
    text_ready = cleaning.trim_text(cleaning.null_missing_cells(raw))
    return cleaning.settled(cleaning.coerce_numbers(cleaning.parse_dates_and_year(text_ready, AS_OF)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.label_rejections(cleaning.fill_sales(typed(spark, sf_dir)), AS_OF)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.keep_first(cleaning.accepted(labelled(spark, sf_dir)))


MARKERS = ", ".join(quoted(m) for m in dict.fromkeys((*text.CELL_MARKERS, *text.READER_MARKERS)))
TRIMMED = ", ".join(quoted(m) for m in text.TRIMMED_MARKERS)
NUMBERS = ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in (*R, "Global_Sales", "Total_Shipped", *schema.SCORES))
# Two-digit years first: the four-digit form would read 95 as the year 95.
FORMATS = "['%d %b %y', '%d %b %Y', '%d %B %y', '%d %B %Y', '%Y-%m-%d', '%d-%b-%Y', '%b %d %Y']"


def _cell(column: str) -> str:
    kept_cell = f"CASE WHEN {column} NOT IN ({MARKERS}) THEN {column} END"
    if column not in schema.TEXT_COLUMNS:
        return f"{kept_cell} AS {column}"
    return f"CASE WHEN trim({kept_cell}) NOT IN ({TRIMMED}) THEN trim({kept_cell}) END AS {column}"


def _date(column: str) -> str:
    bare = f"replace(regexp_replace({column}, '(\\d{{1,2}})(st|nd|rd|th)', '\\1', 'gi'), ',', '')"
    return f"CAST(try_strptime({bare}, {FORMATS}) AS DATE) AS {column}"


RAW = f"""{LOOKUPS}, {BASE},
raw AS ({SELECT.replace("`", '"')} base),
cells AS (SELECT ingest_id, {", ".join(_cell(c) for c in schema.RAW_COLUMNS)} FROM raw),
dated AS (SELECT * REPLACE ({_date("Release_Date")}, {_date("Last_Update")}) FROM cells),
typed AS (SELECT * REPLACE (
    CAST(least(greatest(coalesce(TRY_CAST(Year AS DOUBLE), year(Release_Date), year(Last_Update)), 1970), {AS_OF}) AS INTEGER) AS Year,
    CAST(TRY_CAST(Rank AS DOUBLE) AS BIGINT) AS Rank, {NUMBERS}) FROM dated),
spaced AS (SELECT * REPLACE (regexp_replace(Platform, '\\s+', ' ', 'g') AS Platform,
    coalesce(nullif(Global_Sales, 0), nullif(Total_Shipped, 0), Global_Sales) AS Global_Sales,
    {", ".join(f"CASE WHEN {r} < 0 THEN 0 ELSE {r} END AS {r}" for r in R)}) FROM typed),
filled AS (SELECT s.* REPLACE (coalesce(s.Platform_Family, f.family, 'Other') AS Platform_Family,
    coalesce(Genre, '{schema.UNKNOWN_GENRE}') AS Genre),
    {" + ".join(f"coalesce({r}, 0)" for r in R)} AS "Regional_Sales_Sum"
    FROM spaced s LEFT JOIN families f ON f.platform = s.Platform),
labelled AS (SELECT *, CASE WHEN Year IS NULL THEN 'no_year' WHEN lower(Platform) = 'series' THEN 'aggregate_row'
    WHEN Name IS NULL OR Platform IS NULL OR Global_Sales IS NULL THEN 'missing_key'
    WHEN NOT Global_Sales > 0 THEN 'invalid_sales' WHEN Year NOT BETWEEN 1970 AND {AS_OF} THEN 'year_out_of_range' END AS rejection FROM filled),
kept AS (SELECT * EXCLUDE (rejection, rn) FROM (SELECT *, row_number() OVER (PARTITION BY Name, Platform, Year, Publisher ORDER BY ingest_id) AS rn
    FROM labelled WHERE rejection IS NULL) WHERE rn = 1)"""


def on_raw(sql: str) -> str:
    return f"WITH {RAW}{sql}" if sql.lstrip().startswith(",") else f"WITH {RAW} {sql}"


TEXT = ("Name", "Platform", "Platform_Family", "Genre", "Publisher", "Developer")
NUMERIC = (*R, "Global_Sales", "Total_Shipped", *schema.SCORES)
named = lambda columns: ", ".join(f'{c} AS "{c}"' for c in columns)
rounded6 = lambda columns: ", ".join(f'round({c}, 6) AS "{c}"' for c in columns)


@query("raw_listing_scan", on_raw(f"SELECT ingest_id, {named(('Name', 'Platform', 'Year', 'Release_Date', 'Last_Update'))} FROM raw"))
def _(spark, sf_dir):
    return raw_listing(spark, sf_dir).select("ingest_id", "Name", "Platform", "Year", "Release_Date", "Last_Update")


@query("text_cleanup", on_raw(f"SELECT ingest_id, {named(TEXT)} FROM cells"))
def _(spark, sf_dir):
    raw = cleaning.trim_column_names(raw_listing(spark, sf_dir))
    return cleaning.trim_text(cleaning.null_missing_cells(raw)).select("ingest_id", *TEXT)


@query(
    "dates_and_year",
    on_raw('SELECT ingest_id, CAST(Release_Date AS VARCHAR) AS "Release_Date", CAST(Last_Update AS VARCHAR) AS "Last_Update", Year AS "Year" FROM typed'),
)
def _(spark, sf_dir):
    return typed(spark, sf_dir).select("ingest_id", "Release_Date", "Last_Update", "Year")


@query("numeric_coercion", on_raw(f'SELECT ingest_id, Rank AS "Rank", {rounded6(NUMERIC)} FROM typed'))
def _(spark, sf_dir):
    return typed(spark, sf_dir).select("ingest_id", "Rank", *NUMERIC)


FILLED = ("Platform", "Platform_Family", "Genre")


@query(
    "sales_backfill",
    on_raw(f"SELECT ingest_id, {named(FILLED)}, {rounded6((*R, 'Global_Sales', 'Regional_Sales_Sum'))} FROM filled"),
)
def _(spark, sf_dir):
    return cleaning.fill_sales(typed(spark, sf_dir)).select("ingest_id", *FILLED, *R, "Global_Sales", "Regional_Sales_Sum")


@query(
    "filter_audit",
    on_raw(
        ", "
        + values("rules", "step, rule", list(enumerate(cleaning.REJECTIONS)))
        + """ SELECT CAST(step AS INTEGER) AS step, rule, CASE WHEN rule = 'duplicate'
        THEN (SELECT count(*) FROM labelled WHERE rejection IS NULL) - (SELECT count(*) FROM kept)
        ELSE (SELECT count(*) FROM labelled WHERE rejection = rule) END AS removed FROM rules"""
    ),
)
def _(spark, sf_dir):
    return cleaning.filter_audit(labelled(spark, sf_dir))


@query(
    "retention_ratios",
    on_raw(
        """, n AS (SELECT (SELECT count(*) FROM raw) AS a, (SELECT count(*) FROM kept) AS b,
        (SELECT count(*) FROM labelled WHERE rejection IS NULL) AS c) SELECT a AS initial_rows, b AS final_rows,
        round(b / a, 6) AS retention_rate, round((c - b) / a, 6) AS deduplication_rate FROM n"""
    ),
)
def _(spark, sf_dir):
    return cleaning.retention(labelled(spark, sf_dir))


@query("first_copy_kept", on_raw(f"SELECT ingest_id, {named(schema.DEDUP_KEY)} FROM kept"))
def _(spark, sf_dir):
    return kept(spark, sf_dir).select("ingest_id", *schema.DEDUP_KEY)


FEATURES = (
    "Genre", "Platform_Family_CN", "Top_Region", "Top_Region_CN", *[f"{r}_Share" for r in R], "Decade", "Age_Years",
    "Release_Quarter", "Composite_Score", "Score_Gap", "Is_Modern_Title", "Has_Critic_Score", "Has_User_Score",
    "Sales_Tier", "Score_Tier", "Canonical_Name",
)
ROUNDED = ("Composite_Score", "Score_Gap")


@query(
    "engineered_features",
    on_raw(
        ", "
        + features("kept", "feats", "coalesce(gl.label, s.Genre)", AS_OF)
        + " SELECT ingest_id, "
        + ", ".join(f'round({c}, 6) AS "{c}"' if c in ROUNDED else f'{c} AS "{c}"' for c in FEATURES)
        + " FROM feats"
    ),
)
def _(spark, sf_dir):
    return cleaning.engineer_features(kept(spark, sf_dir), AS_OF).select("ingest_id", *FEATURES)


@query(
    "zero_year_as_missing",
    on_raw(
        f"""SELECT ingest_id, CAST(least(greatest(coalesce(nullif(TRY_CAST(Year AS DOUBLE), 0), year(Release_Date), year(Last_Update)), 1970), {AS_OF}) AS INTEGER) AS "Year" FROM dated"""
    ),
)
def _(spark, sf_dir):
    cells = cleaning.trim_text(cleaning.null_missing_cells(raw_listing(spark, sf_dir)))
    return cleaning.parse_dates_and_year(cells, AS_OF, zero_year_is_null=True).select("ingest_id", "Year")


@query(
    "lookup_scan",
    "WITH " + ", ".join(
        [
            values("families", "k, v", schema.PLATFORM_FAMILIES),
            values("seen", "brand, platform", list(enumerate(__import__("salesprism.plans.titles", fromlist=["x"]).PLATFORM_OF_BRAND, 1))),
        ]
    )
    + """ SELECT platform AS "Platform", f.v AS "Family", count(*) AS parts FROM part
    JOIN seen ON seen.brand = CAST(replace(p_brand, 'Brand#', '') AS INTEGER) LEFT JOIN families f ON f.k = platform GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    from salesprism.plans.titles import PLATFORM_OF_BRAND, table

    seen = {str(i): p for i, p in enumerate(PLATFORM_OF_BRAND, 1)}
    parts = table(spark, sf_dir, "part").select(F.substring("p_brand", 7, 4).alias("brand"))
    named_parts = parts.join(lookup_table(spark, seen, "brand", "Platform"), "brand")
    family = lookup_table(spark, schema.PLATFORM_FAMILIES, "Platform", "Family")
    return named_parts.join(family, "Platform", "left").groupBy("Platform", "Family").agg(F.count("*").alias("parts"))


# Listing cells as they stand on a page, before any typing.
CELLS = f"""
SELECT ingest_id,
  CASE WHEN title_id % 7 = 0 THEN 'n.a.' ELSE '#' || CAST(title_id AS STRING) END AS rank_text,
  CASE WHEN title_id % 11 = 0 THEN '-' WHEN title_id % 13 = 0 THEN '' WHEN title_id % 17 = 0 THEN 'bad'
       ELSE CAST(Global_Sales AS STRING) || CASE WHEN title_id % 2 = 0 THEN 'm' ELSE 'M' END END AS sales_text,
  CASE WHEN title_id % 5 = 0 THEN 'n/a' WHEN title_id % 3 = 0 THEN '' ELSE CAST(Critic_Score AS STRING) END AS score_text,
  CASE title_id % 4 WHEN 0 THEN '' WHEN 1 THEN '5th Nov ' || substr(CAST(Year AS STRING), 3, 2)
       WHEN 2 THEN '1st Nov ' || CAST(Year AS STRING) ELSE 'soon' END AS date_text,
  CASE WHEN title_id % 19 = 0 THEN '1.25m' ELSE '' END AS shipped_text
FROM """


@query(
    "listing_cell_values",
    f"""WITH {LOOKUPS}, {BASE}, cells AS ({CELLS} base),
    n AS (SELECT *, coalesce(TRY_CAST(regexp_replace(sales_text, '[mM]', '', 'g') AS DOUBLE), 0) AS s,
      coalesce(TRY_CAST(regexp_replace(shipped_text, '[mM]', '', 'g') AS DOUBLE), 0) AS sh,
      TRY_CAST(nullif(regexp_extract(trim(regexp_replace(date_text, 'st|nd|rd|th', '', 'g')), '(\\d{{2,4}})$', 1), '') AS INTEGER) AS y FROM cells)
    SELECT ingest_id, coalesce(TRY_CAST(replace(rank_text, '#', '') AS BIGINT), 0) AS rank,
    round(CAST(CAST(s AS DECIMAL(18,4)) AS DECIMAL(18,3))::DOUBLE, 3) AS sales,
    round(CASE WHEN s > 0 THEN CAST(CAST(s AS DECIMAL(18,4)) AS DECIMAL(18,3))::DOUBLE ELSE sh END, 3) AS sales_or_shipped,
    round(TRY_CAST(score_text AS DOUBLE), 6) AS score,
    CASE WHEN y IS NULL THEN 0 WHEN y >= 1900 THEN y WHEN y >= 70 THEN 1900 + y ELSE 2000 + y END AS release_year FROM n""",
)
def _(spark, sf_dir):
    from salesprism.plans.titles import base_titles

    cells = spark.sql(CELLS + "{base}", base=base_titles(spark, sf_dir))
    sold, shipped = text.sales_cell(F.col("sales_text")), text.sales_cell(F.col("shipped_text"))
    return cells.select(
        "ingest_id",
        text.rank_cell(F.col("rank_text")).alias("rank"),
        sold.alias("sales"),
        sales_or_shipped(sold, shipped).alias("sales_or_shipped"),
        text.score_cell(F.col("score_text")).alias("score"),
        text.release_year(F.col("date_text")).alias("release_year"),
    )


@query(
    "safe_ratios",
    f"""WITH {LOOKUPS}, {BASE} SELECT ingest_id, CASE WHEN EU_Sales = 0 THEN 0 ELSE round(NA_Sales / EU_Sales, 6) END AS ratio FROM base""",
)
def _(spark, sf_dir):
    from salesprism.plans.titles import base_titles

    return base_titles(spark, sf_dir).select(
        "ingest_id", safe_ratio(F.col("NA_Sales"), F.col("EU_Sales")).alias("ratio")
    )
