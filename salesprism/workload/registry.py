"""Query registry and the SQL building blocks of the comparison queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesprism import schema
from salesprism.plans import titles as view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded for comparison, dates as text."""
    out = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            col = F.round(col, digits)
        elif isinstance(f.dataType, T.DateType):
            col = col.cast("string")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            col = F.array_join(col, "|")
        out.append(col.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir)`` under ``name`` with the SQL it is compared with."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def on_titles(name: str, sql: str | None = None):
    """Like ``query`` for ``f(titles)``; the SQL may read the ``titles`` expression."""

    def register(f):
        query(name, with_titles(sql) if sql else None)(
            lambda spark, sf_dir: f(view.titles(spark, sf_dir))
        )
        return f

    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(name: str, columns: str, entries: Mapping | list) -> str:
    rows = entries.items() if isinstance(entries, Mapping) else entries
    body = ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def tier_case(column: str, tiers) -> str:
    arms = " ".join(
        f"WHEN {column} IS NOT NULL THEN {quoted(n)}" if e is None else f"WHEN {column} <= {e} THEN {quoted(n)}"
        for n, e in tiers
    )
    return f"CASE {arms} END"


LOOKUPS = ",\n".join(
    [
        values("families", "platform, family", schema.PLATFORM_FAMILIES),
        values("family_labels", "family, label", schema.FAMILY_LABELS),
        values("genre_labels", "genre, label", schema.GENRE_LABELS),
        values("brand_platforms", "brand, platform", list(enumerate(view.PLATFORM_OF_BRAND, 1))),
        values("type_genres", "kind, genre", view.GENRE_OF_TYPE),
    ]
)

AMOUNT = "CAST(l_extendedprice * (1 - l_discount) / 20000 AS DECIMAL(18,4))"


def regional(regions: str) -> str:
    return f"CAST(sum(CASE WHEN r_name IN ({regions}) THEN {AMOUNT} ELSE 0 END) AS DOUBLE)"


def labelled_region(column: str) -> str:
    arms = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in schema.REGION_LABELS.items())
    return f"CASE {column} {arms} END"


BASE = f"""
facts AS (
  SELECT l_partkey AS title_id, CAST(year(o_orderdate) AS INTEGER) AS y,
         {regional("'AMERICA'")} AS na, {regional("'EUROPE'")} AS eu, {regional("'ASIA'")} AS jp,
         {regional("'AFRICA', 'MIDDLE EAST'")} AS oth,
         CAST(sum({AMOUNT}) AS DOUBLE) AS gs,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) / 5 AS us,
         min(l_suppkey) AS pub, CAST(min(o_orderdate) AS DATE) AS rd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2),
base AS (
  SELECT f.title_id * 10000 + f.y AS ingest_id, f.title_id AS title_id, p_name AS "Name", b.platform AS "Platform",
         f.y AS "Year", tg.genre AS "Genre", 'Publisher ' || CAST(f.pub AS VARCHAR) AS "Publisher",
         na AS "NA_Sales", eu AS "EU_Sales", jp AS "JP_Sales", oth AS "Other_Sales", gs AS "Global_Sales",
         CASE WHEN f.title_id % 3 <> 0 THEN CAST(p_size AS DOUBLE) / 5 END AS "Critic_Score",
         CASE WHEN f.title_id % 5 <> 0 THEN us END AS "User_Score", rd AS "Release_Date"
  FROM facts f JOIN part ON f.title_id = p_partkey
  JOIN brand_platforms b ON b.brand = CAST(replace(p_brand, 'Brand#', '') AS INTEGER)
  JOIN type_genres tg ON tg.kind = p_type)"""


def features(source: str, name: str, genre: str = "s.Genre", as_of: int = view.AS_OF_YEAR) -> str:
    """The feature columns in SQL, on any relation with the base columns."""
    shares = ", ".join(f'round({r} / nullif(Global_Sales, 0), 4) AS "{r}_Share"' for r in schema.REGIONS)
    best = "greatest(" + ", ".join(schema.REGIONS) + ")"
    arms = " ".join(f"WHEN {r} = {best} THEN '{r}'" for r in schema.REGIONS)
    return f"""
{name}_0 AS (
  SELECT s.* REPLACE ({genre} AS "Genre"), coalesce(fl.label, '{schema.UNKNOWN_FAMILY_LABEL}') AS "Platform_Family_CN",
         CAST(floor(Year / 10.0) * 10 AS INTEGER) AS "Decade", greatest({as_of} - Year, 0) AS "Age_Years",
         Year >= 2015 AS "Is_Modern_Title", {tier_case("Global_Sales", schema.SALES_TIERS)} AS "Sales_Tier",
         trim(regexp_replace(regexp_replace("Name", '[®™©]', '', 'g'), '\\s+', ' ', 'g')) AS "Canonical_Name",
         CASE {arms} END AS "Top_Region", {shares},
         CAST(year(Release_Date) AS VARCHAR) || 'Q' || CAST(quarter(Release_Date) AS VARCHAR) AS "Release_Quarter",
         Critic_Score IS NOT NULL AS "Has_Critic_Score", User_Score IS NOT NULL AS "Has_User_Score",
         coalesce((Critic_Score + User_Score) / 2.0, Critic_Score, User_Score) AS "Composite_Score",
         Critic_Score - User_Score AS "Score_Gap"
  FROM {source} s LEFT JOIN family_labels fl ON fl.family = s.Platform_Family
  LEFT JOIN genre_labels gl ON gl.genre = s.Genre),
{name} AS (SELECT *, {labelled_region("Top_Region")} AS "Top_Region_CN",
         {tier_case("Composite_Score", schema.SCORE_TIERS)} AS "Score_Tier" FROM {name}_0)"""


TITLES = f"""{LOOKUPS}, {BASE},
with_family AS (SELECT b.*, coalesce(f.family, 'Other') AS "Platform_Family"
  FROM base b LEFT JOIN families f ON f.platform = b.Platform),
{features("with_family", "titles")}"""


def with_titles(sql: str) -> str:
    """Prefixes the view; a query with own expressions starts with ``, name AS (...)``."""
    return f"WITH {TITLES}{sql}" if sql.lstrip().startswith(",") else f"WITH {TITLES}\n{sql}"


def total(column: str) -> str:
    """The exact sum in SQL."""
    return f"CAST(coalesce(sum(CAST({column} AS DECIMAL(18,4))), 0) AS DOUBLE)"
