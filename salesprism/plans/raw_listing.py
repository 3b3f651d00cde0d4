"""Raw listing rows as text, derived from the sales fact with the flaws a listing has.

The text of ``SELECT`` is plain SQL that Spark and the comparison engine read alike, so both
start from the same cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesprism.plans.titles import base_titles

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December")


def _month(date: str, length: int | None) -> str:
    arms = " ".join(f"WHEN {i} THEN '{m[:length]}'" for i, m in enumerate(MONTHS, 1))
    return f"CASE month({date}) {arms} END"


DAY = "lpad(CAST(day(Release_Date) AS STRING), 2, '0')"
YEAR = "CAST(year(Release_Date) AS STRING)"
SHORT = _month("Release_Date", 3)
LONG = _month("Release_Date", None)
SALES = "CAST(Global_Sales AS STRING)"

SELECT = f"""
SELECT ingest_id,
  CASE WHEN title_id % 5 = 0 THEN '#' ELSE '' END || CAST(title_id AS STRING) AS `Rank`,
  CASE WHEN title_id % 97 = 0 THEN 'N/A' WHEN title_id % 89 = 0 THEN '   '
       WHEN title_id % 11 = 0 THEN '  ' || Name || '®  deluxe ' ELSE Name END AS `Name`,
  CASE WHEN title_id % 53 = 0 THEN 'Series' WHEN title_id % 59 = 0 THEN ''
       WHEN title_id % 61 = 0 THEN ' Game   Cube ' ELSE Platform END AS `Platform`,
  CASE WHEN title_id % 41 = 0 THEN 'Arcade' ELSE 'None' END AS `Platform_Family`,
  CASE WHEN title_id % 13 = 0 THEN 'N/A' WHEN title_id % 31 = 0 THEN '0'
       WHEN title_id % 37 = 0 THEN '2050' ELSE CAST(Year AS STRING) END AS `Year`,
  CASE WHEN title_id % 43 = 0 THEN 'na' ELSE Genre END AS `Genre`,
  CASE WHEN title_id % 47 = 0 THEN 'nan' ELSE Publisher END AS `Publisher`,
  'Studio ' || substr(Publisher, 11) AS `Developer`,
  CASE WHEN title_id % 23 = 0 THEN '-1.5' ELSE CAST(NA_Sales AS STRING) END AS `NA_Sales`,
  CASE WHEN title_id % 29 = 0 THEN 'unknown' ELSE CAST(EU_Sales AS STRING) END AS `EU_Sales`,
  CAST(JP_Sales AS STRING) AS `JP_Sales`, CAST(Other_Sales AS STRING) AS `Other_Sales`,
  CASE WHEN title_id % 17 = 0 THEN '0' WHEN title_id % 19 = 0 THEN 'n/a' ELSE {SALES} END AS `Global_Sales`,
  CASE WHEN title_id % 7 = 0 THEN CAST(Critic_Score AS STRING) ELSE '' END AS `Site_Score`,
  CASE WHEN Critic_Score IS NULL THEN 'N/A' ELSE CAST(Critic_Score AS STRING) END AS `Critic_Score`,
  CASE WHEN User_Score IS NULL THEN '' ELSE CAST(User_Score AS STRING) END AS `User_Score`,
  CASE WHEN title_id % 34 = 0 OR title_id % 38 = 0 THEN {SALES} ELSE '0' END AS `Total_Shipped`,
  CASE title_id % 6
    WHEN 0 THEN {DAY} || CASE WHEN day(Release_Date) = 1 THEN 'st' WHEN day(Release_Date) = 2 THEN 'ND' ELSE 'th' END
                || ' ' || {SHORT} || ' ' || substr({YEAR}, 3, 2)
    WHEN 1 THEN CAST(day(Release_Date) AS STRING) || ' ' || {LONG} || ' ' || {YEAR}
    WHEN 2 THEN CAST(Release_Date AS STRING)
    WHEN 3 THEN {DAY} || '-' || {SHORT} || '-' || {YEAR}
    WHEN 4 THEN {SHORT} || ' ' || {DAY} || ', ' || {YEAR}
    ELSE 'N/A' END AS `Release_Date`,
  CASE WHEN title_id % 10 = 0 THEN 'nan' ELSE {DAY} || ' ' || {SHORT} || ' ' || {YEAR} END AS `Last_Update`
FROM """


def raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SELECT + "{base}", base=base_titles(spark, sf_dir))
