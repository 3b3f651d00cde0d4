"""Queries on feature preparation and evaluation; predictions are a formula of the titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.operators import evaluation, preparation
from salesprism.workload.registry import on_titles

SCORES = ("Critic_Score", "User_Score")
SCALED = ("Global_Sales", "NA_Sales")
SPREAD = "(ingest_id * 48271) % 2147483647 % 1000"
SCORED = f"""scored AS (SELECT id, y, p, label, (CAST(h + 500 * label AS DOUBLE)) / 1500 AS prob FROM (
    SELECT ingest_id AS id, Global_Sales AS y, Global_Sales * CAST(0.9 AS DOUBLE) + CAST(ingest_id % 7 AS DOUBLE) / 20 AS p,
    CASE WHEN Global_Sales >= 1 THEN 1 ELSE 0 END AS label, {SPREAD} AS h FROM titles))"""


def scored(t: DataFrame) -> DataFrame:
    """(id, y, p, label, prob) of every title."""
    label = F.when(F.col("Global_Sales") >= 1, 1).otherwise(0)
    return t.select(
        F.col("ingest_id").alias("id"), F.col("Global_Sales").alias("y"),
        (F.col("Global_Sales") * 0.9 + (F.col("ingest_id") % 7).cast("double") / 20).alias("p"), label.alias("label"),
        ((preparation.spread_id("ingest_id") + 500 * label).cast("double") / 1500).alias("prob"),
    )


@on_titles(
    "median_filled_scores",
    "SELECT ingest_id, " + ", ".join(
        f'round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM titles)), 6) AS "{c}"' for c in SCORES
    ) + " FROM titles",
)
def _(t):
    return preparation.fill_median(t, SCORES).select("ingest_id", *SCORES)


@on_titles(
    "standardised_sales",
    "SELECT ingest_id, " + ", ".join(
        f"""round(({c} - (SELECT avg({c}) FROM titles)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1
        ELSE stddev_pop({c}) END FROM titles), 6) AS "{c}" """ for c in SCALED
    ) + " FROM titles",
)
def _(t):
    return preparation.standardise(t, SCALED).select("ingest_id", *SCALED)


@on_titles(
    "region_vectors",
    "SELECT ingest_id, " + ", ".join(
        f"""round(CASE WHEN {" + ".join(schema.REGIONS)} > 0 THEN {r} / ({" + ".join(schema.REGIONS)}) ELSE 0 END, 6) AS "{r}_Part" """
        for r in schema.REGIONS
    ) + " FROM titles",
)
def _(t):
    return preparation.region_vectors(t).select("ingest_id", *[f"{r}_Part" for r in schema.REGIONS])


@on_titles(
    "train_test_counts",
    f""", {SCORED} SELECT label, CASE WHEN (id * 48271) % 2147483647 % 1000 < 200 THEN 'test' ELSE 'train' END AS part,
    count(*) AS n FROM scored GROUP BY 1, 2""",
)
def _(t):
    return preparation.train_test(scored(t), "id").groupBy("label", "part").agg(F.count("*").alias("n"))


@on_titles(
    "similarity_anchors",
    """SELECT ingest_id, "Name", "Global_Sales" FROM (SELECT *, row_number() OVER (PARTITION BY "Name"
    ORDER BY Global_Sales DESC, ingest_id) AS nth FROM titles) WHERE nth = 1 ORDER BY Global_Sales DESC, ingest_id LIMIT 10""",
)
def _(t):
    return preparation.anchors(t, "ingest_id")


@on_titles(
    "regression_metrics",
    f""", {SCORED} SELECT round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
    round(1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0), 6) AS r2 FROM scored""",
)
def _(t):
    return evaluation.regression_metrics(scored(t))


COUNTS = """c AS (SELECT CAST(count(*) FILTER (label = 1 AND prob >= 0.5) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (label = 0 AND prob >= 0.5) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (label = 1 AND prob < 0.5) AS DOUBLE) AS fn,
    CAST(count(*) FILTER (label = 0 AND prob < 0.5) AS DOUBLE) AS tn, avg((prob - label) * (prob - label)) AS brier FROM scored)"""


def rates(t: str, f: str, m: str) -> str:
    return (
        f"coalesce({t} / nullif({t} + {f}, 0), 0) AS precision, coalesce({t} / nullif({t} + {m}, 0), 0) AS recall, "
        f"coalesce(2 * {t} / nullif(2 * {t} + {f} + {m}, 0), 0) AS f1, CAST({t} + {m} AS BIGINT) AS support"
    )


@on_titles(
    "classification_metrics",
    f""", {SCORED}, {COUNTS}, s AS (SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, brier, {rates("tp", "fp", "fn")} FROM c)
    SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
    support, round(brier, 6) AS brier FROM s""",
)
def _(t):
    return evaluation.classification_metrics(scored(t))


@on_titles(
    "classification_report",
    f""", {SCORED}, {COUNTS}, s AS (SELECT '0' AS class, {rates("tn", "fn", "fp")} FROM c
    UNION ALL SELECT '1', {rates("tp", "fp", "fn")} FROM c),
    r AS (SELECT * FROM s UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM s
    UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM s)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r""",
)
def _(t):
    return evaluation.classification_report(scored(t))


@on_titles(
    "calibration_curve",
    f""", {SCORED} SELECT CAST(greatest(ceil(prob * 10) - 1, 0) AS INTEGER) AS bin, round(avg(prob), 6) AS predicted,
    round(avg(label), 6) AS observed, count(*) AS n FROM scored GROUP BY 1""",
)
def _(t):
    return evaluation.calibration_curve(scored(t))


@on_titles(
    "likeliest_hits",
    f", {SCORED} SELECT id, label, round(prob, 6) AS prob FROM scored ORDER BY scored.prob DESC, id LIMIT 25",
)
def _(t):
    return evaluation.likeliest(scored(t).select("id", "label", "prob"), "id")
