"""Queries of the fitted models. Where SQL can state what must hold of a fit, it is the comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesprism import jobs, schema
from salesprism.functions.text import feature_label
from salesprism.models import attribution, bands, clusters, imputation, outliers, segments, similar, supervised
from salesprism.operators import charts, evaluation, market
from salesprism.plans.raw_listing import raw_listing
from salesprism.session import written_once
from salesprism.workload.cleaning import AS_OF, named, on_raw
from salesprism.workload.registry import on_titles, query, quoted

SCORES = ("Critic_Score", "User_Score")


@on_titles("imputed_scores")
def _(t):
    return imputation.impute_scores(t).select("ingest_id", *SCORES)


@on_titles(
    "imputation_audit",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS score, count(*) AS rows, count(*) - count({c}) AS filled, 0::BIGINT AS missing, 0::BIGINT AS changed,
        0::BIGINT AS negative FROM titles""" for c in SCORES
    ),
)
def _(t):
    """Per score: what was filled, what is still missing, and observed values that are not kept."""
    before = t.select("ingest_id", *[F.col(c).alias(f"{c}_before") for c in SCORES], *SCORES, "Global_Sales", "Year")
    after = imputation.impute_scores(before)
    rows = []
    for c in SCORES:
        was, now = F.col(f"{c}_before"), F.col(c)
        counts = after.agg(
            F.count("*").alias("rows"), F.count_if(was.isNull()).alias("filled"), F.count_if(now.isNull()).alias("missing"),
            F.count_if(F.abs(was - now) > 0.0051).alias("changed"), F.count_if(now < 0).alias("negative"),
        )
        rows.append(counts.select(F.lit(c).alias("score"), "*"))
    return rows[0].unionByName(rows[1])


@on_titles("outlier_scores")
def _(t):
    return outliers.flag_outliers(t).select("ingest_id", "Is_Outlier", "Outlier_Score")


@on_titles("region_clusters")
def _(t):
    return clusters.cluster_regions(written_once(t.select("ingest_id", *schema.REGIONS))).select("ingest_id", "PCA_Region_1", "PCA_Region_2", "Regional_Cluster", "Regional_Cluster_Label")


@on_titles("cluster_insights_fitted")
def _(t):
    return market.cluster_summary(clusters.cluster_regions(written_once(t.select(*schema.REGIONS, "Global_Sales", "Genre", "Platform_Family_CN"))))


@on_titles("cluster_release_counts_fitted")
def _(t):
    t = written_once(t.select(*schema.REGIONS, "Year", "Name"))
    return charts.count_wide(clusters.cluster_regions(t), "Regional_Cluster", range(4), prefix="cluster_")


@on_titles("region_segments")
def _(t):
    t = written_once(t.select(*SEGMENTED))
    fitted = clusters.fit_region_clusters(t, k=4)
    return clusters.region_segments(fitted.assign(t)) if fitted else clusters.region_segments(clusters.cluster_regions(t))


SEGMENTED = (*schema.REGIONS, "Global_Sales", "Genre", "Platform_Family")
CLEAN_KEYS = ("Name", "Platform", "Year", "Publisher", "Platform_Family")


@query("clean_table_keys", on_raw(f"SELECT {named(CLEAN_KEYS)}, 0 AS gaps FROM kept"))
def _(spark, sf_dir):
    """The whole clean job; its rows must be those that the cleaning rules keep, with all model columns there."""
    table = jobs.clean_table(raw_listing(spark, sf_dir), AS_OF)
    fitted = ("Is_Outlier", "Outlier_Score", *schema.SCORES, "PCA_Region_1", "PCA_Region_2", "Regional_Cluster", "Regional_Cluster_Label")
    gaps = sum((F.col(c).isNull().cast("int") for c in fitted), F.lit(0))
    return table.select(*CLEAN_KEYS, gaps.alias("gaps"))


@query("clean_table")
def _(spark, sf_dir):
    return jobs.clean_table(raw_listing(spark, sf_dir), AS_OF)


GROUPED = f"""top30 AS (SELECT Publisher FROM titles GROUP BY 1 ORDER BY count(*) DESC, Publisher LIMIT 30),
prepared AS (SELECT t.*, CASE WHEN Publisher IN (SELECT Publisher FROM top30) THEN Publisher ELSE {quoted(schema.OTHER_PUBLISHER)} END
    AS "Publisher_Grouped" FROM titles t)"""
FEATURES = ("Genre", "Platform_Family", "Publisher_Grouped")


@on_titles(
    "prepared_features",
    f""", {GROUPED} SELECT ingest_id, {named(FEATURES)}, CAST(Year AS DOUBLE) AS "Year", CAST(Decade AS DOUBLE) AS "Decade" FROM prepared""",
)
def _(t):
    return supervised.prepare_features(t).select("ingest_id", *FEATURES, "Year", "Decade")


@on_titles(
    "feature_labels",
    "SELECT DISTINCT 'num__Year' AS name, '年份' AS label FROM titles UNION SELECT 'cat__Genre_' || Genre, '类型:' || Genre FROM titles"
    " UNION SELECT 'Platform_Family_' || Platform_Family, '平台:' || Platform_Family FROM titles",
)
def _(t):
    genre = t.select(F.concat(F.lit("cat__Genre_"), "Genre").alias("name"))
    family = t.select(F.concat(F.lit("Platform_Family_"), "Platform_Family").alias("name"))
    names = t.select(F.lit("num__Year").alias("name")).union(genre).union(family).distinct()
    return names.select("name", feature_label(F.col("name")).alias("label"))


PREDICTED = ("ingest_id", "Publisher", "Platform_Family", "Genre", "Year", "Decade", "Global_Sales")


def predicted_sales(t):
    """The prepared titles with a prediction and the part each belongs to."""
    ready = supervised.prepare_features(t)
    fitted = supervised.fit_regression(ready, schema.INGEST_ID)
    return fitted, fitted.predict(ready).withColumn("part", supervised.three_parts(schema.INGEST_ID))


@on_titles("sales_predictions")
def _(t):
    return predicted_sales(t)[1].select("ingest_id", "part", "Global_Sales", "predicted")


@on_titles("sales_prediction_scores")
def _(t):
    fitted, scored = predicted_sales(t)
    scores = evaluation.regression_metrics(scored.filter("part = 'test'"), "Global_Sales", "predicted")
    return scores.withColumn("trees_used", F.lit(fitted.trees_used))


@on_titles("sales_prediction_samples")
def _(t):
    """The first 25 test titles with prediction and band."""
    t = written_once(t.select(*PREDICTED, "Name"))
    ready = supervised.prepare_features(t)
    regression, banded = supervised.fit_regression(ready, schema.INGEST_ID), bands.fit_bands(ready, schema.INGEST_ID)
    columns = ("ingest_id", "Name", "Platform_Family", "Genre", "Year", "Global_Sales", "predicted", "p10", "p50", "p90")
    first = ready.filter(supervised.three_parts(schema.INGEST_ID) == "test").orderBy("ingest_id").limit(25)
    return banded.predict(regression.predict(first)).select(*columns)


@on_titles("feature_importance")
def _(t):
    return predicted_sales(t)[0].importance(t.sparkSession)


@on_titles("feature_attribution")
def _(t):
    fitted, scored = predicted_sales(t)
    inputs = [*supervised.NUMERIC, *supervised.CATEGORICAL]
    background = scored.filter("part = 'train'").orderBy(F.xxhash64(schema.INGEST_ID)).limit(attribution.BACKGROUND)
    values = attribution.shapley_values(scored.filter("part = 'test'").select(*inputs), background, fitted.predict)
    return attribution.mean_attribution(values)


@on_titles("sales_band_summary")
def _(t):
    """Means and medians of the bands, and what share of the test titles lies inside."""
    ready = supervised.prepare_features(written_once(t.select(*PREDICTED)))
    fitted = bands.fit_bands(ready, schema.INGEST_ID)
    test = fitted.predict(ready.filter(supervised.three_parts(schema.INGEST_ID) == "test"))
    levels = ("p10", "p50", "p90")
    inside = F.avg(F.col("Global_Sales").between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage")
    return test.agg(*[F.avg(c).alias(f"{c}_mean") for c in levels], *[F.median(c).alias(f"{c}_median") for c in levels], inside)


def hit_chances(t):
    ready = supervised.prepare_features(t)
    fitted = supervised.fit_hits(ready, schema.INGEST_ID, hit=HIT_SALES)
    label = (F.col("Global_Sales") >= HIT_SALES).cast("int")
    scored = fitted.predict(ready).withColumn("label", label)
    return scored.filter(supervised.three_parts(schema.INGEST_ID) == "test")


# Nearly all titles of these tables pass the usual threshold of 1.
HIT_SALES = 10.0


@on_titles("hit_probabilities")
def _(t):
    return hit_chances(t).select("ingest_id", "label", "prob")


@on_titles("hit_scores")
def _(t):
    return evaluation.classification_metrics(hit_chances(t))


@on_titles("hit_report")
def _(t):
    return evaluation.classification_report(hit_chances(t))


@on_titles("hit_calibration")
def _(t):
    return evaluation.calibration_curve(hit_chances(t))


@on_titles("likeliest_hits_fitted")
def _(t):
    columns = ("ingest_id", "Name", "Platform_Family", "Genre", "Year", "prob")
    return evaluation.likeliest(hit_chances(t).select(*columns), "ingest_id")


@on_titles(
    "similar_titles",
    f""", {GROUPED}, filled AS (SELECT *, coalesce(Composite_Score, (SELECT quantile_cont(Composite_Score, 0.5) FROM titles)) AS cs,
        CAST(Year AS DOUBLE) AS yr FROM prepared),
    m AS (SELECT avg(cs) AS ma, stddev_pop(cs) AS sa, avg(yr) AS mb, stddev_pop(yr) AS sb FROM filled),
    z AS (SELECT *, (cs - ma) / sa AS za, (yr - mb) / sb AS zb FROM filled, m),
    v AS (SELECT *, sqrt(za * za + zb * zb + 6) AS norm FROM z),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Name ORDER BY Global_Sales DESC, ingest_id) AS nth FROM v)
        WHERE nth = 1 ORDER BY Global_Sales DESC, ingest_id LIMIT 10),
    pairs AS (SELECT a.ingest_id AS anchor_id, a.Name AS anchor, b.ingest_id AS candidate_id, b.Name AS candidate, round((b.za * a.za + b.zb * a.zb
        + CASE WHEN a.Genre = b.Genre THEN 4 ELSE 0 END + CASE WHEN a.Platform_Family = b.Platform_Family THEN 1 ELSE 0 END
        + CASE WHEN a.Publisher_Grouped = b.Publisher_Grouped THEN 1 ELSE 0 END) / (b.norm * a.norm), 9) AS similarity,
        a.Genre = b.Genre AS genre_match FROM best a, v b),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY similarity DESC, candidate_id) AS nth FROM pairs)
    SELECT anchor_id, anchor, candidate_id, candidate, round(greatest(similarity, 0), 6) AS similarity, genre_match
    FROM ranked WHERE nth <= 11 AND 1 - similarity >= 0.00001 AND candidate <> anchor""",
)
def _(t):
    t = written_once(t.select("ingest_id", "Name", "Global_Sales", "Composite_Score", "Year", "Decade", "Genre", "Platform_Family", "Publisher"))
    found = similar.similar_titles(supervised.prepare_features(t))
    return found.select("anchor_id", "anchor", "candidate_id", "candidate", "similarity", "genre_match")


@query(
    "similar_vectors",
    """WITH a AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 10),
    p AS (SELECT a.vec_id AS anchor_id, b.vec_id, round(list_dot_product(b.embedding::DOUBLE[], a.embedding::DOUBLE[])
        / (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) * sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))), 9)
        AS similarity FROM a, embeddings b WHERE b.embedding IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY similarity DESC, vec_id) AS position FROM p)
    SELECT anchor_id, CAST(position AS INTEGER) AS position, vec_id, round(similarity, 6) AS similarity FROM r WHERE position <= 11""",
)
def _(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return similar.similar_vectors(table, table.filter("embedding IS NOT NULL").orderBy("vec_id").limit(10), "vec_id", "embedding")


def behavior(t):
    fitted = segments.fit_segments(t)
    return fitted, segments.segment_profiles(written_once(fitted.assign(t)))


@on_titles("behavior_segments")
def _(t):
    fitted, profiles = behavior(written_once(t.select(*SEGMENTED, "Age_Years", "Composite_Score")))
    return profiles.withColumns({"bic": F.lit(fitted.bic), "aic": F.lit(fitted.aic)})


@on_titles("tagged_segments")
def _(t):
    t = written_once(t.select(*SEGMENTED, "Age_Years", "Composite_Score"))
    regional = clusters.region_segments(clusters.fit_region_clusters(t, k=4).assign(t))
    return segments.tagged_segments(regional, behavior(t)[1])
