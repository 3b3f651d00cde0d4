"""Steps of a mixture's seeds share their passes and end where the library's mixture ends."""

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.models import segments
from salesprism.models.statistics import moments

COLUMNS = (*schema.REGIONS, "Age_Years", "Composite_Score", "Global_Sales")


def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, len(COLUMNS))) + rng.integers(0, 3, 400)[:, None] * np.arange(1, len(COLUMNS) + 1)
    rows = [tuple(None if i == 3 and j == 2 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLUMNS))


def test_ends_where_the_library_ends(spark):
    df = table(spark)
    fitted = segments.fit_segments(df, k=3, steps=25)
    filled = df.fillna(0.0).select(*[F.col(c).alias(f"_f_{c}") for c in COLUMNS])
    points = segments._vectors(filled, fitted.projection).select("features").localCheckpoint()
    known = [GaussianMixture(k=3, seed=s, maxIter=25, tol=0.4).fit(points) for s in (42, 43, 44)]
    likelihoods = [m.summary.logLikelihood for m in known]
    assert np.allclose(fitted.likelihoods, likelihoods, rtol=1e-9)
    best = known[int(np.argmax(likelihoods))]
    assert np.allclose(fitted.mixture.weights, best.weights, rtol=1e-7)
    assert np.allclose(fitted.mixture.means, [g["mean"].toArray() for g in best.gaussiansDF.collect()], rtol=1e-6)
    want = np.array([r["probability"].toArray() for r in best.transform(points).collect()])[:, fitted.order]
    found = fitted.assign(df)
    assert np.allclose(want, [r["cluster_probs"] for r in found.collect()], atol=1e-7)
    assert found.columns == [*COLUMNS, "cluster_probs", "behavior_cluster"]


def test_filters_do_not_repeat_the_densities(spark):
    df = table(spark)
    found = segments.fit_segments(df, k=3, steps=2).assign(df)
    plan = found.filter("behavior_cluster >= 0 AND cluster_probs[0] >= 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EXP(") == 3 and found.filter("behavior_cluster >= 0").count() == 400


def test_points_without_spread_have_a_mixture(spark):
    df = spark.createDataFrame([(1.0,) * len(COLUMNS)] * 70, ", ".join(f"{c} double" for c in COLUMNS))
    fitted = segments.fit_segments(df, steps=3)
    assert [round(p, 6) for p in fitted.assign(df).first()["cluster_probs"]] == [0.5, 0.5]


def test_seeds_share_the_passes(spark):
    context, df = spark.sparkContext, table(spark).localCheckpoint()
    spent = []
    for restarts in (1, 3):
        context.setJobGroup(f"restarts-{restarts}", "")
        segments.fit_segments(df, k=3, restarts=restarts, steps=12)
        spent.append(len(context.statusTracker().getJobIdsForGroup(f"restarts-{restarts}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert spent[1] - spent[0] < 12  # else every further seed has its own steps


def test_sums_of_large_and_missing_terms(spark):
    rows = [(1, 3e9, 0.1), (1, -2.5, None), (2, 0.3, 1e-12), (2, float("nan"), 7.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    found = moments(df, ["a", "b"], ["g"])
    assert found[1,].n == 2 and found[1,].sums.tolist() == [2999999997.5, 0.1]
    assert found[1,].products[0, 0] == 9e18 + 6.25 and found[2,].sums.tolist() == [0.3, 7.000000000001]
    small = moments(df.filter("g = 1 AND a < 0 OR b < 1e-6"), ["a", "b"])[()]
    assert small.sums.tolist() == [-2.2, 1e-12] and small.products[0].tolist() == [6.34, 0.0]
    assert moments(df.limit(0), ["a"])[()].n == 0
