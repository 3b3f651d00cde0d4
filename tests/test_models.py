"""Fitted models against numpy and against planted structure."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesprism.models import clusters, imputation, outliers, statistics

TARGETS = ("Site_Score", "Critic_Score", "User_Score")
COLUMNS = (*TARGETS, "Global_Sales", "Year")


def scores_table(n=500, seed=3):
    rng = np.random.default_rng(seed)
    sales, year = rng.lognormal(0, 1, n), rng.integers(1990, 2010, n)
    base = 5 + np.log(sales) + (year - 2000) / 10
    x = np.column_stack([base + rng.normal(0, 0.3, n), 1.2 * base - 1 + rng.normal(0, 0.4, n), base + 1 + rng.normal(0, 0.5, n), sales, year])
    x[:, :3] = np.round(np.maximum(x[:, :3], 0), 2)
    for j, share in enumerate((0.6, 0.3, 0.45)):
        x[rng.random(n) < share, j] = np.nan
    return x


def to_spark(spark, x, columns=COLUMNS, parts=3):
    rows = [(i, *[None if isinstance(v, float) and math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "ingest_id long, " + ", ".join(f"{c} double" for c in columns)).repartition(parts)


def plain_imputation(x, targets, rounds):
    """Row by row: the same rounds on the whole matrix."""
    gaps, z = np.isnan(x), x.copy()
    for j in range(x.shape[1]):
        z[gaps[:, j], j] = np.nanmedian(x[:, j])
    for _ in range(rounds):
        for t in sorted((j for j in range(x.shape[1]) if gaps[:, j].any()), key=lambda j: gaps[:, j].sum()):
            seen = ~gaps[:, t]
            others = np.delete(z, t, axis=1)
            a, b = others[seen] - others[seen].mean(axis=0), z[seen, t] - z[seen, t].mean()
            _, s, v = np.linalg.svd(a, full_matrices=False)
            noise, strength, w = 1 / (b.var() + np.finfo(float).eps), 1.0, None
            for _ in range(300):
                last, w = w, v.T @ (s / (s**2 + strength / noise) * (v @ (a.T @ b) / s))
                used = (noise * s**2 / (strength + noise * s**2)).sum()
                strength = (used + 2e-6) / (w @ w + 2e-6)
                noise = (len(b) - used + 2e-6) / (((b - a @ w) ** 2).sum() + 2e-6)
                if last is not None and abs(last - w).sum() < 1e-3:
                    break
            w = v.T @ (s / (s**2 + strength / noise) * (v @ (a.T @ b) / s))
            z[gaps[:, t], t] = z[seen, t].mean() + (others[gaps[:, t]] - others[seen].mean(axis=0)) @ w
    return np.maximum(z[:, :targets], 0)


@pytest.mark.parametrize("parts", [1, 5])
def test_imputation_equals_the_rounds_on_rows(spark, parts):
    x = scores_table()
    got = imputation.impute_scores(to_spark(spark, x, parts=parts)).orderBy("ingest_id").toPandas()[list(TARGETS)].to_numpy()
    want = plain_imputation(x, 3, imputation.ROUNDS)
    assert not np.isnan(got).any()
    assert np.abs(got - want).max() < 0.0051 + 1e-6  # rounded to two digits
    seen = ~np.isnan(x[:, :3])
    assert np.abs(got[seen] - x[:, :3][seen]).max() < 1e-9


def test_imputation_leaves_tables_alone(spark):
    x = scores_table(60)
    full = to_spark(spark, np.nan_to_num(x, nan=1.234))
    assert imputation.impute_scores(full).orderBy("ingest_id").toPandas().equals(full.orderBy("ingest_id").toPandas())
    few = to_spark(spark, x[:4])
    assert imputation.impute_scores(few).where("Site_Score is null").count() == few.where("Site_Score is null").count()
    x[:, 0] = np.nan
    out = imputation.impute_scores(to_spark(spark, x)).toPandas()
    assert out["Site_Score"].isna().all() and not out["User_Score"].isna().any()
    assert imputation.impute_scores(to_spark(spark, x).limit(0)).count() == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    table = pd.DataFrame({"a": rng.normal(size=3000), "b": np.round(rng.exponential(size=3000), 1), "c": [None] * 3000, "d": [1.0] * 3000})
    table.loc[::7, "b"] = None
    df = spark.createDataFrame(table, "a double, b double, c double, d double")
    for most in (100_000, 150):
        for p in (0.0, 0.05, 0.5, 0.93, 1.0):
            got = statistics.quantiles(df, dict.fromkeys("abcd", p), most=most)
            assert got["c"] is None and got["d"] == 1.0
            for c in "ab":
                assert got[c] == pytest.approx(table[c].quantile(p), abs=1e-12)


def test_forest_finds_planted_outliers_in_any_partitioning(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1000, 4))
    x[:20] = rng.choice([-1, 1], (20, 4)) * rng.uniform(8, 12, (20, 4))
    x[500:560, 2] = np.nan
    columns = ("Global_Sales", "Year", "Critic_Score", "NA_Sales")
    results = [
        outliers.flag_outliers(to_spark(spark, x, columns, parts), columns=columns).select("ingest_id", "Is_Outlier", "Outlier_Score").orderBy("ingest_id").toPandas()
        for parts in (1, 6)
    ]
    assert results[0].equals(results[1])
    worst = results[0].nsmallest(20, "Outlier_Score")
    assert set(worst["ingest_id"]) == set(range(20))
    assert results[0]["Is_Outlier"].sum() == 50 and (results[0].loc[results[0]["Is_Outlier"], "Outlier_Score"] < 0).all()


def test_forest_without_variation(spark):
    same = to_spark(spark, np.ones((30, 2)), ("Global_Sales", "Year"))
    out = outliers.flag_outliers(same, columns=("Global_Sales", "Year"))
    assert out.filter("Is_Outlier").count() == 0 and out.count() == 30
    assert outliers.flag_outliers(same.limit(0), columns=("Global_Sales",)).count() == 0


def test_forest_depths_are_those_of_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(64, 3))
    nodes = []
    for t in range(5):
        for i, n in enumerate(outliers.grow(x, np.random.default_rng(t))):
            nodes.append((t, i, *n))
    table = pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "length"])
    lengths = np.zeros(64)
    for t, part in table.groupby("tree"):
        part = part.set_index("node")
        for i, row in enumerate(x):
            at = 0
            while part.loc[at, "feature"] >= 0:
                at = part.loc[at, "left"] + (row[part.loc[at, "feature"]] > part.loc[at, "split"])
            lengths[i] += part.loc[at, "length"]
    want = -(2.0 ** (-lengths / 5 / outliers.mean_path(64)))
    assert np.allclose(outliers.Forest(table, 64).scores(x), want)


def planted(n=600):
    """Four groups of region mixes, one for each leading region, and rows that sold nothing."""
    rng = np.random.default_rng(7)
    mixes = np.array([[0.8, 0.1, 0.05, 0.05], [0.1, 0.75, 0.05, 0.1], [0.05, 0.05, 0.85, 0.05], [0.1, 0.1, 0.1, 0.7]])
    group = np.repeat(np.arange(4), [n * 4 // 10, n * 3 // 10, n * 2 // 10, n // 10])
    share = np.maximum(mixes[group] + rng.normal(0, 0.01, (n, 4)), 0)
    return group, share * rng.uniform(1, 20, (n, 1))


def test_clusters_find_planted_groups(spark):
    regions = ["NA_Sales", "EU_Sales", "JP_Sales", "Other_Sales"]
    group, x = planted()
    df = to_spark(spark, x, regions)
    fitted = clusters.fit_region_clusters(df)
    assert all(b <= a for a, b in zip(fitted.costs, fitted.costs[1:], strict=False))
    out = fitted.assign(df).orderBy("ingest_id").toPandas()
    assert (out["Regional_Cluster"].to_numpy() == group).all()  # numbered by falling size
    share = x / x.sum(axis=1, keepdims=True)
    z = (share - share.mean(axis=0)) / share.std(axis=0)
    e, v = np.linalg.eigh(z.T @ z / len(z))
    e, v = e[::-1], v[:, ::-1]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(4)])
    assert np.abs(fitted.projection.variance_ratio - e[:2] / e.sum()).max() < 1e-9
    assert np.abs(out[["PCA_Region_1", "PCA_Region_2"]].to_numpy() - z @ v[:, :2]).max() < 1e-6
    from salesprism import schema

    labels = [schema.REGION_LABELS[r] + schema.CLUSTER_LABEL_SUFFIX for r in regions]
    assert fitted.labels()[:3] == labels[:3]  # two components do not keep the smallest group's profile
    assert clusters.fit_region_clusters(df, components=3, restarts=2).labels() == labels
    assert set(out.columns) == {*df.columns, "PCA_Region_1", "PCA_Region_2", "Regional_Cluster", "Regional_Cluster_Label"}


def test_clusters_of_small_tables(spark):
    regions = ["NA_Sales", "EU_Sales", "JP_Sales", "Other_Sales"]
    assert [clusters.clusters_for(r, d) for r, d in ((19, 4), (20, 4), (150, 4), (400, 4), (400, 3), (400, 1))] == [0, 2, 3, 4, 3, 0]
    tiny = to_spark(spark, np.ones((25, 4)), regions)
    assert clusters.cluster_regions(tiny).filter(F.col("Regional_Cluster").isNotNull()).count() == 0
    assert clusters.cluster_regions(tiny.limit(0)).count() == 0


def sold_titles(spark, n=1500):
    rng = np.random.default_rng(9)
    genre, family = rng.integers(0, 6, n), rng.integers(0, 5, n)
    year = rng.integers(1990, 2010, n)
    sales = np.exp(genre / 3 - family / 4 + (year - 2000) / 15 + rng.normal(0, 0.3, n)) * 0.6
    rows = [
        (i, f"Genre {g}" if g else None, f"Family {f}", f"Publisher {min(i % 97, i % 13)}" if i % 11 else None, int(y) if i % 9 else None, int(y) // 10 * 10, float(s))
        for i, (g, f, y, s) in enumerate(zip(genre, family, year, sales, strict=True))
    ]
    return spark.createDataFrame(rows, "ingest_id long, Genre string, Platform_Family string, Publisher string, Year int, Decade int, Global_Sales double")


@pytest.fixture(scope="module")
def prepared(spark):
    from salesprism.models import supervised

    return supervised.prepare_features(sold_titles(spark), publishers=5)


def test_features_have_no_gaps(prepared):
    table = prepared.toPandas()
    assert not table[["Year", "Decade", "Genre", "Platform_Family", "Publisher_Grouped"]].isna().any().any()
    counts = table["Publisher"].value_counts()
    top = sorted(counts.index, key=lambda p: (-counts[p], p))[:5]
    assert (table["Publisher_Grouped"] == table["Publisher"].where(table["Publisher"].isin(top), "OtherPublisher")).all()


def test_regression_predicts_every_row(spark, prepared):
    from salesprism.models import supervised
    from salesprism.operators import evaluation

    fitted = supervised.fit_regression(prepared, "ingest_id", trees=25)
    scored = fitted.predict(prepared).withColumn("part", supervised.three_parts("ingest_id"))
    assert scored.filter("predicted is null").count() == 0 and scored.count() == prepared.count()
    unseen = prepared.limit(3).withColumn("Genre", F.lit("never seen"))
    assert fitted.predict(unseen).filter("predicted is not null").count() == 3
    r2 = evaluation.regression_metrics(scored.filter("part = 'test'"), "Global_Sales", "predicted").first().r2
    assert r2 > 0.5
    shares = fitted.importance(spark).collect()
    assert sum(r.importance for r in shares) == pytest.approx(1) and shares[0].feature == "类型"
    assert supervised.fit_regression(prepared.withColumn("Global_Sales", F.lit(1.0)), "ingest_id") is None
    assert supervised.fit_regression(prepared.limit(10), "ingest_id") is None


def test_calibration_is_monotone_and_no_worse(prepared):
    from salesprism.models import supervised

    fitted = supervised.fit_hits(prepared, "ingest_id", trees=10)
    for _, calibration in fitted.folds:
        assert (np.diff(calibration.predictions.toArray()) >= -1e-12).all()
    scored = fitted.predict(prepared).withColumn("part", supervised.three_parts("ingest_id")).filter("part = 'test'").toPandas()
    hit = (scored["Global_Sales"] >= 1).astype(float)
    assert scored["prob"].between(0, 1).all()
    assert ((scored["prob"] - hit) ** 2).mean() <= ((scored["prob_raw"] - hit) ** 2).mean() + 0.005
    assert supervised.fit_hits(prepared.withColumn("Global_Sales", F.lit(5.0)), "ingest_id") is None


def test_similar_vectors_against_numpy(spark):
    from salesprism.models import similar

    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(60, 5)), np.zeros((1, 5))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vec array<double>").repartition(4)
    got = similar.similar_vectors(df, df.filter("id < 3"), "id", "vec", k=7).collect()
    norm = np.linalg.norm(x, axis=1)
    for a in range(3):
        sims = np.round(np.divide(x @ x[a], norm * norm[a], out=np.zeros(61), where=norm > 0), 9)
        want = sorted(range(61), key=lambda i: (-sims[i], i))[:7]
        assert [r.id for r in sorted((r for r in got if r.anchor_id == a), key=lambda r: r.position)] == want
    with pytest.raises(ValueError):
        similar.nearest_rows(df, spark.range(2000), F.lit(1.0), 3, "id")


def test_mixture_finds_planted_segments(spark):
    from salesprism.models import segments

    group, x = planted(800)
    regions = ["NA_Sales", "EU_Sales", "JP_Sales", "Other_Sales"]
    rng = np.random.default_rng(1)
    age = group * 10 + rng.normal(0, 0.5, len(group))
    table = np.column_stack([x, age, np.where(group % 2, 8.0, 3.0) + rng.normal(0, 0.1, len(group)), x.sum(axis=1)])
    columns = (*regions, "Age_Years", "Composite_Score", "Global_Sales")
    df = to_spark(spark, table, columns).withColumns({"Genre": F.lit("g"), "Platform_Family": F.lit("f")})
    fitted = segments.fit_segments(df, k=4)
    out = fitted.assign(df).toPandas().sort_values("ingest_id")
    probs = np.array(out["cluster_probs"].tolist())
    assert np.abs(probs.sum(axis=1) - 1).max() < 1e-9
    pairs = set(zip(group[out["ingest_id"]], out["behavior_cluster"], strict=True))
    assert len(pairs) <= 6  # nearly each planted group is one segment
    assert fitted.aic < fitted.bic and fitted.parameters == 3 + 12 + 24
    profiles = segments.segment_profiles(fitted.assign(df)).toPandas()
    assert profiles["size"].sum() == 800 and profiles["purity"].between(0.5, 1).all()
    assert segments.fit_segments(df.limit(30)) is None
    longer = segments.fit_segments(df, k=4, steps=20, restarts=1).likelihoods[0]
    assert longer >= segments.fit_segments(df, k=4, steps=5, restarts=1).likelihoods[0] - 1e-6


def test_bands_cover_and_do_not_cross(prepared):
    from salesprism.models import bands, supervised

    fitted = bands.fit_bands(prepared, "ingest_id")
    scored = fitted.predict(prepared).filter(supervised.three_parts("ingest_id") == "test").toPandas()
    assert (scored["p10"] <= scored["p50"]).all() and (scored["p50"] <= scored["p90"]).all()
    inside = scored["Global_Sales"].between(scored["p10"], scored["p90"]).mean()
    assert 0.72 < inside < 0.95
    assert np.allclose(fitted.shares.sum(axis=2)[fitted.shares.sum(axis=2) > 0], 1)


def test_shapley_values_of_a_known_function(spark):
    from itertools import permutations

    from salesprism.models import attribution

    rows = spark.createDataFrame([(1.0, 2.0, "a"), (1.0, 2.0, "a"), (3.0, -1.0, "b"), (0.0, 0.0, None)], "x double, y double, c string")
    background = spark.createDataFrame([(0.5, 1.0, "a"), (2.0, 0.0, "b"), (1.0, 1.0, "c")], "x double, y double, c string")

    def f(x, y, c):
        return x * y + (2.0 if c == "a" else 0.0) * x

    def predict(df):
        return df.withColumn("predicted", F.col("x") * F.col("y") + F.when(F.col("c") == "a", 2.0).otherwise(0.0) * F.col("x"))

    got = attribution.shapley_values(rows, background, predict, ("x", "y", "c")).collect()
    others = [tuple(r) for r in background.collect()]
    assert sorted(r.rows for r in got) == [1, 1, 2]
    for r in got:
        own, want = (r.x, r.y, r.c), np.zeros(3)
        for order in permutations(range(3)):
            for b in others:
                point = list(b)
                for i in order:
                    before = f(*point)
                    point[i] = own[i]
                    want[i] += (f(*point) - before) / 6 / len(others)
        assert np.allclose(r.phi, want) and math.isclose(sum(r.phi), r.predicted - r.base, abs_tol=1e-9)
    top = attribution.mean_attribution(attribution.shapley_values(rows, background, predict, ("x", "y", "c")), ("x", "y", "c")).collect()
    assert len(top) == 3 and top[0].attribution >= top[1].attribution >= top[2].attribution
