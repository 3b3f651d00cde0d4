"""Quality rules: per-text statistics, then robust multivariate outliers per language and source.

Native: DataFrame functions only. The location and scatter of the transformed statistics are
minimum-covariance-determinant estimates of half of a group's rows, reached by concentration
steps from several deterministic starts until the determinant falls no more; the least is kept. A text
is rejected by its squared Mahalanobis distance.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.llm.common import BLANK, BLANKS, in_few, read, sealed, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# The transformed statistics, and for each the spread a group has before it has rows (prior)
# and the spread added to every group (floor), both in the statistic's own unit.
AXES = ("length", "word_length", "symbols", "dup_lines", "repeats")
PRIOR = (0.8, 0.1, 0.03, 0.5, 0.2)
FLOOR = (0.3, 0.03, 0.03, 0.3, 0.1)
PRIOR_ROWS = 20
UNIT = 1000  # statistics are whole thousandths: their sums are exact in any order
SHARE = 0.5
MOST_STEPS = 100
CONVERGED = 1e-6  # least fall of the determinant's logarithm that counts as a step
STARTS = ("quartiles", "moments", "signs", "squashed")
KEYS = ("lang_", "source_", "start_")
LEVEL = 1 - 1e-6
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BINS_PER_OCTAVE = 32
POSITION = (1 << 31) - 1


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _repeat_positions(words: Column) -> Column:
    """Sorted starts of the 3-word windows that the text holds twice or more.

    A key holds 33 bits of the window's hash above its position, so one sort of plain longs
    brings equal windows together. Windows with a neighbour of equal hash are then compared
    by their words.
    """
    keys = F.when(
        F.size(words) >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
                .bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("long")),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def near(x, k, sorted_keys):
        return F.lit(False) | _same(x, F.get(sorted_keys, k - 1)) | _same(x, F.get(sorted_keys, k + 1))

    def _same(x, y):
        return F.coalesce(F.shiftright(x, 31) == F.shiftright(y, 31), F.lit(False))

    maybe = F.transform(
        F.array(keys),
        lambda s: F.transform(F.filter(s, lambda x, k: near(x, k, s)), lambda x: x.bitwiseAND(F.lit(POSITION)).cast("int")),
    )[0]
    windows = F.sort_array(
        F.transform(
            maybe,
            lambda p: F.struct(
                F.get(words, p).alias("a"), F.get(words, p + 1).alias("b"), F.get(words, p + 2).alias("c"), p.alias("p")
            ),
        )
    )

    def equal(x, y):
        return F.coalesce((x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.lit(False))

    return F.transform(
        F.array(windows),
        lambda w: F.sort_array(
            F.transform(
                F.filter(w, lambda x, k: equal(x, F.get(w, k - 1)) | equal(x, F.get(w, k + 1))), lambda x: x.p
            )
        ),
    )[0]


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the base statistics and base_failed.

    Null text has no words. Every array belongs to one text; nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, *BASE, "base_failed")]
    names = [c for c in docs.columns if c not in (text_col, *BASE, "base_failed")]
    split = docs.select(
        *kept,
        F.filter(F.split(text, BLANK + "+"), lambda x: x != "").alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_lines"),
        F.char_length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    found = split.withColumn("_at", _repeat_positions(F.col("_words")))
    at = F.col("_at")
    covered = F.aggregate(
        F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))),
        F.lit(0), lambda total, x: total + x,
    )
    counted = found.select(
        *[F.col(f"`{c}`") for c in names],
        F.size("_words").cast("long").alias("n_words"),
        "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def vector() -> list[Column]:
    """The transformed statistics as whole ``UNIT``ths: logarithms and arcsines of root shares."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def angle(share):
        return F.asin(F.sqrt(F.least(share, F.lit(1.0))))

    axes = (
        F.log(words.cast("double")),
        F.log(chars / words),
        angle(F.col("n_symbols") / chars),
        F.log1p(F.col("n_dup_lines").cast("double")),
        angle(F.col("n_repeat_words") / words),
    )
    return [F.round(x * UNIT).cast("long").alias(f"x_{name}") for x, name in zip(axes, AXES, strict=True)]


def _factored(groups: DataFrame, mean: dict[str, Column], cov: dict[tuple[int, int], Column], most: int) -> DataFrame:
    """Group rows with means m_i, the Cholesky factor l_i_j of the regularised scatter and det.

    det is the logarithm of the determinant: twice the sum of those of the factor's diagonal.
    There are at most ``most`` rows.
    """
    p = len(AXES)
    prior = [(x * UNIT) ** 2 for x in PRIOR]
    floor = [(x * UNIT) ** 2 for x in FLOOR]
    n = F.col("n").cast("double")
    out = groups.select(
        *KEYS, "n",
        *[mean[a].alias(f"m_{i}") for i, a in enumerate(AXES)],
        *[
            (
                (n * cov[i, j] + (PRIOR_ROWS * prior[i] if i == j else 0.0)) / (n + PRIOR_ROWS)
                + (floor[i] if i == j else 0.0)
            ).alias(f"c_{i}_{j}")
            for i in range(p) for j in range(i + 1)
        ],
    )
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}_{j}"))
    out = out.withColumn("det", sum((2 * F.log(f"l_{i}_{i}") for i in range(p)), F.lit(0.0)))
    return written(in_few(out.drop(*[f"c_{i}_{j}" for i in range(p) for j in range(i + 1)]), most), "scatter")


def _distances(rows: DataFrame, groups: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` with the squared Mahalanobis distance d2 from their group's centre, for each start."""
    p = len(AXES)
    keys = ["lang_", "source_"]
    out = rows.join(groups.drop("n", "det"), keys, how)
    for i in range(p):
        rest = F.col(f"x_{AXES[i]}") - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    out = out.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(p)), F.lit(0.0)))
    return out.drop(*[f"y_{i}" for i in range(p)], *[c for c in groups.columns if c not in KEYS])


def _moments(rows: DataFrame, x: list[Column], inside: Column | None = None) -> DataFrame:
    """Count n, sums s_i and sums of products s_i_j of whole numbers ``x``, exact in any order."""
    def some(value):
        return value if inside is None else F.when(inside, value)

    p, keys = len(x), [k for k in KEYS if k in rows.columns]
    return rows.groupBy(*keys).agg(
        F.count(some(F.lit(1))).alias("n"),
        *[F.sum(some(x[i])).cast("double").alias(f"s_{i}") for i in range(p)],
        *[
            F.sum(some((x[i] * x[j]).cast("decimal(38,0)"))).cast("double").alias(f"s_{i}_{j}")
            for i in range(p) for j in range(i + 1)
        ],
    )


def _scatter(p: int) -> dict[tuple[int, int], Column]:
    """Covariances from the sums of ``_moments``."""
    return {
        (i, j): F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n") / F.col("n")
        for i in range(p) for j in range(i + 1)
    }


def _starts(rows: DataFrame) -> tuple[DataFrame, int]:
    """The starts of each group, and how many these are: medians with quartile spreads, moments, and two of shrunk rows.

    The medians and quartiles come from counts of binned values. Of the rows less the medians,
    in quartile spreads, one start takes the directions (spatial signs), the other hyperbolic
    tangents; the scatter of these, in the spreads' units, lies around the medians.
    """
    p = len(AXES)
    bins = (
        rows.select("lang_", "source_", F.posexplode(F.array(*[F.floor(F.col(f"x_{a}") / 20) for a in AXES])).alias("axis", "bin"))
        .groupBy("lang_", "source_", "axis", "bin").count()
    )
    order = Window.partitionBy("lang_", "source_", "axis").orderBy("bin")
    ranked = bins.withColumns({
        "upto": F.sum("count").over(order),
        "all": F.sum("count").over(Window.partitionBy("lang_", "source_", "axis")),
    })

    def quantile(axis, q):
        return F.min(F.when((F.col("axis") == axis) & (F.col("upto") >= q * F.col("all")), F.col("bin"))) * 20.0 + 10.0

    middle = ranked.groupBy("lang_", "source_").agg(
        F.max("all").alias("n"),
        *[quantile(i, q).alias(f"q{int(100 * q)}_{i}") for i in range(p) for q in (0.25, 0.5, 0.75)],
    )
    # The spread is at least the floor: constant statistics divide by it.
    middle = written(middle.select(
        "lang_", "source_", "n", *[F.col(f"q50_{i}").alias(f"q_{i}") for i in range(p)],
        *[F.greatest((F.col(f"q75_{i}") - F.col(f"q25_{i}")) / 1.349, F.lit(FLOOR[i] * UNIT)).alias(f"w_{i}") for i in range(p)],
    ), "middle")
    medians = {a: F.col(f"q_{i}") for i, a in enumerate(AXES)}
    diagonal = {(i, j): F.col(f"w_{i}") * F.col(f"w_{j}") if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)}
    most = middle.count()
    found = [_factored(middle.withColumn("start_", F.lit(STARTS[0])), medians, diagonal, most)]

    sums = _moments(rows, [F.col(f"x_{a}") for a in AXES]).withColumn("start_", F.lit(STARTS[1]))
    found.append(_factored(sums, {a: F.col(f"s_{i}") / F.col("n") for i, a in enumerate(AXES)}, _scatter(p), most))

    z = rows.join(middle.drop("n"), ["lang_", "source_"]).select(
        "lang_", "source_", *[((F.col(f"x_{a}") - F.col(f"q_{i}")) / F.col(f"w_{i}")).alias(f"z_{i}") for i, a in enumerate(AXES)]
    )
    long = F.sqrt(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(p)), F.lit(0.0)))
    for name, shrunk in (
        (STARTS[2], lambda i: F.when(long > 0, F.col(f"z_{i}") / long * math.sqrt(p)).otherwise(F.lit(0.0))),
        (STARTS[3], lambda i: F.tanh(f"z_{i}")),
    ):
        whole = z.select("lang_", "source_", *[F.round(shrunk(i) * UNIT).cast("long").alias(f"v_{i}") for i in range(p)])
        sums = _moments(whole, [F.col(f"v_{i}") for i in range(p)]).join(middle.drop("n"), ["lang_", "source_"])
        cov = {(i, j): c * F.col(f"w_{i}") * F.col(f"w_{j}") / UNIT**2 for (i, j), c in _scatter(p).items()}
        found.append(_factored(sums.withColumn("start_", F.lit(name)), medians, cov, most))
    return reduce(DataFrame.unionByName, found), most * len(STARTS)


def _concentrate(rows: DataFrame, groups: DataFrame, share: float, most: int) -> DataFrame:
    """One concentration step: mean and scatter of the ``share`` of rows nearest the centre.

    The nearest rows of a group are found from counts of distances in fine logarithmic bins,
    so no group is sorted; rows in the last bin are all taken.
    """
    p, keys = len(AXES), list(KEYS)
    far = _distances(rows, groups, "inner").withColumn(
        "bin", F.floor(F.log2(F.col("d2") + 1e-6) * BINS_PER_OCTAVE).cast("int")
    )
    counts = far.groupBy(*keys, "bin").count()
    order = Window.partitionBy(*keys).orderBy("bin")
    last = (
        counts.withColumns({
            "upto": F.sum("count").over(order), "all": F.sum("count").over(Window.partitionBy(*keys)),
        })
        .filter(F.col("upto") >= share * F.col("all"))
        .groupBy(*keys).agg(F.min("bin").alias("last"))
    )
    sums = _moments(far.join(last, keys), [F.col(f"x_{a}") for a in AXES], F.col("bin") <= F.col("last"))
    mean = {a: F.col(f"s_{i}") / F.col("n") for i, a in enumerate(AXES)}
    consistent = share / chi2_cdf(chi2_quantile(share, p), p + 2)
    return _factored(sums, mean, {at: consistent * c for at, c in _scatter(p).items()}, most)


def least_determinant(rows: DataFrame, share: float, most: int = MOST_STEPS) -> DataFrame:
    """Per language and source the estimate of least determinant that any start converges to.

    A start takes steps while its determinant falls, and keeps the last estimate that fell.
    """
    starts, n = _starts(rows)
    best = moving = _concentrate(rows, starts, share, n)
    for _ in range(most):
        new = _concentrate(rows, moving, share, n)
        values = [c for c in new.columns if c not in KEYS]
        old = best.select(*KEYS, F.struct(*values).alias("old"))
        joined = old.join(new.select(*KEYS, F.struct(*values).alias("new")), list(KEYS), "left")
        fell = F.coalesce(F.col("new.det") < F.col("old.det") - CONVERGED, F.lit(False))
        judged = joined.select(*KEYS, F.when(fell, F.col("new")).otherwise(F.col("old")).alias("kept"), fell.alias("fell"))
        judged = written(in_few(judged.select(*KEYS, "kept.*", "fell"), n), "best")
        best, moving = judged.drop("fell"), judged.filter("fell").drop("fell")
        if moving.isEmpty():
            break
    values = [c for c in best.columns if c not in KEYS]
    least = best.groupBy("lang_", "source_").agg(F.min(F.struct("det", "start_", *[c for c in values if c != "det"])).alias("least"))
    return written(in_few(least.select("lang_", "source_", "least.*"), n), "estimates")


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    share: float = SHARE,
    level: float = LEVEL,
) -> DataFrame:
    """``docs`` without the text, with the base statistics, base_failed, distance2 and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows.
    The texts that pass are the rows of the estimates, per language and source. kept is false
    if base_failed, else whether distance2 is at most the chi-square quantile of ``level``.

    A null language or source counts as the empty string. Scatter is shrunk towards a prior of
    ``PRIOR_ROWS`` rows and has a floor, so constant statistics and groups of one row have a
    defined distance; there is no least group size. distance2 is null where base_failed.
    Repeated rows count as often as they stand; extra columns stay, whatever their names, save the
    new ones, which are replaced.
    An empty table gives an empty result.

    Sums are of whole numbers and exact, quantiles come from counts of bins: the result does
    not depend on the order of rows. Groups are pre-aggregated before each shuffle, and the
    join of rows with their group's estimate has small rows on both sides, split when skewed.
    """
    docs, given = sealed(docs.drop(*BASE, "base_failed", "distance2", "kept"))
    stats = base_statistics(docs, given[text_col])
    rows = written(
        stats.select(
            "*",
            F.coalesce(F.col(given[lang_col]), F.lit("")).alias("lang_"),
            F.coalesce(F.col(given[source_col]), F.lit("")).alias("source_"),
            *vector(),
        ),
        "statistics",
    )
    passing = rows.filter("NOT base_failed").select("lang_", "source_", *[f"x_{a}" for a in AXES])
    groups = least_determinant(passing, share)
    limit = chi2_quantile(level, len(AXES))
    judged = _distances(rows, groups.drop("start_"))
    return judged.select(
        *[F.col(g).alias(c) for c, g in given.items() if c != text_col],
        *BASE, "base_failed",
        F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"),
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(False))).alias("kept"),
    )


def op9_quality_rules(spark, sf_dir):
    out = quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *BASE, "base_failed", "kept", F.round("distance2", 6).alias("distance2"))
