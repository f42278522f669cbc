"""Checks of a fitted model's residuals: uniformity of scaled residuals, leverage and influence of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.combine import join_groups
from tidemark.operators.design import design_columns
from tidemark.operators.glm import Fit
from tidemark.operators.residuals import pearson_rows
from tidemark.session import settle

LEVEL_BITS = 12
KOLMOGOROV_TERMS = 100


def _running(buckets: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """Adds ``upto`` (rows to the end of a bucket) and between what ends the distance in it lies."""
    window = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = buckets.withColumn("upto", F.col("start") + F.sum("m").over(window))
    above, below = F.col("upto") / F.col("n"), (F.col("upto") - F.col("m")) / F.col("n")
    return counted.withColumns(
        {
            "least": F.greatest(above - F.col("high"), F.col("low") - below),
            "most": F.greatest(above - F.col("low"), F.col("high") - below),
        }
    )


def _open_buckets(buckets: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The largest distance that is sure so far per group, and the buckets that may hold a larger one."""
    best = settle(buckets.groupBy(*by).agg(F.max("least").alias("best")), "best")
    larger = join_groups(buckets, best, by).where(F.col("most") > F.col("best")).drop("best")
    return best, larger


def kolmogorov_distance(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``n`` and the exact largest distance ``ks`` between the values' distribution and the uniform one on 0..1, per group.

    Values are counted in 4,096 buckets first. The count, smallest and largest value of a bucket
    bound the distance inside it, so only buckets that may hold the largest are cut finer, once more
    into 4,096; of those that are still open the distinct values are ranked. Windows run over at most
    4,096 buckets, or over the distinct values of one bucket that is 2**-24 wide. Missing values do
    not count; values outside of 0..1 fall into the buckets at the ends.
    """
    if not by:
        return kolmogorov_distance(df.withColumn("tm_all", F.lit(0)), value, ["tm_all"]).drop("tm_all")
    by = list(by)
    held = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*[F.col(f"`{b}`") for b in by], F.col(value).cast("double").alias("tm_u"))

    def bucket(bits: int) -> Column:
        top = (1 << bits) - 1
        return F.least(F.greatest(F.floor(F.col("tm_u") * (1 << bits)), F.lit(0)), F.lit(top)).cast("long")

    sizes = [F.count(F.lit(1)).alias("m"), F.min("tm_u").alias("low"), F.max("tm_u").alias("high")]
    first = settle(held.withColumn("wide", bucket(LEVEL_BITS)).groupBy(*by, "wide").agg(*sizes), "buckets")
    totals = settle(first.groupBy(*by).agg(F.sum("m").alias("n")), "totals")
    wide = settle(_running(join_groups(first, totals, by).withColumn("start", F.lit(0).cast("long")), by, "wide"), "buckets")
    best, larger = _open_buckets(wide, by)
    start = settle(larger.select(*by, "wide", "n", (F.col("upto") - F.col("m")).alias("start")), "open")
    inside = join_groups(held.withColumn("wide", bucket(LEVEL_BITS)), start, [*by, "wide"], "inner")
    second = inside.withColumn("narrow", bucket(2 * LEVEL_BITS)).groupBy(*by, "wide", "narrow", "n", "start").agg(*sizes)
    narrow = settle(_running(second, [*by, "wide"], "narrow"), "buckets")
    sure = settle(best.unionByName(narrow.groupBy(*by).agg(F.max("least").alias("best"))).groupBy(*by).agg(F.max("best").alias("best")), "best")
    still = join_groups(narrow, sure, by).where(F.col("most") > F.col("best"))
    start = settle(still.select(*by, "narrow", "n", (F.col("upto") - F.col("m")).alias("start")), "open")
    values = join_groups(held.withColumn("narrow", bucket(2 * LEVEL_BITS)), start, [*by, "narrow"], "inner").groupBy(*by, "narrow", "n", "start", "tm_u").agg(F.count(F.lit(1)).alias("m"))
    ranked = _running(values.withColumns({"low": F.col("tm_u"), "high": F.col("tm_u")}), [*by, "narrow"], "tm_u")
    exact = ranked.groupBy(*by).agg(F.max("least").alias("best"))
    found = sure.unionByName(exact).groupBy(*by).agg(F.max("best").alias("ks"))
    return join_groups(totals, found, by).select(*by, "n", "ks")


def kolmogorov_p(ks: Column, n: Column) -> Column:
    """Tail of the limit distribution of the distance, with Stephens' correction for the number of values."""
    root = F.sqrt(n.cast("double"))
    x = ks * (root + 0.12 + 0.11 / root)

    def term(k: Column) -> Column:
        return F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x)

    total = F.aggregate(F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS)), F.lit(0.0), lambda a, k: a + term(k))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def residual_uniformity(df: DataFrame, scaled: str, by: Sequence[str] = (), draws: int = 250) -> DataFrame:
    """Tests of scaled residuals per group: n, ks, p_value, low and high outliers, how many are expected, spread.

    An outlier lies where fewer than one in ``draws`` + 1 simulated values would. ``spread`` is the
    variance over that of a uniform value: above 1 the response varies more than the model says.
    """
    if not by:
        return residual_uniformity(df.withColumn("tm_all", F.lit(0)), scaled, ["tm_all"], draws).drop("tm_all")
    by = list(by)
    u = F.col(scaled)
    end = 1.0 / (draws + 1)
    known = df.where(u.isNotNull() & ~F.isnan(u))
    tails = known.groupBy(*by).agg(
        F.count_if(u < end).alias("low_outliers"), F.count_if(u > 1 - end).alias("high_outliers"), (12 * F.var_pop(u)).alias("spread")
    )
    tested = settle(kolmogorov_distance(df, scaled, by), "distances").withColumns(
        {"p_value": kolmogorov_p(F.col("ks"), F.col("n")), "expected_outliers": F.col("n") * (2 * end)}
    )
    return join_groups(tested, settle(tails, "tails"), by)


def lm_diagnostics(df: DataFrame, fit: Fit, response: str) -> DataFrame:
    """Fitted value, residual, leverage, standardised residual and Cook's distance of every row of a linear model.

    The covariance of the estimates enters as literals, so this is one scan without a shuffle. A row
    that alone decides an estimate (leverage 1) has neither a standardised residual nor a distance.
    Rows that miss a variable of the model are left out.
    """
    if fit.family.name != "gaussian" or fit.covariance is None:
        raise ValueError("needs a gaussian fit with its covariance")
    defined = design_columns(fit.design)
    x = {name: defined.get(name, F.lit(1.0)) for name in fit.estimates}
    names = list(x)
    leverage = F.lit(0.0)
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            leverage = leverage + F.lit(float(fit.covariance[i, j]) * (1 if i == j else 2)) * x[a] * x[b]
    rows = pearson_rows(df, fit, response)
    for factor, levels in fit.design.factors.items():
        rows = rows.where(F.col(factor).isin(list(levels)))
    h = F.col("leverage")
    free = F.when(h < 1 - 1e-12, 1 - h)
    rows = rows.withColumn("leverage", leverage)
    rows = rows.withColumn("standardised", F.try_divide(F.col("residual"), F.sqrt(fit.dispersion * free)))
    return rows.withColumn("cook", F.col("standardised") * F.col("standardised") * h / free / len(names))
