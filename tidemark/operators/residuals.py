"""Residual tables of fitted models: simulated scaled residuals, trend over time, spread per level."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.tails import normal_two_sided
from tidemark.operators.combine import join_groups
from tidemark.operators.glm import Fit, fitted_mean
from tidemark.operators.quantiles import box_summary
from tidemark.session import settle

CHUNK = 2048


def cell_residuals(df: DataFrame, by: Sequence[str], value: str, name: str = "residual") -> DataFrame:
    """Add the difference from the mean of the row's cell, i.e. residuals of the saturated model."""
    means = settle(df.groupBy(*by).agg(F.avg(value).alias("tm_mean")), "cell_means")
    return join_groups(df, means, by).withColumn(name, F.col(value) - F.col("tm_mean")).drop("tm_mean")


def pearson_rows(df: DataFrame, fit: Fit, response: str) -> DataFrame:
    """Add fitted mean ``mu`` and response residual to rows that hold the model's variables."""
    used = df.na.drop("any", subset=[response, *fit.design.variables])
    return used.withColumn("mu", fitted_mean(fit, on_rows=True)).withColumn("residual", F.col(response) - F.col("mu"))


def _random_words(seeds: np.ndarray, draws: int) -> np.ndarray:
    """32 random bits by row and draw from a 64-bit mixing function of (row seed, place)."""
    places = (draws + 1) // 2
    with np.errstate(over="ignore"):
        step = np.arange(1, places + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = seeds.view(np.uint64)[:, None] + step[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        z ^= z >> np.uint64(31)
    return z.view(np.uint32)


def _share_below(words: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Share of a row's uniforms, held as 32-bit fractions, that lie below its level."""
    bar = np.minimum(level * 4294967296.0, 4294967295.0).astype(np.uint32)
    return np.count_nonzero(words < bar[:, None], axis=1) / words.shape[1]


def count_tails(cases: DataFrame) -> DataFrame:
    """``below`` = P(Y < y) and ``upto`` = P(Y <= y) next to each distinct case (tm_mu, tm_size, tm_y) of a count.

    Y is a negative binomial of mean tm_mu and size tm_size, or a Poisson where the size is infinite.
    Tails are running sums over the lattice 0, 1, ... of each distribution, up to its largest count;
    masses follow each other by their ratio, in logarithms, so neither large means nor large sizes
    break them. The work follows the distinct distributions and their counts, not the rows.
    """
    mu, size, k = F.col("tm_mu"), F.col("tm_size"), F.col("k")
    poisson = size == float("inf")
    tops = cases.where("tm_y >= 0").groupBy("tm_mu", "tm_size").agg(F.floor(F.max("tm_y")).alias("top"))
    lattice = tops.select("tm_mu", "tm_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("k"))
    first = F.when(poisson, -mu).otherwise(-size * F.log1p(mu / size))
    ratio = F.when(poisson, F.ln(mu / k)).otherwise(F.ln((k - 1 + size) / k) + F.ln(mu / (mu + size)))
    upwards = Window.partitionBy("tm_mu", "tm_size").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    logs = lattice.withColumn("step", F.when(k == 0, first).when(mu > 0, ratio).otherwise(float("-inf"))).withColumn("mass", F.exp(F.sum("step").over(upwards)))
    tails = logs.withColumn("upto", F.least(F.sum("mass").over(upwards), F.lit(1.0))).withColumnsRenamed({"tm_mu": "mu_", "tm_size": "size_"})
    joined = cases.join(tails, (mu == F.col("mu_")) & (size == F.col("size_")) & (F.floor("tm_y") == k), "left")
    upto = F.coalesce("upto", F.lit(0.0))
    whole = F.col("tm_y") == F.floor("tm_y")
    below = F.when(whole, F.greatest(upto - F.coalesce("mass", F.lit(0.0)), F.lit(0.0))).otherwise(upto)
    return joined.select("tm_mu", "tm_size", "tm_y", below.alias("below"), upto.alias("upto"))


def row_uniform(seed: int, keys: Sequence[str]) -> Column:
    """A number in (0, 1) from the hash of seed and row key, 52 bits."""
    named = [F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys]
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *named), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _count_residuals(rows: DataFrame, size: Column, columns: Sequence[str], u: Column) -> DataFrame:
    """``scaled``: the place of each row between the two tails of its count."""
    sized = rows.withColumns({"tm_size": size, "tm_mu": F.col("mu")})
    cases = settle(count_tails(sized.select("tm_mu", "tm_size", "tm_y").distinct()), "tails")
    tailed = sized.join(cases, ["tm_mu", "tm_size", "tm_y"])
    return tailed.withColumn("scaled", F.col("below") + u * (F.col("upto") - F.col("below"))).select(*columns)


def _tweedie_ranks(
    seeds: np.ndarray, y: np.ndarray, mu: np.ndarray, power: float, phi: np.ndarray, draws: int
) -> tuple[np.ndarray, np.ndarray]:
    """Simulated values below and equal to the observation, as shares: sums of a Poisson number of gammas."""
    rate = mu ** (2 - power) / (phi * (2 - power))
    shape = (2 - power) / (power - 1)
    unit = phi * (power - 1) * mu ** (power - 1)
    less, same = np.empty_like(mu), np.empty_like(mu)
    for i in range(len(y)):
        rng = np.random.Generator(np.random.Philox(key=int(seeds[i]) & 0xFFFFFFFFFFFFFFFF))
        hits = rng.poisson(rate[i], draws)
        draw = np.where(hits > 0, rng.gamma(np.maximum(hits, 1) * shape) * unit[i], 0.0)
        less[i], same[i] = (draw < y[i]).mean(), (draw == y[i]).mean()
    return less, same


def _scaled(pdf: pd.DataFrame, family: str, power: float, draws: int) -> np.ndarray:
    seeds = pdf["tm_seed"].to_numpy(dtype=np.int64)
    y, mu = pdf["tm_y"].to_numpy(dtype=float), pdf["mu"].to_numpy(dtype=float)
    phi = pdf["tm_phi"].to_numpy(dtype=float)
    words = _random_words(np.ascontiguousarray(seeds), draws + 2)
    words, tie = words[:, :draws], words[:, draws] / 4294967296.0
    if family == "tweedie":
        less, same = _tweedie_ranks(seeds, y, mu, power, phi, draws)
    else:
        z = (y - mu) / np.sqrt(2 * phi)
        less, same = _share_below(words, 0.5 * (1 + np.array([math.erf(v) for v in z]))), 0.0
    return less + tie * same


def simulated_residuals(
    df: DataFrame, fit: Fit, response: str, keys: Sequence[str], draws: int = 250, seed: int = 26
) -> DataFrame:
    """Add ``scaled``: the place of each observation in the distribution that the fit gives it.

    A count lies between two exact tails of its distribution, at a place that a hash of seed and row
    key gives (Dunn and Smyth 1996); this runs as joins and running sums, without Python. Other
    responses are placed among ``draws`` simulated ones, in small Arrow batches where the rows lie.
    Residuals of a right model are uniform. Numbers depend on seed and row key only. After a refit by
    dispersion, each row has the dispersion of its level.
    """
    rows = pearson_rows(df, fit, response)
    phi = F.lit(float(fit.dispersion))
    if fit.spread is not None:
        rows = join_groups(rows, fit.spread.withColumnRenamed("dispersion", "tm_level"), fit.spread_by, "inner")
        phi = phi * F.col("tm_level")
    rows = rows.withColumn("tm_phi", phi)
    rows = rows.withColumn("tm_seed", F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])).withColumn(
        "tm_y", F.col(response).cast("double")
    )
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("mu", "residual", "scaled")]])
    family = fit.family.name
    power = fit.family.power or 0.0
    columns = schema.names
    if family not in ("tweedie", "gaussian"):
        size = F.lit(float("inf"))
        if family == "negbin2":
            size = F.lit(float(fit.family.theta or 0.0))
        elif family == "negbin1":
            size = F.when(F.col("tm_phi") > 1, F.col("mu") / F.greatest(F.col("tm_phi") - 1, F.lit(1e-12))).otherwise(float("inf"))
        return _count_residuals(rows, size, columns, row_uniform(seed, keys))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                part = batch.iloc[start : start + CHUNK]
                yield part.assign(scaled=_scaled(part, family, power, draws))[columns]

    return rows.mapInPandas(simulate, schema)


def durbin_watson(df: DataFrame, residual: str, time: str, by: Sequence[str]) -> DataFrame:
    """Durbin-Watson statistic of the mean residual per time, centred, for each series.

    Rows are reduced to one per series and time before any ordering; ``z`` compares with the
    moments of the statistic under independence, ``p_value`` is its two-sided normal tail.
    """
    series = Window.partitionBy(*by)
    per_time = df.groupBy(*by, time).agg(F.avg(residual).alias("r"))
    steps = per_time.withColumn("r", F.col("r") - F.avg("r").over(series)).withColumn(
        "gap", F.col("r") - F.lag("r").over(series.orderBy(time))
    )
    n = F.col("n_times")
    return (
        steps.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_times"),
            F.try_divide(F.sum(F.col("gap") * F.col("gap")), F.sum(F.col("r") * F.col("r"))).alias("dw"),
        )
        .withColumn("r1", 1 - F.col("dw") / 2)
        .withColumn(
            "z", F.try_divide(F.col("dw") - 2, F.sqrt(F.try_divide(4.0 * (n - 2), (n - 1) * (n + 1.0))))
        )
        .withColumn("p_value", _normal_p_value("z"))
    )


@F.pandas_udf(T.DoubleType())
def _normal_p_value(z: pd.Series) -> pd.Series:
    return z.map(normal_two_sided, na_action="ignore").astype(float)


def residual_summary(df: DataFrame, residual: str, by: Sequence[str]) -> DataFrame:
    """Mean, deviation and box of the residuals per level of a factor or time."""
    return box_summary(df, by, residual, moments=True)


def dispersion_of_rows(df: DataFrame, residual: str, by: Sequence[str]) -> DataFrame:
    """Mean square of the residuals per level."""
    r = F.col(residual)
    return df.where(r.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(r * r).alias("dispersion")
    )
