"""Every operator as a query over the star-schema and event tables.

A survey row is a line item (treatments ``l_returnflag`` and ``l_linestatus``, date
``l_shipdate``), a logger reading an event (site ``event_type``, logger ``user_id``), and a
measured animal a part (species ``p_brand``, size ``p_size``). Money and readings are turned
into whole cents where means are taken, so that sums are exact whatever their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import days_to_anchor, us_date
from tidemark.functions.labels import composite_key, label_of, level_index, recode, relabel, within_levels
from tidemark.functions.logit import with_logit
from tidemark.operators import bootstrap as B
from tidemark.operators import combine as J
from tidemark.operators import reshape as R
from tidemark.operators.allometry import curve_weight, fit_loglog, predict_loglog, regression_band
from tidemark.operators.design import Design, crossed, design_matrix, model_table
from tidemark.operators.diagnostics import lm_diagnostics, residual_uniformity
from tidemark.operators.elapsed import since_start
from tidemark.operators.glm import (
    Family,
    Fit,
    coef_table,
    dispersion_by_level,
    fit_glm,
    fit_negbin2_likelihood,
    refit_by_dispersion,
    tweedie_power,
    value_counts,
)
from tidemark.operators.oneway import anova_oneway, oneway_ols
from tidemark.operators.quality import dictionary_violations, violations
from tidemark.operators.quantiles import box_outliers, box_summary, exact_percentiles
from tidemark.operators.residuals import (
    cell_residuals,
    dispersion_of_rows,
    durbin_watson,
    residual_summary,
    simulated_residuals,
)
from tidemark.operators.summaries import cell_summary, daily_peak_band, histogram, mean_of_daily_peaks, monthly_mean
from tidemark.operators.terms import drop_table, drop_terms, type2_tests, wald_tests
from tidemark.session import scratch_path, settle
from tidemark.sources.tables import UNREADABLE, read_csv_checked, write_csv, write_partitioned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE_KEYS = ["l_orderkey", "l_linenumber"]
# Fixed values of the driver tables.
FLAGS, STATUSES = ["A", "N", "R"], ["F", "O"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a ship date and its year."""
    return table(spark, sf, "lineitem").withColumn("ship_date", F.col("l_shipdate").cast("date")).withColumn(
        "ship_year", F.year("ship_date")
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as logger readings in whole cents."""
    return table(spark, sf, "events").select(
        "event_type", "user_id", F.col("ts").cast("date").alias("day"), "value", cents("value").alias("cents")
    )


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def rounded(df: DataFrame, digits: int, *columns: str, scale: float = 1.0) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) / scale, digits) for c in columns})


# --- scans, sinks, checks ------------------------------------------------------------------


@query("scan")
def scan(spark, sf):
    return lines(spark, sf).select(
        *LINE_KEYS, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "ship_date"
    )


@query("sink_roundtrip")
def sink_roundtrip(spark, sf):
    path = scratch_path(spark, "lines")
    columns = [*LINE_KEYS, "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "ship_date"]
    df = lines(spark, sf).select(*columns)
    write_partitioned(df, path, ["l_returnflag", "l_linestatus"])
    return spark.read.schema(df.schema).parquet(path).select(*columns)


@query("csv_roundtrip")
def csv_roundtrip(spark, sf):
    """Line items through CSV files in which fields are missing, or are no values of their type."""
    quantity, day = F.col("l_quantity").cast("int").cast("string"), F.col("ship_date")
    line = F.col("l_linenumber")
    text = lines(spark, sf).select(
        *LINE_KEYS,
        "l_partkey",
        F.when(line == 7, F.concat(quantity, F.lit("x"))).otherwise(quantity).alias("quantity"),
        F.nullif(F.col("l_tax"), F.lit(0.08)).alias("tax"),
        F.when(line == 6, F.date_format(day, "dd.MM.yyyy")).otherwise(day.cast("string")).alias("ship_date"),
        "l_returnflag",
    )
    path = scratch_path(spark, "lines_csv")
    write_csv(text, path)
    kinds = {"quantity": T.IntegerType(), "tax": T.DoubleType(), "ship_date": T.DateType()}
    layout = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in text.schema])
    faults = F.array_join(F.transform(UNREADABLE, lambda x: F.concat_ws("=", x["field"], x["value"])), ";")
    return read_csv_checked(spark, path, layout).withColumn(UNREADABLE, faults)


@query("quality_codes")
def quality_codes(spark, sf):
    df = lines(spark, sf).withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.08)))
    return violations(
        df,
        [*LINE_KEYS, "l_partkey"],
        codes={"l_returnflag": ["A", "N"], "l_linestatus": STATUSES},
        ranges={"l_quantity": (1.0, 45.0), "l_discount": (0.0, 0.09)},
        required=["l_tax"],
        rules={"shipped late": F.col("ship_year") > 2000},
    )


@query("quality_dictionary")
def quality_dictionary(spark, sf):
    """Lines against codes and ranges that come from tables: known flags, the lower half of quantities."""
    df = lines(spark, sf)
    old = df.where(F.col("l_returnflag") < "R")
    codes = old.select(F.lit("l_returnflag").alias("field"), F.col("l_returnflag").alias("code")).union(
        df.where("l_quantity < 2").select(F.lit("l_linestatus").alias("field"), F.col("l_linestatus").alias("code"))
    )
    ends = old.agg(F.min("l_quantity").alias("low"), F.avg("l_quantity").alias("high"))
    ranges = ends.select(F.lit("l_quantity").alias("field"), F.col("low").cast("double"), F.col("high").cast("double"))
    keys = [*LINE_KEYS, "l_partkey"]
    found = dictionary_violations(df, keys, ["l_returnflag", "l_linestatus", "l_quantity", "l_tax"], codes.distinct(), ranges)
    return found.withColumn("value", F.when(F.col("rule") == "range", F.col("value").cast("double").cast("bigint").cast("string")).otherwise(F.col("value")))


# --- reshape and union -----------------------------------------------------------------------


@query("unpivot_fill")
def unpivot_fill(spark, sf):
    df = lines(spark, sf).withColumns(
        {"l_discount": F.nullif(F.col("l_discount"), F.lit(0.05)), "l_tax": F.nullif(F.col("l_tax"), F.lit(0.02))}
    )
    return R.to_long(df, LINE_KEYS, ["l_discount", "l_tax"], "measure", "amount", fill=0.0)


@query("unpivot_prefix_date")
def unpivot_prefix_date(spark, sf):
    orders = table(spark, sf, "orders").withColumn("month", F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd"))
    ends = orders.agg(F.min("month"), F.max("month")).first()
    first, last = ([int(x) for x in e.split("-")[:2]] for e in ends)
    months = [f"{m // 12}-{m % 12 + 1:02d}-01" for m in range(first[0] * 12 + first[1] - 1, last[0] * 12 + last[1])]
    wide = R.to_wide(
        orders.withColumn("cents", cents("o_totalprice")), ["o_orderpriority", "o_orderstatus"], "month", months, "cents", "sum"
    )
    return R.to_long_by_prefix(wide, ["o_orderpriority", "o_orderstatus"], tuple(months), "month", "cents")


@query("two_family_union")
def two_family_union(spark, sf):
    families = {"count": ["l_quantity", "l_linenumber"], "rate": ["l_discount", "l_tax"]}
    return R.families_to_long(table(spark, sf, "lineitem"), [*LINE_KEYS, "l_returnflag"], families, "measure")


@query("pivot_wide")
def pivot_wide(spark, sf):
    wide = R.to_wide(readings(spark, sf), ["user_id"], "event_type", None, "cents", "mean")
    return rounded(wide, 8, *wide.columns[1:], scale=100.0)


@query("pivot_wide_map")
def pivot_wide_map(spark, sf):
    """Levels without a bound: purchases by brand and part size, a map per brand."""
    part = table(spark, sf, "part")
    wide = R.to_wide_map(part, ["p_brand"], "p_size", "p_partkey", "max", "sizes")
    entries = F.array_join(F.transform(F.map_entries("sizes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return wide.select("p_brand", entries.alias("sizes"))


# --- labels, keys, levels --------------------------------------------------------------------


@query("relabel_ordered")
def relabel_ordered(spark, sf):
    # each rule sees what the rules before it made: URGENT ends as "Top"
    rules = {"URGENT": "HIGH", "HIGH": "Top", "[0-9]-": "", "NOT SPECIFIED": "None"}
    return table(spark, sf, "orders").select("o_orderkey", relabel(F.col("o_orderpriority"), rules).alias("label"))


@query("relabel_map")
def relabel_map(spark, sf):
    codes = {"ECONOMY": "Control", "SMALL": "Inclusion", "LARGE": "Exclusion"}
    return table(spark, sf, "part").select("p_partkey", recode(F.col("p_type"), codes).alias("label"))


@query("composite_key")
def composite_keys(spark, sf):
    part = table(spark, sf, "part").withColumn("size", F.nullif(F.col("p_size"), F.lit(1)))
    return part.select("p_partkey", composite_key("size", "p_brand").alias("key"), label_of("p_type", "size").alias("label"))


@query("ordered_levels")
def ordered_levels(spark, sf):
    levels = ["R", "A"]  # N is outside and becomes missing
    df = lines(spark, sf).withColumn("flag", within_levels(F.col("l_returnflag"), levels))
    cells = df.groupBy("flag", "ship_year").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))
    return cells.withColumn("place", level_index(F.col("flag"), levels)).orderBy("place", "ship_year")


@query("distinct_levels")
def distinct_levels(spark, sf):
    return J.distinct_values(table(spark, sf, "part"), "p_type", "p_brand").orderBy("p_type", "p_brand")


# --- filters ---------------------------------------------------------------------------------


@query("exclude_keep_null")
def exclude_keep_null(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("notes")
    )
    return J.drop_containing(orders, "notes", "URGENT")


@query("conditional_exclude")
def conditional_exclude(spark, sf):
    df = lines(spark, sf).select(*LINE_KEYS, "l_returnflag", "l_linestatus", "l_quantity")
    return J.drop_when(df, (F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "O"))


@query("date_set_subset")
def date_set_subset(spark, sf):
    month = F.month("ship_date")
    keep = ((F.col("l_linestatus") == "F") & month.isin(3, 9)) | ((F.col("l_linestatus") == "O") & month.isin(4, 10))
    return lines(spark, sf).where(keep).select(*LINE_KEYS, "l_linestatus", "ship_date", "l_quantity")


@query("drop_any_null")
def drop_any_null(spark, sf):
    df = lines(spark, sf).select(
        *LINE_KEYS,
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"),
    )
    return J.drop_incomplete(df)


@query("distinct_rows")
def distinct_rows(spark, sf):
    df = lines(spark, sf).select(
        "l_returnflag", "l_linestatus", F.nullif(F.col("l_linenumber"), F.lit(7)).alias("line"), "l_suppkey", "ship_year"
    )
    return J.distinct_rows(df)


# --- elapsed time ----------------------------------------------------------------------------


@query("weeks_since_start")
def weeks_since_start(spark, sf):
    df = since_start(lines(spark, sf), "ship_date", ["l_returnflag"])
    return df.select(*LINE_KEYS, "l_returnflag", "days", "timediff")


@query("days_to_anchor")
def anchor_days(spark, sf):
    anchors = {"A": "1998-06-21", "N": "1997-12-21", "R": "1999-03-20"}
    return lines(spark, sf).select(
        *LINE_KEYS, days_to_anchor(F.col("ship_date"), F.col("l_returnflag"), anchors).alias("days")
    )


@query("parse_us_date")
def parse_us_date(spark, sf):
    text = F.date_format("o_orderdate", "M/d/yyyy")
    return table(spark, sf, "orders").select("o_orderkey", us_date(text).alias("order_date"))


# --- summaries -------------------------------------------------------------------------------


@query("monthly_mean_range")
def monthly_mean_range(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_orderstatus", cents("o_totalprice").alias("price")
    )
    out = monthly_mean(orders, "year", "month", "price", ["o_orderstatus"], first_year=1996, before_year=2001)
    return rounded(out, 6, "price", scale=100.0)


@query("cell_mean_se")
def cell_mean_se(spark, sf):
    cells = cell_summary(lines(spark, sf), ["l_returnflag", "l_linestatus", "ship_year"], "l_quantity")
    return rounded(cells.withColumn("label", label_of("l_returnflag", "l_linestatus")), 8, "av", "sd", "se", "lo", "hi")


@query("cell_mean_missing")
def cell_mean_missing(spark, sf):
    """Mean and error where a missing value makes a cell's result missing, next to those that skip it."""
    df = lines(spark, sf).withColumn("q", F.when(~((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "R")), F.col("l_quantity")))
    by = ["l_returnflag", "l_linestatus"]
    strict = cell_summary(df, by, "q").select(*by, "n", "av", "se")
    loose = cell_summary(df, by, "q", na_rm=True, prefix="rm_").select(*by, "rm_av", "rm_se")
    return rounded(J.full_join(strict, loose, by), 8, "av", "se", "rm_av", "rm_se")


@query("daily_max_mean")
def daily_max_mean(spark, sf):
    out = mean_of_daily_peaks(readings(spark, sf), ["event_type", "user_id"], "day", "cents")
    return rounded(out, 8, "adm", scale=100.0)


@query("daily_series_band")
def daily_series_band(spark, sf):
    out = daily_peak_band(readings(spark, sf), ["event_type"], "day", "user_id", "cents")
    return rounded(out, 8, "av", "sd", "se", "lo", "hi", scale=100.0)


@query("p99_by_group")
def p99_by_group(spark, sf):
    out = exact_percentiles(readings(spark, sf), ["event_type", "user_id"], "cents", [0.99])
    return rounded(out, 8, "p99", scale=100.0)


@query("box_summary")
def box(spark, sf):
    out = box_summary(readings(spark, sf), ["event_type"], "cents")
    return rounded(out, 8, "q1", "median", "q3", "whisker_low", "whisker_high", scale=100.0)


@query("box_outliers")
def box_outlier_rows(spark, sf):
    return box_outliers(readings(spark, sf), ["event_type"], "cents")


@query("histogram_fixed")
def histogram_fixed(spark, sf):
    return histogram(readings(spark, sf), ["event_type"], "value", width=10.0)


@query("logit_summary")
def logit_summary(spark, sf):
    df = with_logit(lines(spark, sf).withColumn("cover", F.col("l_discount") * 1000), "cover", "logit_cover")
    cells = cell_summary(df, ["l_returnflag", "l_linestatus", "ship_year"], "logit_cover")
    return rounded(cells, 8, "av", "sd", "se", "lo", "hi")


# --- joins of summaries ----------------------------------------------------------------------


@query("full_join_summaries")
def full_join_summaries(spark, sf):
    keys, df = ["event_type", "user_id"], readings(spark, sf)
    both = J.full_join(
        exact_percentiles(df, keys, "cents", [0.99]), mean_of_daily_peaks(df, keys, "day", "cents"), keys
    )
    return rounded(both, 8, "p99", "adm", scale=100.0)


@query("full_join_nullsafe")
def full_join_nullsafe(spark, sf):
    def counted(status: Column, hidden: str, name: str) -> DataFrame:
        key = F.nullif(F.col("o_orderpriority"), F.lit(hidden)).alias("priority")
        return orders.where(status).groupBy(key).agg(F.count(F.lit(1)).alias(name))

    orders = table(spark, sf, "orders")
    is_open = F.col("o_orderstatus") == "O"
    return J.full_join(counted(is_open, "5-LOW", "open"), counted(~is_open, "1-URGENT", "closed"), ["priority"])


def _monthly_cells(spark, sf):
    df = lines(spark, sf).withColumn("ship_month", F.trunc("ship_date", "month"))
    cells = cell_summary(df, ["l_returnflag", "l_linestatus", "ship_month"], "l_quantity")
    months = J.distinct_values(df.where(F.month("ship_date").isin(3, 9)), "ship_month")
    return rounded(cells.select("l_returnflag", "l_linestatus", "ship_month", "n", "av"), 8, "av"), months


@query("analysed_semi")
def analysed_semi(spark, sf):
    cells, months = _monthly_cells(spark, sf)
    return J.keep_matching(cells, months, ["ship_month"])


@query("nonanalysed_anti")
def nonanalysed_anti(spark, sf):
    cells, months = _monthly_cells(spark, sf)
    return J.keep_unmatched(cells, months, ["ship_month"])


# --- size to weight --------------------------------------------------------------------------


@query("loglog_fit")
def loglog_fit(spark, sf):
    return rounded(fit_loglog(lines(spark, sf), ["l_returnflag"], "l_quantity", "l_extendedprice"), 8, "slope", "intercept", "r2")


@query("loglog_predict")
def loglog_predict(spark, sf):
    df = lines(spark, sf)
    curves = fit_loglog(df, ["l_returnflag"], "l_quantity", "l_extendedprice")
    out = predict_loglog(df, curves, ["l_returnflag"], "l_quantity", "price")
    return rounded(out.select(*LINE_KEYS, "l_returnflag", "l_quantity", "price"), 2, "price")


@query("regression_band")
def regression_bands(spark, sf):
    logs = lines(spark, sf).select("l_returnflag", F.ln("l_quantity").alias("x"), F.ln("l_extendedprice").alias("y"))
    band = regression_band(logs, ["l_returnflag"], "x", "y", critical=1.96)
    return rounded(band, 8, "at", "fit", "se", "lo", "hi")


def _pool(spark, sf):
    """Parts as a pool of measured animals, weighed on one curve."""
    part = table(spark, sf, "part").withColumns({"slope": F.lit(1.55), "intercept": F.lit(-6.5)})
    return part.select("p_partkey", "p_brand", curve_weight(F.col("p_size")).alias("weight"))


def _counts(spark, sf):
    """Line items as survey counts of the brand they order."""
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines(spark, sf).join(brands, "l_partkey").select(
        *LINE_KEYS, "l_partkey", "l_suppkey", "l_extendedprice", "ship_date", "l_returnflag", "p_brand", "l_quantity"
    )


@query("expected_total")
def expected_totals(spark, sf):
    totals = B.expected_total(_counts(spark, sf), _pool(spark, sf), "p_brand", "l_quantity", "weight")
    out = totals.groupBy("p_brand", "l_returnflag").agg(
        F.sum("l_quantity").cast("bigint").alias("animals"), F.sum("expected").alias("expected")
    )
    return rounded(out, 6, "expected")


@query("bootstrap_total")
def bootstrap_totals(spark, sf):
    pool = B.number_pool(_pool(spark, sf), "p_brand", ["p_partkey"])
    keys = [*LINE_KEYS, "l_partkey", "l_suppkey", "ship_date"]
    totals = B.bootstrap_total(
        _counts(spark, sf), pool, keys, "p_brand", "l_quantity", "weight", seed=26, carry=["l_extendedprice", "l_returnflag"]
    )
    out = totals.groupBy("p_brand", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))
    return rounded(out, 6, "total")


# --- one-factor models -----------------------------------------------------------------------


@query("oneway_ols")
def oneway_coefficients(spark, sf):
    out = oneway_ols(readings(spark, sf), "event_type", "cents", "click").drop("p_value")  # SQL has no such tails
    return rounded(out, 6, "estimate", "se", "t_value", "r2")


@query("anova_oneway")
def oneway_anova(spark, sf):
    out = anova_oneway(readings(spark, sf), "event_type", "value").drop("p_value")  # SQL has no such tails
    return rounded(rounded(out, 3, "ss_between", "ss_within", "ms_between", "ms_within"), 8, "f_value", "r2")


# --- design tables and generalised linear models ----------------------------------------------


def _design(order: int | None = None, time: bool = True) -> Design:
    covariates = ["years"] if time else []
    return crossed({"l_returnflag": FLAGS, "l_linestatus": STATUSES}, covariates, order)


def _model_rows(spark, sf):
    return lines(spark, sf).withColumn("years", (F.datediff("ship_date", F.lit("1995-01-01").cast("date")) / 91).cast("int") / 4.0)


def _fit(spark, sf, family: Family, response: str, order: int | None = None, time: bool = True) -> Fit:
    design, rows = _design(order, time), _model_rows(spark, sf)
    if response == "logit_cover":
        rows = with_logit(rows.withColumn("cover", F.col("l_discount") * 1000), "cover", "logit_cover")
    cells = model_table(rows, design, response)
    return fit_glm(cells, design, family)


def _saturated(spark, sf, family: Family, response: str) -> DataFrame:
    """Two crossed factors without time: the estimates are contrasts of cell means."""
    out = coef_table(spark, _fit(spark, sf, family, response, time=False)).drop("p_value")
    return rounded(out, 6, "estimate", "se", "statistic")


@query("design_matrix")
def design_table(spark, sf):
    rows = lines(spark, sf).withColumn("quantity", F.col("l_quantity"))
    design = crossed({"l_returnflag": FLAGS, "l_linestatus": STATUSES}, ["quantity"], 3)
    return design_matrix(rows, design, LINE_KEYS)


@query("coef_table")
def coefficients(spark, sf):
    return _saturated(spark, sf, Family("gaussian"), "l_quantity")


@query("glm_tweedie_cells")
def glm_tweedie_cells(spark, sf):
    return _saturated(spark, sf, Family("tweedie", power=1.5), "l_discount")


@query("glm_quasipoisson_cells")
def glm_quasipoisson_cells(spark, sf):
    return _saturated(spark, sf, Family("negbin1"), "l_quantity")


@query("glm_negbin2_cells")
def glm_negbin2_cells(spark, sf):
    return _saturated(spark, sf, Family("negbin2"), "l_quantity")


@query("glm_logit_gaussian_cells")
def glm_logit_gaussian_cells(spark, sf):
    return _saturated(spark, sf, Family("gaussian"), "logit_cover")


@query("glm_gaussian_slopes")
def glm_gaussian_slopes(spark, sf):
    """A line in time per flag in one model: contrasts of the separate fits."""
    design = crossed({"l_returnflag": FLAGS}, ["years"])
    fit = fit_glm(model_table(_model_rows(spark, sf), design, "l_quantity"), design, Family("gaussian"))
    return rounded(coef_table(spark, fit).drop("p_value"), 6, "estimate", "se", "statistic")


@query("glm_tweedie")
def glm_tweedie(spark, sf):
    design, rows = _design(3), _model_rows(spark, sf)
    cells = model_table(rows, design, "l_discount")
    power = tweedie_power(cells, ["l_returnflag", "l_linestatus", "years"])
    return coef_table(spark, fit_glm(cells, design, Family("tweedie", power=power)))


@query("glm_quasipoisson")
def glm_quasipoisson(spark, sf):
    return coef_table(spark, _fit(spark, sf, Family("negbin1"), "l_quantity"))


@query("glm_negbin2")
def glm_negbin2(spark, sf):
    return coef_table(spark, _fit(spark, sf, Family("negbin2"), "l_quantity"))


@query("glm_logit_gaussian")
def glm_logit_gaussian(spark, sf):
    return coef_table(spark, _fit(spark, sf, Family("gaussian"), "logit_cover"))


@query("drop_terms")
def term_dropping(spark, sf):
    return drop_table(spark, drop_terms(_fit(spark, sf, Family("negbin1"), "l_quantity", order=2))[1])


@query("type2_tests")
def type2_table(spark, sf):
    return type2_tests(spark, _fit(spark, sf, Family("gaussian"), "l_quantity", order=2))


@query("wald_tests")
def wald_table(spark, sf):
    """Type-II Wald tests of two crossed factors in a count model."""
    out = wald_tests(spark, _fit(spark, sf, Family("negbin1"), "l_quantity", time=False)).drop("p_value")  # SQL has no such tails
    return rounded(out, 6, "statistic")


@query("glm_negbin2_likelihood")
def glm_negbin2_likelihood(spark, sf):
    """A negative binomial by flag, its size at the maximum of the likelihood."""
    rows, design = lines(spark, sf), crossed({"l_returnflag": FLAGS})
    fit = fit_negbin2_likelihood(model_table(rows, design, "l_quantity"), value_counts(rows, design, "l_quantity"), design)
    out = coef_table(spark, fit).drop("p_value").withColumn("theta", F.lit(fit.family.theta))
    return rounded(out, 6, "estimate", "se", "statistic", "theta")


@query("dispersion_cells")
def dispersion_cells(spark, sf):
    """Pearson dispersion of a count model per level, from design cells."""
    fit = _fit(spark, sf, Family("negbin1"), "l_quantity", time=False)
    return rounded(dispersion_by_level(fit, ["l_linestatus"]), 6, "dispersion")


@query("dispersion_refit")
def dispersion_refit(spark, sf):
    fit = _fit(spark, sf, Family("negbin1"), "l_quantity")
    return coef_table(spark, refit_by_dispersion(fit, ["l_returnflag"]))


# --- residuals -------------------------------------------------------------------------------


def _residual_rows(spark, sf):
    return cell_residuals(lines(spark, sf), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("dispersion_by_level")
def dispersion_levels(spark, sf):
    return rounded(dispersion_of_rows(_residual_rows(spark, sf), "residual", ["l_returnflag", "ship_year"]), 8, "dispersion")


@query("durbin_watson")
def durbin_watson_series(spark, sf):
    out = durbin_watson(_residual_rows(spark, sf), "residual", "ship_date", ["l_returnflag"]).drop("p_value")  # SQL has no such tails
    return rounded(out, 8, "dw", "r1", "z")


@query("residual_summary")
def residual_boxes(spark, sf):
    out = residual_summary(_residual_rows(spark, sf), "residual", ["l_returnflag", "ship_year"])
    return rounded(out, 8, "q1", "median", "q3", "whisker_low", "whisker_high", "av", "sd")


@query("sim_residuals")
def simulated_residual_rows(spark, sf):
    fit = _fit(spark, sf, Family("negbin1"), "l_quantity")
    rows = _model_rows(spark, sf).select(*LINE_KEYS, "l_partkey", "l_returnflag", "l_linestatus", "years", "l_quantity")
    return simulated_residuals(rows, fit, "l_quantity", [*LINE_KEYS, "l_partkey"])


def _scaled_cells(spark, sf):
    """Scaled residuals of a saturated count model."""
    fit = _fit(spark, sf, Family("negbin1"), "l_quantity", time=False)
    rows = lines(spark, sf).select(*LINE_KEYS, "l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    return simulated_residuals(rows, fit, "l_quantity", [*LINE_KEYS, "l_partkey"])


@query("sim_residuals_cells")
def simulated_residual_cells(spark, sf):
    """Where the residuals of a saturated count model lie: rows per tenth, which a right model fills alike."""
    scaled = _scaled_cells(spark, sf)
    tenth = F.least(F.floor(F.col("scaled") * 10), F.lit(9)).cast("int").alias("tenth")
    out = scaled.groupBy("l_returnflag", "l_linestatus", tenth).agg(F.count("*").alias("n"), F.avg("scaled").alias("av"))
    return rounded(out, 6, "av")


@query("residual_uniformity")
def residual_uniformity_tests(spark, sf):
    scaled = settle(_scaled_cells(spark, sf).select("l_returnflag", "l_linestatus", "scaled"), "scaled")
    out = residual_uniformity(scaled, "scaled", ["l_returnflag", "l_linestatus"])
    return rounded(out, 6, "ks", "p_value", "expected_outliers", "spread")


@query("lm_diagnostics")
def linear_diagnostics(spark, sf):
    """Leverage and influence of every line in a model with a line in time per flag."""
    design, rows = crossed({"l_returnflag": FLAGS}, ["years"]), _model_rows(spark, sf)
    fit = fit_glm(model_table(rows, design, "l_quantity"), design, Family("gaussian"))
    out = lm_diagnostics(rows.select(*LINE_KEYS, "l_partkey", "l_returnflag", "years", "l_quantity"), fit, "l_quantity")
    out = out.withColumns({"leverage": F.col("leverage") * 1000, "cook": F.col("cook") * 1000})
    return rounded(out.drop("years"), 6, "mu", "residual", "leverage", "standardised", "cook")
