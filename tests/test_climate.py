import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.oneway import f_p_value, t_p_value
from tidemark.plans import climate as C
from tidemark.sources.schemas import LOGGER_READINGS, _layout


def test_humidity_equals_shipped_table(raw, find):
    shipped = find(_layout("year:i|month:i|humidity:d|site:s"), "year", "month", "humidity", "site", records=120)
    ours = C.humidity_clean(raw["native_humidity"], raw["invaded_humidity"])
    assert ours.count() == 120
    sizes = {r["site"]: r["count"] for r in ours.groupBy("site").count().collect()}
    assert sizes == {"BS": 60, "NG": 60}
    keys = ["year", "month", "site"]
    near = ours.join(shipped.withColumnRenamed("humidity", "h"), keys).where(F.abs(F.col("humidity") - F.col("h")) < 1e-7)
    assert near.count() == 120


def test_humidity_model(raw):
    hum = C.humidity_clean(raw["native_humidity"], raw["invaded_humidity"])
    coefs, anova = C.site_contrast(hum, "humidity", "BS")
    rows = {r["term"]: r for r in coefs.withColumn("p", t_p_value("t_value", F.col("df").cast("double"))).collect()}
    assert rows["intercept"]["estimate"] == pytest.approx(87.589624858, abs=1e-7)
    assert rows["NG"]["estimate"] == pytest.approx(-34.524624858, abs=1e-7)
    assert rows["NG"]["r2"] == pytest.approx(0.907484089, abs=1e-8)
    assert rows["NG"]["p"] < 1e-50
    a = anova.withColumn("p", f_p_value("f_value", F.col("df_between").cast("double"), F.col("df_within").cast("double"))).first()
    assert (a["df_between"], a["df_within"]) == (1, 118)
    assert a["ss_between"] == pytest.approx(35758.491647749, rel=1e-9)
    assert a["ss_within"] == pytest.approx(3645.495790487, rel=1e-9)
    assert a["f_value"] == pytest.approx(1157.456284944, rel=1e-9)
    assert a["f_value"] == pytest.approx(rows["NG"]["t_value"] ** 2)


def test_humidity_box(raw):
    hum = C.humidity_clean(raw["native_humidity"], raw["invaded_humidity"])
    box = {r["site"]: r for r in C.humidity_box(hum).collect()}
    assert (box["BS"]["q1"], box["BS"]["median"], box["BS"]["q3"]) == (
        pytest.approx(84.948104508), pytest.approx(87.992685314), pytest.approx(90.324317744),
    )
    assert (box["NG"]["q1"], box["NG"]["median"], box["NG"]["q3"]) == (47.5, pytest.approx(53.05), pytest.approx(57.675))


def test_temperature(spark):
    native = spark.createDataFrame(
        [("6/20/2006", "10:00:00", 1, 10.0), ("06/20/2006", "11:00:00", 1, 14.0), ("6/22/2006", "10:00:00", 1, 20.0),
         ("6/22/2006", "10:00:00", 2, 30.0), ("6/22/2006", None, 2, 99.0)],
        LOGGER_READINGS,
    )
    invaded = spark.createDataFrame([("2005-12-20", "10:00:00", 3, 7.0), ("2005-12-20", "11:00:00", 3, None)], LOGGER_READINGS)
    temp = C.temperature_clean(native, invaded, {"BP": "2006-06-21", "PA": "2005-12-21"})
    assert temp.count() == 6
    assert {r["dss"] for r in temp.collect()} == {-1, 1}
    assert temp.where("number = 1").first()["date_ibutton"] == dt.date(2006, 6, 20)
    rows = {(r["site"], r["number"]): r for r in C.logger_summary(temp).collect()}
    assert rows[("BP", 1)]["adm"] == 17.0
    assert rows[("BP", 1)]["nnquant"] == pytest.approx(14 + 0.98 * 6)
    assert rows[("PA", 3)]["adm"] == 7.0
    band = C.temperature_band(temp).where("site = 'BP' and dss = 1").first()
    assert (band["av"], band["se"], band["lo"], band["hi"]) == (25.0, 5.0, 20.0, 30.0)
