import pytest
from pyspark.sql import functions as F

from tidemark.operators.allometry import curve_table
from tidemark.plans import grazers as Z
from tidemark.plans import figures as G
from tidemark.session import settle


@pytest.fixture(scope="module")
def pool(spark, raw):
    return settle(Z.weighed_pool(raw["sizes"], Z.published_curves(spark)))


def test_curves(raw):
    got = {r["species"]: r for r in Z.size_weight_curves(raw["weights"], raw["limpet_weights"]).collect()}
    expected = {
        "Siphonaria": (2.8318002785, -10.6002322910, 0.9365643231, 18),
        "Littorina": (2.4532788776, -9.6748227461, 0.9826330706, 32),
        "Lottia": (1.5532852942, -6.5113769278, 0.9035998822, 47),
    }
    for species, (slope, intercept, r2, n) in expected.items():
        r = got[species]
        assert r["n"] == n
        assert (r["slope"], r["intercept"], r["r2"]) == (pytest.approx(slope, abs=1e-8), pytest.approx(intercept, abs=1e-8), pytest.approx(r2, abs=1e-8))
        assert Z.ROUNDED_CURVES[species] == (pytest.approx(slope, abs=1e-4), pytest.approx(intercept, abs=1e-4))


def test_mean_pool_weights(spark, raw):
    expected = {
        "Siphonaria": {"Siphonaria": 0.0139336932, "Littorina": 0.0146493301, "Lottia": 0.0447737252},
        "Littorina": {"Siphonaria": 0.0008050014, "Littorina": 0.0012202968, "Lottia": 0.0090917409},
        "Lottia": {"Siphonaria": 0.0112010309, "Littorina": 0.0123252264, "Lottia": 0.0411891284},
    }
    for curve in ("Siphonaria", "Littorina", "Lottia"):
        curves = curve_table(spark, {s: Z.ROUNDED_CURVES[curve] for s in Z.GRAZERS})
        means = Z.weighed_pool(raw["sizes"], curves).groupBy("species").agg(F.avg("dw_g").alias("m")).collect()
        for r in means:
            assert r["m"] == pytest.approx(expected[r["species"]][curve], abs=1e-9)


def test_biomass(abundance, pool):
    weights = settle(Z.abundance_weights(abundance, pool))
    expected = Z.expected_weights(abundance, pool)
    assert weights.count() == 612
    assert weights.where("total_dw_g is null").count() == 0
    assert weights.where("count = 0 and total_dw_g <> 0").count() == 0
    assert weights.where("count > 0 and total_dw_g <= 0").count() == 0
    biomass = Z.herbivore_biomass(weights)
    assert biomass.count() == 492
    drawn = biomass.agg(F.sum("biomass_g")).first()[0]
    mean = expected.agg(F.sum("total_dw_g")).first()[0]
    # 3475 draws: a few percent
    assert drawn == pytest.approx(mean, rel=0.1)
    assert G.biomass(biomass).count() == 42


def test_shipped_biomass_used_the_same_curves(find, abundance, pool):
    from tidemark.sources.schemas import _layout

    shipped = find(
        _layout("plot_location:s|location:s|timediff:d|plot:i|block:s|barnacles:s|biomass_g:d"), "plot_location", "location"
    ).agg(F.sum("biomass_g")).first()[0]
    mean = Z.expected_weights(abundance, pool).agg(F.sum("total_dw_g")).first()[0]
    assert shipped == pytest.approx(mean, rel=0.05)


def test_draws_do_not_depend_on_partitions(abundance, pool):
    one = Z.abundance_weights(abundance.repartition(1), pool.repartition(3))
    many = Z.abundance_weights(abundance.repartition(7), pool.repartition(1))
    sums = [
        {tuple(r[k] for k in Z.ROW_KEYS) + (r["species"],): round(r["total_dw_g"], 12) for r in w.collect()} for w in (one, many)
    ]
    assert sums[0] == sums[1]


def test_mean_over_seeds_approaches_the_expected_total(spark, pool):
    from tidemark.operators.bootstrap import bootstrap_total, expected_total, number_pool

    rows = spark.range(2000).select(F.col("id"), F.lit("Siphonaria").alias("species"), F.lit(10.0).alias("count"))
    numbered = number_pool(pool, "species", ["size_mm", "copy"])
    drawn = bootstrap_total(rows, numbered, ["id"], "species", "count", "dw_g").agg(F.avg("total")).first()[0]
    mean = expected_total(rows, pool, "species", "count", "dw_g").first()["expected"]
    assert drawn == pytest.approx(mean, rel=0.02)


def test_size_histogram(raw):
    rows = G.size_histogram(Z.size_table(raw["sizes"])).where("species = 'Siphonaria'").collect()
    assert {r["bin"]: r["n"] for r in rows} == {
        4: 6, 5: 24, 6: 65, 7: 78, 8: 69, 9: 68, 10: 89, 11: 55, 12: 30, 13: 14, 14: 9, 15: 4, 16: 3, 17: 1,
    }


def test_allometry_line(raw):
    rows = G.allometry_line(raw["limpet_weights"]).orderBy("step").collect()
    assert len(rows) == 80
    slope = (rows[-1]["fit"] - rows[0]["fit"]) / (rows[-1]["at"] - rows[0]["at"])
    assert slope == pytest.approx(2.8318002785)
    middle = rows[40]
    assert middle["lo"] < middle["fit"] < middle["hi"]
    # t quantile for 16 degrees of freedom
    assert (middle["hi"] - middle["fit"]) / middle["se"] == pytest.approx(2.1199, abs=1e-4)
