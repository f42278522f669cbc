"""Treatment by time summaries against measured totals."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.combine import keep_unmatched
from tidemark.plans import figures as G


def totals(df, prefix=""):
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(f"{prefix}av").alias("av"),
        F.sum(f"{prefix}se").alias("se"),
        F.count(F.when(F.col(f"{prefix}se").isNull(), 1)).alias("missing"),
    ).first()
    assert row["missing"] == 0
    return row["n"], row["av"], row["se"]


@pytest.mark.parametrize(
    "figure, source, expected",
    [
        (G.ephemeral_cover, "responses", (120, 679.844586895, 265.769900276)),
        (G.perennial_cover, "responses", (126, 4184.403561251, 673.011499735)),
        (G.balanus_recruits, "responses", (120, 607.033333333, 243.716074884)),
        (G.chthamalus_recruits, "responses", (60, 210.833333333, 118.335732081)),
        (G.littorina_abundance, "abundance", (60, 433.166666667, 129.751842897)),
        (G.limpet_abundance, "abundance", (42, 146.0, 43.426282008)),
        (G.siphonaria_recruits, "responses", (60, 10.2, 8.010282759)),
    ],
)
def test_series(figure, source, expected, request):
    n, av, se = totals(figure(request.getfixturevalue(source)))
    assert n == expected[0]
    assert (av, se) == (pytest.approx(expected[1], abs=1e-6), pytest.approx(expected[2], abs=1e-6))


def test_series_order_and_labels(responses):
    rows = G.balanus_recruits(responses).collect()
    assert [r["herbivores"] for r in rows[:40]] == ["Control"] * 40
    assert list(dict.fromkeys(r["treatment"] for r in rows[:40])) == G.TREATMENT_ORDER
    days = [r["days"] for r in rows[:10]]
    assert days == sorted(days)


def test_subsets(responses, abundance):
    assert G.ephemerals(responses).count() == 692
    assert G.equinox_subset(G.ephemerals(responses)).count() == 205
    assert G.perennials(responses).count() == 728
    equinox = G.equinox_subset(G.perennials(responses))
    assert equinox.count() == 205
    days = {(r["location"], r["days"]) for r in equinox.select("location", "days").distinct().collect()}
    assert days == {("BP", 113), ("BP", 295), ("BP", 397), ("PA", 135), ("PA", 299), ("PA", 434)}
    counts = {r["species"]: (r["n"], r["c"]) for r in abundance.groupBy("species").agg(F.count("count").alias("n"), F.sum("count").alias("c")).collect()}
    assert counts == {"Littorina": (360, 2599), "Lottia": (120, 318), "Siphonaria": (132, 558)}


def test_analysed_and_rest_make_the_whole(responses):
    summary = G.perennial_cover(responses)
    analysed, rest = G.split_analysed(summary, G.equinox_subset(G.perennials(responses)))
    assert analysed.count() == 36
    assert analysed.count() + rest.count() == summary.count()
    assert keep_unmatched(summary, analysed.unionByName(rest), ["treatment", "herbivores", "days"]).count() == 0


def test_logit_of_cover(responses):
    from tidemark.functions.logit import with_logit

    rows = with_logit(G.perennials(responses), "percent_cover", "lg")
    assert rows.agg(F.sum("lg")).first()[0] == pytest.approx(-876.048733751, abs=1e-6)
    ends = {r["percent_cover"]: r["lg"] for r in rows.where("percent_cover in (0, 50, 100)").collect()}
    assert ends[0.0] == pytest.approx(-3.663561646) and ends[100.0] == pytest.approx(3.663561646)
    assert ends.get(50.0, 0.0) == pytest.approx(0.0)


def test_shipped_biomass_summary(find):
    from tidemark.sources.schemas import _layout

    shipped = find(
        _layout("plot_location:s|location:s|timediff:d|plot:i|block:s|barnacles:s|biomass_g:d"), "plot_location", "location"
    )
    n, av, se = totals(G.biomass(shipped))
    assert n == 42
    assert (av, se) == (pytest.approx(1.647018937), pytest.approx(0.480519379))
