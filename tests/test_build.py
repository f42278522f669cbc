import pytest
from pyspark.sql import functions as F

from tidemark.plans.build import build_products
from tidemark.sources.schemas import LOGGER_READINGS


def test_all_products(spark, raw, tmp_path):
    readings = [(f"{m}/{d}/2006", "12:00:00", n, float(d + n)) for m in (6, 7) for d in range(1, 29) for n in (1, 2, 3)]
    temperature = spark.createDataFrame(readings, LOGGER_READINGS)
    inputs = {**raw, "native_temperature": temperature, "invaded_temperature": temperature}
    done = build_products(spark, inputs, str(tmp_path / "out"), published=True)
    rows = {
        "bio_responses": 7035, "canopy_clean": 360, "humidity_clean": 120, "herbivore_abundance": 612, "herbivore_biomass": 492,
        "size_weight_curves": 3, "humidity_box": 2, "littorina_abundance": 60, "limpet_abundance": 42, "biomass": 42,
        "ephemeral_cover": 120, "ephemeral_cover_analysed": 36, "ephemeral_cover_other": 84, "perennial_cover": 126,
        "perennial_cover_analysed": 36, "perennial_cover_other": 90, "balanus_recruits": 120, "chthamalus_recruits": 60,
        "siphonaria_recruits": 60, "allometry_line": 80, "temperature_clean": 336, "temperature_band": 112, "logger_summary": 6,
    }
    for name, n in rows.items():
        assert done[name].count() == n, name
    assert done["herbivore_biomass"].agg(F.sum("biomass_g")).first()[0] == pytest.approx(20, rel=0.5)
