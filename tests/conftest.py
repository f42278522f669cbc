import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tidemark.session import local_session  # noqa: E402
from tidemark.sources import schemas as S  # noqa: E402
from tidemark.sources.tables import read_csv  # noqa: E402

SURVEY_ROOT = Path(os.environ["TIDEMARK_SURVEY_DATA"]) if "TIDEMARK_SURVEY_DATA" in os.environ else None
TABLES = Path(os.environ.get("TIDEMARK_TABLES", "/root/testdata")) / "sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tidemark-tests", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    if not TABLES.exists():
        pytest.skip("no driver tables")
    return str(TABLES)


def headers():
    """Header and record count of every delimited survey file."""
    found = {}
    for path in sorted(SURVEY_ROOT.rglob("*.csv")):
        with open(path, encoding="utf-8-sig") as lines:
            found[path] = lines.readline().strip().split(","), sum(1 for line in lines if line.strip())
    return found


@pytest.fixture(scope="session")
def find(spark):
    """Read the survey file whose header starts with the given columns."""
    if SURVEY_ROOT is None or not SURVEY_ROOT.exists():
        pytest.skip("no survey files")
    known = headers()

    def read(schema, *first, width=None, records=None):
        for path, (columns, size) in known.items():
            same = columns[: len(first)] == list(first) and width in (None, len(columns))
            if same and records in (None, size):
                return read_csv(spark, str(path), schema)
        pytest.skip(f"no survey file starts with {first}")

    return read


@pytest.fixture(scope="session")
def raw(find):
    """The survey, size and climate tables by name."""
    return {
        "native": find(S.NATIVE_COMMUNITY, "date", "block", "barnacles", "herbivores", "plot"),
        "start": find(S.INVADED_START, "barnacles", "herbivores", "Dens Siph"),
        "community": find(S.INVADED_COMMUNITY, "herbivores", "barnacles", "plot", "date"),
        "adults": find(S.ADULT_LIMPETS, "barnacles", "herbivores", "plot", "Month"),
        "canopy": find(S.CANOPY_COVER, "date", "block", "barnacles", "herbivores", "fucus_raw", width=7),
        "sizes": find(S.GRAZER_SIZES, "date", "sp", "barnacles", "size_mm"),
        "weights": find(S.SIZE_WEIGHTS, "size_mm", "dw_g", "sp"),
        "limpet_weights": find(S.LIMPET_WEIGHTS, "size_mm", "dw_mg", "dw_g"),
        "native_humidity": find(S.NATIVE_HUMIDITY, "year", "month", "humidity", "site", records=69),
        "invaded_humidity": find(S.INVADED_HUMIDITY, "month", "year", "humidity", "mean_temp"),
        "factors": find(S.FACTOR_CODES, "attributeName", "code", "definition"),
        "variables": find(S.VARIABLES, "attributeName", "attributeDefinition"),
    }


@pytest.fixture(scope="session")
def responses(raw):
    from tidemark.plans.surveys import bio_responses
    from tidemark.session import settle

    return settle(bio_responses(raw["native"], raw["community"], raw["adults"], raw["start"]))


@pytest.fixture(scope="session")
def abundance(responses):
    from tidemark.plans.grazers import herbivore_abundance
    from tidemark.session import settle

    return settle(herbivore_abundance(responses))
