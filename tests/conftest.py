from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wellpanel.session import build_session

    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def month(text: str) -> dt.date:
    year, m = text.split("-")
    return dt.date(int(year), int(m), 1)


def months(first: str, last: str) -> list[dt.date]:
    a, b = month(first), month(last)
    out = []
    while a <= b:
        out.append(a)
        a = dt.date(a.year + a.month // 12, a.month % 12 + 1, 1)
    return out


#: The two cutoffs the feature fixture is built for.
EARLIER, LATER = "2023-03-01", "2023-04-01"


def own_wells() -> list[tuple[str, dt.date, float]]:
    """Made-up series with four kinds of trouble: shut-ins, gaps and a stale tail, a cold start, mostly zero."""
    rows = []
    for i, m in enumerate(months("2021-01", "2023-06")):
        idle = m in (month("2021-09"), month("2022-11"))
        rows.append(("shutin", m, 0.0 if idle else 900.0 - 13 * i - (i % 4)))
    for i, m in enumerate(months("2021-08", "2023-06")):
        absent = m in {month(x) for x in ("2021-12", "2022-05", "2023-02", "2023-03", "2023-05")}
        if not absent:
            rows.append(("gaps", m, 400.0 - 6 * i + (i * i) % 5))
    rows += [("young", m, 20.0 + 9 * i - i * i / 2) for i, m in enumerate(months("2022-11", "2023-06"))]
    rows += [("idle", m, 8.25 if m.month in (3, 9) else 0.0) for m in months("2021-01", "2023-06")]
    return rows


OWN_STATICS = [
    ("shutin", "NORTH", "FIELD A", "TIGHT"), ("gaps", "SOUTH", "FIELD B", "TIGHT"), ("young", "NORTH", "FIELD C", "SHALE"), ("idle", "WEST", "FIELD D", "TIGHT"),
]


@pytest.fixture(scope="session")
def series(spark):
    return spark.createDataFrame(own_wells(), "well_id string, production_month date, oil_prod_m3 double").cache()


@pytest.fixture(scope="session")
def statics(spark):
    return spark.createDataFrame(OWN_STATICS, "well_id string, basin string, field string, resource_type string")


@pytest.fixture(scope="session")
def features(series, statics):
    from wellpanel.operators.features import well_features

    return well_features(series, statics, [EARLIER, LATER]).cache()
