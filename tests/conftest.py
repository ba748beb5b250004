"""A small session, and legs built by hand."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leg_rows import DEFAULTS  # noqa: E402

from slipstream.operators.normalize import normalize  # noqa: E402
from slipstream.operators.reconcile import row_identity  # noqa: E402
from slipstream.operators.rollup import attribute_legs, build_slips  # noqa: E402
from slipstream.schema import LEG_SCHEMA  # noqa: E402
from slipstream.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def raw_legs(spark):
    """Typed legs from a list of overrides; the list position is the file row."""

    def build(rows: list[dict]):
        full = [{**DEFAULTS, "source_row": i, **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[f.name] for f in LEG_SCHEMA) for r in full], LEG_SCHEMA)

    return build


@pytest.fixture
def norm(raw_legs):
    return lambda rows: normalize(row_identity(raw_legs(rows)))


@pytest.fixture
def rolled(norm):
    def build(rows: list[dict]):
        legs = norm(rows).cache()
        slips = build_slips(legs).cache()
        return slips, attribute_legs(legs, slips).cache()

    return build
