from __future__ import annotations

import os
import sys
import tempfile
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("opskpi-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="opskpi-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def relation_schemas(spark):
    """Typed schemas of the ERP relations (taken from the driver adapters)."""
    from pyspark.sql import types as T

    from opskpi.sources.driver import RELATIONS, driver_tables
    t = driver_tables(spark, SF_SMALL)
    return {r.name: T.StructType([T.StructField(f.name, f.dataType, True) for f in t[r.name].schema])
            for r in RELATIONS}


@pytest.fixture
def make_tables(spark, relation_schemas):
    """Build a ``Tables`` from literal rows: {relation: [dict, ...]}.

    Relations not given are empty; missing keys are NULL.
    """
    from opskpi.sources.tables import Tables

    def build(data: dict[str, list[dict]]):
        frames = {}
        for name, schema in relation_schemas.items():
            rows = data.get(name, [])
            tuples = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
            frames[name] = spark.createDataFrame(tuples, schema)
        return Tables.from_frames(frames)

    return build


@pytest.fixture
def clock():
    from opskpi.functions.clock import AsOf
    return AsOf.parse("2000-06-30 00:00:00")


def d(s: str) -> date:
    return date.fromisoformat(s)
