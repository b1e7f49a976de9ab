from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from opskpi.plans import publish as P
from opskpi.plans.metric import all_metrics
from opskpi.plans.publish import one_file, publish, recover
from opskpi.plans.queries import AS_OF, DRIVER_PARAMS
from opskpi.sources.driver import driver_tables


@pytest.fixture
def target():
    return os.path.join(tempfile.mkdtemp(prefix="opskpi-publish-"), "as_of=2000-06-30 00%3A00%3A00")


def write(spark, n):
    return lambda folder: spark.range(n).write.parquet(folder)


def left_over(target):
    return [f for f in os.listdir(os.path.dirname(target)) if f.startswith("_run-")]


def test_a_write_that_dies_leaves_the_old_run(spark, target):
    publish(spark, target, write(spark, 5))

    def dies(folder):
        # some tasks have written their files when one fails
        spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("id")) \
             .write.parquet(folder)

    with pytest.raises(Exception, match="killed"):
        publish(spark, target, dies)
    assert spark.read.parquet(target).count() == 5 and not left_over(target)
    publish(spark, target, write(spark, 7))
    assert spark.read.parquet(target).count() == 7 and not left_over(target)


@pytest.mark.parametrize("moves_done", [0, 1])
def test_a_driver_that_dies_between_the_moves(spark, target, monkeypatch, moves_done):
    publish(spark, target, write(spark, 5))
    real, seen = P._move, []

    def dies(fs, a, b):
        if len(seen) == moves_done:
            raise SystemExit
        seen.append(a)
        real(fs, a, b)

    monkeypatch.setattr(P, "_move", dies)
    with pytest.raises(SystemExit):
        publish(spark, target, write(spark, 9))
    monkeypatch.setattr(P, "_move", real)
    if moves_done:      # the old run is aside: the new one, written whole, takes its place
        assert not os.path.exists(target) and recover(spark, target) == 1
        assert spark.read.parquet(target).count() == 9
    else:
        assert spark.read.parquet(target).count() == 5 and recover(spark, target) == 0
    assert not left_over(target)


def test_one_ordered_file(spark, target):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("n"), F.lit('a "b", c').alias("x,y")).orderBy("n")
    one_file(spark, rows, target + ".csv")
    assert os.path.isfile(target + ".csv")
    lines = open(target + ".csv").read().splitlines()
    assert lines[0] == 'n,"x,y"' and [int(v.split(",")[0]) for v in lines[1:]] == list(range(1000))
    back = spark.read.option("header", True).csv(target + ".csv")
    assert back.columns == ["n", "x,y"] and back.select("x,y").distinct().collect()[0][0] == 'a "b", c'
    one_file(spark, rows.where("n < 0"), target + ".csv")
    assert open(target + ".csv").read() == 'n,"x,y"\n'


def test_export_as_one_file(spark, target):
    m = all_metrics()["export_D1d"]
    rows = m.ordered(driver_tables(spark, "/root/testdata/sf0.001"), AS_OF, **{k: v for k, v in DRIVER_PARAMS.items()})
    one_file(spark, rows, target + ".csv")
    want = [tuple("" if v is None else str(v) for v in r) for r in rows.collect()]
    import csv
    got = [tuple(r) for r in csv.reader(open(target + ".csv"), escapechar="\\")]
    assert got[0] == tuple(rows.columns) and got[1:] == want
