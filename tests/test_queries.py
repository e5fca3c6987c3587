"""Every registered query of the frame engine: against its oracle, or at least rows and schema."""

import duckdb
import pytest

from pixelwright.plans import registry
from tests.conftest import SF
from tests.oracle import check, connect

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, con, name):
    check(spark, con, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(ORACLES) <= set(__spark_entry__.queries())


def test_filter_reaches_the_scan(spark):
    plan = QUERIES["f1_cut_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id)" in plan


def test_frame_operators_do_not_shuffle(spark):
    for name in ("w1_box_blur", "w3_sobel", "w10_bilinear_demosaic", "p12_tone_curves", "a27_deflicker", "a3_lower_median"):
        assert "Exchange" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_layers_of_incomplete_clips(spark, tmp_path):
    """Clips that lack a layer, one with a frame twice, one below zero: null, the largest and as the SQL says."""
    frames = [0, 1, 2, 3, 3, 4, 5, 6, 9, 10, 11, 12, 14, 15, -1, -2, 21]
    rows = [(i, [((i * 7 + n * 3 + p * 5) % 29) / 15 - 0.9 for p in range(64)], 0) for n, i in enumerate(frames)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    check(spark, con, QUERIES["e8_layer_compositing"], ORACLES["e8_layer_compositing"], str(tmp_path))


def test_ranges_at_their_bounds(spark, tmp_path):
    """Values below, at, just below and beyond the bounds of the ranges, and none."""
    values = [-0.5, -50.0, -0.0, 0.0, 49.99999999999999, 50.0, 149.99999999999997, 349.99999999999994, 350.0, 499.99999999999994, 500.0, 560.21, float("nan"), float("inf"), None]
    spark.createDataFrame([(v,) for v in values], "value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    check(spark, con, QUERIES["r_range_join"], ORACLES["r_range_join"], str(tmp_path))
