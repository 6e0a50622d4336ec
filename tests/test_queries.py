"""Registered queries against their SQL, and the plans they get."""

import pytest

import __spark_entry__ as entry
from fissura.plans import oracles, queries
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries.ALL))
def test_query_equals_sql(spark, con, name):
    got, want, spark_types, sql_types = check(spark, con, SF, name)
    assert got == want
    assert {c: SQL_TYPES[t] for c, t in spark_types.items()} == sql_types
    assert got[1] or name in ("mask_default_threshold", "output_name_collisions")


def test_every_query_has_sql():
    assert set(queries.ALL) == set(oracles.ALL)
    assert set(queries.ALL) <= set(entry.queries()) and set(oracles.ALL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["image_id", "num_instances", "mask_area"] and df.count() > 0


@pytest.mark.parametrize("name", list(queries.ALL))
def test_no_pairwise_joins(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_confidence_filter_and_pruning_reach_the_scan(spark):
    df = entry.queries()["mask_union_runs"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<embedding:array<float>,label:int>" in plan
    # Unpacking, filtering and packing of pixels precede the first shuffle.
    first_shuffle = plan[plan.rindex("Exchange") :]
    assert "partial_bit_or" in first_shuffle and "Generate posexplode" in first_shuffle


def test_upload_checks_read_no_contents(spark, tmp_path):
    from fissura.operators.validation import accepted, check_uploads
    from fissura.sources.images import list_files

    (tmp_path / "a.jpg").write_bytes(b"x")
    kept = accepted(check_uploads(list_files(spark, str(tmp_path))))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_limits_per_image_do_not_pin_a_hot_image_to_one_task(spark):
    from fissura.plans import fixtures, queries
    from fissura.plans.overlay import mask_words

    images = queries._frames_with_conf(spark, SF)
    words = mask_words(images, fixtures.frame_detections(spark, SF), queries.FRAME)
    plan = words._jdf.queryExecution().executedPlan().toString()
    # Between the join and the union: a spreading shuffle, then a map-side combine.
    above_join = plan[: plan.index("Join")]
    assert "REPARTITION_BY_COL" in above_join
    assert above_join.index("partial_bit_or") < above_join.index("REPARTITION_BY_COL")


def test_painting_leaves_pixels_where_they_were_decoded(spark, tmp_path):
    from fissura.plans import fixtures, queries
    from fissura.plans.overlay import overlay
    from fissura.sources.images import scan_images

    images = scan_images(spark, queries._frame_files(spark, SF))
    lines = overlay(images, fixtures.frame_detections(spark, SF), queries.FRAME).lines
    execution = lines._jdf.queryExecution()
    plan = execution.executedPlan().toString()
    # Scan, paint, cut into scanlines: no pixel is shuffled, sorted or joined.
    assert "strategy=" not in execution.analyzed().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan
    assert plan.count("MapInArrow") == 1 and plan.count("FileScan image") == 1


def test_strips_run_nothing_ahead_of_the_query(spark):
    from fissura.operators import masks, outline
    from fissura.plans import fixtures

    sc = spark.sparkContext
    runs = masks.union_runs(fixtures.speckle_runs(spark, SF), masks.IMAGE)
    sc.setJobGroup("strips", "")
    try:
        for pixels in (448, outline.STRIP_PIXELS):
            plan = outline.filled_runs(runs, strip_pixels=pixels)._jdf.queryExecution().executedPlan().toString()
            # Low images once, tall ones once for their border gaps and once for their runs.
            assert plan.count("MapInArrow") == 3
        assert not list(sc.statusTracker().getJobIdsForGroup("strips"))
    finally:
        sc.setJobGroup(None, None)


def test_thickening_does_not_grow_with_the_width(spark):
    """As many rows reach the strips for a width of 200 as for 2."""
    from fissura.operators import masks

    layout = "image_id bigint, height int, width int, outline int, y int, x0 int, x1 int"
    rows = [(i, 3000, 3000, 200 if i % 2 else 2, 700 + 2 * k, 100 + k, 140 + k) for i in range(4) for k in range(50)]
    thick = masks.thicken_runs(spark.createDataFrame(rows, layout), masks.IMAGE_AND_OUTLINE)
    plan = thick._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "dy" not in plan
    strips = [l for l in thick._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in l]
    assert len(strips) == 1
    assert thick.filter("outline = 200").count() > 2 * 298 and thick.filter("outline = 2").count() == 2 * 101
