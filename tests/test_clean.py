import math

import pytest

from trellium.functions.feature_lists import SchemaError
from trellium.operators.clean import clean, one_row_per_id


def test_null_target_goes_nan_stays(spark, rows):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "ID int, Label double")
    got = {r.id: r.label for r in clean(df, "Label").collect()}
    assert set(got) == {1, 3} and math.isnan(got[3])


def test_one_row_per_id_repeats_and_nulls_fold(spark, rows):
    data = [(1, 5, "b"), (1, 5, "a"), (1, 9, "c"), (None, 2, "x"), (None, 1, "y"), (2, 0, "z")]
    df = spark.createDataFrame(data, "id int, label int, s string")
    want = rows(spark.createDataFrame([(1, 5, "a"), (None, 1, "y"), (2, 0, "z")], df.schema))
    for n in (1, 3, 7):
        assert rows(one_row_per_id(df.repartition(n))) == want
    assert one_row_per_id(df, any_row=True).count() == 3


def test_order_columns_choose_the_survivor(spark, rows):
    df = spark.createDataFrame([(1, 5, 1), (1, 4, 2)], "id int, label int, at int")
    assert rows(one_row_per_id(df, order_by=["at"])) == [(1, 5, 1)]


def test_maps_do_not_stop_the_pick(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 2})], "id int, m map<string,int>")
    assert one_row_per_id(df).collect()[0].m == {"a": 1}


def test_no_id_column_keeps_repeats(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, label int")
    assert clean(df, "label").count() == 2


def test_missing_target_is_an_error_before_any_job(spark):
    with pytest.raises(SchemaError):
        clean(spark.range(1), "label")


def test_hot_id_sends_one_row_per_task(spark):
    """Copies fold before the shuffle."""
    df = spark.range(0, 30000, 1, 8).selectExpr("if(id % 3 = 0, id, -1) as id", "id as label")
    plan = one_row_per_id(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    assert one_row_per_id(df).count() == 10001
