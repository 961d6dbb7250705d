import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scenelake.operators.ordered import previous_value, row_numbers, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaab"), i, float(rng.randint(0, 40)), rng.choice([None, "p", "q"])) for i in range(300)]
    return spark.createDataFrame(data, "k string, id bigint, t double, v string").cache()


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_chunks_equal_one_window(rows, width):
    w = Window.partitionBy("k").orderBy("t", "id")
    prev = previous_value(rows, ["k"], F.col("t"), [F.col("t"), F.col("id")], F.col("v"), "p", width)
    wanted = rows.withColumn("p", F.lag("v").over(w))
    assert sorted(map(str, prev.collect())) == sorted(map(str, wanted.collect()))

    total = running(rows, ["k"], F.col("t"), [F.col("t"), F.col("id")], F.col("id"), "s", width)
    wanted = rows.withColumn("s", F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(str, total.collect())) == sorted(map(str, wanted.collect()))

    numbered = row_numbers(rows, ["k"], "id", "n", width)
    wanted = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("bigint"))
    assert sorted(map(str, numbered.collect())) == sorted(map(str, wanted.collect()))
