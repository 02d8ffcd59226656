import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.validity import DAY, as_known_at


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("stride", [1, 3])
def test_against_all_pairs(spark, packed, stride):
    rnd = random.Random(stride)
    sign = 1 if packed else -1
    at = [(rnd.choice("AAB"), i, rnd.randint(0, 10 * DAY), rnd.choice([None, rnd.randint(0, 12 * DAY)]), sign * rnd.randint(0, 5)) for i in range(150)]
    at += [("A", 900, 3 * DAY, 4 * DAY, 9), ("A", 901, 3 * DAY, 3 * DAY + 5, 10), ("A", 901, 3 * DAY, 3 * DAY + 5, 10), ("B", 902, None, None, 99), (None, 903, 0, None, 99), ("B", 904, 5, 5, 99), ("C", 905, 3 * DAY, None, 1)]
    ev = [(rnd.choice("ABD"), i, rnd.randint(-DAY, 13 * DAY)) for i in range(200)] + [("A", 1000 + i, 3 * DAY + i) for i in range(10)] + [("C", 2000, 3 * DAY - 1), ("C", 2001, 3 * DAY), ("A", 1000, 3 * DAY), ("A", 1000, 3 * DAY), (None, 3000, 5), ("A", 3001, None)]
    a = spark.createDataFrame(at, "k string, id long, f long, t long, p long").withColumn("ts", F.lit("clash"))
    e = spark.createDataFrame(ev, "k string, ev long, ts long").withColumn("p", F.lit("clash"))
    got = [tuple(r) for r in as_known_at(e, a, entity="k", event_id="ev", event_time="ts", attribute_id="id", valid_from="f", valid_to="t", precedence=["p"], stride=stride).collect()]
    want = set()
    for k, i, t in ev:
        valid = [(p, j) for kk, j, f, to, p in at if k and kk == k and None not in (t, f) and f <= t and (to is None or t < to)]
        if valid:
            want.add((i, max(valid)[1]))
    assert set(got) == want and len(got) == len(want)


def test_empty(spark):
    e = spark.createDataFrame([], "k string, ev long, ts long")
    a = spark.createDataFrame([("A", 1, 5)], "k string, id long, f long")
    run = lambda x, y: as_known_at(x, y, entity="k", event_id="ev", event_time="ts", attribute_id="id", valid_from="f").count()
    assert run(e, a) == 0 and run(spark.createDataFrame([("A", 1, 9)], "k string, ev long, ts long"), a.limit(0)) == 0


def test_precedence_of_dates_and_nulls(spark):
    """Far sentinel dates, nulls (last) and several columns; packed and, where the ranges don't fit, as structs."""
    import datetime as dt

    at = [("A", 1, 0, dt.date(2024, 1, 1), 5), ("A", 2, 0, dt.date(9999, 12, 31), None), ("A", 3, 0, dt.date(9999, 12, 31), -7), ("A", 4, 0, None, 99), ("B", 5, 0, None, None), ("C", 7, 0, None, 1), ("C", 6, 0, None, 1)]
    a = spark.createDataFrame(at, "k string, id long, f long, day date, p long")
    e = spark.createDataFrame([(k, i, 100) for i, k in enumerate("ABC")], "k string, ev long, ts long")
    run = lambda x: dict(map(tuple, as_known_at(e, x, entity="k", event_id="ev", event_time="ts", attribute_id="id", valid_from="f", precedence=["day", "p"]).collect()))
    assert run(a) == {0: 3, 1: 5, 2: 7}
    wide = a.withColumn("p", (F.col("p") * 10**15).cast("decimal(38,0)"))
    assert run(wide) == {0: 3, 1: 5, 2: 7}
    far = a.withColumn("p", F.when(F.col("p") == 99, F.lit(2**63 - 1)).when(F.col("p") == -7, F.lit(-(2**63))).otherwise(F.col("p"))).withColumn("id", F.when(F.col("id") == 7, 2**62).otherwise(F.col("id")))
    assert run(far) == {0: 3, 1: 5, 2: 2**62}
