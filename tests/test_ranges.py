"""Ranked, running and hot-key operators against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import joins
from helixframe.operators.ranking import numbered, numbered_in, with_previous, with_running_max


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = [(i, rnd.choice(["hot"] * 6 + ["a", "b", "c"]), rnd.choice([None, rnd.randint(0, 50)])) for i in range(400)]
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "at long, g string, v long")


def test_numbers(rows):
    data, df = rows
    assert {(r.at, r.n) for r in numbered(df, ["at"]).collect()} == {(x[0], i + 1) for i, x in enumerate(sorted(data))}
    places = {}
    for at, g, _ in sorted(data):
        places[at] = (g, 1 + sum(1 for x in places.values() if x[0] == g))
    assert {(r.at, r.g, r.n) for r in numbered_in(df, "g", ["at"]).collect()} == {(at, *x) for at, x in places.items()}


def test_previous(rows):
    data, df = rows
    ordered = sorted(data, key=lambda x: x[0])
    want = {(x[0], ordered[i - 1][2] if i else None) for i, x in enumerate(ordered)}
    assert {(r.at, r.before) for r in with_previous(df, ["at"], "v", "before").collect()} == want


def test_running_max(rows):
    data, df = rows
    want, tops = set(), {}
    for at, g, v in sorted(data, key=lambda x: x[0]):
        want.add((at, tops.get(g)))
        if v is not None:
            tops[g] = max(v, tops.get(g, v))
    assert {(r.at, r.top) for r in with_running_max(df, "g", ["at"], "v", "top").collect()} == want


def test_hot_keys_are_joined_as_others(spark, rows, monkeypatch):
    data, df = rows
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    lookup = df.filter("g != 'c'").groupBy("g").agg(F.count("*").alias("size"), F.sum("v").alias("total"))
    got = joins.spread_join(df, lookup, ["g"], "size", len(data))
    plan = got._jdf.queryExecution().toString()
    assert sorted(got.columns) == ["at", "g", "total", "v"] and "BroadcastHashJoin" in plan
    want = df.join(lookup.drop("size"), "g")
    assert sorted(map(str, got.select("at", "g", "v", "total").collect())) == sorted(map(str, want.select("at", "g", "v", "total").collect()))
