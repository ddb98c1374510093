import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.ordered import (
    after, before, has_hot_group, latest, position, running_min, running_sum, scan, split_points,
    upcoming,
)

OUTS = ["n", "prev", "next", "last_even", "next_even", "total", "least"]


def sample(seed, rows=400):
    rng = random.Random(seed)
    return [
        # Half of all rows share one group.
        ("big" if rng.random() < 0.5 else f"g{rng.randint(0, 30)}", rng.randint(0, 40), f"r{i}",
         rng.choice([None, *range(9)]))
        for i in range(rows)
    ]


def expected(rows):
    out = {}
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    for members in groups.values():
        members.sort(key=lambda r: (r[1], r[2]))
        total, least, last = 0, None, None
        for i, (_, _, name, v) in enumerate(members):
            total += v or 0
            least = v if least is None else least if v is None else min(least, v)
            last = name if v is not None and v % 2 == 0 else last
            coming = [m[2] for m in members[i + 1:] if m[3] is not None and m[3] % 2 == 0]
            out[name] = (
                i,
                members[i - 1][3] if i else None,
                members[i + 1][3] if i + 1 < len(members) else None,
                last,
                coming[0] if coming else None,
                total,
                least,
            )
    return out


def scanned(spark, rows, cold=None):
    df = spark.createDataFrame(rows, "g string, at int, name string, v int")
    even = F.when(F.col("v") % 2 == 0, F.col("name"))
    v = F.col("v")
    outs = [position("n"), before("prev", v), after("next", v), latest("last_even", even),
            upcoming("next_even", even), running_sum("total", v), running_min("least", v)]
    got = scan(df, ["g"], ["at", "name"], outs, cold)
    assert got.columns == ["g", "at", "name", "v", *OUTS]
    return {r["name"]: tuple(r[o] for o in OUTS) for r in got.collect()}


@pytest.mark.parametrize("cold", [None, True, False])
def test_scan_matches_brute_force(spark, cold):
    rows = sample(1)
    assert scanned(spark, rows, cold) == expected(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_scan_of_hot_groups_matches_brute_force(spark, hot, seed):
    rows = sample(seed)
    assert scanned(spark, rows) == expected(rows)


def test_hot_group_of_equal_times_is_still_cut(spark, hot):
    rows = [("big", 1, f"r{i:03}", i % 9) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, at int, name string, v int")
    assert has_hot_group(df, ["g"])
    edges = split_points(df, ["g"], ["at", "name"]).collect()
    assert sum(len(block) for block in edges[0]["__edges"]) >= 10
    assert scanned(spark, rows) == expected(rows)


def test_small_groups_take_the_plain_window(spark):
    df = spark.createDataFrame(sample(4), "g string, at int, name string, v int")
    assert not has_hot_group(df, ["g"])
    assert split_points(df, ["g"], ["at", "name"]) is None


def test_scan_of_nothing(spark):
    assert scanned(spark, []) == {}
