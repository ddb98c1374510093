import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.stab import best_covering, latest_ended, nearest_interval


def sample(seed):
    rng = random.Random(seed)
    group = lambda: "big" if rng.random() < 0.4 else f"g{rng.randint(0, 12)}"
    spans = [(group(), f"i{i:03}", s := rng.randint(0, 300), s + int(rng.expovariate(1 / 15)))
             for i in range(250)]
    points = [(group(), f"p{i:03}", rng.randint(-10, 340)) for i in range(300)]
    return spans, points


def frames(spark, spans, points):
    return (
        spark.createDataFrame(spans, "g string, iid string, s long, e long"),
        spark.createDataFrame(points, "g string, pid string, t long"),
    )


def as_dict(df):
    rows = df.collect()
    found = {r["pid"]: r["hit"] for r in rows}
    assert len(found) == len(rows)
    return found


def check_all(spark, seed):
    spans, points = sample(seed)
    iv, pt = frames(spark, spans, points)
    covering = lambda g, t: [r for r in spans if r[0] == g and r[2] <= t <= r[3]]
    ended = lambda g, t: [r for r in spans if r[0] == g and r[3] <= t]

    narrow = best_covering(pt, iv, ["g"], "pid", "t", "s", "e",
                           [F.col("e") - F.col("s"), F.col("s"), F.col("iid")], F.col("iid"), "hit")
    want = {p: min(c, key=lambda r: (r[3] - r[2], r[2], r[1]))[1]
            for g, p, t in points if (c := covering(g, t))}
    assert as_dict(narrow) == want

    want = {p: min(c, key=lambda r: (-r[3], r[1]))[1] for g, p, t in points if (c := ended(g, t))}
    back = latest_ended(pt, iv, ["g"], "pid", "t", "e", [F.col("iid")], F.col("iid"), "hit")
    assert as_dict(back) == want

    want = {}
    for g, p, t in points:
        every = [r for r in spans if r[0] == g]
        if c := covering(g, t):
            want[p] = min(c, key=lambda r: (-r[2], r[1]))[1]
        elif c := ended(g, t):
            want[p] = min(c, key=lambda r: (-r[3], r[2], r[1]))[1]
        elif every:
            want[p] = min(every, key=lambda r: (r[2], r[1]))[1]
    near = nearest_interval(pt, iv, ["g"], "pid", "t", "s", "e", "iid", F.col("iid"), "hit")
    assert as_dict(near) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_joins_match_brute_force(spark, seed):
    check_all(spark, seed)


def test_interval_joins_of_hot_groups_match_brute_force(spark, hot):
    check_all(spark, 3)


def test_block_lookups_stay_small(spark):
    """A point meets one block per level, however many intervals cover it."""
    spans = [("g", f"i{i:04}", 0, 10_000 + i) for i in range(500)]
    points = [("g", f"p{i:04}", i) for i in range(500)]
    iv, pt = frames(spark, spans, points)
    got = best_covering(pt, iv, ["g"], "pid", "t", "s", "e",
                        [F.col("e") - F.col("s"), F.col("iid")], F.col("iid"), "hit")
    assert set(as_dict(got).values()) == {"i0000"} and got.count() == 500
