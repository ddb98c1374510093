"""Hard negatives, against all scores in plain Python."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, row string"


def mined_expected(rows, is_anchor, low=80, high=100):
    """All result rows, from (id, vector, label); numbers of rows tell repeated ids apart."""

    def fine(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in filter(fine, rows)]
    out = collections.Counter()
    for i, v, label in usable:
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in usable if j != i and len(w) == len(v)]
        scored.sort(key=lambda s: s[:2])
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p]
            out.update((i, j, rank, k, -p, -n) for rank, (n, k, _) in enumerate(fit[:5], 1))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def found(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("low,high", [(80, 100), (50, 90)])
def test_against_all_scores(spark, monkeypatch, low, high):
    rng = random.Random(low)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 7)  # several blocks
    monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    # Few coordinates, so that scores tie; one label holds a third of the rows.
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)], rng.choice([0, 0, 0, 1, 2, 3, 4, 5])) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5], i % 3) for i in range(12)] + [(320, [], 1), (330, [], 1), (331, [], 2)]
    rows += [(400, None, 1), (410, [0.1, None, 0.1, 0.1], 1), (420, [float("nan")] * 4, 1), (430, [float("inf")] * 4, 2), (440, [0.5] * 4, None), (None, [0.5] * 4, 1)]
    rows += [rows[10], rows[10], rows[11], rows[11], rows[20]]
    got = hard_negatives.mine(frame(spark, rows).repartition(5), F.col("vec_id") % 10 == 0, low=low, high=high)
    want = mined_expected(rows, lambda i: i % 10 == 0, low, high)
    assert want and found(got) == want


def test_odd_tables(spark):
    nothing = frame(spark, [(1, [0.5], 1, )])
    assert hard_negatives.mine(nothing.limit(0), F.col("vec_id") == 1).count() == 0
    assert hard_negatives.mine(nothing, F.col("vec_id") == 1).count() == 0
    assert hard_negatives.mine(nothing, F.col("vec_id") == 2).count() == 0
    # Scores below zero open no window; those of large components stay exact.
    rows = [(0, [1.0], 0), (1, [-1.0], 0), (2, [-1.0], 1), (10, [3e6, 1.0], 0), (11, [3e6, 1.0], 0), (12, [3e6, 0.0], 1)]
    got = found(hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0))
    assert got == mined_expected(rows, lambda i: i % 10 == 0) and len(got) == 1


def test_scores_beyond_doubles_and_longs():
    left, right = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0], [2.0**40, 0.0], [2.0**60, 0.0], [-(2.0**60), 0.0]])
    assert hard_negatives.scores(left, right)[0].tolist() == [2**60 + 1, 2**63 - 1, 2**63 - 1, -(2**63)]


def test_keys_sort_by_anchor_falling_score_kind_and_id():
    rng = random.Random(2)
    items = [(rng.choice([-5, 0, 2**62]), rng.randrange(2), rng.choice([-(2**62), -1, 0, 3, 2**62]), rng.randrange(2), rng.choice([-9, 4, 7])) for _ in range(200)]
    packed = [hard_negatives.pack_keys(*(np.array([x]) for x in (a, r, s)), k, np.array([i]), np.array([0])).tobytes() for a, r, s, k, i in items]
    assert [hard_negatives.unpack_key(k) for k in packed] == items
    assert [hard_negatives.unpack_key(k) for k in sorted(packed)] == sorted(items, key=lambda x: (x[0], x[1], -x[2], x[3], x[4]))
