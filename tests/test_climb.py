import collections
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import nesting
from spanloom.operators.climb import nearest_stop, reach
from spanloom.operators.nesting import first_inside, inside, nested_intervals
from spanloom.operators.ordered import HOT_ROWS, HOT_ROWS_CONF
from spanloom.runtime import settle


def test_nearest_stop_over_long_chains(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i % 100 else None, i % 10 == 5) for i in range(300)]
    rows += [("lost", "missing", False), ("below", "lost", False), ("self", "self", False)]
    links = spark.createDataFrame(rows, "id string, parent string, stop boolean")
    roots = {r["id"]: r["root"] for r in
             nearest_stop(links, "id", "parent", F.lit(False), out="root").collect()}
    assert all(roots[f"n{i}"] == f"n{i // 100 * 100}" for i in range(300) if i % 100)
    assert roots["below"] == "lost" and "lost" not in roots and "self" not in roots

    near = {r["id"]: (r["near"], r["found"]) for r in
            nearest_stop(links, "id", "parent", F.col("stop"), out="near").collect()}
    assert near["n17"] == ("n15", True) and near["n15"] == ("n5", True)
    assert near["n3"] == ("n0", False)


def test_cycles_are_set_aside(spark):
    rows = [("a", "b"), ("b", "a"), ("tail", "b"), ("c", "d"), ("d", "e"), ("e", None)]
    links = spark.createDataFrame(rows, "id string, parent string")
    got = {r.id: r.stop for r in nearest_stop(links, "id", "parent", F.lit(False)).collect()}
    assert got == {"c": "e", "d": "e"}
    near = {r.id: (r.stop, r.found) for r in nearest_stop(links, "id", "parent", F.col("id") == "b").collect()}
    assert near["a"] == ("b", True) and near["tail"] == ("b", True) and near["c"] == ("e", False)
    above = {(r.id, r.above) for r in inside(nested_intervals(links, "id", "parent", []), "id").collect()}
    assert above == {("c", "d"), ("c", "e"), ("d", "e")}


def test_chains_of_any_depth(spark):
    links = spark.range(12_000).selectExpr("id", "nullif(id - 1, -1) as parent")
    roots = nearest_stop(links, "id", "parent", F.lit(False))
    assert roots.filter("stop = 0").count() == 11_999


def test_scopes_keep_equal_ids_apart(spark):
    rows = [("x", "a", None), ("x", "b", "a"), ("y", "a", "c"), ("y", "c", None), ("y", "b", "a")]
    links = spark.createDataFrame(rows, "s string, id string, parent string")
    got = {(r["s"], r["id"]): r["stop"] for r in
           nearest_stop(links, "id", "parent", F.lit(False), ["s"]).collect()}
    assert got == {("x", "b"): "a", ("y", "a"): "c", ("y", "b"): "c"}


def nested_expected(rows):
    """{node: (root, depth, enter, leave)} by walking each tree, siblings by order and id."""
    kids, parent = collections.defaultdict(list), {}
    ids = {r[0] for r in rows}
    for n, p, o in rows:
        if p in ids and p != n:
            kids[p].append((o, n))
            parent[n] = p
    out = {}

    def walk(n, root, depth, at):
        enter = at
        for _, kid in sorted(kids[n]):
            at = walk(kid, root, depth + 1, at + 1)
        out[n] = (root, depth, enter, at)
        return at

    for n in ids - set(parent):
        walk(n, n, 0, 0)
    return out


@pytest.mark.parametrize("listed", [2, 65_536])
def test_nested_intervals_of_random_forests(spark, monkeypatch, listed):
    monkeypatch.setattr(nesting, "LISTED", listed)
    rng = random.Random(listed)
    rows = [(i, rng.choice([None, -1, i, *range(max(0, i - 4), i)]) if i % 7 else None, rng.randrange(3)) for i in range(150)]
    rows += [(200, 201, 0), (201, 202, 0), (202, 200, 0), (203, 200, 0)]  # a circle, and a node below it
    links = spark.createDataFrame(rows, "id bigint, parent bigint, o int")
    labels = settle(nested_intervals(links, "id", "parent", ["o"]))
    want = nested_expected(rows[:150])
    assert {r.id: (r.root, r.depth, r.enter, r.leave) for r in labels.collect()} == want

    def holds(a, b):
        return a != b and want[a][0] == want[b][0] and want[a][2] <= want[b][2] <= want[a][3]

    got = [(r.above, r.id, r.levels) for r in inside(labels, "id").collect()]
    assert sorted(got) == sorted((a, b, want[b][1] - want[a][1]) for a in want for b in want if holds(a, b))
    for limit in (1_000_000, 20):  # scopes numbered where they lie, or some, or none
        spark.conf.set(HOT_ROWS_CONF, str(limit))
        tops = labels.select("id", "root")
        scoped = links.join(tops, "id", "left").withColumn("tree", F.when(F.col("root") % 5 != 0, F.col("root"))).drop("root")
        again = nested_intervals(scoped, "id", "parent", ["o"], scope="tree")
        assert {r.id: (r.root, r.depth, r.enter, r.leave) for r in again.collect()} == want
    spark.conf.set(HOT_ROWS_CONF, str(HOT_ROWS))
    few = spark.createDataFrame([(3,), (70,), (200,)], "id bigint")
    assert {r.above for r in inside(labels, "id", few).collect()} <= {3, 70}

    owners, wanted = [i for i in want if i % 3 == 0], [i for i in want if i % 5 < 2]
    frames = [spark.createDataFrame([(i,) for i in x], "id bigint") for x in (owners, wanted)]
    first = {a: min((want[b][2], b) for b in wanted if holds(a, b))[1] for a in owners if any(holds(a, b) for b in wanted)}
    assert first and {r.above: r.id for r in first_inside(labels, "id", *frames).collect()} == first


def test_nested_intervals_of_hot_parents_and_deep_chains(spark, hot):
    rows = [(i, None if i == 0 else 0, -i) for i in range(40)] + [(100 + i, 99 + i if i else None, 0) for i in range(70)]
    got = nested_intervals(spark.createDataFrame(rows, "id bigint, parent bigint, o int"), "id", "parent", ["o"])
    assert {r.id: (r.root, r.depth, r.enter, r.leave) for r in got.collect()} == nested_expected(rows)
    assert nested_intervals(spark.createDataFrame([], "id bigint, parent bigint, o int"), "id", "parent", ["o"]).count() == 0


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("counted", "counted")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    out = work()
    after = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, after - before


def test_jobs_grow_with_the_logarithm_of_a_chain(spark):
    seeds = spark.createDataFrame([(0,), (17,)], "seed bigint")

    def walked(n):
        edges = spark.range(n).selectExpr("id as src", "id + 1 as dst")
        return reach(edges, seeds).count()

    found, few = jobs_of(spark, lambda: walked(600))
    assert found == 600 + 583
    found, more = jobs_of(spark, lambda: walked(5_000))
    assert found == 5_000 + 4_983 and more < 2 * few


def test_reach_in_random_graphs(spark):
    rng = random.Random(9)
    edges, seeds = [], []
    for g in range(12):
        n = 25
        chain = [(g, i, i + 1) for i in range(n)] if g % 2 else []
        more = [(g, rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(5, 40))]
        edges += [(f"{g}-{a}", f"{g}-{b}") for g, a, b in chain + more]
        seeds += [f"{g}-{rng.randrange(n)}" for _ in range(2)]
    # Forks that meet again, one after the other, and a circle with a way in.
    edges += [e for i in range(9) for e in ((f"f{i}", f"a{i}"), (f"f{i}", f"b{i}"), (f"a{i}", f"f{i + 1}"), (f"b{i}", f"c{i}"), (f"c{i}", f"f{i + 1}"))]
    edges += [("f9", "r0"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("q0", "q1"), ("q1", "q0"), (None, "q0"), ("q0", None), ("s", "s"), ("t", "u"), ("u", "t")]
    seeds += ["f0", "s", "t", "nowhere"]
    after = collections.defaultdict(set)
    for a, b in edges:
        if a and b:
            after[a].add(b)
    want = set()
    for seed in seeds:
        front = [seed]
        while front:
            front = [(seed, b) for a in front for b in after[a] if (seed, b) not in want]
            want.update(front)
            front = list({b for _, b in front})
    got = [tuple(r) for r in reach(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(s,) for s in seeds], "seed string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    part = F.when(~F.col("key").startswith("7-"), F.regexp_extract("key", "^[0-9]+|", 0))
    ends = spark.createDataFrame(edges, "src string, dst string").withColumn("key", F.coalesce("src", "dst")).withColumn("part", part)
    asked = spark.createDataFrame([(s, s) for s in seeds], "seed string, key string").withColumn("part", part)
    for limit in (1_000_000, 30):
        spark.conf.set(HOT_ROWS_CONF, str(limit))
        got = [tuple(r) for r in reach(ends, asked, "part").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    spark.conf.set(HOT_ROWS_CONF, str(HOT_ROWS))


def test_reach_through_diamonds_and_cycles(spark):
    layers = [(f"{i}{x}", f"{i + 1}{y}") for i in range(12) for x in "ab" for y in "ab"]
    edges = spark.createDataFrame([*layers, ("x", "y"), ("y", "x")], "src string, dst string")
    seeds = spark.createDataFrame([("0a",), ("x",), ("none",)], "seed string")
    got = [(r["seed"], r["node"]) for r in reach(edges, seeds).collect()]
    assert len(got) == len(set(got))
    assert {n for s, n in got if s == "0a"} == {f"{i}{x}" for i in range(1, 13) for x in "ab"}
    assert {n for s, n in got if s == "x"} == {"x", "y"}
    assert not [n for s, n in got if s == "none"]
