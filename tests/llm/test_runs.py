"""Periodic runs of words, against all periods tried one by one."""

import random

import pytest

from spanloom.llm import periodic_runs


def runs_expected(words, least):
    """Every period in turn; stretches of equal words that far apart; those with a smaller period go."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                out.append((start, length, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_expected(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


@pytest.mark.parametrize("block", [2, 1024])
def test_runs_of_random_texts(monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(1500):
        n, kinds = rng.randrange(0, 60), rng.choice([1, 2, 2, 3, 5])
        words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        least = rng.choice([2, 3, 5, 8, 12])
        runs = periodic_runs.runs_of(words, least)
        assert runs == runs_expected(words, least)
        assert periodic_runs.collapse(words, runs) == collapsed_expected(words, runs)


def test_common_words_of_sorted_suffixes():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        codes = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        order, common = periodic_runs.suffix_order(np.array(codes), 1)
        assert [codes[i:] for i in order] == sorted(codes[i:] for i in range(len(codes)))
        for k in range(1, len(codes)):
            a, b = codes[order[k - 1] :], codes[order[k] :]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_long_texts_take_no_quadratic_time():
    same = [b"a"] * 120_000
    assert periodic_runs.runs_of(same, 12) == [(0, 120_000, 1)]
    wheel = [b"%d" % (i % 7) for i in range(120_000)]
    assert periodic_runs.runs_of(wheel, 12) == [(0, 120_000, 7)]
    # The same eight words behind ever different ones: many places, no run.
    lines = [w for i in range(8_000) for w in (b"x%d" % i, *b"a b c d e f g h".split())]
    assert periodic_runs.runs_of(lines, 12) == []


def test_odd_rows(spark):
    again = "one two three four " * 5
    rows = [(1, again, "x"), (1, again, "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n", None), (None, "a " * 12, "y"), (5, "a\u00a0b c " * 11, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = sorted(periodic_runs.find_runs(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (1, 20, [(0, 20, 4)], "one two three four"), (1, 20, [(0, 20, 4)], "one two three four"),
        (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 22, [(0, 22, 2)], "a\u00a0b c"), (None, 12, [(0, 12, 1)], "a"),
    ]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, min_words=1)
