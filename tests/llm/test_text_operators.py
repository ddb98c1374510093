"""Quality rules, line removal, near-duplicates and secrets, against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import line_dedup, minhash_dedup, quality_rules, secret_scan

WORDS = [f"w{i}" for i in range(400)]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


# ---- Quality rules -------------------------------------------------------------------------------


def prose(n, seed=1):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if i % 9 == 8 else "") for i in range(n)) + "."


def test_quality_counts_and_verdict(spark):
    menu = "Home | About | News | Contact | Login"
    rows = [
        (1, prose(80)), (2, None), (3, ""), (4, " \t\n "), (5, prose(80) + "\n" + menu),
        (6, "\n".join([menu] * 20)), (7, "a b c " * 40), (8, "x y é " + prose(60)), (None, prose(60)), (1, prose(80)),
    ]
    got = quality_rules.quality(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].kept and by[5].kept and by[8].kept and not by[5].base_failed
    assert by[5].lost_chars == len(menu.replace(" ", ""))
    assert [by[i].n_words for i in (2, 3, 4)] == [0, 0, 0] and all(by[i].base_failed and not by[i].kept for i in (2, 3, 4))
    assert by[6].n_dup_lines == 19 and not by[6].kept
    assert by[7].n_repeat_words == 120 and by[7].base_failed
    # A no-break space does not part words.
    assert by[8].n_words == 62


def test_repeated_words_against_windows():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice(b"abcd").to_bytes(1, "big") for _ in range(rng.randrange(0, 14))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert quality_rules.repeated_words(words) == len(inside)


def test_clean_takes_lines_out_and_keeps_columns(spark):
    text = prose(90) + "\nAll rights reserved. Licensed under terms.\n" + prose(90, 2)
    docs = frame(spark, [(1, text, "x"), (2, "short", "y"), (3, None, None)], "doc_id bigint, text string, kept string")
    got = quality_rules.clean(docs).collect()
    assert [(r.doc_id, r.kept) for r in got] == [(1, "x")]
    assert got[0].text == prose(90) + "\n" + prose(90, 2)
    assert quality_rules.clean(docs.limit(0)).count() == 0


# ---- Lines ----------------------------------------------------------------------------------------


def lines_expected(rows, min_docs, min_chars):
    holders = {}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    for id_, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(id_)
    gone = {k for k, ids in holders.items() if len(ids) >= min_docs and len(k) >= min_chars}
    out = []
    for id_, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((id_, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [2, 4, 10])
@pytest.mark.parametrize("partitions", [1, 7])
def test_shared_lines(spark, min_docs, partitions):
    rng = random.Random(min_docs)
    pool = ["common", " Common\t", "é", "", " ", "\x0b a b \x0c", *[f"line {i}" for i in range(30)]]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(i, "hot line") for i in range(100, 160)] + [(200, None), (201, ""), (None, "common\nalone"), (None, "hot line"), rows[0], rows[0]]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = line_dedup.line_digest(frame(spark, rows), min_docs=min_docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted([tuple(r) for r in got], key=str) == lines_expected(rows, min_docs, 1)


def test_dedup_lines_keeps_columns_and_nulls(spark):
    rows = [(i, f"keep {i}\nsame", "b") for i in range(12)] + [(50, None, None), (None, "same\nown", "n")]
    docs = frame(spark, rows, "doc_id bigint, text string, bitmap string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[3].text == "keep 3" and got[3].bitmap == "b" and got[50].text is None and got[None].text == "own"
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_bitmap_of_a_long_document(spark):
    long = "\n".join(["same" if i % 3 else f"own {i}" for i in range(5000)])
    rows = [(i, "same") for i in range(12)] + [(99, long)]
    got = {r.doc_id: r for r in line_dedup.line_digest(frame(spark, rows)).collect()}
    assert got[99].n_dropped == sum(1 for i in range(5000) if i % 3)


# ---- Near-duplicates -------------------------------------------------------------------------------


def components_expected(rows, width, percent):
    sets = {}
    for id_, text in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        sets[id_] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width, monkeypatch):
    # Small blocks, so that lists and families are dealt to pairs of blocks.
    monkeypatch.setattr(minhash_dedup, "LIST_BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "FAMILY_BLOCK", 5)
    rng, rows, n = random.Random(width), [], 0
    for _ in range(25):
        words = [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 40, 300]))]
        for _ in range(rng.choice([1, 2, 5, 14])):
            rows.append((n, " ".join(words)))
            n += 1
            if rng.random() < 0.7:
                words = list(words)
                words[rng.randrange(len(words))] = rng.choice(WORDS)
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    rows += [(n + i, passage + " " + " ".join(rng.choice(WORDS) for _ in range(60))) for i in range(30)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A  b\tC d e f"), (1004, "a b c D e f")]
    got = minhash_dedup.near_duplicates(frame(spark, rows + [rows[0]]), width=width).collect()
    assert len(got) == len(rows) + 1
    want = components_expected(rows, width, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark):
    text = prose(50)
    docs = frame(spark, [(2, text, "x"), (None, text, "y"), (1, text, None), (1, text, None)], "doc_id bigint, text string, rep string")
    got = sorted([tuple(r) for r in minhash_dedup.near_duplicates(docs).collect()], key=str)
    assert got == sorted([(2, 46, 1, False), (1, 46, 1, True), (1, 46, 1, True), (None, None, None, True)], key=str)
    left = sorted([(r.doc_id, r.rep) for r in minhash_dedup.drop_near_duplicates(docs).collect()], key=str)
    assert left == [(1, None), (None, "y")]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="0.8"):
        minhash_dedup.near_duplicates(docs, percent=70)


# ---- Secrets -----------------------------------------------------------------------------------------


def spans_expected(text):
    patterns = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ]
    found = [
        (m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(patterns) for m in re.finditer(p, text or "") if len(m[g]) >= least
    ]
    return [f"{patterns[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def test_secrets(spark):
    rng = random.Random(5)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    mixed = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(32)) for _ in range(40)]
    words = ["configuration", "identifier", "notification", "preferences", "administrator", "implementation"]
    texts = [f"some {rng.choice(words)} and {rng.choice(words)} password = {mixed[i]} é {hexes[i]}" for i in range(40)]
    texts += [
        None, "", "token=token=abcdef secret: token = abcdefgh", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "😀 API_KEY: 'abcdef'",
        " ".join(["passwd: abcdefg"] * 600), "ordinaryidentifiernotification and " + mixed[0], "pAsSwOrD\"='x+/_.=-1",
    ]
    rows = list(enumerate(texts)) + [(None, texts[0]), (0, texts[0])]
    got = secret_scan.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id or 0]
        base = spans_expected(text)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == base
    alone = next(r for r in got if r.doc_id == 46)
    # The random token is found by the models, the long identifier is not.
    assert alone.spans == f"markov:{len('ordinaryidentifiernotification and ')}:{len(texts[46])}"


def test_secrets_of_nothing(spark):
    empty = frame(spark, []).withColumn("base", F.lit("x"))
    assert secret_scan.scan(empty).count() == 0
    one = secret_scan.scan(frame(spark, [(1, None)])).first()
    assert (one.n_assign, one.spans, one.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
