"""URLs, mixing, packing, pages, vectors and archives, against plain Python."""

import base64
import collections
import gzip
import hashlib
import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from spanloom.llm import embedding_dedup, html_extract, packing, source_mixing, url_filters, warc
from spanloom.llm.common import Scratch, sorted_groups

# ---- URLs ---------------------------------------------------------------------------------------------


def verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fitting = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fitting, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("partitions", [1, 5])
def test_url_rules(spark, partitions):
    rng = random.Random(partitions)
    hosts, paths = ["net", "a.net", "-a.net", "", "com", "x.com", "é.org", "org"], ["", "/", "q", "/e", "/en", "/en/", "/en/a/", "/é/", "/z"]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(22)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [None, "", "nothing", "http://", "http://?x", "HTTP://A.NET/en/", "http://.net/", "http://a..net/en/x", "s://u@a.net:80/", "x://net", "a://b://c"]
    urls += [f"http://{rng.choice(['', 'w.', 'q.w.', 'xa.', '-a.', 'b.-a.', '.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'q', 'a/b', '?en/', '#', '/en/a/'])}" for _ in range(150)]
    urls += ["http://hot.a.net/en/a/1"] * 60
    rows = list(enumerate(urls)) + [(None, urls[5]), (0, urls[0])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = url_filters.judge_urls(pages, table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = collections.Counter((i, *verdict(u, rules)) for i, u in rows)
    assert collections.Counter(tuple(r) for r in got) == want
    assert {r.verdict for r in url_filters.judge_urls(pages, table.limit(0), default="block").collect()} == {"block"}
    assert url_filters.judge_urls(pages.limit(0), table).count() == 0


def test_a_rule_without_a_path_holds_around_rules_of_hosts_below(spark):
    rules = [("net", "", "block"), ("-a.net", "/q", "allow"), ("-a.net", "", "block"), ("net", "q", "allow")]
    urls = ["http://net/x", "http://foo.net/x", "http://b.-a.net/z", "http://-a.net/q/1", "http://netq/x", "http://net"]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), table).collect()
    assert sorted(tuple(r) for r in got) == [(i, *verdict(u, rules)) for i, u in enumerate(urls)]


# ---- Mixing ---------------------------------------------------------------------------------------------


def labelled(spark, n=300):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(rng.randrange(5, 60))]
        if bad:
            words[rng.randrange(len(words))] = "idiot!"
        docs.append((i, " ".join(words), "x"))
        if i % 3:
            labels.append((i, "toxic" if bad else "clean"))
    docs += [(None, "alpha idiot", None), (1000, None, None), (1001, "", "y"), docs[1]]
    return docs, spark.createDataFrame(docs, "doc_id bigint, text string, posteriors string"), spark.createDataFrame(labels, "doc_id bigint, domain string")


def test_mixing_meets_its_targets(spark):
    rows, docs, labels = labelled(spark)
    got = source_mixing.document_rates(docs, labels, {"clean": 0.9, "toxic": 0.1}).collect()
    assert len(got) == len(rows)
    tokens = {(i, t): len((t or "").split()) for i, t, _ in rows}
    assert sum(r.n_tokens for r in got) == sum(tokens[i, t] for i, t, _ in rows)
    p = np.array([[r.p_clean, r.p_toxic] for r in got])
    assert np.allclose(p.sum(axis=1), 1)
    right = [(r.p_toxic > 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 300]
    assert np.mean(right) > 0.97
    n, rate = np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    mass, reached = (n[:, None] * p).sum(axis=0), (n[:, None] * p * rate[:, None]).sum(axis=0)
    target = np.array([0.9, 0.1]) * min(mass[0] / 0.9, mass[1] / 0.1)
    assert np.abs(reached / target - 1).max() < 1e-3 and rate.min() >= 0
    # The rates are those of projected gradient steps taken over all documents.
    own = np.ones(len(n))
    for _ in range(40):
        own = np.maximum(0, own - p @ (((n * own) @ p - target) / mass))
    assert np.allclose(own, rate, atol=1e-2)


def test_mixed_rows(spark):
    rows, docs, labels = labelled(spark)
    left = source_mixing.mixed(docs, labels, {"clean": 0.99, "toxic": 0.01}, anchor="clean", snap=0.25)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert {i for i in range(300) if i % 4} <= set(ids) and ids.count(1) == 2
    assert sum(i is not None and i < 300 and i % 4 == 0 for i in ids) < 20
    assert source_mixing.mixed(docs.limit(0), labels, {"clean": 1.0}).count() == 0
    assert source_mixing.mixed(docs, labels.limit(0), {"clean": 1.0}).count() == len(rows)


def test_the_mixing_stage_meets_its_shares(spark, tmp_path):
    rows, docs, _ = labelled(spark, 4000)
    marks = [(i, int(i % 4 == 0), 1) for i in range(4000) if i % 3]
    spark.createDataFrame(marks, "doc_id bigint, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    left = collections.Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect())
    labels = corpus_pipeline.domain_labels(spark.read.parquet(str(tmp_path / "labels.parquet")))
    got = source_mixing.document_rates(docs, labels, corpus_pipeline.SHARES, anchor="clean").filter("doc_id < 4000 AND doc_id != 1").collect()
    tokens = np.array([[r.n_tokens * r.p_clean, r.n_tokens * r.p_toxic] for r in got])
    copies, rates = np.array([left[r.doc_id] for r in got]), np.array([r.rate for r in got])
    toxic = np.array([r.doc_id % 4 == 0 for r in got])
    wanted, reached = rates @ tokens, copies @ tokens
    assert reached[0] == pytest.approx(wanted[0], rel=0.01)
    assert wanted[1] / wanted.sum() == pytest.approx(corpus_pipeline.SHARES["toxic"], rel=0.05)
    assert reached[1] == pytest.approx(wanted[1], rel=0.25)
    assert copies[toxic].sum() > 0.5 * rates[toxic].sum() > 0


# ---- Packing --------------------------------------------------------------------------------------------


def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")


def test_words_give_the_tokenizers_ids():
    tokens = packing.WordTokens(vocabulary())
    texts = [
        "Plain words, twice words,\nand MORE.", "", " \t", "it's we'll 'd ''s", "naïve Ａ １２3 İstanbul ΑΣ ς", "a\u00a0b\u2003c\x1cd\x85e", "<|endoftext|> x<|startoftext|>y",
        "e\u0301 \u0301x", "日本語 😀😀 !!!???", "w" * 3000,
    ] * 2
    for text in texts:
        want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.ids(text), dtype="<u4").tolist() == want


def test_letters_between_punctuation_give_the_tokenizers_ids():
    tokens = packing.WordTokens(vocabulary(), kept=400)
    rng = random.Random(7)
    some = [*"abXY", "\u00e9", "\u00dc", "\u00df", "\u0130", "\u017f", "\u0149", "\u00d7", "\u00aa", "e\u0301", "K", "\u03a3", "7", "'s", "'LL", "<|endoftext|>", "endoftext"]
    marks = [*"!'.#<|>(", "\u0338", "\u0307", "\u00bf"]
    for _ in range(3000):
        before, after = (rng.choices(marks, k=rng.randrange(4)) for _ in range(2))
        word = "".join([*before, *rng.choices(some, k=rng.randrange(6)), *after])
        want = tokens.tokenizer.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(tokens.ids(word), dtype="<u4").tolist() == want, word


def test_letters_meet_the_tokenizer_once():
    tokens, seen = packing.WordTokens(vocabulary()), []

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, text, **options):
            seen.extend(text.lower().split())
            return self.inner.encode(text, **options)

    for name in ("tokenizer", "plain"):
        if hasattr(tokens, name):
            setattr(tokens, name, Watched(getattr(tokens, name)))
    for text in ("alpha \u00e9tude", "Alpha, (\u00e9TUDE) \"alpha'", "ALPHA! \u00e9tude... <|alpha|>"):
        assert len(tokens.ids(text)) >= 8
    assert [word.strip("!.,'\"()<|>") for word in seen if any(c.isalpha() for c in word)].count("alpha") == 1
    assert sum("tude" in word for word in seen) == 1


def test_packing(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.choice([0, 1, 5, 20, 30, 31, 90, 200]))) for _ in range(120)] + [None, "same words"] + ["hot"] * 60
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "no id", None), (0, texts[0], "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length string")
    got = packing.pack(docs.repartition(5), vocabulary(), capacity=64).collect()
    tokens = packing.WordTokens(vocabulary())
    want = collections.Counter()
    for i, t, _ in rows:
        ids = tokens.ids(t or "") + b"\0" * 4
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[i, piece, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(used) <= -(-total // 64) + 2
    assert packing.pack(docs.limit(0), vocabulary(), capacity=64).count() == 0


@pytest.mark.parametrize("histogram", [{}, {64: 7}, {33: 10}, {40: 6, 24: 6}, {1: 1000, 63: 10}, {20: 5, 22: 7, 21: 9, 43: 3, 11: 30}])
def test_plans_cover_the_histogram(histogram):
    plan = packing.packing_plan(histogram, 64)
    packed = collections.Counter()
    for config, n in plan:
        assert sum(config) <= 64 and n > 0
        for length in config:
            packed[length] += n
    assert packed == collections.Counter(histogram)
    assert sum(n for _, n in plan) >= -(-sum(k * v for k, v in histogram.items()) // 64)


def test_knapsack_against_all_choices():
    lengths, prices = np.array([2, 3, 5]), np.array([1.0, 1.7, 2.9])
    best, _ = packing.knapsack(lengths, prices, 12)
    for size in range(13):
        choices = [a + 1.7 * b + 2.9 * c for a in range(7) for b in range(5) for c in range(3) if 2 * a + 3 * b + 5 * c <= size]
        assert best[size] == pytest.approx(max(choices))


# ---- Pages ------------------------------------------------------------------------------------------------


def page(i, body, article=True):
    own = f"<h1>Title {i}</h1><p>First &amp; best {i}<p>Second\n  part&nbsp;{i}"
    block = f"<article>{own}<div class='share'>Tell a friend</div></article>" if article else f"<div class=text>{own}</div>"
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Menu {i}</a></nav>"
        f"<div class='ad'>Buy {i}</div>{block}{body}<footer>&copy; me {i}</footer></body></html>"
    )


def test_main_text(spark):
    slogan = "<div>We are the best site</div>"
    odd = [None, "", "plain <b>text", "<p>a<br>b<p>c", "<script>var x='</p>'</script>x<!-- y -->z", "<article>un<p>closed", "<div " * 50, "<div>" * 3000 + "deep"]
    rows = [(i, f"http://a.net/{i}", page(i, "<aside>More</aside>" + slogan)) for i in range(12)]
    rows += [(20 + i, f"http://b.net/{i}", page(i, slogan + "<form><p>Write</p></form>", article=False)) for i in range(12)]
    rows += [(50 + i, "http://c.net/", x) for i, x in enumerate(odd)] + [(None, None, "<p>x</p>")] + [rows[0]] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1))
    got = html_extract.extract_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    for i in range(12):
        assert by[i] == f"Title {i}\nFirst & best {i}\nSecond part {i}"
        assert by[20 + i] == by[i]  # the content slot is found without an article element
    assert [by[50 + i] for i in range(6)] == ["", "", "plain text", "a b\nc", "xz", "un\nclosed"]
    assert by[57] == "deep" and by[None] == "x"
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def seen(pages):
    """The evidence of pages that are all different, with the first as reference."""
    gathered = {}
    for page_ in pages:
        for node, same, *sizes in html_extract.evidence(page_, pages[0]):
            gathered.setdefault(node, []).append((1, int(same), *sizes))
    return tuple((node, *map(sum, zip(*rows, strict=True))) for node, rows in sorted(gathered.items()))


def test_a_page_without_the_usual_text_keeps_its_own():
    for tag, n in (("article", 40), ("div", 10)):
        usual = [f"<body><{tag}><p>By the editors</p><p>First of {i}</p><p>Second of {i}</p></{tag}>" for i in range(n)]
        other = f"<body><{tag}><p>First of all</p><p>Second of all</p></{tag}>"
        stats = seen([*usual, other])
        assert html_extract.main_text(usual[3], usual[0], stats) == "First of 3\nSecond of 3"
        assert html_extract.main_text(other, usual[0], stats) == "First of all\nSecond of all"


def test_all_varying_text_is_content():
    def plain(i):
        column = f"<div class=text><p>Long story {i} {'on ' * 60}</p></div><div class=more><p>Second column {i}</p></div>"
        return f"<body><div class=top>Our site</div><div class=page><h1>Title {i}</h1>{column}</div><div class=end>All rights</div>"

    usual = [plain(i) for i in range(10)]
    other = "<body><div class=top>Our site</div><table><tr><td>Another template's story</table><div class=end>All rights</div>"
    stats = seen([*usual, other])
    assert html_extract.main_text(usual[4], usual[0], stats) == f"Title 4\nLong story 4 {'on ' * 60}".strip() + "\nSecond column 4"
    assert html_extract.main_text(other, usual[0], stats) == "Another template's story"


@pytest.mark.parametrize("deep", ["<div>" * 100, "<div>" + "<b>" * 100, "<div>" * 20_000])
def test_blocks_stay_blocks_at_any_depth(deep):
    def nested(i):
        return f"<body>{deep}<p>One {i}</p><nav>Menu {i}</nav><p>Two {i}</p><!-- x --><footer>Foot {i}</footer><div class=ad>Buy {i}</div>"

    pages = [nested(i) for i in range(5)]
    assert html_extract.main_text(pages[2], pages[0], seen(pages)) == "One 2\nTwo 2"
    article = pages[1].replace("<body>", "<body><article>")
    assert html_extract.main_text(article, None, ()) == "One 1\nTwo 1"


@pytest.mark.parametrize("shell", [
    '<div class="site no-sidebar">%s</div>', '<div id="search-results-page">%s</div>', '<section class="social-science">%s</section>',
    '<div class="entry comment-closed">%s</div>', '<div class="search">%s</div>', '<div class="widget hidden">%s</div>',
])
def test_names_that_hold_a_purpose_word_do_not_delete_the_text(shell):
    text = "One real paragraph of some length."
    assert html_extract.main_text(f"<body>{shell % f'<p>{text}</p>'}</body>", None, ()) == text
    around = "<div class=site-footer>Foot</div><ul class='comment-list'><li>Comment</ul><div id=nav-menu>Menu</div><div role=search>Find</div>"
    assert html_extract.main_text(f"<body>{shell % f'<p>{text}</p>'}{around}</body>", None, ()) == text
    assert html_extract.main_text(f"<body>{around}{shell % f'<article><p>{text}</p></article>'}</body>", None, ()) == text


def test_all_articles_of_a_page_stay():
    parts = "<article><p>Part one</p></article><aside><article>Teaser</article></aside><article><p>Part two, longer</p></article>"
    assert html_extract.main_text(f"<body><p>Before</p>{parts}</body>", None, ()) == "Part one\nPart two, longer"


def _tree(rng, depth):
    node = html_extract.Node("x", rng.choice("ab") if depth < 4 else "root", False)
    node.items = [_tree(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0)]
    return node


def _most(a, b):
    """Simple tree matching as it is defined."""
    if a.label != b.label:
        return 0
    left, right = a.blocks(), b.blocks()
    rows = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, p in enumerate(left):
        for j, q in enumerate(right):
            rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + _most(p, q))
    return rows[-1][-1] + 1


def test_alignment_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        a, b = _tree(rng, 4), _tree(rng, 4)
        got = html_extract.align(a, b)
        order = {id(n): k for tree in (a, b) for k, n in enumerate(html_extract.numbered(tree))}
        above = {id(c): n for tree in (a, b) for n in html_extract.numbered(tree) for c in n.blocks()}
        assert len(got) == _most(a, b)
        places = sorted((order[id(p)], order[id(q)]) for p, q in got)
        assert all(p < r and q < s for (p, q), (r, s) in zip(places, places[1:], strict=False))
        pairs = {(id(p), id(q)) for p, q in got}
        assert all(p.label == q.label and (p is a or (id(above[id(p)]), id(above[id(q)])) in pairs) for p, q in got)


@pytest.mark.parametrize(("short", "part"), [(0, 1 << 20), (0, 4), (3, 1)])
def test_alignment_by_rows_against_brute_force(monkeypatch, short, part):
    monkeypatch.setattr(html_extract, "SHORT_PAIRS", short)
    monkeypatch.setattr(html_extract, "PART_PAIRS", part)
    rng = random.Random(8)
    for _ in range(200):
        a, b = _tree(rng, 4), _tree(rng, 4)
        got = html_extract.align(a, b)
        order = {id(n): k for tree in (a, b) for k, n in enumerate(html_extract.numbered(tree))}
        assert len(got) == _most(a, b)
        places = sorted((order[id(p)], order[id(q)]) for p, q in got)
        assert all(p < r and q < s for (p, q), (r, s) in zip(places, places[1:], strict=False))


def test_template_far_off_the_diagonals_goes():
    def page(first, then, seed):
        rows = "".join(f"<p>Text {seed} {i}</p>" for i in range(first)) + "<div class=box><b>Our</b> site</div>"
        return f"<body>{rows}" + "".join(f"<ul><li>Item {seed} {i}</li></ul>" for i in range(then)) + "</body>"

    pages = [page(60, 60, 0), *(page(15 + 2 * k, 5 + 2 * k, k) for k in range(1, 9))]
    pairs = html_extract.align(html_extract.parse(pages[0]), html_extract.parse(pages[1]))
    assert len(pairs) == 2 + 17 + 1 + 2 * 7  # page and body, paragraphs, the box, lists and their items
    stats = collections.defaultdict(lambda: [0, 0])
    for other in pages:
        for node, same in html_extract.evidence(other, pages[0]):
            stats[node][0] += 1
            stats[node][1] += same
    known = tuple((node, *counts) for node, counts in sorted(stats.items()))
    assert "Our site" not in html_extract.main_text(pages[1], pages[0], known)
    assert "Text 1 16\nItem 1 0" in html_extract.main_text(pages[1], pages[0], known)


@pytest.mark.parametrize("block", ["<p>Text {}</p>", "<div class=row><p>Text {}</p></div>"])
def test_long_pages_are_aligned_in_time_that_grows_with_them(block):
    def long(n, seed):
        return "<body><div class=top>Our site</div>" + "".join(block.format(seed + i) for i in range(n)) + "<div class=end>All rights</div>"

    started = time.monotonic()
    pairs = html_extract.align(html_extract.parse(long(10_000, 0)), html_extract.parse(long(9_000, 5)))
    assert time.monotonic() - started < 20
    assert len(pairs) == 4 + 9_000 * block.count("</")  # page, body, top, end
    assert {html_extract.own_text(q) for _, q in pairs} >= {"Our site", "All rights"}


def test_simple_tree_matching_counts_the_most_matches():
    def tree(spec):
        node = html_extract.Node(spec[0], spec[0], False)
        node.items = [tree(x) for x in spec[1:]]
        return node

    a = tree(["a", ["b", ["c"]], ["d"], ["b", ["c"], ["e"]]])
    b = tree(["a", ["b", ["c"], ["e"]], ["d"]])
    assert len(html_extract.align(a, b)) == 4
    assert len(html_extract.align(b, a)) == 4


# ---- Vectors -------------------------------------------------------------------------------------------------


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((20, 32))
    vectors = [base[i % 20] + rng.standard_normal(32) * rng.choice([0.05, 0.15, 0.2]) for i in range(150)]
    vectors += [base[0] + rng.standard_normal(32) * 0.03 for _ in range(40)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    rows += [(500, rows[3][1]), (501, [2 * x for x in rows[3][1]]), (502, [0.0] * 32), (503, None), (504, [float("nan")] * 32), (505, [1.0, None]), (506, []), (507, [1.0, 2.0]), (508, [2.0, 4.0]), (509, [float("inf")] * 2)]
    good = {i: np.array(v, dtype=float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j in good if j != i and len(good[j]) == len(good[i]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.95} for i in good}
    frame = spark.createDataFrame(rows + [rows[0], (None, rows[0][1])], "vec_id bigint, embedding array<float>").withColumn("rep", F.lit("x"))
    got = embedding_dedup.near_vectors(frame).collect()
    assert len(got) == len(rows) + 2
    found = {r.vec_id: r.n_links for r in got if r.vec_id is not None}
    true = sum(map(len, links.values()))
    assert sum(found.values()) >= 0.99 * true and all(found[i] <= len(links.get(i, ())) for i in found)
    assert all(found[i] == 0 and next(r for r in got if r.vec_id == i).kept for i in (502, 503, 504, 505, 506, 509))
    assert found[507] == 1 and found[508] == 1
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_recall_of_windows():
    assert embedding_dedup.least_count(32) < 32 * 0.95
    assert embedding_dedup.least_count(32, 0.5) >= embedding_dedup.least_count(32, 0.9999)


@pytest.mark.parametrize(("vectors", "cuts"), [(51_282, 10), (1_000_000, 14), (3_000_000, 16)])
def test_recall_of_vectors_does_not_fall_with_their_number(vectors, cuts):
    tables, got_cuts = embedding_dedup.layout(vectors, 64, 0.998, 16)
    assert got_cuts == cuts
    rng, pairs = np.random.default_rng(cuts), 8000
    one, other = rng.standard_normal((2, pairs, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (one * other).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    two = 0.95 * one + np.sqrt(1 - 0.95**2) * other
    keys = []
    for side in (one, two):
        made = embedding_dedup._window_keys(0.95, tables, cuts, 32, 11)(iter([pd.DataFrame({"vector": list(side)})]))
        keys.append(np.stack(next(made)["keys"].to_list()))
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.9965


# ---- Archives -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_archives_round_trip(spark, tmp_path, monkeypatch, min_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = ["<p>é 😀</p>", "same", "same", "", None, "x" * 5000, "\r\n\r\nWARC/1.1\r\n", "ab", "ab"]
    rows = [(i, f"http://h/{i} \n", h) for i, h in enumerate(pages)] + [(30 + i, None, "same") for i in range(20)] + [(None, "u", "same"), (7, "http://h/7 \n", "ab")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit(0))
    index = warc.archive(frame.repartition(3), folder=str(tmp_path / "out"), min_bytes=min_bytes)
    assert {"file", "offset", "length", "url", "digest"} <= set(index.columns) and index.count() == len(rows)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", -1))
    for r in got:
        want = [h or "" for i, _, h in rows if i == r.page_id]
        payload = want[0].encode()
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        original = last[want[0]] == r.page_id or len(payload) < min_bytes
        assert (r.record_type, r.refers_to) == (("response", None) if original else ("revisit", last[want[0]]))
        assert r.payload == (payload if original else None)
    # Any selection of the index reads the same records, and every file is a series of gzip members.
    some = warc.read_records(index.filter("page_id % 7 = 1")).collect()
    assert sorted(r.page_id for r in some) == sorted(i for i, _, _ in rows if i is not None and i % 7 == 1)
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "out").glob("*.warc.gz"))
    assert whole.count(b"WARC-Record-ID") == len(rows)
    assert warc.read_records(warc.archive(frame.limit(0), folder=str(tmp_path / "none"))).count() == 0


# ---- Helpers ----------------------------------------------------------------------------------------------------


def test_sorted_groups_span_batches():
    import pandas as pd

    frame = pd.DataFrame({"a": [1, 1, 1, 2, 2, 3, 3, 3, 3], "b": range(9)})
    for size in range(1, 10):
        groups = list(sorted_groups((frame.iloc[i : i + size] for i in range(0, 9, size)), ["a"]))
        assert [g["b"].tolist() for g in groups] == [[0, 1, 2], [3, 4], [5, 6, 7, 8]]


def test_components_of_chains_and_stars(spark):
    from spanloom.llm import components

    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 240)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    rng.shuffle(links)
    label = {}
    for a, b in links:
        label.setdefault(a, a)
        label.setdefault(b, b)
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(6)
    got = components.components(frame, Scratch(spark)).collect()
    moving = {a for a, b in links if a != b} | {b for a, b in links if a != b}
    assert {r.node: r.component for r in got} == {k: v for k, v in label.items() if k in moving}
