"""The registered training-data queries on the smallest driver tables: against SQL, or against plain Python."""

import collections
import os
import re
import zlib

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

import __spark_entry__ as contract  # noqa: E402
import compare  # noqa: E402
import corpus_pipeline  # noqa: E402
from spanloom.llm import html_extract, packing, quality_rules, queries  # noqa: E402
from spanloom.llm.common import table  # noqa: E402
from spanloom.llm.sql import SQL  # noqa: E402
from tests.llm.test_text_operators import components_expected, spans_expected  # noqa: E402


@pytest.fixture(scope="module")
def con():
    import duckdb

    made = duckdb.connect()
    for name in compare.TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return made


def test_all_operators_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 14)}
    assert "pipeline" in names and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert compare._rows(df.columns, [tuple(r) for r in df.collect()]) == compare._rows(columns, result.fetchall())


def documents(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]


def test_near_duplicates_of_all_documents(spark):
    rows = documents(spark)
    got = queries.op4_minhash_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_expected(rows, 4, 80)


def test_secrets_of_all_documents(spark):
    texts = dict(documents(spark))
    for r in queries.op5_secret_scan(spark, SF).collect():
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == spans_expected(texts[r.doc_id])


def test_rates_of_all_documents(spark):
    got = queries.op3_source_mixing(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(t.encode().split()) for i, t in documents(spark)}
    assert all(r.rate >= 0 and abs(r.p_clean + r.p_junk + r.p_toxic - 1) < 1e-9 for r in got)


def pieces_expected(rows, capacity=2048):
    tokens = packing.WordTokens(queries.vocabulary("word_bpe_49k.json")).tokenizer
    out = collections.Counter()
    for id_, text in rows:
        ids = b"".join(i.to_bytes(4, "little") for i in [*tokens.encode(text or "", add_special_tokens=False).ids, 0])
        for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            out[id_, piece, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    return out


def packed(rows):
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def test_packing_of_all_documents(spark):
    got = queries.op6_best_fit_packing(spark, SF).collect()
    assert packed(got) == pieces_expected(documents(spark))


def test_main_text_of_all_pages(spark):
    import html

    got = {r.page_id: r.text for r in queries.op7_html_extraction(spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)
    assert html_extract.main_text("", None, ()) == ""


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "packing"]

    def run(name, rows):
        frame = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], docs.schema)
        out = stages[name](spark, frame, SF)
        if name != "packing":
            assert out.columns == columns
        return out.collect()

    def texts(found):
        return sorted((r.doc_id, r.text) for r in found)

    judged = [(i, quality_rules.judge(t, quality_rules.Limits())) for i, t in rows]
    kept = sorted((i, j[-1]) for i, j in judged if j[-2])
    found = run("quality_rules", rows)
    assert texts(found) == kept and all(r.n_chars == len(r.text) for r in found)

    holders = collections.defaultdict(set)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    for i, t in kept:
        for line in t.split("\n"):
            holders[key(line)].add(i)
    cleaned = sorted((i, "\n".join(x for x in t.split("\n") if not key(x) or len(holders[key(x)]) < 10)) for i, t in kept)
    assert texts(run("line_dedup", kept)) == cleaned

    label = components_expected(cleaned, 5, 80)
    single = [(i, t) for i, t in cleaned if label[i][1] == i]
    assert texts(run("near_duplicates", cleaned)) == single

    mixed = texts(run("mixing", single))
    assert set(mixed) <= set(single)
    assert packed(run("packing", mixed)) == pieces_expected(mixed)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables not present")
def test_mixing_stage_thins_out_toxic_documents(spark):
    """On the next larger tables, as a few dozen labels do not tell the domains apart."""
    sf = "/root/testdata/sf0.01"
    passed = table(spark, sf, "labels").filter("quality = 1").select("doc_id", "toxic")
    docs = table(spark, sf, "documents").join(passed.select("doc_id"), "doc_id", "left_semi")
    left = collections.Counter(r.doc_id for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, sf).select("doc_id").collect())
    marks = {r.doc_id: r.toxic for r in passed.collect()}
    clean, toxic = [i for i, t in marks.items() if not t], [i for i, t in marks.items() if t]
    assert sum(i in left for i in clean) >= 0.99 * len(clean)
    assert sum(left[i] for i in toxic) < 0.5 * len(toxic)
