"""JSON documents read in pieces, against whole parsing."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.plans import workbench
from spanloom.sources import files, otel, records
from traces import traced_session, write

ODD = ["", "a", "é{", "}\\\\", '\\\\"', "[{", "\\n}]", "\\u00e9}", "x" * 40, '"}, {"', "\\\\}"]


def some_json(rng, depth=3):
    kind = rng.randrange(4 if depth else 2)
    if kind == 0:
        return "".join(rng.choices(ODD, k=rng.randrange(4)))
    if kind == 1:
        return rng.choice([None, True, 1, -2.5])
    if kind == 2:
        return [some_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {f"k{i}{rng.choice(ODD)}": some_json(rng, depth - 1) for i in range(rng.randrange(4))}


def pieces_of(rng, text, path):
    """The text in pieces cut behind some of its closing braces."""
    parts, at = [], 0
    for k, c in enumerate(text):
        if c == "}" and rng.random() < 0.5:
            parts.append(text[at : k + 1])
            at = k + 1
    return [(path, i // 3, i % 3, part) for i, part in enumerate([*parts, text[at:]])]


@pytest.mark.parametrize("crowded", [False, True])
def test_records_of_random_arrays(spark, request, crowded):
    if crowded:
        request.getfixturevalue("hot")
    rng = random.Random(int(crowded))
    rows, want = [], {}
    for n in range(60):
        array = [some_json(rng) for _ in range(rng.randrange(12))]
        text = json.dumps(array, ensure_ascii=bool(n % 2), indent=n % 3 or None)
        rows += pieces_of(rng, text, f"/d/{n}.json")
        want[f"/d/{n}.json"] = [x for x in array if isinstance(x, dict)]
    rng.shuffle(rows)
    rows += [(None, 0, 0, "[{}]"), ("/d/null", 0, 0, None), ("/d/open", 0, 0, '[{"a":1},{"b":['), ("/d/text", 0, 0, "} no json \"")]
    want["/d/open"] = [{"a": 1}]
    pieces = spark.createDataFrame(rows, "path string, block bigint, piece bigint, text string").withColumn("offset", F.lit(1))
    got = {}
    for row in records.records(pieces, 1).orderBy("path", "offset").collect():
        got.setdefault(row.path, []).append(json.loads(row.record))
    assert got == {path: found for path, found in want.items() if found}
    assert records.records(pieces.limit(0), 1).count() == 0


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    events = [{"event_name": f"e{i}", "body": "{[\\\\\"é}" * (i % 50), "tool_input": json.dumps({"i": i})} for i in range(4_000)]
    write(tmp_path, "logs.json", json.dumps(events, indent=1, ensure_ascii=False))
    write(tmp_path, "small.json", "[]")
    size = (tmp_path / "logs.json").stat().st_size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 7))
    try:
        pieces = records.read_pieces(spark, [str(tmp_path)], "*.json", 1_000)
        parts = pieces.withColumn("part", F.spark_partition_id()).groupBy("path").agg(F.countDistinct("part").alias("n")).collect()
        assert len(parts) == 1 and parts[0].n >= 7
        whole = "".join(r.text for r in pieces.orderBy("block", "piece").collect())
        assert whole == (tmp_path / "logs.json").read_text()
        got = otel.record_logs(records.records(pieces, otel.EVENT_LEVEL)).orderBy("pos").select("event_name", "body", "tool_input").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == [(e["event_name"], e["body"], e["tool_input"]) for e in events]


def test_files_are_the_same_whole_and_in_pieces(spark, tmp_path, monkeypatch):
    spans, logs = traced_session()
    write(tmp_path, "trace-1.json", spans)
    write(tmp_path, "logs.json", logs)
    monkeypatch.setattr(records, "PIECE_CHARS", 300)

    def read():
        inputs = files.listing(spark, [str(tmp_path)])
        parts = [make(spark, [str(tmp_path)], inputs) for make in (workbench._spans, workbench._logs)]
        assert [p.schema["pos"].dataType.simpleString() for p in parts] == ["bigint", "bigint"]
        return [[tuple(r) for r in p.orderBy("path", "pos").drop("pos").collect()] for p in parts]

    whole = read()
    spark.conf.set(records.WHOLE_BYTES_CONF, "10")
    try:
        assert read() == whole and all(whole)
    finally:
        spark.conf.unset(records.WHOLE_BYTES_CONF)
