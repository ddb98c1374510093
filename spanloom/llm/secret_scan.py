"""Secrets in texts: fixed patterns, and character Markov models of random strings and identifiers.

One pass over the texts finds the spans of the patterns and the long tokens that may be secrets; it also
takes the labelled samples: values behind the patterns are random strings, ordinary words are not. Two
first-order Markov models of characters are counted from the samples. A long token outside the pattern
spans is a secret if the log of the likelihood ratio of the models reaches ``least``.

Positions come from the lengths of the pieces between matches, so everything stays inside one row and
inside DataFrame functions; texts are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch

#: Kinds in the order in which they are listed; the last is that of the models.
KINDS = ("assign", "access", "hex", "markov")
#: The patterns, the group that holds the value, and the characters a value needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24)}
#: What may be a secret on its own, and what an ordinary word looks like.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z_]{5,}"
#: Characters with a state of their own; all others share one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Prefix sums are taken in blocks, so that long texts take time in proportion.
BLOCK = 256


def _running(values: Column, first: Column) -> Column:
    """``first``, and its sums with the values so far."""
    return F.aggregate(values, F.array(first), lambda seen, x: F.concat(seen, F.array(F.element_at(seen, -1) + x)))


def add_matches(rows: DataFrame, name: str, pattern: str, group: int, kind: str, least: int) -> DataFrame:
    """Adds ``name``: spans (start, kind's number, end, value) of the matches whose value has ``least`` characters.

    Column by column, as an expression inside a lambda function is computed for every element. Texts
    without a match have empty arrays throughout.
    """
    there = F.rlike("text", F.lit(pattern))
    nothing = F.array().cast("array<string>")
    found = rows.withColumn("whole", F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(nothing))
    some = F.size("whole") > 0
    value = F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(nothing) if group else F.col("whole")
    found = found.withColumns({"value": value, "pieces": F.when(some, F.split("text", pattern, -1)).otherwise(nothing)})
    # The end of a match comes this much after the end of the one before.
    zero = F.lit(0).cast("bigint")
    steps = F.zip_with(F.slice("pieces", 1, F.size("whole")), F.col("whole"), lambda p, m: (F.char_length(p) + F.char_length(m)).cast("bigint"))
    found = found.withColumn("steps", steps)
    numbers = F.sequence(F.lit(0), F.floor(F.size("steps") / BLOCK).cast("int"))
    found = found.withColumn("blocks", F.transform(numbers, lambda b: F.slice("steps", b * BLOCK + 1, BLOCK)))
    found = found.withColumn("begins", _running(F.transform("blocks", lambda b: F.aggregate(b, zero, lambda x, y: x + y)), zero))
    ends = F.flatten(F.zip_with("blocks", F.slice("begins", 1, F.size("blocks")), lambda b, s: F.slice(_running(b, s), 2, F.greatest(F.size(b), F.lit(1)))))
    found = found.withColumn("ends", ends)
    number = KINDS.index(kind)
    spans = F.zip_with(
        F.arrays_zip("ends", "whole"), F.col("value"),
        lambda s, v: F.struct(
            (s["ends"] - F.char_length(s["whole"])).alias("start"), F.lit(number).alias("kind"), s["ends"].alias("end"), v.alias("value")
        ),
    )
    found = found.withColumn("spans", spans)
    kept = F.filter("spans", lambda s: F.char_length(s["value"]) >= least)
    return found.withColumn(name, kept).drop("whole", "value", "pieces", "steps", "blocks", "begins", "ends", "spans")


def _states(token: Column) -> Column:
    return F.transform(F.split(token, "", -1), lambda c: F.instr(F.lit(ALPHABET), c))


def _steps(states: Column) -> Column:
    """The numbers of the steps from each character to the next."""
    n = F.size(states)
    return F.zip_with(F.slice(states, 1, F.greatest(n - 1, F.lit(0))), F.slice(states, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a * STATES + b)


def ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each step, random over ordinary, from (token, random); at most STATES ** 2 rows.

    Every step counts half a time more than it was seen.
    """
    steps = samples.select("random", F.explode(_steps(_states(F.col("token")))).alias("step"))
    counts = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}
    logs = {}
    for random in (True, False):
        for a in range(STATES):
            row = [counts.get((random, a * STATES + b), 0) + 0.5 for b in range(STATES)]
            logs[random, a] = [math.log(x / sum(row)) for x in row]
    return [x - y for a in range(STATES) for x, y in zip(logs[True, a], logs[False, a], strict=True)]


def score(token: Column, model: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # one constant
    return F.aggregate(_steps(_states(token)), F.lit(0.0), lambda total, s: total + F.element_at(table, s + 1))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(
        spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    ), ",")


def _number(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 12.0, word_rows: int = 20_000
) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, sorted and comma-joined; ``base_sha256`` is the
    hash of those of the patterns. A null text is empty. Ordinary words are taken from about
    ``word_rows`` rows, chosen by hash; values behind patterns from all rows. Without samples of either
    kind both models are even and find nothing.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = min(1.0, word_rows / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)
    seen = rows.withColumn("words", F.when(chosen, F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))))
    for kind in KINDS[:3]:
        seen = add_matches(seen, kind, *PATTERNS[kind][:2], kind, PATTERNS[kind][2])
    seen = add_matches(seen, "tokens", TOKEN, 0, "markov", 0)
    seen = seen.select("id", F.array_sort(F.concat(*KINDS[:3])).alias("base"), "tokens", "words")
    seen = scratch.keep(seen, "seen")
    samples = seen.select(F.explode("base.value").alias("token"), F.lit(True).alias("random")).filter("char_length(token) >= 16").unionByName(
        seen.select(F.explode("words").alias("token"), F.lit(False).alias("random"))
    )
    model = ratios(samples)
    secret = F.filter("tokens", lambda t: (score(t["value"], model) >= least) & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    told = seen.select("id", "base", F.array_sort(F.concat("base", secret)).alias("spans"))
    return told.select(
        F.col("id").alias(id_col), *[_number(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
