"""Mixing documents to target token shares of domains, with soft membership.

1. A classifier that adds up the evidence of hashed words is counted from labelled documents; a scale and
   a bias per domain, fitted on labelled documents it was not counted from, turn sums into posteriors.
2. Each document has a rate, its expected number of copies. The expected tokens of domain k are the sum of
   rate x tokens x posterior over all documents, and should match the target. Projected gradient steps
   for the least squares of the relative differences, in the metric of the tokens, change a rate by the
   document's posteriors times one number per domain, and cut it at zero. So a rate is a fold of these
   numbers over the document's own posteriors: a step is one sum over a slim table, nothing is written,
   and what the driver holds is one number per domain and step.

Only DataFrame functions are used, and no row moves but for the sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import BLANKS, Scratch, ascii_lower

#: Places for words that tell domains apart; of words that share a place the strongest has it.
PLACES = 1 << 14
#: A character that is no letter, digit or white space, as far as ASCII goes.
SYMBOL = r"[!-/:-@\[-`{-~]"
#: Documents that a word's prior weighs, and the standard deviations within which counts may be chance.
SMOOTHING, CHANCE = 5.0, 4.0


def add_features(rows: DataFrame) -> DataFrame:
    """``n_tokens`` and the distinct ``features`` of ``text``: hashes of its words, without stops at their ends, and symbols."""
    lowered = rows.withColumn("lowered", F.btrim(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(BLANKS)))
    empty = F.array().cast("array<string>")
    words = F.when(F.col("lowered") == "", empty).otherwise(F.split("lowered", r"[\x20\x09-\x0D]+", -1))
    symbols = F.array_distinct(F.regexp_extract_all("lowered", F.lit(rf"{SYMBOL}{{2,}}|\x20{SYMBOL}\x20"), F.lit(0)))
    parted = lowered.withColumns({"words": words, "symbols": symbols})
    hashes = F.concat(
        F.transform("words", lambda w: F.xxhash64(F.rtrim(w, F.lit(".,;:!?")))), F.transform("symbols", lambda w: F.xxhash64(w))
    )
    told = parted.withColumns({"n_tokens": F.size("words").cast("bigint"), "features": F.array_distinct(hashes)})
    return told.drop("lowered", "words", "symbols")


def evidence(here: int, everywhere: int, prior: float) -> float:
    """Log of how much likelier a domain is where a word is seen; zero where chance may explain it."""
    expected = everywhere * prior
    if abs(here - expected) <= CHANCE * math.sqrt(expected * (1 - prior)) + 1:
        return 0.0
    return math.log((here + SMOOTHING * prior) / ((everywhere + SMOOTHING) * prior))


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    words: list[int]  # by place, 0 for none
    weights: list[list[float]]
    scales: list[float]
    biases: list[float]
    held_out: dict[str, float] = field(default_factory=dict)

    def add_evidence(self, rows: DataFrame) -> DataFrame:
        """``found``, the sums of evidence per domain, from the column ``features``."""
        words = constant(self.words, "bigint")
        known = F.filter("features", lambda h: F.element_at(words, _place(h) + 1) == h)
        told = rows.withColumn("known", F.transform(known, _place))
        sums = [F.aggregate("known", F.lit(0.0), _adder(weights)) for weights in self.weights]
        return told.withColumn("found", F.array(*sums)).drop("known")

    def add_posteriors(self, rows: DataFrame) -> DataFrame:
        """``posteriors``, one probability per domain, from the column ``features``.

        Column by column, as an expression inside a lambda function is computed for every element.
        """
        scored = self.add_evidence(rows)
        weighed = F.zip_with(F.col("found"), constant(self.scales), lambda e, s: e * s)
        scored = scored.withColumn("found", F.zip_with(weighed, constant(self.biases), lambda e, b: e + b))
        scored = scored.withColumn("top", F.array_max("found"))
        scored = scored.withColumn("found", F.transform("found", lambda s: F.exp(s - F.col("top"))))
        scored = scored.withColumn("top", F.aggregate("found", F.lit(0.0), lambda a, b: a + b))
        return scored.withColumn("posteriors", F.transform("found", lambda p: p / F.col("top"))).drop("found", "top")


def _place(feature: Column) -> Column:
    return F.pmod(feature, F.lit(PLACES)).cast("int")


def constant(values: list, kind: str = "double") -> Column:
    """An array of numbers as one constant; they are exact, as text of a double is."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _adder(weights: list[float]):
    table = constant(weights)
    return lambda total, place: total + F.element_at(table, place + 1)


def fit_classifier(
    docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str, text_col: str, label_rows: int
) -> Classifier:
    """Counted on four fifths of at most ``label_rows`` labelled documents, its scales and biases on the rest.

    ``labels`` has the id and ``domain``; rows of other domains do not count. An id with several labels
    counts under each. The labels used are those of the smallest hashes, and small enough to broadcast.
    """
    known = labels.filter(F.col("domain").isin(domains) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("labelled"), "domain"
    ).distinct()
    total = known.count()
    some = known.filter(F.pmod(F.xxhash64("labelled"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.95 * label_rows / max(1, total))))
    some = some.limit(label_rows) if total > label_rows else some
    texts = docs.select(F.col(id_col).cast("bigint").alias("labelled"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession)
    sample = scratch.keep(add_features(texts.join(F.broadcast(some), "labelled")).drop("text").withColumn("test", F.pmod(F.xxhash64("labelled", F.lit(5)), F.lit(5)) == 0), "sample")
    train = sample.filter("NOT test")
    number = {r["domain"]: r["n"] for r in train.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    everything = sum(number.values())
    priors = [math.log((number.get(d, 0) + 1) / (everything + len(domains))) for d in domains]
    counts = [F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]
    seen = train.select("domain", F.explode("features").alias("word")).groupBy("word").agg(*counts, F.count("*").alias("n"))
    surprise = F.greatest(*[
        F.abs(F.col(f"n{k}") - F.col("n") * math.exp(p)) - CHANCE * F.sqrt(F.col("n") * (math.exp(p) * (1 - math.exp(p)))) for k, p in enumerate(priors)
    ], F.lit(0.0))
    strong = seen.withColumn("surprise", surprise).filter("surprise > 1").groupBy(_place(F.col("word")).alias("place")).agg(
        F.max_by(F.struct("word", "n", *[f"n{k}" for k in range(len(domains))]), "surprise").alias("of")
    )
    words, weights = [0] * PLACES, [[0.0] * PLACES for _ in domains]
    for place, of in strong.collect():  # at most PLACES rows
        words[place] = of["word"]
        for k, prior in enumerate(priors):
            weights[k][place] = evidence(of[f"n{k}"], of["n"], math.exp(prior))
    raw = Classifier(domains, words, weights, [1.0] * len(domains), priors)
    tests = raw.add_evidence(sample.filter("test")).select("domain", F.col("found").alias("scores")).collect()
    scores = np.array([r["scores"] for r in tests], dtype=float).reshape(-1, len(domains))
    truth = np.array([domains.index(r["domain"]) for r in tests], dtype=int)
    scales, biases = calibrated(scores, truth, np.array(priors))
    right = float(((scores * scales + biases).argmax(axis=1) == truth).mean()) if len(truth) else 0.0
    return Classifier(domains, words, weights, scales.tolist(), biases.tolist(), {"rows": len(truth), "accuracy": right})


def calibrated(scores: np.ndarray, truth: np.ndarray, priors: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """A scale and a bias per domain, by the likelihood of the held-out rows; near 1 and the priors if few."""
    scales, biases = np.ones(len(priors)), priors.copy()
    target = np.eye(len(priors))[truth]
    for _ in range(rounds if len(truth) else 0):
        logits = scores * scales + biases
        powers = np.exp(logits - logits.max(axis=1, keepdims=True))
        off = powers / powers.sum(axis=1, keepdims=True) - target
        spread = np.maximum((scores**2).mean(axis=0), 1.0)
        scales -= (off * scores).mean(axis=0) / spread + 0.01 * (scales - 1) / len(truth)
        biases -= off.mean(axis=0) + 0.01 * (biases - priors) / len(truth)
    return scales, biases


@dataclass(frozen=True)
class Mixture:
    """A classifier, the steps that fold posteriors into a rate, and how well the targets are met."""

    classifier: Classifier
    steps: list[list[float]]
    targets: list[float]
    reached: list[float]

    def rate(self, posteriors: Column) -> Column:
        return folded_rate(posteriors, self.steps)


def folded_rate(posteriors: Column, steps: list[list[float]]) -> Column:
    if not steps:
        return F.lit(1.0)

    def step(rate: Column, change: Column) -> Column:
        moved = F.aggregate(F.zip_with(posteriors, change, lambda p, c: p * c), F.lit(0.0), lambda a, b: a + b)
        return F.greatest(F.lit(0.0), rate - moved)

    return F.aggregate(F.lit(steps), F.lit(1.0), step)


def fit_rates(
    members: DataFrame, shares: list[float], tokens: float | None, rounds: int, close: float, anchor: int | None = None
) -> tuple[list[list[float]], list[float], list[float]]:
    """Steps, targets and reached totals, for ``members`` of n_tokens and posteriors.

    ``tokens`` is the wanted total; by default that in which the domain ``anchor`` has all its tokens once,
    or without one the most that needs no document more than once on average.
    """
    k = len(shares)

    def totals(rate: Column) -> list[float]:
        row = members.agg(*[F.sum(rate * F.col("n_tokens") * F.element_at("posteriors", i + 1)).alias(f"k{i}") for i in range(k)]).first()
        return [row[f"k{i}"] or 0.0 for i in range(k)]

    mass = totals(F.lit(1.0))
    if tokens is None and anchor is not None:
        tokens = mass[anchor] / shares[anchor]
    elif tokens is None:
        tokens = min((m / s for m, s in zip(mass, shares, strict=True) if s > 0 and m > 0), default=0.0)
    targets = [s * tokens for s in shares]
    steps: list[list[float]] = []
    reached = mass
    for _ in range(rounds):
        change = [(x - t) / m if m > 0 else 0.0 for x, t, m in zip(reached, targets, mass, strict=True)]
        if max(map(abs, change), default=0.0) <= close:
            break
        steps.append(change)
        reached = totals(folded_rate(F.col("posteriors"), steps))
    return steps, targets, reached


def members(docs: DataFrame, classifier: Classifier, id_col: str, text_col: str) -> DataFrame:
    rows = add_features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).drop("text")
    return classifier.add_posteriors(rows).select(F.col("id").alias(id_col), "n_tokens", "posteriors")


def fit_mixture(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    tokens: float | None = None, anchor: str | None = None, label_rows: int = 20_000, rounds: int = 40, close: float = 1e-4,
) -> tuple[Mixture, DataFrame]:
    """The mixture and a stored table of id, n_tokens and posteriors, one row per row of ``docs``.

    ``targets`` gives each domain's share of tokens. A null or empty text has no tokens and the prior
    for posteriors; a row without an id is classified like any other. Empty ``docs`` give rate 1.
    """
    domains = list(targets)
    whole = sum(targets.values())
    classifier = fit_classifier(docs, labels, domains, id_col, text_col, label_rows)
    table = Scratch(docs.sparkSession).keep(members(docs, classifier, id_col, text_col), "members")
    steps, wanted, reached = fit_rates(table, [targets[d] / whole for d in domains], tokens, rounds, close, None if anchor is None else domains.index(anchor))
    return Mixture(classifier, steps, wanted, reached), table


def document_rates(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Per row: id, n_tokens, ``p_<domain>`` for each domain, rate."""
    mixture, table = fit_mixture(docs, labels, targets, id_col, text_col, **options)
    shares = [F.element_at("posteriors", i + 1).alias(f"p_{d}") for i, d in enumerate(targets)]
    return table.select(id_col, "n_tokens", *shares, mixture.rate(F.col("posteriors")).alias("rate"))


def mixed(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    snap: float = 1e-6, **options,
) -> DataFrame:
    """``docs`` with each row as often as its rate says, columns unchanged.

    Rates are rounded up or down by a hash of the text and id, so that the expected number of copies is the
    rate. Those within ``snap`` of a whole number are taken as that number; more than the noise of sums
    there makes totals miss their targets.
    """
    mixture, _ = fit_mixture(docs, labels, targets, id_col, text_col, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(row.alias("row")).withColumn("text", F.col("row")[text_col])
    rated = mixture.classifier.add_posteriors(add_features(carried)).withColumn("rate", mixture.rate(F.col("posteriors")))
    chance = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.col("row")[id_col]), F.lit(1_000_000)) / 1_000_000
    copies = F.when(F.abs(F.col("rate") - F.round("rate")) <= snap, F.round("rate")).otherwise(F.floor(F.col("rate") + chance))
    repeated = rated.withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int")))).filter("copy > 0")
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])
