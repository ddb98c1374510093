"""Token sequences packed by a configuration linear program over the length histogram.

Documents become token pieces of at most ``capacity`` ids. What the packing needs of them is the
histogram of lengths, at most ``capacity`` numbers whatever the input. A configuration is a multiset
of lengths that fits one sequence. The linear program (fewest configurations that cover the
histogram) is solved by multiplicative weights: prices of lengths, configurations priced by a
knapsack dynamic program, weights of covered lengths lowered. Whole parts of the solution are used
as they are; the rest of the histogram is filled longest first with the largest length that fits.

The plan is a list of (configuration, count). Pieces find their place by rank within their length,
which a count per task and length gives without sorting; no piece passes through the driver.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch

#: Entries of a worker's memory of words; it starts anew beyond that.
WORDS_KEPT = 600_000

#: Stands for a missing document id.
NO_ID = -(2**63)

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


# ---- Tokens ------------------------------------------------------------------------------------


#: ASCII punctuation before and after a word's letters; an apostrophe before letters may belong to them.
_AFTER = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BEFORE = _AFTER.replace(b"'", b"")
#: Letters that normalization leaves single letters, as UTF-8: from U+00C0 to U+017F but U+0130, and ASCII ones in lower case.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+")
#: What a tokenizer does that drops case and keeps runs of letters and of punctuation apart.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_RUNS = {
    "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed", "invert": True,
}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class WordTokens:
    """Token ids of whole texts, with the ids of words remembered.

    The tokenizer drops white space and never looks over it, so the ids of a text are those of its
    words in a row. Words are parted at ASCII white space only; whatever else a tokenizer takes for
    white space stays inside a word and is left to it.

    Where the tokenizer drops case and keeps letters and punctuation apart, the ids of letters between
    punctuation are those of its three parts in a row. Many new words differ from a known one in case or
    punctuation alone, so their letters are remembered too. All other words go to the tokenizer whole.
    """

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}
        made = json.loads(self.tokenizer.to_str())
        kind, added = made["model"], [t["content"].encode() for t in made["added_tokens"]]
        #: The letters of added tokens, which are tokens only with their punctuation.
        self.added = {t.strip(_AFTER) for t in added}
        self.parted = (
            (made["normalizer"] or {}).get("normalizers") == _NORMALIZERS
            and (made["pre_tokenizer"] or {}).get("pretokenizers") == [_RUNS, _BYTES]
            and not (made["post_processor"] or made["truncation"] or made["padding"])
            and (kind["type"], kind.get("dropout"), kind.get("end_of_word_suffix")) == ("BPE", None, "</w>")
            and all(t[:1] in _BEFORE and t[-1:] in _AFTER for t in added)
        )
        if self.parted:
            # For letters that are normalized and stand apart already.
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.last[[i for token, i in kind["vocab"].items() if token.endswith("</w>")]] = True

    def _learn_whole(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 512):
            part = [w.decode() for w in words[i : i + 512]]
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            sizes = np.fromiter((len(w) + 1 for w in part), dtype=np.int64, count=len(part))
            begins = np.fromiter((o[0] for o in coded.offsets), dtype=np.int64, count=len(coded.ids))
            cuts = 4 * np.searchsorted(begins, np.cumsum(sizes) - sizes)
            ids = np.array(coded.ids, dtype="<u4").tobytes()
            for word, a, b in zip(words[i : i + 512], cuts, [*cuts[1:], len(ids)], strict=True):
                self.known[word] = ids[a:b]

    def _learn_letters(self, runs: list[bytes]) -> None:
        for i in range(0, len(runs), 512):
            part = runs[i : i + 512]
            ids = np.array(self.plain.encode(b" ".join(part).decode().lower(), add_special_tokens=False).ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            ids = ids.tobytes()
            for run, a, b in zip(part, [0, *ends[:-1]], ends, strict=True):
                self.letters[run] = ids[a:b]

    def _mark(self, run: bytes) -> bytes:
        if run not in self.marks:
            ids = self.tokenizer.encode(run.decode(), add_special_tokens=False).ids
            if len(self.marks) > self.kept:
                return np.array(ids, dtype="<u4").tobytes()
            self.marks[run] = np.array(ids, dtype="<u4").tobytes()
        return self.marks[run]

    def _learn(self, words: list[bytes]) -> None:
        if not self.parted:
            self._learn_whole(words)
            return
        letters, latin, added = self.letters, _LATIN.fullmatch, self.added
        whole, parted, new = [], [], set()
        for word in words:
            run = word.lower().lstrip(_BEFORE).rstrip(_AFTER)
            if (run.isalpha() or latin(run)) and run not in added:
                parted.append((word, run))
                if run not in letters:
                    new.add(run)
            else:
                whole.append(word)
        if whole:
            self._learn_whole(whole)
        if new:
            self._learn_letters(list(new))
        for word, run in parted:
            ids = letters[run]
            if len(run) < len(word):
                at = word.lower().index(run)
                ids = self._mark(word[:at]) + ids + self._mark(word[at + len(run) :])
            self.known[word] = ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words, known = text.encode().split(), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) + len(self.letters) > self.kept:
                known.clear()
                if len(self.letters) > self.kept // 2:
                    self.letters.clear()
            self._learn(list({w for w in words if w not in known}))
            return b"".join(map(known.__getitem__, words))


@functools.cache
def _tokens(path: str, kept: int) -> WordTokens:
    return WordTokens(path, kept)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str, kept: int = WORDS_KEPT
) -> DataFrame:
    """Rows of pieces, each with its task and its number among the task's pieces of this length."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, task = _tokens(tokenizer_path, kept), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for id_, text in zip(batch["id"], batch["text"], strict=True):
                ids = tokens.ids(text or "") + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((id_, piece, at // 4, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    # pandas would turn ids into floating numbers where some are null.
    id_ = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))
    slim = docs.select(id_.alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(cut, _PIECES)


# ---- The linear program -------------------------------------------------------------------------


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best price within each size up to ``capacity``, and the index of the last item taken, or -1."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for size in range(1, capacity + 1):
        best[size], last[size] = best[size - 1], -2  # -2: one unit is left empty
        if n := upto[size]:
            worth = best[size - lengths[:n]] + prices[:n]
            k = int(worth.argmax())
            if worth[k] > best[size]:
                best[size], last[size] = worth[k], k
    return best, last


def priced(lengths: np.ndarray, last: np.ndarray, first: int, capacity: int) -> tuple[int, ...]:
    """The best configuration that holds item ``first``, as sorted item indices."""
    items, room = [first], capacity - int(lengths[first])
    while room > 0 and last[room] != -1:
        if last[room] == -2:
            room -= 1
            continue
        items.append(int(last[room]))
        room -= int(lengths[last[room]])
    return tuple(sorted(items))


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, rate: float = 0.5) -> dict:
    """Configurations with their amounts, covering ``counts`` nearly evenly.

    Each round prices once and takes, for every length, the best configuration that holds it if its
    price comes near the best of all.
    """
    weight, load, amount = np.ones(len(lengths)), np.zeros(len(lengths)), {}
    for _ in range(rounds):
        prices = weight / counts
        prices = prices / prices.max()
        best, last = knapsack(lengths, prices, capacity)
        worth = prices + best[capacity - lengths]
        chosen = {priced(lengths, last, int(k), capacity) for k in np.flatnonzero(worth >= 0.8 * worth.max())}
        steps, added = {}, np.zeros(len(lengths))
        for config in chosen:
            items, times = np.unique(config, return_counts=True)
            steps[config] = float((counts[items] / times).min())
            added[items] += steps[config] * times / counts[items]
        scale = 1 / added.max()
        for config, step in steps.items():
            amount[config] = amount.get(config, 0.0) + step * scale
        load += added * scale
        weight *= np.exp(-rate * added * scale)
        weight /= weight.max()
        weight = np.maximum(weight, 1e-12)
    used = max(float(np.average(load, weights=counts * lengths)), 1e-9)
    return {config: x / used for config, x in amount.items()}


def fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each time the largest length that fits; every step uses up some length."""
    there, plan = [i for i in range(len(lengths)) if left[i]], []
    left = left.copy()
    sizes = [int(lengths[i]) for i in there]
    while there:
        items, room = [], capacity
        taken: dict[int, int] = {}
        while True:
            k = bisect.bisect_right(sizes, room) - 1
            while k >= 0 and taken.get(there[k], 0) >= left[there[k]]:
                k -= 1
            if k < 0:
                break
            item = there[k]
            items.append(item)
            taken[item] = taken.get(item, 0) + 1
            room -= sizes[k]
        times = min(int(left[i]) // n for i, n in taken.items())
        plan.append((tuple(sorted(items)), times))
        for i, n in taken.items():
            left[i] -= n * times
            if not left[i]:
                k = there.index(i)
                del there[k], sizes[k]
    return plan


def packing_plan(histogram: dict[int, int], capacity: int, rounds: int = 40) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), for all pieces of the histogram.

    The better of the rounded linear program and plain filling. Whole parts of amounts are taken
    largest first, as far as the histogram reaches.
    """
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    plain = fill(lengths, counts, capacity)
    left, plan = counts.copy(), []
    for config, x in sorted(fractional(lengths, counts.astype(float), capacity, rounds).items(), key=lambda c: (-c[1], c[0])):
        items, times = np.unique(config, return_counts=True)
        n = min(int(x), int((left[items] // times).min()))
        if n > 0:
            plan.append((config, n))
            left[items] -= n * times
    plan += fill(lengths, left, capacity)
    fewest = min(plan, plain, key=lambda p: sum(n for _, n in p))
    return [(tuple(int(lengths[i]) for i in config), n) for config, n in fewest]


# ---- Places --------------------------------------------------------------------------------------


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Runs of ranks within a length: first rank, first sequence, places per sequence, offset."""
    rows, rank, sequence = [], {}, 0
    for config, n in plan:
        offset = 0
        for length in dict.fromkeys(sorted(config, reverse=True)):
            each = config.count(length)
            rows.append((length, rank.get(length, 0), sequence, each, offset))
            rank[length] = rank.get(length, 0) + n * each
            offset += each * length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "each", "offset"]).sort_values(["length", "rank"])


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    rounds: int = 40, kept: int = WORDS_KEPT,
) -> DataFrame:
    """One row per piece: its document, its ids' checksum, its sequence and its place there.

    A document is its ids followed by id 0; only longer ones are cut. A null text is an empty one.
    Repeated rows and rows without an id are packed like any other. No rows give no rows. ``kept`` bounds the
    words that a worker remembers; fewer take less memory and more time.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.keep(token_pieces(docs, tokenizer_path, capacity, id_col, text_col, kept), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # At most ``capacity`` rows.
    histogram = {int(r["length"]): int(r["n"]) for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(packing_plan(histogram, capacity, rounds))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = pieces.join(per_task.select("length", "task", before.alias("before")), ["length", "task"])
    shift = 2**44  # ranks stay below
    keys = (slots["length"] * shift + slots["rank"]).to_numpy(dtype=np.int64)
    table = {c: slots[c].to_numpy(dtype=np.int64) for c in ("rank", "sequence", "each", "offset")}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["length"].to_numpy(dtype=np.int64)
            rank = batch["rank"].to_numpy(dtype=np.int64)
            run = np.searchsorted(keys, length * shift + rank, side="right") - 1
            nth = rank - table["rank"][run]
            batch["sequence_id"] = table["sequence"][run] + nth // table["each"][run]
            batch["offset"] = table["offset"][run] + nth % table["each"][run] * length
            yield batch.drop(columns="rank")

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    ranked = ranked.select(*columns, (F.col("before") + F.col("nth")).alias("rank"))
    placed = ranked.mapInPandas(place, kinds)
    return placed.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
