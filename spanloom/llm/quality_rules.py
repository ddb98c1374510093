"""Line-first cleaning: rules per line, then documents that lose too much text.

A line is judged alone by punctuation, navigation and boilerplate rules. Lines that fail are taken
out; a document that loses more than a share of its text this way is rejected, and so is one that
fails the base rules (too few words, or too many words in repeated three-word windows). One pass over
the rows, no shuffle, and memory for one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters counted as symbols, and those that a line may not be full of.
SYMBOLS = "#*$%&|<>"
NOISE = "#*$%&|<>!"
#: Words that only part the entries of a menu.
SEPARATORS = (b"|", b">", b"<", b"/", b"-", "»".encode(), "«".encode(), "•".encode(), "·".encode(), "›".encode())
#: A line of many words has one of these at the end of some word.
STOPS = (b".", b"!", b"?", b",", b";", b":")
#: Phrases, lower-cased, of lines that say nothing about their page.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "licensed under",
    "lorem ipsum", "privacy policy", "released under the", "sign up for", "subscribe to our", "terms of use",
)


@dataclass(frozen=True)
class Limits:
    """When a line or a document fails; shares are in percent."""

    min_words: int = 50
    repeat_share: int = 50
    noise_share: int = 10
    separator_share: int = 20
    unpunctuated_words: int = 10
    lost_share: int = 30


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    n = len(known)
    pairs = ids[:-2] * n + ids[1:-1]
    if n > 1_500_000:  # else the codes of windows would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, times = np.unique(pairs * n + ids[2:], return_inverse=True, return_counts=True)
    again = times[where] > 1
    inside = np.zeros(len(words), dtype=bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


def line_fails(line: str, words: list[bytes], chars: int, limits: Limits) -> bool:
    """Whether one of the rules takes out a line of ``chars`` code points in ``words``."""
    if 100 * sum(map(line.count, NOISE)) > limits.noise_share * chars:
        return True
    if 100 * sum(w in SEPARATORS for w in words) >= limits.separator_share * len(words):
        return True
    if len(words) >= limits.unpunctuated_words and not any(w.endswith(STOPS) for w in words):
        return True
    lower = line.lower()
    return any(phrase in lower for phrase in BOILERPLATE)


def judge(text: str | None, limits: Limits) -> tuple[int, int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept, text left."""
    text = text or ""
    words: list[bytes] = []
    seen: set[str] = set()
    word_chars = dup_lines = lost = 0
    left = []
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            left.append(line)
            continue
        words += own
        chars = len(b"".join(own).decode())
        word_chars += chars
        if line in seen:
            dup_lines += 1
        seen.add(line)
        if line_fails(line, own, chars, limits):
            lost += chars
        else:
            left.append(line)
    repeats = repeated_words(words)
    failed = len(words) < limits.min_words or 100 * repeats > limits.repeat_share * len(words)
    kept = not failed and 100 * lost <= limits.lost_share * word_chars
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), word_chars, symbols, dup_lines, repeats, lost, failed, kept, "\n".join(left)


_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")
_JUDGED = ", ".join(f"{c} bigint" for c in _NUMBERS) + ", base_failed boolean, kept boolean"


def _judged(docs: DataFrame, text_col: str, limits: Limits, with_text: bool) -> DataFrame:
    """``docs`` as struct ``row`` with struct ``judged``; input names cannot clash."""

    @F.pandas_udf(_JUDGED + (", left string" if with_text else ""))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [*_NUMBERS, "base_failed", "kept", "left"]
        for texts in batches:
            out = pd.DataFrame([judge(t, limits) for t in texts], columns=names)
            yield out if with_text else out.drop(columns="left")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row")).withColumn("judged", run(F.col("row")[text_col]))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Per row: id, the counts, base_failed, kept. A null or empty text has no words and fails."""
    rows = _judged(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col, limits, False)
    return rows.select(F.col("row")[id_col].alias(id_col), "judged.*")


def clean(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows that are kept, with all their columns, their text without the lines that failed."""
    rows = _judged(docs, text_col, limits, True).filter("judged.kept")
    return rows.select(*[
        F.col("judged.left").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns
    ])
