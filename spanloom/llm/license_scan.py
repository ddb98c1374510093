"""Licence notices in texts, by a positional index of the rarest words of notice templates.

A template is a notice with its label and the phrases that it must hold. The index has, for each template, its
words of highest inverse document frequency and the rarest word of each phrase, with their places in the
template. One pass over the texts cuts them into words and counts, for every word of the templates, the
texts that hold it. Texts that hold all words of some phrase keep their words; the indexed ones among these are
looked up, each with the few words around it. A word and its posting give the place where the template
would begin. A phrase is verified word by word around its rarest word. A template is confirmed where all
its phrases begin at the same place, up to its slack; what share of its indexed words stands there too,
by weight, is the score.

A phrase that stands in a text is always found, whatever the frequencies, as its rarest word is indexed.
Templates, postings and counts per word are bounded by the templates; texts are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, ascii_lower

#: Words are made of all but ASCII control characters, blanks, marks and upper-case letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice, in words parted by blanks; ``keys`` are stretches of it that must be there."""

    label: str
    notice: str
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def slack(self) -> int:
        """Words that may be put in or left out between phrases: one in eight; none inside a single phrase."""
        return len(self.words) // 8 if len(self.keys) > 1 else 0

    def key_places(self) -> list[tuple[int, list[str]]]:
        """Where each phrase begins in the notice, and its words."""
        out = []
        for key in self.keys:
            before, found, _ = f" {self.notice} ".partition(f" {key} ")
            if not found:
                raise ValueError(f"{key!r} is no stretch of words of {self.notice!r}")
            out.append((len(before.split()), key.split()))
        return out


def phrase(label: str, words: str, base: bool = False) -> Template:
    return Template(label, words, (words,), base)


#: The phrases of the contract.
BASE = (
    phrase("mit", "mit license", True), phrase("apache", "apache license", True), phrase("gpl", "general public license", True),
)

# The words of public licence notices.
NOTICES = (
    phrase("apache-2.0", "apache license version 2 0"),
    phrase("apache-2.0", "spdx license identifier apache 2 0"),
    phrase("mit", "spdx license identifier mit"),
    phrase("bsd", "spdx license identifier bsd"),
    phrase("isc", "spdx license identifier isc"),
    phrase("gpl-2.0", "spdx license identifier gpl 2 0"),
    phrase("gpl-3.0", "spdx license identifier gpl 3 0"),
    phrase("gpl-2.0", "gnu general public license version 2"),
    phrase("gpl-3.0", "gnu general public license version 3"),
    phrase("gpl-2.0", "gnu general public license v2"),
    phrase("gpl-3.0", "gnu general public license v3"),
    phrase("lgpl", "gnu lesser general public license"),
    phrase("lgpl", "gnu library general public license"),
    phrase("agpl", "gnu affero general public license"),
    phrase("mpl-2.0", "mozilla public license version 2 0"),
    phrase("mpl-2.0", "mozilla public license v 2 0"),
    phrase("epl", "eclipse public license"),
    phrase("bsl-1.0", "boost software license version 1 0"),
    phrase("bsd", "bsd 2 clause license"),
    phrase("bsd", "bsd 3 clause license"),
    phrase("cc-by-4.0", "cc by 4 0"),
    phrase("cc-by-sa-4.0", "cc by sa 4 0"),
    phrase("cc-by-nc-4.0", "cc by nc 4 0"),
    phrase("cc-by-nd-4.0", "cc by nd 4 0"),
    phrase("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    phrase("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    phrase("cc-by-4.0", "creative commons attribution 4 0 international"),
    phrase("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international"),
    phrase("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international"),
    phrase("cc0-1.0", "cc0 1 0 universal"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
        " files the software to deal in the software without restriction including without limitation the rights to use copy"
        " modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met redistributions of source code must retain the above copyright notice",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www"
        " apache org licenses license 2 0",
        ("except in compliance with the license", "apache org licenses license 2 0"),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation",
        ("this program is free software", "published by the free software foundation"),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not"
        " distributed with this file you can obtain one at",
        ("this source code form is subject to the terms", "if a copy of the mpl was not distributed"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use"
        " compile sell or distribute this software",
        ("free and unencumbered software", "released into the public domain"),
    ),
)


def weights(templates: tuple[Template, ...], texts: int, holders: dict[str, int]) -> dict[str, int]:
    """Inverse document frequency of each word of the templates, in whole bits; ``holders`` texts hold a word."""
    return {w: ((texts + 1) // (holders.get(w, 0) + 1)).bit_length() for t in templates for w in t.words}


def postings(templates: tuple[Template, ...], weight: dict[str, int], rare: int) -> list[tuple]:
    """(word, template, offset, weight, key, key_offset, phrase) of the index; ``key`` is null but for a phrase's rarest word.

    ``key_offset`` is the word's place in the phrase. Of equal weights the earlier word counts as rarer. A
    word that is the rarest of two overlapping phrases has a posting for each.
    """
    out = []
    for number, template in enumerate(templates):
        words = template.words
        offsets = sorted(range(len(words)), key=lambda i: (-weight[words[i]], i))
        anchors = []
        for key, (begin, own) in enumerate(template.key_places()):
            at = min(range(len(own)), key=lambda i: (-weight[own[i]], i))
            anchors.append((begin + at, key, at, " ".join(own)))
        for offset in sorted({*offsets[:rare], *[a[0] for a in anchors]}):
            marks = [a[1:] for a in anchors if a[0] == offset] or [(None, None, None)]
            out += [(words[offset], number, offset, weight[words[offset]], *mark) for mark in marks]
    return out


_POSTING = "word string, template int, offset int, weight int, key int, key_offset int, phrase string"


def _words(rows: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(row, id, n_words, holds, words): the distinct template words that a text holds, and its words if they make up some phrase."""
    vocabulary = sorted({w for t in templates for w in t.words})
    phrases = sorted({" ".join(sorted(set(own))) for t in templates for _, own in t.key_places()})
    listed = lambda items: F.split(F.lit(" ".join(items)), " ")  # noqa: E731  one constant
    cut = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    cut = cut.select("id", F.size("words").alias("n_words"), "words", F.array_intersect("words", listed(vocabulary)).alias("holds"))
    whole = F.lit(False)
    for group in phrases:
        whole |= F.size(F.array_except(listed(group.split()), F.col("holds"))) == 0
    return cut.select(
        F.monotonically_increasing_id().alias("row"), "id", F.col("n_words").cast("bigint").alias("n_words"), "holds",
        F.when(whole, F.col("words")).alias("words"),
    )


def _lookups(cut: DataFrame, index: DataFrame, indexed: list[str], around: int) -> DataFrame:
    """(row, template, offset, weight, key, place, begin): indexed words with their postings.

    ``place`` is where the template would begin, ``begin`` the start of a verified phrase, else null. The lookup
    carries ``around`` words before and after each indexed word, as many as the longest phrase needs.
    """
    rows = cut.filter("words is not null").select("row", "words")
    numbers = F.sequence(F.lit(0), F.size("words") - 1)
    rows = rows.withColumn("at", F.filter(numbers, lambda i: F.get("words", i).isin(indexed)))
    near = lambda i: F.slice("words", F.greatest(i - around, F.lit(0)) + 1, F.lit(2 * around + 1))
    hits = F.transform("at", lambda i: F.struct(i.alias("at"), F.get("words", i).alias("word"), near(i).alias("near")))
    hits = rows.select("row", F.explode(hits).alias("hit")).select("row", "hit.*")
    found = hits.join(F.broadcast(index), "word")
    begin = F.least(F.col("at"), F.lit(around)) - F.col("key_offset")  # inside ``near``, from 0
    length = F.size(F.split("phrase", " "))
    there = F.when(begin >= 0, F.array_join(F.slice("near", F.greatest(begin, F.lit(0)) + 1, length), " ") == F.col("phrase"))
    return found.select(
        "row", "template", "offset", "weight", "key", (F.col("at") - F.col("offset")).alias("place"),
        F.when(there, F.col("at") - F.col("key_offset")).alias("begin"),
    )


def _confirmed(looked: DataFrame, facts: DataFrame) -> DataFrame:
    """(row, template, matched): the places where all phrases of a template stand, with the weight of the indexed words there.

    Words and phrases meet the first phrase's places through blocks of ``slack`` + 1 words, so that only near
    ones are compared, however many a text has.
    """
    looked = looked.join(F.broadcast(facts.select("template", "slack")), "template")
    block = F.floor(F.col("place") / (F.col("slack") + 1))
    first = looked.filter("key = 0 and begin is not null").select("row", "template", F.col("place").alias("from"), block.alias("own")).distinct()
    asked = first.withColumn("block", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1))).drop("own")
    near = asked.join(looked.withColumn("block", block), ["row", "template", "block"]).filter(F.abs(F.col("place") - F.col("from")) <= F.col("slack"))
    # A posting counts once; one that has a key and one that has none share the word's weight.
    verified = F.when(F.col("begin").isNotNull(), F.col("key"))
    each = near.groupBy("row", "template", "from", "offset").agg(F.max("weight").alias("weight"), F.collect_set(verified).alias("keys"))
    whole = each.groupBy("row", "template", "from").agg(F.sum("weight").alias("matched"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    return whole.join(F.broadcast(facts), "template").filter(F.size("keys") == F.col("n_keys"))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = (*BASE, *NOTICES), rare: int = 8,
) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score.

    A-Z are lower-cased and words numbered from 0. ``n_base``, ``first_word`` and ``last_word`` tell of the places of
    phrases of base templates, ``base_labels`` of their labels, ``labels`` of the labels of all confirmed templates, both
    sorted; ``score`` is the best share, by weight, of a confirmed template's ``rare`` highest words (and rarest
    words of phrases) that stand at its place, 0 if none is confirmed. A null or empty text has no words.
    Repeated rows and rows without an id give a row each; other columns are not read. No rows give no rows.
    """
    if any(t.base and len(t.keys) > 1 for t in templates):
        raise ValueError("a base template is one phrase")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text"))
    cut = scratch.keep(_words(rows, templates), "words")
    # As many rows as the templates have words.
    holders = {r["word"]: r["n"] for r in cut.select(F.explode("holds").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    listed = postings(templates, weights(templates, cut.count(), holders), rare)
    index = spark.createDataFrame(listed, _POSTING)
    totals: dict[int, dict[int, int]] = {}
    for _, template, offset, weight, *_ in listed:
        totals.setdefault(template, {})[offset] = weight
    facts = spark.createDataFrame(
        [(i, t.label, t.base, len(t.keys), t.slack, sum(totals[i].values())) for i, t in enumerate(templates)],
        "template int, label string, base boolean, n_keys int, slack int, total int",
    )
    around = max(len(own) for t in templates for _, own in t.key_places()) - 1
    looked = scratch.keep(_lookups(cut, index, sorted({p[0] for p in listed}), around), "lookups")
    confirmed = _confirmed(looked, facts)
    told = confirmed.groupBy("row").agg(
        F.sort_array(F.collect_set("label")).alias("labels"), F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.max(F.col("matched").cast("double") / F.col("total")).alias("score"),
    )
    places = looked.filter("begin is not null").join(F.broadcast(facts.filter("base").select("template")), "template", "left_semi")
    counted = places.groupBy("row").agg(F.count("*").alias("n_base"), F.min("begin").alias("first_word"), F.max("begin").alias("last_word"))
    nothing = F.array().cast("array<string>")
    return cut.select("row", "id", "n_words").join(told, "row", "left").join(counted, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", nothing).alias("base_labels"), F.coalesce("labels", nothing).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

