"""License scans by diagonal voting; DataFrame functions only.

All rolling ``GRAM``-word grams of all texts are joined, by hash and then by their words, with the
positions they have in the templates (phrases, opening sentences and whole texts of licenses). A hit votes for the diagonal: its place in the text
less its place in the template. Votes are sets of template places, kept as bits in words of 64 places, so a template may have any length and texts that occur several
times vote as one; they are aggregated in the map tasks and stored, a few rows per text that quotes a license. Neighbouring diagonals are merged, as words
may be put in or left out, and a merged span is verified: it must hold ``COVER`` of the template's grams
within the template's length plus the slack for it. A base phrase has to stand on one diagonal, whole.

Null and empty texts have no words and no labels. Equal texts, and rows that are repeated, get equal results. A text may be of any length. Where spans
tie, nothing is chosen: labels are sets, the score is the largest share. Extra columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import stage
from .storage import small_bytes

GRAM = 3
#: Diagonals so near each other are merged; a span may be so many words longer than its template for each 64 grams begun.
SLACK = 2
#: Share of a template's grams that makes a span a license.
COVER = 0.6

# Phrases of the contract, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Opening words of well-known notices, and their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
]

# Whole licenses, and their labels.
TEXTS = [
    (
        """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions:

        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
        """,
        "mit",
    ),
    (
        """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.

        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
        ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
        """,
        "isc",
    ),
    (
        """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met:

        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution.

        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
        """,
        "bsd",
    ),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What is between words before A-Z are lower-cased.
_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Template places in one word of votes.
_PLACES = 64


def license_words(text: Column) -> Column:
    """The words of a text; none for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() is many times faster than translate(), and the same for texts of ASCII characters.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def template_grams(base: list[tuple[str, str]], notices: list[tuple[str, str]]) -> list[tuple]:
    """(template, label, is_base, n_grams, place, template_gram), a row per gram of every template."""
    rows = []
    for number, (phrase, label) in enumerate([*base, *notices]):
        own = re.findall("[a-z0-9\x80-\U0010FFFF]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in phrase))
        grams = [" ".join(own[k : k + GRAM]) for k in range(len(own) - GRAM + 1)]
        if not grams:
            raise ValueError(f"a template has {GRAM} words or more: {phrase}")
        rows += [(number, label, number < len(base), len(grams), place, gram) for place, gram in enumerate(grams)]
    return rows


def templates(spark: SparkSession, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES + TEXTS) -> DataFrame:
    """``template_grams`` as a table; templates of any length."""
    return spark.createDataFrame(template_grams(base, notices), "template int, label string, is_base boolean, n_grams int, place int, template_gram string")


def _text_keys() -> tuple[Column, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("2"), text).alias("k2")


def votes(docs: DataFrame, template_table: DataFrame) -> DataFrame:
    """Per text, template and diagonal the places voted for, as bits of ``block`` 0, 1, ..., and the first and last word voting."""
    rows = docs.select(*_text_keys(), license_words(F.col("text")).alias("words"))
    names = [f"w{k}" for k in range(GRAM)]
    # Shifted arrays side by side: much faster than a function for each place. The last grams lack words and match nothing.
    shifted = F.arrays_zip(*(F.slice("words", k + 1, F.size("words")).alias(name) for k, name in enumerate(names)))
    grams = rows.select("k1", "k2", F.posexplode(shifted).alias("pos", "own"))
    own = [F.col("own")[name] for name in names]
    template_words = F.split("template_gram", " ")
    side = small_bytes(template_table, F.octet_length("template_gram"))
    side = side.withColumn("template_hash", F.xxhash64(*(template_words[k] for k in range(GRAM))))
    # Each a prefix of the other: equal, and not a key of the join, so that its table is one of longs.
    gram = F.concat_ws(" ", *own)
    equal = F.startswith(gram, F.col("template_gram")) & F.startswith(F.col("template_gram"), gram)
    hits = grams.join(side, (F.xxhash64(*own) == F.col("template_hash")) & equal)
    block, bit = F.floor(F.col("place") / _PLACES).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place") % _PLACES)
    by = hits.groupBy("k1", "k2", "template", "label", "is_base", "n_grams", (F.col("pos") - F.col("place")).alias("diagonal"), block.alias("block"))
    return by.agg(F.bit_or(bit).alias("bits"), F.min("pos").alias("low"), F.max("pos").alias("high"))


def spans(voted: DataFrame) -> DataFrame:
    """(k1, k2, label, is_base, first, last, share): verified spans by text, in words from 0; from a stored table of ``votes``."""
    of_template = ["k1", "k2", "template", "label", "is_base", "n_grams"]
    cast = (F.sum(F.bit_count("bits")).alias("n"), F.min("low").alias("first"), (F.max("high") + GRAM - 1).alias("last"))
    share = F.col("n") / F.col("n_grams")
    columns = ("k1", "k2", "label", "is_base", "first", "last", share.cast("double").alias("share"))
    base = voted.where("is_base").groupBy(*of_template, "diagonal").agg(*cast).where("n = n_grams").select(*columns)

    order = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    # Blocks of one diagonal are neighbours too; the running sum takes them as equals.
    merged = voted.where("not is_base").withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
    merged = merged.groupBy(*of_template, "span", "block").agg(F.bit_or("bits").alias("bits"), F.min("low").alias("low"), F.max("high").alias("high"))
    merged = merged.groupBy(*of_template, "span").agg(*cast)
    room = F.col("n_grams") + GRAM - 1 + SLACK * (F.floor(F.col("n_grams") / _PLACES) + 1)
    return base.union(merged.where((share >= COVER) & (F.col("last") - F.col("first") + 1 <= room)).select(*columns))


def by_text(found: DataFrame) -> DataFrame:
    """The license columns of every text with a span."""
    names = lambda which: F.concat_ws(",", F.array_sort(F.collect_set(which)))
    of_base = lambda c: F.when(F.col("is_base"), F.col(c))
    return found.groupBy("k1", "k2").agg(
        F.count(of_base("label")).alias("n_base"),
        F.min(of_base("first")).cast("bigint").alias("first_word"),
        F.max(of_base("first")).cast("bigint").alias("last_word"),
        names(of_base("label")).alias("base_labels"),
        names(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )


def scan_licenses(docs: DataFrame, template_table: DataFrame | None = None) -> DataFrame:
    """row (all columns of ``docs``) and the license columns of every document.

    The texts' grams are made once, and the votes stored; a second scan counts words and takes the results. Those are broadcast if they are
    few bytes, so that copies of one text meet nothing by shuffle.
    """
    table = template_table if template_table is not None else templates(docs.sparkSession)
    found = stage(by_text(spans(stage(votes(docs, table), "license-votes"))), "licenses")
    n_words = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), _NO_WORD), "")).cast("bigint").alias("n_words")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_text_keys(), n_words)
    joined = rows.join(small_bytes(found, F.octet_length("labels") + F.octet_length("base_labels")), ["k1", "k2"], "left")
    return joined.select(
        "row",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
