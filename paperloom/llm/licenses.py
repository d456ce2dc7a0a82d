"""License scans by diagonal voting, in DataFrame operations only.

Every pair of words in a row is joined, by hash and then by its words, to its
positions in license templates. A hit votes for its diagonal, the offset between
text and template. A diagonal with all votes of a template is a place where the
template stands word by word, whatever lies beside it. Neighbouring diagonals
are merged, so that a long template with a few words put in or left out still
gathers its votes; from each diagonal on, the merged stretch is verified by its
length and its share of votes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Passages by which further labels are known.
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-text", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "creative commons attribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("cc0", "to the extent possible under law the person who associated this work has waived all copyright and related or neighboring rights to this work"),
    ("agpl-3.0", "gnu affero general public license version 3"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1"),
    ("lgpl-3.0", "gnu lesser general public license version 3"),
    ("gfdl", "gnu free documentation license"),
    ("artistic-2.0", "the artistic license 2 0"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The only character beyond ASCII whose lower case is ASCII; only A-Z are to be folded, so another such character takes its place.
KELVIN, OTHER = "\u212a", "\u00e5"
#: Diagonals at most so far apart are merged.
GAP = 2
#: Votes that a stretch needs, as a share of the template's pairs: all of a template with fewer pairs than LONG, whose every word tells.
LONG = 12
SHARE = 0.8
#: Length of a stretch at most, as a multiple of the template's.
STRETCH = 1.3


def templates(spark: SparkSession, base: tuple = BASE, more: tuple = TEMPLATES) -> DataFrame:
    """A row for each pair of words of each template: a few hundred rows, whatever the data."""
    rows = []
    for t, (label, text) in enumerate((*base, *more)):
        words = text.split(" ")
        if len(words) < 2:
            raise ValueError(f"a template has two words at least: {text}")
        rows += [f"({t}, '{label}', {str(t < len(base)).lower()}, {i}, {len(words) - 1}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    found = spark.sql(f"select * from values {', '.join(rows)} as t(template, label, is_base, at, pairs, first, second)")
    return found.withColumn("pair_hash", F.xxhash64("first", "second"))


def reach(base: tuple = BASE, more: tuple = TEMPLATES) -> int:
    """Diagonals that a stretch of the longest template reaches on: as many as words may be put in."""
    return int(max(len(text.split(" ")) for _, text in (*base, *more)) * (STRETCH - 1))


def scan(docs: DataFrame, base: tuple = BASE, more: tuple = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row's whole text.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower
    case. score is the largest share of a template's pairs that stand in one
    stretch. A null or empty text has no words and null places; equal rows give
    equal rows; a null id is an id like any other; other columns are ignored; an
    empty table gives no rows.
    """
    text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit(KELVIN), F.lit(OTHER)))
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.array_remove(F.split(text, SEPARATORS), "").alias("words"))
    each = words.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "words", F.posexplode_outer("words").alias("word", "one"))
    pairs = each.select("doc_id", "text_hash", "n_words", "word", "one", F.get("words", F.col("word") + 1).alias("two"))
    pairs = pairs.withColumn("pair_hash", F.xxhash64("one", "two"))
    met = pairs.join(F.broadcast(templates(docs.sparkSession, base, more)), "pair_hash", "left")
    # the first word of a text stays without a hit, too: so every text has a row
    met = met.filter(F.col("template").isNotNull() | (F.coalesce("word", F.lit(0)) == 0))
    met = met.withColumn("hit", F.coalesce((F.col("one") == F.col("first")) & (F.col("two") == F.col("second")), F.lit(False))).filter("hit or coalesce(word, 0) = 0")
    known = [F.when(F.col("hit"), F.col(c)).alias(c) for c in ("template", "label", "is_base", "pairs", "at")]
    votes = met.select("doc_id", "text_hash", "n_words", *known, F.when(F.col("hit"), F.col("word") - F.col("at")).alias("diagonal"))
    text_key = ["doc_id", "text_hash", "n_words"]
    # equal rows vote together: each place of a diagonal has as many votes as there are rows
    diagonals = votes.groupBy(*text_key, "template", "label", "is_base", "pairs", "diagonal").agg(F.collect_set("at").alias("ats"), F.count("*").alias("n"))
    along = Window.partitionBy(*text_key, "template").orderBy("diagonal")
    nexts = F.collect_list(F.struct("diagonal", "ats")).over(along.rangeBetween(0, reach(base, more)))

    def longer(s, d):
        ats = F.array_union(s["ats"], d["ats"])
        on = s["on"] & (d["diagonal"] - s["diagonal"] <= GAP)
        low = F.least(s["low"], d["diagonal"] + F.array_min(d["ats"]))
        high = F.greatest(s["high"], d["diagonal"] + F.array_max(d["ats"]) + 2)
        fits = on & (high - low <= (F.col("pairs") + 1) * STRETCH)
        return F.struct(on.alias("on"), d["diagonal"].alias("diagonal"), ats.alias("ats"), low.alias("low"), high.alias("high"), F.when(fits, F.greatest(s["most"], F.size(ats))).otherwise(s["most"]).alias("most"))

    none = F.struct(F.lit(True).alias("on"), F.col("diagonal"), F.array().cast("array<int>").alias("ats"), (F.col("diagonal") + F.array_min("ats")).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("most"))
    runs = diagonals.withColumn("nexts", nexts).withColumn("most", F.greatest(F.size("ats"), F.aggregate("nexts", none, longer, lambda s: s["most"])))
    place = F.when(F.col("is_base") & (F.size("ats") == F.col("pairs")), F.col("diagonal"))
    needed = F.when(F.col("pairs") < LONG, F.col("pairs")).otherwise(F.ceil(F.col("pairs") * SHARE))
    found = runs.groupBy(*text_key).agg(
        F.count(place).alias("n_base"),
        F.min(place).cast("long").alias("first_word"),
        F.max(place).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(place.isNotNull(), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(place.isNotNull() | (~F.col("is_base") & (F.col("most") >= needed)), F.col("label")))).alias("labels"),
        F.max(F.col("most") / F.col("pairs")).alias("score"),
        F.max((F.col("n") / F.greatest(F.size("ats"), F.lit(1))).cast("int")).alias("copies"),
    )
    out = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
