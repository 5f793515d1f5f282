"""License scan by diagonal voting.

Rolling word k-gram hashes of every text are joined to the positions of the same
hashes in license templates. A hit votes for the diagonal (position in the text
minus position in the template), which is the place where the template would
start. Votes are summed per diagonal, neighbouring diagonals are merged (words
put in or left out move the rest of a copy to the next diagonals), and a merged
span is accepted if enough of the template votes for it within a bounded length.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def k(self) -> int:
        return min(GRAM, len(self.words))

    @property
    def n_grams(self) -> int:
        return len(self.words) - self.k + 1

    @property
    def needed(self) -> int:
        """Votes that accept a span: all of a short phrase, half of a longer text."""
        share = 1.0 if len(self.words) <= 8 else 0.5
        return -int(-share * self.n_grams // 1)

    @property
    def drift(self) -> int:
        """Diagonals further apart than this are different places."""
        return 0 if len(self.words) <= 8 else max(2, len(self.words) // 10)


# Public license phrases and notices, lower case, words only.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("mit", "the mit license"),
    Template("mit", "under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
             "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
             "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
             "the free software foundation"),
    Template("agpl-3.0", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc0-1.0", "cc0 1 0 universal"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
_MARK = 0  # hash of the row that every document sends along


def lower_ascii(c: Column) -> Column:
    """Lower case of A-Z. ``lower`` also changes letters beyond ASCII, which no template has; the two that become ASCII are kept apart."""
    return F.when(c.rlike("[İK]"), F.translate(c, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(c))


def _hash(k: int, *words: Column) -> Column:
    return F.xxhash64(F.lit(k), *words)


def template_grams(spark, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """h, template (its number), at: a few hundred rows, as many as the templates have words."""
    rows = [(t, i, x.k, (x.words[i:i + x.k] + [""] * GRAM)[:GRAM]) for t, x in enumerate(templates) for i in range(x.n_grams)]
    df = spark.createDataFrame(rows, "template int, at int, k int, w array<string>")
    h = F.lit(None).cast("long")
    for k in range(1, GRAM + 1):
        h = F.when(F.col("k") == k, _hash(k, *[F.get("w", F.lit(i)) for i in range(k)])).otherwise(h)
    return df.select(h.alias("h"), "template", F.col("at").alias("t_at"))


def spans(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` with ``n_words`` and ``spans``: array of (template, label, base, first_word, last_word, share), in order of place.

    One row for every row of ``docs``, repeated rows included; a null or empty
    text has no words and no spans. Columns of ``docs`` named n_words or spans
    are replaced. The text itself is not returned.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_words", "spans", text)]
    w = F.col("_w")
    n = F.size(w)
    split = docs.select(
        F.monotonically_increasing_id().alias("_rid"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in keep]).alias("_row"),
        F.array_remove(F.split(lower_ascii(F.coalesce(F.col(f"`{text}`"), F.lit(""))), NOT_WORD), "").alias("_w"),
    )
    place = lambda at, h: F.struct(at.cast("int").alias("at"), h.alias("h"))

    def roll(k: int) -> Column:
        starts = F.slice(w, 1, F.greatest(n - (k - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: place(i, _hash(k, x, *[F.get(w, i + j) for j in range(1, k)])))

    rolled = [roll(k) for k in sorted({t.k for t in templates})]
    mark = F.array(place(n, F.lit(_MARK).cast("long")))
    grams = split.select("_rid", "_row", F.explode(F.concat(mark, *rolled)).alias("g")).select("_rid", "_row", "g.at", "g.h")
    known = template_grams(spark, templates)
    marks = spark.range(1).select(F.lit(_MARK).cast("long").alias("h"), F.lit(-1).alias("template"), F.lit(0).alias("t_at"))
    hits = grams.join(F.broadcast(known.unionByName(marks)), "h")
    # The mark carries the row itself, the hits only its number.
    row = F.when(F.col("template") == -1, F.col("_row"))
    hits = hits.select("_rid", row.alias("_row"), "template", (F.col("at") - F.col("t_at")).alias("diagonal"), "at")
    votes = hits.groupBy("_rid", "template", "diagonal").agg(F.first("_row", ignorenulls=True).alias("_row"), F.count("*").alias("votes"),
                                                            F.min("at").alias("lo"), F.max("at").alias("hi"))
    facts = spark.createDataFrame(
        [(i, t.label, t.base, t.k, len(t.words), t.n_grams, t.needed, t.drift) for i, t in enumerate(templates)] + [(-1, "", False, 0, 0, 1, 0, 0)],
        "template int, label string, base boolean, k int, n int, grams int, needed int, drift int",
    )
    votes = votes.join(F.broadcast(facts), "template")
    order = Window.partitionBy("_rid", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > F.col("drift")).cast("int")
    merged = votes.withColumn("c", F.sum(F.coalesce(apart, F.lit(0))).over(order)).groupBy("_rid", "template", "label", "base", "k", "n", "grams", "needed", "c")
    merged = merged.agg(F.first("_row", ignorenulls=True).alias("_row"), F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    good = (F.col("template") == -1) | ((F.col("votes") >= F.col("needed")) & (F.col("hi") - F.col("lo") < 2 * F.col("n")))
    span = F.when(F.col("template") >= 0, F.struct(
        F.col("lo").alias("first_word"), (F.col("hi") + F.col("k") - 1).alias("last_word"), "template", "label", "base",
        F.least(F.lit(1.0), F.col("votes") / F.col("grams")).alias("share"),
    ))
    done = merged.filter(good).groupBy("_rid").agg(
        F.first("_row", ignorenulls=True).alias("_row"), F.max(F.when(F.col("template") == -1, F.col("lo"))).cast("long").alias("n_words"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    return done.select(*[F.col("_row")[c].alias(c) for c in keep], "n_words", "spans")
