"""License scans in DataFrame expressions only.

Texts are compared with licence templates by the Dice coefficient over sets of word bigrams. The units compared are each
line, each paragraph (lines between blank ones) and the whole text, as sequences of words in lower case.

Two exact rules prune the comparisons. Size bounds: a unit of u bigrams can reach a coefficient t with a template of m
only if t m / (2 - t) <= u <= (2 - t) m / t. Anchors: of each template a few of its longest words are such that a
unit without any of them shares too few bigrams with it; a unit without any anchor is passed over.

On request, windows are compared too, so that a notice inside a longer line or paragraph, or broken up by comment markers,
is found: of the words of the whole text, every stretch of ``least`` to ``most`` neighbouring pairs for the template's own
size bounds. A best stretch begins and ends with a bigram of the template, as it would be no worse without any other at
its ends, and holds ``least`` of them, so only those stretches are counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower

WORD = r"[a-z0-9]+(?:\.[a-z0-9]+)*"

#: Notices that licences ask for or that stand for them, as published; fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
)


@dataclass(frozen=True)
class Template:
    name: str
    bigrams: tuple[str, ...]
    least: int
    most: int
    anchors: frozenset[str]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def prepare(templates, threshold: float) -> list[Template]:
    """Bigrams, size bounds and anchors; templates of fewer than two words cannot be compared and are refused."""
    t = Fraction(str(threshold))
    out = []
    for name, text in templates:
        words = words_of(text)
        grams = bigrams_of(words)
        if not grams:
            raise ValueError(f"the template {text!r} has no bigram")
        need = ceil(t * len(grams) / (2 - t))
        anchors: set[str] = set()
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if sum(not anchors & set(g.split(" ")) for g in grams) < need:
                break
            anchors.add(w)
        out.append(Template(name, tuple(grams), need, floor((2 - t) * len(grams) / t), frozenset(anchors)))
    return out


def units(text: Column) -> Column:
    """The words of each line, of each paragraph and of the whole text."""
    paragraphs = F.split(ascii_lower(text), r"\n[\t\r ]*\n", -1)
    lines = F.transform(paragraphs, lambda p: F.transform(F.split(p, "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))))
    whole = F.transform(lines, lambda p: F.flatten(p))
    return F.concat(F.flatten(lines), whole, F.array(F.flatten(whole)))


def _dice(grams: Column, t: Template) -> Column:
    mine = F.array(*map(F.lit, t.bigrams))
    fits = F.filter(grams, lambda g: F.size(g).between(t.least, t.most))
    return F.coalesce(F.array_max(F.transform(fits, lambda g: F.lit(2.0) * F.size(F.array_intersect(g, mine)) / (F.size(g) + len(t.bigrams)))), F.lit(0.0))


def _pairs(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))


def _window_dice(pairs: Column, hits: Column, t: Template) -> Column:
    """The best coefficient of all windows; ``hits`` are the places (from 0) and bigrams of ``pairs`` that any template holds."""
    mine = F.array(*map(F.lit, t.bigrams))

    def ending(own: Column, a: Column, rank: Column) -> Column:
        near = F.filter(F.slice(own, rank + t.least, t.most - t.least + 1), lambda b: b["at"] - a["at"] < t.most)
        windows = F.transform(near, lambda b: F.array_distinct(F.slice(pairs, a["at"] + 1, b["at"] - a["at"] + 1)))
        return F.array_max(F.transform(windows, lambda g: F.lit(2.0) * F.size(F.array_intersect(g, mine)) / (F.size(g) + len(t.bigrams))))

    # a one-element array binds the filtered hits, which would be made anew at every use
    own = F.array(F.filter(hits, lambda h: F.array_contains(mine, h["gram"])))
    best = F.element_at(F.transform(own, lambda o: F.array_max(F.transform(o, lambda a, rank: ending(o, a, rank)))), 1)
    return F.coalesce(F.when(F.size(hits) >= t.least, best), F.lit(0.0))


def scan(docs: DataFrame, *, text_col: str = "text", templates=TEMPLATES, threshold: float = 0.8, windows: bool = False) -> DataFrame:
    """Adds ``licenses``: an array of (license, dice), the best coefficient of each licence that reaches ``threshold``, by name.

    With ``windows`` the windows of the whole text count as well as its lines, its paragraphs and itself.

    A null text has none, like one without two words in a row. Whole texts are scanned; repeated rows get equal
    answers; an input column named ``licenses`` is replaced and all others pass through.
    """
    ready = prepare(templates, threshold)
    anchors = F.array(*map(F.lit, sorted(set().union(*(t.anchors for t in ready)))))
    least = min(t.least for t in ready)
    every = units(F.coalesce(F.col(text_col), F.lit("")))
    near = F.filter(every, lambda u: (F.size(u) > least) & F.arrays_overlap(u, anchors))
    grams = F.transform(near, lambda u: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(u) - 1), lambda i: F.concat_ws(" ", F.element_at(u, i), F.element_at(u, i + 1)))))
    base = docs.drop("licenses")
    if windows:
        text = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
        base = base.withColumn("__words", text)
        base = base.withColumn("__pairs", F.when(F.arrays_overlap("__words", anchors), _pairs(F.col("__words"))).otherwise(F.array().cast("array<string>"))).drop("__words")
        known = F.array(*map(F.lit, sorted({g for t in ready for g in t.bigrams})))
        common = F.array_intersect("__pairs", known)
        base = base.withColumn("__common", common)
        places = F.transform("__pairs", lambda g, i: F.struct(i.alias("at"), g.alias("gram")))
        none = F.array().cast("array<struct<at:int,gram:string>>")
        base = base.withColumn("__hits", F.when(F.size("__common") >= least, F.filter(places, lambda h: F.array_contains(F.col("__common"), h["gram"]))).otherwise(none))
    found = []
    for name in sorted({t.name for t in ready}):
        scores = [_dice(F.col("__grams"), t) for t in ready if t.name == name]
        if windows:
            scores += [_window_dice(F.col("__pairs"), F.col("__hits"), t) for t in ready if t.name == name]
        best = F.array_max(F.array(*scores))
        found.append(F.struct(F.lit(name).alias("license"), best.alias("dice")))
    some = F.size("__grams") > 0 if not windows else (F.size("__grams") > 0) | (F.size("__hits") > 0)
    scored = base.withColumn("__grams", grams).withColumn("licenses", F.when(some, F.filter(F.array(*found), lambda x: x["dice"] >= threshold)).otherwise(F.array().cast("array<struct<license:string,dice:double>>")))
    return scored.drop("__grams", "__pairs", "__common", "__hits")
