"""Licence scan: a trained paragraph classifier, confirmed by templates, with DataFrame functions only.

Units are the lines of a text and its paragraphs of several lines (between blank lines). A unit is the set of
its word n-grams (one to three words); a sparse softmax regression over the n-grams of the notices below names
a family or `unknown`. It is fitted on the driver by proximal gradient steps from the notices, varied at
random with a fixed seed, against a bounded sample of the corpus's own lines, and calibrated by a temperature
on held-out variants. A family with a probability of 0.5 or more is confirmed if one of its notices is
contained in the unit by at least 0.7 of its three-word runs; else it is reported as unconfirmed.

Most texts hold none of the words without which no family can reach the threshold (the fit proves that bound
from the weights); they are `unknown` without further work.

Null and empty texts have no notice. Repeated rows are judged alike; ids are not looked at. An empty table
gives an empty result (the classifier then has the notices alone); extra columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Usual wordings of licence notices, by family.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This project is licensed under the terms of the MIT license."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    "lgpl": ("Licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "agpl-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "proprietary": ("All rights reserved.", "No part of this publication may be reproduced without prior written permission.", "Confidential and proprietary.", "Unauthorized copying of this file is strictly prohibited."),
}
# Sentences that use the notices' words without being one.
DECOYS = (
    "She renewed her driving license before the public hearing about the new version of the law.",
    "The general public was granted free use of the source of the river.",
    "Permission to use the library was granted to any person with a copy of the form.",
    "The software company released version 2.0 under the name of its founder.",
    "The terms of the agreement were published by the foundation without charge.",
    "All rights of way are reserved for the public in this part of the common.",
)
#: Documents whose lines are the sample of what is no notice; varied copies of each notice; n-gram sizes.
SAMPLE_DOCS, VARIANTS, SIZES = 200, 24, (1, 2, 3)
THRESHOLD, CONTAINED = 0.5, 0.7
#: A word in more than this share of the sample's lines is usual; n-grams of usual words alone are no features.
USUAL = 0.002
_SPLIT = "[^a-z0-9]+"


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    #: n-gram -> weight of each family, then of unknown; already divided by the temperature
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    #: a unit without any of these words can't reach the threshold for any family
    gate: tuple[str, ...]


def _tokens(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def _grams(tokens: list[str], sizes=SIZES) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in sizes for i in range(len(tokens) - n + 1)}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_lines(lines: list[str], l1: float = 2e-4, steps: int = 250) -> Model:
    """Fits the classifier to the notices against these lines and the decoys."""
    rnd = random.Random(20240817)
    families = tuple(sorted(NOTICES))
    known = [set(_grams(_tokens(t), (3,)) or {" ".join(_tokens(t))}) for ts in NOTICES.values() for t in ts]
    clean = [t for t in map(_tokens, lines) if t and not any(len(k & _grams(t, (3,))) >= 0.3 * len(k) for k in known)]
    seen: dict[str, int] = {}
    for t in clean:
        for w in set(t):
            seen[w] = seen.get(w, 0) + 1
    usual = {w for w, n in seen.items() if n > max(1, USUAL * len(clean))}
    clean += [_tokens(d) for d in DECOYS for _ in range(8)]
    names = sorted({g for ts in NOTICES.values() for t in ts for g in _grams(_tokens(t)) if not set(g.split()) <= usual})
    place = {g: i for i, g in enumerate(names)}
    rows: list[list[int]] = []
    y: list[int] = []
    for k, f in enumerate(families):
        for t in NOTICES[f]:
            base = _tokens(t)
            for v in range(VARIANTS):
                words = [w for w in base if v == 0 or rnd.random() > 0.08]
                noise = rnd.choice(clean) if v % 2 else []
                cut = rnd.randrange(len(noise) + 1)
                rows.append([place[g] for g in _grams([*noise[:cut][-30:], *words, *noise[cut:][:30]]) if g in place])
                y.append(k)
    unknown = len(families)
    for t in clean:
        rows.append([place[g] for g in _grams(t) if g in place])
        y.append(unknown)
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r] = 1
    target = np.eye(unknown + 1)[y]
    held = np.arange(len(rows)) % 5 == 4
    weight = np.where(np.array(y) == unknown, 0.5 / max(1, y.count(unknown)), 0.5 / max(1, len(y) - y.count(unknown)))
    weight = weight / weight[~held].sum()
    w, b = np.zeros((len(names), unknown + 1)), np.zeros(unknown + 1)
    momentum, rate = np.zeros_like(w), 2.0
    for t in range(steps):
        ahead = w + t / (t + 3) * momentum
        error = (_softmax(x @ ahead + b) - target) * (weight * ~held)[:, None]
        new = ahead - rate * (x.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        momentum, w = new - w, new
        b = b - rate * error.sum(axis=0)
    z = x[held] @ w + b
    loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), np.array(y)[held]], 1e-12)).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    heat = min(loss, key=loss.get)
    w, b = w / heat, b / heat
    weights = {g: tuple(float(v) for v in w[i]) for i, g in enumerate(names) if np.any(w[i])}
    return Model(families, weights, tuple(map(float, b)), _gate(weights, b, usual))


def _gate(weights: dict[str, tuple[float, ...]], b: np.ndarray, usual: set[str]) -> tuple[str, ...]:
    """Words such that a unit without them stays below the threshold: families then lose to unknown.

    The words left out are taken in as long as all n-grams made of them, together, could lift a family.
    """
    lift = {g: np.maximum(np.array(v[:-1]) - v[-1], 0) for g, v in weights.items()}
    words = {t for g in weights for t in g.split()}
    power = {t: sum((v.max() / len(g.split()) for g, v in lift.items() if t in g.split()), 0.0) for t in words}
    gate: list[str] = []
    for t in sorted(words, key=lambda t: (t in usual, len(t) < 4, -power[t], t)):
        outside = [v for g, v in lift.items() if not set(g.split()) & set(gate)]
        if not outside or (np.sum(outside, axis=0) + b[:-1] - b[-1]).max() < 0:
            break
        gate.append(t)
    return tuple(sorted(gate))


def fit(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits with the lines of at most sample_docs texts, chosen by a hash of the text."""
    rows = docs.select(F.col(text).alias("text")).filter("text is not null").select("text", F.xxhash64("text").alias("h")).orderBy("h", "text").limit(sample_docs)
    lines = [r["line"] for r in rows.select(F.explode(F.split("text", "\n")).alias("line")).collect()]
    return fit_lines(lines)


def _constant(value, kind: str) -> Column:
    """A constant as one literal, folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _strings(values) -> Column:
    return _constant(list(values), "array<string>")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: higher-order functions compute what they mention anew each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan_unit(model: Model, unit: Column) -> Column:
    """(family, p, contained) of a unit; the family is `unknown` below the threshold."""
    n = len(model.bias)
    by = [[sorted(_grams(_tokens(t), (3,)) or {" ".join(_tokens(t))}) for t in NOTICES[f]] for f in model.families]
    # one struct of constants, bound once a unit
    constants = F.struct(_constant(model.weights, "map<string,array<double>>").alias("weights"), _constant(by, "array<array<array<string>>>").alias("notices"), _strings(model.families).alias("families"))

    def runs(tokens: Column) -> Column:
        gram = lambda k: F.when(F.size(tokens) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))).otherwise(_strings([]))
        return F.concat(tokens, gram(2), gram(3))

    def judged(c: Column, grams: Column, z: Column, top: Column) -> Column:
        p = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))
        at = F.array_position(z, top).cast("int")
        held = F.array_max(F.transform(F.element_at(c["notices"], at), lambda t: F.size(F.array_intersect(grams, t)) / F.size(t)))
        return F.struct(F.when(p >= THRESHOLD, F.element_at(c["families"], at)).otherwise("unknown").alias("family"), p.alias("p"), held.alias("contained"))

    def scored(c: Column, grams: Column) -> Column:
        add = lambda a, g: F.zip_with(a, F.element_at(c["weights"], g), lambda x, y: x + y)
        scores = F.aggregate(F.array_intersect(grams, _strings(sorted(model.weights))), _constant(model.bias, "array<double>"), add)
        return _let(scores, lambda z: _let(F.array_max(F.slice(z, 1, n - 1)), lambda top: judged(c, grams, z, top)))

    tokens = F.filter(F.split(F.lower(unit), _SPLIT), lambda t: t != "")
    return _let(constants, lambda c: _let(tokens, lambda w: _let(runs(w), lambda grams: scored(c, grams))))


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs' columns and `notices`: array of (unit, family, p, contained, confirmed) of the units with a family."""
    gate = _strings(model.gate)
    words = lambda c: F.split(F.lower(c), _SPLIT)
    lines = F.split(F.col(text), "\n")
    blocks = F.filter(F.split(F.col(text), r"\n[ \t\r]*\n"), lambda p: F.instr(p, "\n") > 0)
    units = F.filter(F.concat(lines, blocks), lambda u: F.arrays_overlap(words(u), gate))
    found = F.filter(F.transform(units, lambda u: F.struct(u.alias("unit"), _scan_unit(model, u).alias("s"))), lambda x: x["s"]["family"] != "unknown")
    notices = F.transform(found, lambda x: F.struct(x["unit"].alias("unit"), x["s"]["family"].alias("family"), x["s"]["p"].alias("p"), x["s"]["contained"].alias("contained"), (x["s"]["contained"] >= CONTAINED).alias("confirmed")))
    none = _constant([], "array<struct<unit:string,family:string,p:double,contained:double,confirmed:boolean>>")
    return docs.withColumn("notices", F.when(F.arrays_overlap(words(F.col(text)), gate), notices).otherwise(none))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """key, families (confirmed, sorted, joined by commas), n_families, unconfirmed, best_p."""
    model = model or fit(docs, text)
    rows = scan(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), model)
    sure = F.array_sort(F.array_distinct(F.transform(F.filter("notices", lambda x: x["confirmed"]), lambda x: x["family"])))
    other = F.array_sort(F.array_distinct(F.transform(F.filter("notices", lambda x: ~x["confirmed"]), lambda x: x["family"])))
    rows = rows.select("id", sure.alias("sure"), F.array_except(other, sure).alias("other"), F.array_max(F.transform("notices", lambda x: x["p"])).alias("p"))
    return rows.select(F.col("id").alias(key), F.array_join("sure", ",").alias("families"), F.size("sure").cast("long").alias("n_families"), F.array_join("other", ",").alias("unconfirmed"), F.round(F.coalesce("p", F.lit(0.0)), 6).alias("best_p"))
