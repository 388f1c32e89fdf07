"""License scans (operator 5): a trained paragraph classifier, with DataFrame functions only.

A paragraph is one to WIDEST lines that follow each other without a line lacking words between, so a grant that is wrapped is one
paragraph too. Its word n-grams (one to three words) are the sparse features of a multinomial logistic regression over licence
families and the class `unknown`. It is trained with Spark's own library on variants of template sentences and identifiers, on
sentences that only sound alike, and on a bounded sample of the corpus's ordinary lines. On held-out variants a temperature is
fitted, and the probability of `unknown` above which a paragraph is unknown. What is left names its families: those that have MINOR of
the probability, so that a choice of two licences gives both. Each counts only if a template of the family confirms it (`agrees`).

Most paragraphs never reach the features: the weights bound what each word can add (`gains`), and a paragraph whose words cannot reach the
threshold together is unknown. Leaving it out loses nothing (tests/llm compare with the model on every paragraph).

Of paragraphs that overlap and are found to be of one family the one with fewest lines stays, then the likeliest, then the first.

Defined results: a null or empty text has no paragraphs; equal paragraphs of a document count each; families of one paragraph come in
order of name; rows with one doc_id are told apart by their text, repeated rows are reported each; extra columns are ignored; a row
without a doc_id is left out; a text without line ends is one line, however long.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import body_of, staged, texts

UNKNOWN = "unknown"
# Sentences that name or grant a licence, by family; `year` stands for any.
SENTENCES = {
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it under the terms of the gnu affero general public license",
        "you should have received a copy of the gnu affero general public license along with this program",
    ],
    "apache": [
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the apache license",
        "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "distributed under the apache software license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
        "apache license version 2.0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "released under the bsd 3-clause license",
        "use of this source code is governed by a bsd style license",
        "use of this source code is governed by a bsd-style license that can be found in the license file",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
        "bsd license",
    ],
    "cc-by": [
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by 4.0",
        "licensed under cc by-sa 4.0",
        "this work is licensed under the creative commons attribution sharealike 3.0 license",
        "cc by 4.0",
        "cc by-sa 4.0",
        "cc-by-sa 3.0",
        "cc-by 3.0",
    ],
    "cc-by-nc": [
        "licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial license",
        "licensed under cc by-nc-sa 4.0",
        "creative commons attribution noncommercial sharealike 4.0 international license",
    ],
    "copyright-notice": ["copyright c year", "copyright year", "c copyright year by the authors", "c year"],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "licensed under the eclipse public license version 2.0",
        "which accompanies this distribution and is available at the eclipse public license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it under the terms of the gnu general public license",
        "it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
        "gnu general public license",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "the software is provided as is and the author disclaims all warranties with regard to this software",
        "released under the isc license",
        "isc license",
    ],
    "lgpl": [
        "released under the gnu lesser general public license",
        "this library is free software you can redistribute it under the terms of the gnu lesser general public license",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "licensed under the mit license",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit license",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license version 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
        "licensed under the mozilla public license",
    ],
    "proprietary": ["all rights reserved", "proprietary and confidential no license is granted", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"],
    "public-domain": ["this work has been released into the public domain", "dedicated to the public domain under the cc0 license", "this is free and unencumbered software released into the public domain"],
}
# Public identifiers of licences, by family, in lower case.
IDENTIFIERS = {
    "agpl": ["agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"], "apache": ["apache-2.0", "apache-1.1"], "bsd": ["bsd-3-clause", "bsd-2-clause", "bsd"], "cc-by": ["cc-by-4.0", "cc-by-sa-4.0", "cc-by-sa"],
    "cc-by-nc": ["cc-by-nc-4.0", "cc-by-nc-sa-4.0"], "epl": ["epl-2.0", "epl-1.0"], "gpl": ["gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gplv3", "gplv2"],
    "isc": ["isc"], "lgpl": ["lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0"], "mit": ["mit"], "mpl": ["mpl-2.0"], "public-domain": ["cc0-1.0", "unlicense"],
}
#: An identifier that is also an ordinary word says something only in these places; others also stand alone.
PLACES = ("spdx-license-identifier {}", "license {}", "licensed under {}", "{} license", "or {}", "{} or")
#: What confirms each family.
TEMPLATES = {
    family: list(dict.fromkeys([*own, *(p.format(x) for x in IDENTIFIERS.get(family, []) for p in (*PLACES, *(["{}"] if any(c.isdigit() for c in x) else [])))]))
    for family, own in SENTENCES.items()
}
#: Sentences with such words that license nothing.
ALIKE = [
    "the driver must carry a valid license at all times",
    "she asked for permission to leave the room early",
    "the museum said that the public may visit on sundays",
    "the apache helicopter flew over the valley",
    "he studied at mit before he moved to the coast",
    "copyright law changed several times in the last century",
    "the license fee for the shop went up again",
    "the warranty does not cover damage by water",
    "creative people in common rooms talk a lot",
    "the gnu is an antelope of the open plains",
    "a version of the story was released in the spring",
    "the general spoke in public about the terms",
    "rights of way across the field are reserved for walkers",
    "the mozilla team met under the bridge",
    "wine is sold under license in this town",
    "the free person obtained a copy of the letter",
]
#: More of them, for the class unknown only.
IN_PASSING = [
    "her driving license was renewed in year and the copy got lost",
    "he read the words all rights reserved aloud and laughed at them with the driver",
    "the software was distributed to every school in the county free of charge",
    "without the permission of the owner no person may use the garden",
    "the notice above the door shall remain in all rooms of the house",
    "the law of copyright was taught at mit in year",
    "the foundation gave money to the public library in year",
    "the terms of the contract were agreed in writing by both sides",
    "the eclipse was seen by the public in year",
    "a fishing license is required by law on this river",
    "they made the materials available to the press in the general office",
    "the author disclaims any interest in the sale of the house",
]
#: Lines of a paragraph, at most.
WIDEST = 3
#: Ordinary lines of the corpus in the training set, at most.
MAX_ORDINARY = 800
#: Share of a template's word pairs, or of a paragraph's own, that both have.
SHARED = 0.6
#: A template of fewer words than these must be a quarter of the paragraph's words.
SHORT = 4
#: Strength of the penalty on weights, half of it on their absolute values, which leaves most at nothing.
REGULARISATION = 0.002
#: Probability of a family that is reported.
MINOR = 0.2
#: Steps in which the bounds of words are counted.
PARTS = 64
#: Share of the need that words of little weight may have together, whether they are there or not.
WEAK = 0.2
KEY = ["doc_id", "body", "place", "width"]


@dataclass
class Classifier:
    vocabulary: Any
    model: Any
    families: list[str]
    temperature: float
    least: float
    #: Training lines of no licence, most of them the corpus's own, that have the word.
    common: Counter

    @property
    def grams(self) -> list[str]:
        return list(self.vocabulary.vocabulary)

    @property
    def weights(self) -> np.ndarray:
        """A row for each n-gram, a column for each family."""
        return self.model.coefficientMatrix.toArray().T

    @property
    def intercepts(self) -> np.ndarray:
        return self.model.interceptVector.toArray()


def plain_lines(text: Column) -> Column:
    """The lines of a text, in lower case, each its words between single spaces: letters, digits and marks inside words; a year is `year`."""
    # patterns begin with a class and leave a single space alone, as every match and every position that has to be looked at costs
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9.+\\n-](?:[^a-z0-9.+\\n-]+|(?<! ))", " ")
    plain = F.regexp_replace(plain, r"[12](?<=\b[12])(?:(?<=1)9|(?<=2)0)\d\d\b", "year")
    bare = F.regexp_replace(plain, r"(?=[.+-])(?:(?<![a-z0-9.+-])[.+-]++|[.+-]++(?![a-z0-9.+-]))", "")
    return F.split(F.trim(F.regexp_replace(bare, " {2,}", " ")), " ?\n ?")


def ngrams(tokens: Column, n: int) -> Column:
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    # slice() would copy all tokens each time; a gram with a missing token is missing
    return F.transform(starts, lambda i: F.concat(*[x for k in range(n) for x in (F.lit(" "), F.get(tokens, i + (k - 1)))][1:]))


def of_tokens(line: Column, f: Callable[[Column], Column]) -> Column:
    """f of a plain line's words, which a lambda binds: written out inside another lambda they would be made anew for every word."""
    return F.transform(F.array(F.split(line, " ")), f)[0]


def features(line: Column, words: list[str] | None = None) -> Column:
    """The distinct n-grams of a plain line; with words those that are made of these alone."""
    if words is None:
        return of_tokens(line, lambda t: F.array_distinct(F.concat(t, ngrams(t, 2), ngrams(t, 3))))
    known = F.transform(F.array(F.split(line, " ")), lambda t: F.transform(t, lambda w: F.when(w.isin(words), w)))
    return F.transform(known, lambda t: F.array_distinct(F.filter(F.concat(t, ngrams(t, 2), ngrams(t, 3)), lambda g: g.isNotNull())))[0]


def pairs_of(sentence: str) -> list[str]:
    """The distinct word pairs of a template, of one word that word."""
    own = sentence.split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(own, own[1:]))) or own  # noqa: B905


def agrees(line: Column, family: Column) -> Column:
    """Whether a template of the family confirms a plain line: it has SHARED of the template's word pairs, or two or more that are SHARED of its own.

    A short template must moreover be a quarter of the line's words.
    """
    given = {f: [{"pairs": pairs_of(s), "words": len(s.split())} for s in own] for f, own in TEMPLATES.items()}
    templates = F.element_at(F.from_json(F.lit(json.dumps(given)), "map<string,array<struct<pairs:array<string>,words:int>>>"), family)

    def confirms(t: Column, own: Column) -> Column:
        shared = F.size(F.array_intersect(t["pairs"], own["grams"]))
        much = (shared >= SHARED * F.size(t["pairs"])) | ((shared >= 2) & (shared >= SHARED * own["pairs"]))
        return much & ((t["words"] >= SHORT) | (4 * t["words"] >= own["words"]))

    own = of_tokens(line, lambda w: F.struct(F.concat(w, ngrams(w, 2)).alias("grams"), F.size(F.array_distinct(ngrams(w, 2))).alias("pairs"), F.size(w).alias("words")))
    return F.exists(F.array(own), lambda o: F.exists(templates, lambda t: confirms(t, o)))


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of constants, inside the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def variants(sentence: str, k: int) -> list[str]:
    """A template whole, without a fifth of its words at either end, and with ordinary words before or behind it; a year where it has one."""
    tokens = sentence.replace("year", str(1990 + k % 35)).split()
    cut, whole = math.ceil(len(tokens) * 0.8), " ".join(tokens)
    cuts = [" ".join(tokens[:cut]), " ".join(tokens[-cut:])] if cut > 3 else []
    return [whole, *cuts, *(f"{ALIKE[(k + j) % len(ALIKE)]} {whole}" for j in range(3)), *(f"{whole} {ALIKE[(k + j) % len(ALIKE)]}" for j in range(3))]


def labelled_paragraphs(spark: SparkSession, ordinary: DataFrame) -> DataFrame:
    """line, family and part (0 to 3) of the training set: variants of templates, sentences that sound alike, beginnings of templates, ordinary lines."""
    rows = []
    for family, sentences in sorted(TEMPLATES.items()):
        for sentence in sentences:
            rows += [{"line": v, "family": family} for v in variants(sentence, len(rows))]
    first = {family: own[0] for family, own in sorted(IDENTIFIERS.items())}
    rows += [{"line": f"{first[a]} or {first[b]}", "family": f} for a in first for b in first if a != b for f in (a, b)]  # a choice is of both
    unknown = [" ".join(x) for s in [*ALIKE, *IN_PASSING] for t in [s.split()] for x in (t, t[: len(t) // 2 + 2], t[len(t) // 3 :])]
    unknown += [f"{a} {b}" for a, b in zip(ALIKE, [*IN_PASSING, *ALIKE], strict=False)]
    whole = {s for own in TEMPLATES.values() for s in own}
    unknown += sorted({" ".join(s.split()[k : k + 2]) for own in SENTENCES.values() for s in own if len(s.split()) > 5 for k in (0, 2)} - whole)
    rows += [{"line": x, "family": UNKNOWN} for x in unknown]
    given = literal_table(spark, rows, "line:string,family:string")
    plain = ordinary.select("line", F.lit(UNKNOWN).alias("family"))
    return given.unionByName(plain).withColumn("line", plain_lines(F.col("line"))[0]).withColumn("part", F.pmod(F.xxhash64("line"), F.lit(4)))


def _softmax(logits: list[float], temperature: float) -> list[float]:
    top = max(logits)
    e = [math.exp((x - top) / temperature) for x in logits]
    return [x / sum(e) for x in e]


def _calibrated(families: list[str], held: list[tuple[str, list[float]]]) -> tuple[float, float]:
    """The temperature with the least log loss on held-out rows, and the least probability that a paragraph is of any licence."""
    loss = lambda t: -sum(math.log(max(1e-12, _softmax(x, t)[families.index(f)])) for f, x in held)
    temperature = min([0.5, 0.7, 1.0, 1.4, 2.0, 3.0], key=loss)
    known = lambda x: 1 - _softmax(x, temperature)[families.index(UNKNOWN)]
    wrong = sorted(known(x) for f, x in held if f == UNKNOWN) or [0.0]
    right = sorted(known(x) for f, x in held if f != UNKNOWN) or [1.0]
    return temperature, min(0.9, max(0.5, (wrong[-1 - len(wrong) // 50] + right[len(right) // 20]) / 2))


def train(spark: SparkSession, ordinary: DataFrame) -> Classifier:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    rows = staged(labelled_paragraphs(spark, ordinary).withColumn("grams", features(F.col("line"))), "licence-training").coalesce(1)
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2, vocabSize=1 << 15).fit(rows.filter("part < 3"))
    ready = vocabulary.transform(index.transform(rows))
    model = LogisticRegression(family="multinomial", regParam=REGULARISATION, elasticNetParam=0.5, maxIter=50).fit(ready.filter("part < 3"))
    families = list(index.labels)
    held = [(families[int(r["label"])], list(r["rawPrediction"])) for r in model.transform(ready.filter("part = 3")).select("label", "rawPrediction").collect()]
    common = Counter(w for r in rows.filter(F.col("family") == UNKNOWN).select("line").collect() for w in set(r["line"].split()))
    return Classifier(vocabulary, model, families, *_calibrated(families, held), common)


@dataclass
class Gains:
    """What a word can add at most to a paragraph's case for a licence, in PARTS of what a family needs: whole numbers, rounded up."""

    words: dict[str, int]
    need: int

    def of(self, line: Column) -> Column:
        """The sum over a plain line's words."""
        levels = sorted(set(self.words.values()))
        by_level = {n: [w for w, g in self.words.items() if g == n] for n in levels}

        def gain(w: Column) -> Column:
            out = F.lit(0)
            for n in levels:
                out = F.when(w.isin(by_level[n]), n).otherwise(out)
            return out

        strong = F.array_distinct(F.filter(F.split(line, " "), lambda w: w.isin(sorted(self.words))))
        return F.aggregate(strong, F.lit(0), lambda a, w: a + gain(w))


def gains(model: Classifier) -> Gains | None:
    """Bounds by which a paragraph whose words gain less than `need` is unknown to the model; None if there are none.

    A paragraph that is not unknown has for some family a score over unknown's of at least what that family needs. Every n-gram's score
    over unknown's is booked on one of its words, the one that ordinary lines have least (then the one in fewest n-grams), so what is booked
    on a paragraph's words is at least what its n-grams score, and words of everyday use carry little. Words on which little is booked are taken as there in every paragraph, as long as that leaves most of the need.
    """
    k = model.families.index(UNKNOWN)
    others = [i for i in range(len(model.families)) if i != k]
    over, start = model.weights[:, others] - model.weights[:, [k]], model.intercepts[others] - model.intercepts[k]
    # P(known) / P(unknown) is a sum over the families, so one of them has its share
    need = model.temperature * (math.log(model.least / (1 - model.least)) - math.log(len(others))) - start
    if (need <= 0).any():
        return None
    spread = Counter(w for g in model.grams for w in set(g.split()))
    booked: dict[str, np.ndarray] = {}
    for g, row in zip(model.grams, np.maximum(over, 0), strict=True):
        if row.any():
            w = min(g.split(), key=lambda x: (model.common[x], spread[x], x))
            booked[w] = booked.get(w, 0) + row / need
    weak, words = np.zeros(len(others)), {}
    for w in sorted(booked, key=lambda x: (booked[x].max(), x)):
        if (weak + booked[w]).max() <= WEAK:
            weak = weak + booked[w]
        else:
            words[w] = min(PARTS, math.ceil(PARTS * booked[w].max() + 1e-6))
    return Gains(words, math.floor(PARTS * (1 - weak.max()) - 1e-6))


def paragraphs(docs: DataFrame, bounds: Gains | None = None) -> DataFrame:
    """doc_id, body, place (0-based line), width (lines) and plain line of the paragraphs of docs(doc_id, body, text); with bounds those that can be more than unknown."""
    lines = docs.select("doc_id", "body", plain_lines(F.col("text")).alias("lines"))
    lines = lines.withColumn("gains", F.transform("lines", bounds.of if bounds else lambda x: F.lit(0)))
    need = bounds.need if bounds else 0

    def wide(width: int) -> Column:
        each = lambda column, i: [F.get(column, i + k) for k in range(width)]

        def unit(i: Column) -> Column:
            return F.struct(i.cast("int").alias("place"), F.lit(width).alias("width"), F.concat_ws(" ", *each("lines", i)).alias("line"))

        def whole(i: Column) -> Column:
            gain = reduce(Column.__add__, each("gains", i))  # null beyond the last line
            return reduce(Column.__and__, [x != "" for x in each("lines", i)], F.coalesce(gain >= need, F.lit(False)))

        return F.transform(F.filter(every, whole), unit)

    some = F.exists("gains", lambda x: x > 0) if bounds else F.lit(True)
    every = F.when(some, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    units = F.concat(*[wide(w) for w in range(1, WIDEST + 1)])
    return lines.select("doc_id", "body", F.inline(units))


def scored(units: DataFrame, model: Classifier) -> DataFrame:
    """KEY, line, family and probability of the families that the model finds in each paragraph; a task scores its own paragraphs."""
    from pyspark.ml.functions import vector_to_array

    words = sorted({w for g, row in zip(model.grams, model.weights, strict=True) if row.any() for w in g.split()})  # other n-grams weigh nothing
    raw = model.model.transform(model.vocabulary.transform(units.withColumn("grams", features(F.col("line"), words))))
    unknown = F.lit(model.families.index(UNKNOWN))
    powers = lambda x: F.transform(x, lambda v: F.exp((v - F.array_max(x)) / model.temperature))
    shares = lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))

    def found(p: Column) -> Column:
        named = F.zip_with(F.lit(model.families), p, lambda f, v: F.struct(f.alias("family"), v.alias("probability")))
        return F.filter(named, lambda x: (1 - F.get(p, unknown) >= model.least) & (x["family"] != UNKNOWN) & (x["probability"] >= MINOR))

    # one expression of bound steps, which no rule of the optimizer can write out several times
    out = F.array(vector_to_array("rawPrediction"))
    for step in (powers, shares, found):
        out = F.transform(out, step)
    return raw.select(*KEY, "line", F.inline(out[0]))


def classify(units: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, body, place, width, family and probability of the paragraphs that are confirmed to license something, of repeated rows once."""
    confirmed = scored(units, model).filter(agrees(F.col("line"), F.col("family"))).select(*KEY, "family", "probability").dropDuplicates([*KEY, "family"])
    near = Window.partitionBy("doc_id", "body", "family").orderBy("place").rangeBetween(1 - WIDEST, WIDEST - 1)  # at most WIDEST * (2 * WIDEST - 1) paragraphs
    others = confirmed.withColumn("near", F.collect_list(F.struct("place", "width", "probability")).over(near))

    def wins(x: Column) -> Column:
        overlaps = (x["place"] < F.col("place") + F.col("width")) & (F.col("place") < x["place"] + x["width"])
        rank = lambda width, p, place: F.struct(width.alias("w"), (-p).alias("p"), place.alias("at"))
        return overlaps & (rank(x["width"], x["probability"], x["place"]) < rank(F.col("width"), F.col("probability"), F.col("place")))

    return others.filter(~F.exists("near", wins)).select(*KEY, "family", "probability")


def ordinary_lines(docs: DataFrame) -> DataFrame:
    """line: one line, cut to 400 characters, of each of MAX_ORDINARY documents, without those that a template would confirm. For training only."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    at = F.xxhash64("doc_id", F.lit(5))
    some = docs.select(at.alias("at"), "doc_id", F.substring(F.get(lines, F.pmod(at, F.size(lines)).cast("int")), 1, 400).alias("line")).filter("trim(line) != ''")
    some = some.orderBy("at", "doc_id", "line").limit(MAX_ORDINARY)
    licensed = F.exists(F.lit(sorted(TEMPLATES)), lambda f: agrees(F.col("plain"), f))
    return some.withColumn("plain", plain_lines(F.col("line"))[0]).filter(~licensed).select("line")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, body (hash of the text), n_paragraphs (lines with a word) and licences (array of place, width, family, probability, by place) of each row of docs(doc_id, text)."""
    docs = texts(docs).withColumns({"body": body_of(), "text": F.coalesce("text", F.lit(""))})
    model = train(docs.sparkSession, ordinary_lines(docs))
    found = classify(paragraphs(docs, gains(model)), model)
    item = F.struct("place", "width", "family", "probability")
    per_doc = found.groupBy("doc_id", "body").agg(F.sort_array(F.collect_list(item)).alias("licences"))
    counts = docs.select("doc_id", "body", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_paragraphs"))
    none = F.array().cast("array<struct<place:int,width:int,family:string,probability:double>>")
    return counts.join(per_doc, ["doc_id", "body"], "left").withColumn("licences", F.coalesce("licences", none))
