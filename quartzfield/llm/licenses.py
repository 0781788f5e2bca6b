"""License scans with DataFrame functions: logistic regression on word n-grams names a family, template comparison confirms it.

A text is read by lines. A line that holds mostly pairs of words of known notices, or that the regression claims by itself, is licence-like; a run of
such lines, however long, is one notice, which is rated as a whole. So each line is rated once and each notice once. The regression is sparse: a
text without any of its ``cues`` provably stays below one half, and is known to be unknown without adding up its weights.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, text_of

UNKNOWN = "unknown"

#: A licence that is none of the families with templates.
OTHER = "other"

#: Bins of a probability in which the scores of notices are counted.
BINS = 100_000

#: A text with one of these speaks of licences, so it trains the unknown class only where it is labelled.
LICENCE_WORDS = r"(?i)licen|copyright|rights|\bgnu\b|\bl?gpl|\bmpl\b|spdx|apache|\bmit license|\bbsd\b|mozilla|creative commons|\bcc\b|\bcc0|public domain|redistribut|permission"

#: Usual wording of licence notices by family (fixed values): the templates, which are labelled notices too.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "cc-by": (
        "This work is licensed under CC BY 4.0.",
        "Licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0": (
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "Released into the public domain.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL v3.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this work may be reproduced without permission.",
    ),
}

#: Names of licences by family (fixed values); put into the sentences below they are labelled notices.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"),
    "bsd": ("BSD License", "3-Clause BSD License", "New BSD License", "BSD-2-Clause", "BSD-3-Clause"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "cc0": ("CC0 1.0 Universal", "CC0 public domain dedication", "CC0-1.0"),
    "gpl": ("GNU General Public License, version 3", "GNU GPL", "GPL v3", "GPL-3.0-or-later", "GPL-2.0-only"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL v3", "LGPL-2.1-or-later"),
    "mit": ("MIT License", "MIT licence", "Expat License", "MIT"),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    OTHER: ("zlib License", "Artistic License 2.0", "Common Development and Distribution License, version 1.0", "SIL Open Font License, version 1.1", "Academic Free License", "Microsoft Public License", "Python Software Foundation License", "Open Database License", "Artistic-2.0", "CDDL-1.0", "OFL-1.1", "AFL-3.0", "CeCILL, version 2.1", "Unlisted, Version 1.1", "unlisted-1.0", "Unlisted Public License 2.0"),
}

#: Sentences around a name (fixed values): those that train, and those that calibrate.
CARRIERS = ("Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This project is released under {}.", "Distributed under the terms of the {}.", "This software is available under the {}.", "This program is made available under the terms of the {}.", "SPDX-License-Identifier: {}", "License: {}")
CALIBRATING_CARRIERS = ("The code is licensed under {}.", "This library is distributed under the {}.", "You may use this file under the terms of the {}.", "// SPDX-License-Identifier: {}")

#: Notices of other licences, some without a name (fixed values).
OTHER_NOTICES = (
    "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted.",
    "See the file LICENSE for the license.",
    "This file is subject to the license terms in the file COPYING.",
    "Use of this source code is governed by a license that can be found in the LICENSE file.",
)

#: Sentences with words of licences that license nothing (fixed values): those that train, and those that calibrate.
NO_NOTICES = (
    "She passed the test and got her driving licence in May.",
    "The city will license street vendors from next year.",
    "A fishing license costs ten dollars a day.",
    "The court held that copyright law does not cover recipes.",
    "They fought for civil rights and equal pay.",
    "The rights of the accused were explained by the officer.",
    "You need permission from your parents to join the trip.",
    "The public domain of the crown was sold under the old king.",
    "The Apache people lived in the southwest.",
    "Researchers at MIT published a new study.",
    "He was released under the terms of the agreement.",
    "The bar lost its liquor license under the new rules.",
    "A general public meeting was held on version two of the plan.",
    "The conditions of the work are met by the following source.",
    "His license plate was reported by a witness.",
    "Human rights groups reserved their judgment.",
    "In the end he got his pilot license.",
    "The new version of the software is available under the menu.",
)
CALIBRATING_NO_NOTICES = (
    "Her medical license was suspended under state law.",
    "The government may license the use of the waterway.",
    "Patients have rights, and all of them were explained.",
    "The library is free and open to the public.",
    "Copyright disputes are common in the music trade.",
    "The museum asked for permission to copy the painting.",
    "The software was distributed to all members of the staff.",
    "Mozilla hired a general counsel to work on policy.",
    "Without insurance nobody renewed the license.",
)


def tokens(text: Column) -> Column:
    """Lower-case words; full stops and hyphens inside a word stay, as in 2.0 or by-nc."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.\-]+|[.\-]+(?=\s|$)", " "), " +")
    return F.filter(words, lambda w: w != "")


def ngrams(words: Column, ends: bool = True) -> Column:
    """Words and pairs of neighbours; ``^`` and ``$`` are the neighbours of the ends."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    inner = F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))
    edges = F.when(F.size(words) > 0, F.array(F.concat(F.lit("^ "), F.get(words, F.lit(0))), F.concat(F.get(words, F.size(words) - 1), F.lit(" $")))).otherwise(F.array().cast("array<string>"))
    return F.concat(inner, edges) if ends else inner


def _words(text: str) -> list[str]:
    """As ``tokens``, for the templates (ASCII)."""
    return re.sub(r"[^a-z0-9.\-]+|[.\-]+(?=\s|$)", " ", text.lower()).split()


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator: filters and lambdas that use them read the value, where Spark would else compute it for each use."""
    for name, col in columns.items():
        df = df.select("*", F.explode(F.array(col)).alias(name))
    return df


def _with_runs(df: DataFrame) -> DataFrame:
    """Add the pairs and triples of neighbouring words, by which runs are told."""
    def of(k: int) -> Column:
        return F.when(F.size("words") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (k - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice("words", i, F.lit(k))))).otherwise(F.array().cast("array<string>"))

    return _once(df, _g2=of(2), _g3=of(3))


def _longest_run(template: list[str]) -> Column:
    """The share of a template in the longest run of its words that stands in ``words`` in order (a run of three words at least, or the whole of a shorter template).

    Runs are told by their neighbouring triples of words; a triple that stands elsewhere may join two runs.
    """
    k = min(3, len(template))
    have = F.col(f"_g{k}")
    own = F.lit([" ".join(template[i : i + k]) for i in range(len(template) - k + 1)])
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(state: Column, gram: Column) -> Column:
        now = F.when(F.array_contains(have, gram), state["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    best = F.aggregate(own, zero, step, lambda s: s["best"])
    return F.when(best > 0, (best + (k - 1)) / F.lit(float(len(template)))).otherwise(0.0)


def _templates(family: str) -> list[list[str]]:
    """Words of the family's templates, and of the tags that name it."""
    return [*map(_words, TEMPLATES[family]), *(_words(f"SPDX-License-Identifier: {n}") for n in NAMES.get(family, ()) if " " not in n)]


def _overlap(family: str) -> Column:
    """The largest share of a template of the family that stands in ``words`` as one run."""
    return F.greatest(F.lit(0.0), F.lit(0.0), *(_longest_run(t) for t in _templates(family)))


def _confirmed(family: str, least: float) -> Column:
    """True if a run holds the share ``least`` of a template; of one under eight words, half of the rest more."""
    tests = F.lit(False)
    for t in _templates(family):
        tests = tests | (_longest_run(t) >= (least if len(t) >= 8 else (1 + least) / 2))
    return tests


def _of_family(make, default: Column) -> Column:
    """``make(family)`` for the family that the row names; families without templates give the default."""
    return F.coalesce(*(F.when(F.col("family") == f, make(f)) for f in TEMPLATES), default)


@dataclass(frozen=True)
class LicenseModel:
    """Features and weights, the family of each class, Platt's slope and offset of the margin over unknown, the words one of which every claimed text has, and all n-grams of known notices."""

    stages: PipelineModel
    families: list[str]
    cues: tuple[str, ...]
    known: tuple[str, ...]
    slope: float = 1.0
    offset: float = 0.0


def cue_words(vocabulary: list[str], weights: list[list[float]], bias: list[float], common: set[str] = frozenset()) -> tuple[str, ...]:
    """Words without which no class but the first reaches a probability of a half.

    Class k needs a larger margin over class 0 than 0: its bias and the positive weights of the features present. The largest weights are cues until
    all others together cannot lift the margin to 0; of a pair the longer word is the cue, one of ``common`` only if there is no other. A text without
    features is unknown by definition.
    """
    cues = set()
    for k in range(1, len(bias)):
        lift = sorted(((w - z, f) for w, z, f in zip(weights[k], weights[0], vocabulary, strict=True) if w > z), reverse=True)
        rest, need = sum(w for w, _ in lift), max(1e-9, bias[0] - bias[k])
        for w, f in lift:
            if rest < need:
                break
            cues.add(max(f.split(" "), key=lambda x: (x not in common, len(x))))
            rest -= w
    return tuple(sorted(cues))


def _maybe(text: Column, cues: tuple[str, ...]) -> Column:
    """False only for texts without any cue: a cheap look at runs of letters and digits, of which each cue has one."""
    parts = sorted({max(re.findall(r"[a-z0-9]+", c), key=len) for c in cues})
    return F.arrays_overlap(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.lit(parts)) if parts else F.lit(False)


def _margin(words: DataFrame, stages: PipelineModel, families: list[str]) -> DataFrame:
    """Add the likeliest family (the first by name of equal ones) and ``margin``, the log odds of all families together against unknown."""
    raw = _once(stages.transform(_once(words, grams=ngrams(F.col("words")))), _raw=vector_to_array("rawPrediction"))
    known, best = F.slice("_raw", 2, len(families) - 1), F.array_max(F.slice("_raw", 2, len(families) - 1))
    raw = _once(raw, _best=best)
    name = F.element_at(F.array(*map(F.lit, families[1:])), F.array_position(known, F.col("_best")).cast("int"))
    return raw.withColumn("family", name).withColumn("margin", F.col("_best") - F.col("_raw")[0] + F.log(F.aggregate(known, F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best"))))).drop("grams", "features", "rawPrediction", "probability", "prediction", "_raw", "_best")


def _rated(words: DataFrame, model: LicenseModel) -> DataFrame:
    """Add the likeliest family and its calibrated probability ``p``."""
    return _once(_margin(words, model.stages, model.families), p=1 / (1 + F.exp(-(F.col("margin") * model.slope + model.offset)))).drop("margin")


def notices(df: DataFrame, id_col: str, text_col: str, model: LicenseModel, least_share: float, least_overlap: float) -> DataFrame:
    """``doc, paragraph, lines, body, words``: runs of lines that are licence-like, of any length.

    A line is licence-like where the regression claims it by itself, or where at least ``least_share`` of its different pairs of words (its word,
    if it has one only) stand in known notices. A line that is claimed for another family than the claimed one before it, or that a template confirms by itself, starts a notice of its own.
    """
    single = sorted({w for g in model.known for w in g.split(" ")})
    docs = df.select(F.col(id_col).cast("bigint").alias("doc"), text_of(text_col).alias("_text")).where(_maybe(F.col("_text"), model.cues))
    lines = docs.withColumn("_row", F.monotonically_increasing_id()).select("doc", "_row", F.posexplode(F.split("_text", "\n")).alias("paragraph", "body"))
    worded = _once(lines, words=tokens(F.col("body"))).where(F.arrays_overlap("words", F.lit(single)))
    pairs = F.when(F.size("words") > 1, F.array_distinct(F.filter(ngrams(F.col("words"), ends=False), lambda g: F.instr(g, " ") > 0))).otherwise(F.col("words"))
    shared = _once(_once(worded, _pairs=pairs), share=F.size(F.array_intersect("_pairs", F.lit(list(model.known)))) / F.size("_pairs"))
    rated = _rated(shared, model).withColumn("alone", F.when(F.col("p") >= 0.5, F.col("family")))
    # ids of rows must not change between the jobs that read them
    like = materialise(rated.where(F.col("alone").isNotNull() | (F.col("share") >= least_share)).select("doc", "_row", "paragraph", "body", "words", "family", "alone"))
    by_row, by_run = Window.partitionBy("_row").orderBy("paragraph"), Window.partitionBy("_row", "_run").orderBy("paragraph")
    runs = _with_runs(like).withColumn("_run", F.col("paragraph") - F.row_number().over(by_row))
    before = F.last("alone", ignorenulls=True).over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    whole = F.when(F.col("alone").isNotNull(), _of_family(lambda f: _confirmed(f, least_overlap), F.lit(False))).otherwise(F.lit(False))
    begun = runs.withColumn("_begins", F.coalesce(F.col("alone").isNotNull() & ((before != F.col("alone")) | (before.isNotNull() & whole)), F.lit(False)))
    parts = begun.withColumn("_part", F.sum(F.col("_begins").cast("int")).over(by_run))
    found = parts.groupBy("_row", "_run", "_part").agg(F.first("doc").alias("doc"), F.array_sort(F.collect_list(F.struct("paragraph", "body", "words"))).alias("_l"))
    return found.select("doc", F.col("_l")[0]["paragraph"].alias("paragraph"), F.size("_l").alias("lines"), F.concat_ws(" ", "_l.body").alias("body"), F.flatten("_l.words").alias("words"))


def _labelled(carriers: tuple[str, ...], families: list[str]) -> list[tuple[float, str]]:
    """Names in sentences, and by themselves if they are longer than an ordinary word's three letters."""
    return [(float(families.index(f)), c.format(n)) for f, names in NAMES.items() for n in names for c in (*carriers, *(["{}"] if len(n) > 3 else []))]


def fit_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_documents: int = 1000, max_paragraphs: int = 4000) -> LicenseModel:
    """Train on labelled notices and on a bounded sample of the corpus: lines of about ``max_documents`` texts chosen by hash, ``max_paragraphs`` different ones at most.

    A family is trained by its templates, by its names in sentences, and by lines of the sample that hold nine tenths of a template; the class ``other`` by
    names that no family has and by the sentences without a name; the class ``unknown`` by lines without licence words and by sentences with such words that license nothing. Known and
    unknown weigh the same. N-grams of English stop words only are no features. Probabilities are calibrated (Platt) on a fold of its own: other sentences
    around the names, other sentences that license nothing, and a fifth of the sampled lines.
    """
    spark = df.sparkSession
    families = [UNKNOWN, *sorted({*TEMPLATES, OTHER})]
    text = df.select(text_of(text_col).alias("_text"))
    share = min(1.0, max_documents / max(1, df.count()))
    some = text.where(F.pmod(F.xxhash64("_text", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    lines = some.select(F.explode(F.split("_text", "\n")).alias("body")).where(F.length("body") > 0).distinct()
    sample = materialise(lines.orderBy(F.xxhash64("body"), "body").limit(max_paragraphs).select("body", tokens(F.col("body")).alias("words")).where(F.size("words") > 0))
    plain = sample.where(~F.col("body").rlike(LICENCE_WORDS)).select(F.lit(0.0).alias("label"), "words", (F.pmod(F.xxhash64("body", F.lit(2)), F.lit(5)) == 0).alias("apart"))
    near = F.coalesce(*(F.when(_overlap(f) >= 0.9, float(families.index(f))) for f in TEMPLATES))
    found = _once(_with_runs(sample.where(F.col("body").rlike(LICENCE_WORDS))), label=near).where("label IS NOT NULL").select("label", "words", F.lit(False).alias("apart"))
    n_plain = plain.count()

    def rows(pairs: list[tuple[float, str]], apart: bool) -> DataFrame:
        return spark.createDataFrame(pairs, "label double, body string").select("label", tokens(F.col("body")).alias("words"), F.lit(apart).alias("apart"))

    known = [(float(families.index(f)), t) for f, texts in TEMPLATES.items() for t in texts] + [(float(families.index(OTHER)), t) for t in (*OTHER_NOTICES, *(c.format("") for c in CARRIERS[:-1]))] + _labelled(CARRIERS, families)
    none = [(0.0, t) for t in (*NO_NOTICES, "")]
    learnt = rows(known, False).unionByName(found)
    kept, held = [x for x in _labelled(CALIBRATING_CARRIERS, families) if x not in known], [(0.0, t) for t in CALIBRATING_NO_NOTICES]
    common = {"^", "$", *StopWordsRemover.loadDefaultStopWords("english")}
    seen = CountVectorizer(inputCol="grams", minDF=1.0, vocabSize=1 << 14).fit(learnt.withColumn("grams", ngrams(F.col("words"))).coalesce(1)).vocabulary
    vocabulary = sorted(g for g in seen if not common.issuperset(g.split(" ")))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    # sentences that license nothing weigh as much as all known ones, and the sampled lines as much again
    hard = learnt.withColumn("weight", F.lit(1.0)).unionByName(rows(none, False).withColumn("weight", F.lit(len(known) / len(none))))
    train = hard.unionByName(plain.where("NOT apart").withColumn("weight", F.lit(len(known) / max(1, n_plain)))).withColumn("grams", ngrams(F.col("words")))
    fitted = LogisticRegression(family="multinomial", regParam=2e-5, elasticNetParam=0.5, maxIter=80, weightCol="weight").fit(vectors.transform(train).select("label", "features", "weight").coalesce(1))
    stages = PipelineModel([vectors, fitted])
    fold = rows(kept, True).withColumn("weight", F.lit(1.0)).unionByName(rows(held, True).withColumn("weight", F.lit(len(kept) / 2 / len(held))))
    fold = fold.unionByName(plain.where("apart").withColumn("weight", F.lit(len(kept) / 2 / max(1, n_plain / 5))))
    margins = _margin(fold, stages, families).select((F.col("label") > 0).cast("double").alias("label"), F.array("margin").alias("_m"), "weight")
    slope, offset = _platt(margins)
    discard(sample)
    bias = fitted.interceptVector.toArray().tolist()
    bias[0] += -offset / slope - math.log(len(families) - 1)  # the margin at which the calibrated probability is one half; all families together have the best one's odds that many times at most
    return LicenseModel(stages, families, cue_words(vocabulary, fitted.coefficientMatrix.toArray().tolist(), bias, common), tuple(sorted(g for g in seen if not {"^", "$"} & set(g.split(" ")))), slope, offset)


def _platt(margins: DataFrame) -> tuple[float, float]:
    """Slope and offset of the probability that a margin is a notice's; the slope is positive."""
    from pyspark.ml.functions import array_to_vector

    fit = LogisticRegression(regParam=1e-2, maxIter=50, weightCol="weight").fit(margins.select("label", array_to_vector("_m").alias("features"), "weight").coalesce(1))
    return max(1e-3, float(fit.coefficients[0])), float(fit.intercept)


def quiet_threshold(counts: dict[int, int], share: float) -> float:
    """The least bin edge that at most ``share`` of the counted lines exceed; bin k holds probabilities above (k - 1) / BINS up to k / BINS."""
    above, allowed, edge = 0, share * sum(counts.values()), 0
    for k in sorted(counts, reverse=True):
        above += counts[k]
        if above > allowed:
            edge = k + 1e-6
            break
    return edge / BINS


def scan_licenses(df: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", least_overlap: float = 0.6, least_share: float = 0.5, false_alarms: float = 0.001) -> DataFrame:
    """One row per notice that a licence family, or the class ``other``, claims: ``id_col, paragraph, lines, family, probability, overlap, confirmed, body``.

    A notice is a line of the text (``paragraph``, counted from 0) or a run of neighbouring ones (see ``notices``); their text is joined by spaces; a blank
    line ends it. It is claimed where the likeliest family (ties: the first by name) reaches one half, or more where else over the share
    ``false_alarms`` of all lines would be claimed without a licence word; all others are of the class ``unknown`` and give no row. ``overlap`` is the largest share of a
    template of that family whose words stand in the notice in order, as one run; from ``least_overlap`` on the claim is confirmed (0.8 for templates under eight words). The
    class ``other`` has no templates and is never confirmed. Null and empty texts and lines without words give no rows; ids may be null or
    repeat, each row is read by itself; an empty table gives an empty result. Only licence-like lines move, by row.
    """
    rated = materialise(_rated(notices(df, id_col, text_col, model, least_share, least_overlap), model).where("p >= 0.5"))
    text = text_of(text_col)
    every = df.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    loud = rated.where(~F.col("body").rlike(LICENCE_WORDS)).groupBy(F.ceil(F.col("p") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.bin: r.n for r in loud.collect()}
    counts[0] = max(0, every - sum(counts.values()))
    claimed = rated.where(F.col("p") >= max(0.5, quiet_threshold(counts, false_alarms)))
    out = _with_runs(claimed).withColumn("overlap", _of_family(_overlap, F.lit(0.0))).withColumn("confirmed", _of_family(lambda f: _confirmed(f, least_overlap), F.lit(False)))
    return out.select(F.col("doc").alias(id_col), F.col("paragraph").cast("int").alias("paragraph"), F.col("lines").cast("int").alias("lines"), "family", F.col("p").alias("probability"), "overlap", "confirmed", "body")
