"""Licence scans on forms that train nothing."""

import pytest

from quartzfield.llm import licenses

PLAIN = [(100 + i, f"plain paragraph number {i} about nothing in particular\nand a second line {i}") for i in range(60)]

#: Forms that neither train nor calibrate.
HELD_OUT = {
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "other",
    "SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: EUPL-1.2": "other",
    "Distributed under the Boost Software License, Version 1.0.": "other",
    "This program is made available under the terms of the Eclipse Public License 2.0": "other",
    "Licensed under the EUPL, Version 1.2": "other",
    "All source files here are covered by the MPL-2.0.": "mpl-2.0",
    "It is provided under the Apache License 2.0 (see LICENSE).": "apache-2.0",
    "Copyright 2020 Acme Corp. All rights reserved.": "proprietary",
    "The scripts are free to use under the MIT License.": "mit",
    "Text and pictures: CC BY-SA 4.0": "cc-by-sa",
    "You can copy it under the GNU General Public License, version 3 or later.": "gpl",
    "It is covered by the GNU Lesser General Public License, version 2.1 or later.": "lgpl",
    "Our data is licensed under CC0 1.0 Universal.": "cc0",
}
INNOCENT = (
    "His driving license was renewed under the new law and all rights were read to him.",
    "He got a licence to sell beer.",
    "The rights were reserved for the family.",
    "She studied the history of public domain works at MIT.",
    "He works under the general manager, version 2 of the plan was open.",
    "The dog license law was changed by the new council.",
    "All of them had the right to use the river.",
    "Permission was granted to build the bridge.",
)


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit_licenses(spark.createDataFrame(PLAIN, "doc_id bigint, text string"))


def test_held_out_forms(make, model):
    texts = [*HELD_OUT, *INNOCENT]
    got = {r.doc_id: r for r in licenses.scan_licenses(make([*enumerate(texts), *PLAIN]), model).collect()}
    found = {texts[i]: r.family for i, r in got.items() if i < len(texts)}
    right = sum(found.get(t) == f for t, f in HELD_OUT.items())
    assert right / len(HELD_OUT) >= 0.9 and right / len(found) >= 0.9, found  # recall and precision
    assert texts[len(HELD_OUT)] not in found and not any(r.confirmed for i, r in got.items() if i >= len(HELD_OUT))
    assert all(found.get(t) == f for t, f in list(HELD_OUT.items())[:6])
    assert {texts[i] for i, r in got.items() if r.confirmed} >= {"SPDX-License-Identifier: MIT", "Copyright 2020 Acme Corp. All rights reserved."}


def test_scattered_words_confirm_nothing(spark):
    words = spark.createDataFrame([(["rights", "were", "all", "reserved"],), (["all", "rights", "reserved"],), (["by", "all", "rights", "reserved", "here"],), ([],)], "words array<string>")
    assert [r[0] for r in licenses._with_runs(words).select(licenses._overlap("proprietary")).collect()] == [0.0, 1.0, 1.0, 0.0]


def test_notices_of_any_length_and_neighbours(make, model):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.".split()
    narrow = "\n".join(" ".join(mit[i : i + 2]) for i in range(0, len(mit), 2))
    docs = [(1, narrow), (1, "Released under the MIT License.\nReleased under the MIT License.\nAll rights reserved.\nprose"), (None, "\n" * 3000 + "Licensed under the GPL v3." + "\n" * 70_000)]
    got = sorted(((r.doc_id or 0, r.paragraph, r.lines, r.family, r.overlap) for r in licenses.scan_licenses(make([*docs, *PLAIN]), model).collect() if r.confirmed))
    assert got == [(0, 3000, 1, "gpl", 1.0), (1, 0, 1, "mit", 1.0), (1, 0, (len(mit) + 1) // 2, "mit", 1.0), (1, 1, 1, "mit", 1.0), (1, 2, 1, "proprietary", 1.0)]


def test_probability_of_a_half_needs_a_cue(spark, model):
    """Texts of features without any cue stay below one half."""
    vocabulary = model.stages.stages[0].vocabulary
    left = [f for f in vocabulary if not set(f.split(" ")) & set(model.cues) and not set(f.split(" ")) & {"^", "$"}]
    df = spark.createDataFrame([(" ".join(left).split(" "),), *((f.split(" "),) for f in left)], "words array<string>")
    assert left and licenses._rated(df, model).where("p >= 0.5").count() == 0
