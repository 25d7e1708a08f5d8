import re

from tessella.llm import license

SCHEMA = "doc_id long, text string, family string, words string"
PROSE = "The river was wide and the people of the town had built a bridge over it long ago."
ROWS = [
    (1, f"{PROSE}\nReleased under the MIT License.", "x", "y"),
    (2, f"{PROSE}\nLicensed under the Apache License, Version 2.0.\n{PROSE}", "x", "y"),
    (3, "This work is licensed under the GNU General Public License, version 3.", "x", "y"),
    (4, "Licensed under CC BY-NC 4.0.", "x", "y"),
    (5, f"{PROSE}\nThe licence of the driver was taken away by the police.\nThe MIT is a university.", "x", None),
    (6, None, None, "y"),
    (7, "", "x", "y"),
    (None, " \n\t\n", "x", "y"),
    (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "x", "y"),
    (8, "word " * 100_000, "x", "y"),
    (9, "MIT License\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "x", "y"),
]


def test_scan(spark):
    df = spark.createDataFrame(ROWS + [(100 + i, f"{PROSE} Number {i} of many lines.\nAnother {i} of the lines", "x", "y") for i in range(50)], SCHEMA)
    got = license.scan(df).collect()
    assert len(got) == len(ROWS) + 50
    families = {}
    for r in got:
        families.setdefault(r.doc_id, set()).update(filter(None, r.families.split(",")))
    assert [families[i] for i in (1, 2, 3, 4, 8)] == [{"mit"}, {"apache"}, {"gpl"}, {"cc-by-nc"}, {"mit"}]
    assert families[9] == {"apache", "mit"}
    assert not any(families[i] for i in (5, 6, 7, None, *range(100, 150)))
    assert {r.doc_id: r.n_paragraphs for r in got if r.doc_id in (5, 6, None)} == {5: 3, 6: 0, None: 0}
    assert all((r.probability is None) == (r.families == "") for r in got)


def test_empty(spark):
    assert license.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_the_lines_of_the_corpus(spark, sf_dir):
    """The corpus holds four notices; every text with one of them, and no other, is found."""
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: ",".join(sorted({f for line, f in lines.items() if line in re.split("\n", r.text or "")})) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.families for r in license.scan(docs).collect()} == want


#: Notices and paragraphs whose wording is in no template, with the family that is to be found (None: no licence).
UNSEEN = [
    ("This project is distributed under the MIT License, see the file COPYING.", "mit"),
    ("Code in this folder is licensed under the Apache License, Version 2.0, unless stated otherwise.", "apache"),
    ("Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 2, or any later version.", "gpl"),
    ("You should have received a copy of the GNU Affero General Public License along with Foo.", "agpl"),
    ("The contents of this file are subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
    ("All images are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License by the museum.", "cc-by-nc"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without prior permission.", "bsd"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.", "isc"),
    ("This is free and unencumbered software which the town released into the public domain.", "unlicense"),
    ("Distributed under the Boost Software License, see the accompanying file.", "bsl"),
    ("The museum was free to all visitors and the terms of the visit were published.", None),
    ("Anyone is free to walk in the garden for any purpose.", None),
    ("The program of the concert may be changed without notice.", None),
    ("The general gave the public a license to hunt in the forest.", None),
]


def test_wordings_that_are_no_templates(spark):
    assert not {t for t, _ in UNSEEN} & {t for texts in license.TEMPLATES.values() for t in texts}
    rows = [(k, text, "x", "y") for k, (text, _) in enumerate(UNSEEN)] + [(100 + i, f"{PROSE} Number {i} of many lines.", "x", "y") for i in range(200)]
    got = {r.doc_id: r.families for r in license.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    wrong = [(text, family, got[k]) for k, (text, family) in enumerate(UNSEEN) if got[k] != (family or "")]
    assert len(wrong) <= 1, wrong
    assert not any(got[100 + i] for i in range(200))


def test_training_sends_little_to_the_driver(spark):
    """A step of the optimiser is a job of one task; gradients are not shuffled."""
    sc = spark.sparkContext
    df = spark.createDataFrame([(i, f"{PROSE} Number {i} of many lines.", "x", "y") for i in range(200)], SCHEMA).repartition(8)
    sc.setJobGroup("licence-training", "")
    try:
        license.train(df)
        told = [sc.statusTracker().getJobInfo(i) for i in sc.statusTracker().getJobIdsForGroup("licence-training")]
    finally:
        sc.setJobGroup("", "")
    tasks = [sum(s.numTasks for i in job.stageIds if (s := sc.statusTracker().getStageInfo(i))) for job in told if job]
    assert len(tasks) > 100 and sorted(tasks)[len(tasks) * 9 // 10] == 1
