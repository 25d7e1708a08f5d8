"""Licence scans: a paragraph classifier finds licence families, a comparison with templates confirms them.

A paragraph is a line with a word. Its features are its word n-grams of one and two words, hashed into ``FEATURES``
columns; a multinomial logistic regression over them, sparse by an L1 penalty, gives a score to each family and to
``unknown``. It is trained on variants of the templates (words dropped by a hash, notices put around them) and, as unknown,
on a bounded sample of the corpus's own paragraphs that no template resembles, about ``UNKNOWN_ROWS`` of them, and on
sentences that speak of licences without granting one.

The lead of the best family over unknown is calibrated by a second regression with one feature. Its rows are wordings that
the classifier has not seen: whole templates with all their variants are dealt into ``FOLDS`` folds, each fold is scored by
a classifier of the others, and the leads of all folds are put together. Below a probability of ``MIN_PROBABILITY`` a
paragraph is unknown. A prediction counts only if a template shares at least ``MIN_OVERLAP`` of the three-word shingles of
the shorter of the two; of the families that the classifier puts above unknown the one with the nearest template is given.

All paragraphs are scored where they are read; only those with a prediction are shuffled.

Defined cases: a null or empty text has no paragraphs and no licence; null ids and repeated rows are documents of their
own; of families with equal scores the first by name is taken; an empty table gives an empty result (the classifier is
then trained without corpus paragraphs); other columns are ignored.
"""
from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, with_row_id

FEATURES = 1 << 12
UNKNOWN_ROWS = 4000
ITERATIONS = 40
VARIANTS, FOLDS = 24, 3
MIN_PROBABILITY, MIN_OVERLAP = 0.5, 0.5
UNKNOWN = "unknown"
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"

#: Paragraphs of public licences and usual notices of them, by family.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "artistic": [
        "This library is free software; you may redistribute it and/or modify it under the same terms as Perl itself.",
        "This package is distributed under the terms of the Artistic License 2.0.",
        "You may distribute this module under the terms of either the GNU General Public License or the Artistic License, as specified in the Perl README file.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "bsl": [
        "Distributed under the Boost Software License, Version 1.0.",
        "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.',
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0, for noncommercial use only.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "This work is marked with CC0 1.0 Universal (CC0 1.0) Public Domain Dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 1.0.",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "Licensed under the GNU GPL, version 2.",
        "This software may be used and distributed according to the terms of the GNU General Public License version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ofl": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software.",
        "This license is available with a FAQ at: http://scripts.sil.org/OFL",
        "SPDX-License-Identifier: OFL-1.1",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "For more information, please refer to http://unlicense.org/",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "This notice may not be removed or altered from any source distribution.",
        "SPDX-License-Identifier: Zlib",
    ],
}
#: What may stand around a notice, and sentences about licences that grant nothing.
AROUND = [("", ""), ("Copyright 2019 The Authors.", ""), ("", "All rights reserved."), ("Note:", "See the file for details."), ("#", "")]
NOT_LICENCES = [
    "He lost his driving licence on the way to the city.",
    "The committee discussed which license would suit the project.",
    "A licence fee is due every year.",
    "The permission of the owner is needed before anyone enters the house.",
    "The warranty of this device ends after two years.",
    "Version 2.0 of the program was released in the spring.",
    "The general public was not admitted.",
    "The software is distributed in boxes of twelve.",
    "They granted him the right to use the road.",
    "The authors thank the foundation for its support.",
    "All rights reserved.",
    "Copyright 2019 The Authors.",
]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _shingles(words: str) -> str:
    return f"array_distinct(transform(sequence(0, greatest(size({words}) - 3, 0)), i -> array_join(slice({words}, i + 1, 3), ' ')))"


def _literal(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """A small table of constants: (family, text)."""
    items = F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in rows])
    return spark.range(1).select(F.explode(items).alias("r")).select("r.family", "r.text")


def _features(df: DataFrame) -> DataFrame:
    """Add words, and the hashed n-grams of one and two words between marks of begin and end."""
    df = df.withColumn("words", _words(F.col("text"))).withColumn("marked", F.concat(F.array(F.lit("^")), "words", F.array(F.lit("$"))))
    df = NGram(n=2, inputCol="marked", outputCol="pairs").transform(df).withColumn("grams", F.concat("words", "pairs"))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(df).drop("marked", "pairs", "grams")


def paragraphs(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep``, pos and text of each line with a word."""
    return df.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


@dataclass
class Model:
    classes: list[str]  # the last is unknown
    weights: LogisticRegressionModel
    slope: float
    offset: float

    def lead(self, df: DataFrame) -> DataFrame:
        """Add the best family, how far its logit is above that of unknown, and all families that are above it."""
        scored = self.weights.transform(df).withColumn("raw", vector_to_array("rawPrediction")).drop("rawPrediction", "probability", "prediction")
        n = len(self.classes) - 1
        scored = scored.withColumn("best", F.expr(f"array_max(slice(raw, 1, {n}))"))
        names = F.array(*[F.lit(c) for c in self.classes])
        above = F.transform(F.filter(F.arrays_zip(names.alias("name"), F.col("raw").alias("raw")), lambda x: x["raw"] > F.element_at("raw", n + 1)), lambda x: x["name"])
        return scored.withColumns({"above": above, "family": F.element_at(names, F.array_position("raw", F.col("best")).cast("int")), "lead": F.col("best") - F.col("raw")[n]}).drop("raw", "best")

    def predict(self, df: DataFrame) -> DataFrame:
        """Add family and calibrated probability of (text)."""
        scored = self.lead(_features(df))
        scored = scored.withColumn("probability", 1 / (1 + F.exp(-(F.lit(self.slope) * F.col("lead") + self.offset)))).drop("features", "lead")
        # A generator between them keeps a filter on the probability from being pushed down, which would put the
        # expressions for the words into the lambdas over the words, once for every word.
        return scored.select(F.inline(F.array(F.struct(*[F.col(c) for c in scored.columns]))))


def _templates(spark: SparkSession) -> DataFrame:
    """One row: an array of (family, shingles)."""
    rows = _literal(spark, [(f, t) for f, texts in TEMPLATES.items() for t in texts]).withColumn("words", _words(F.col("text")))
    return rows.select("family", F.expr(_shingles("words")).alias("shingles")).agg(F.collect_list(F.struct("family", "shingles")).alias("templates"))


def _confirm(df: DataFrame) -> DataFrame:
    """Add ``confirmed`` to rows with family, above and words, and give them the family, of those above unknown, whose template
    is nearest: families share whole openings, which the classifier alone cannot tell apart. The templates are one row."""
    share = "size(array_intersect(t.shingles, shingles)) / least(size(t.shingles), size(shingles))"
    near = F.expr(f"array_max(transform(filter(templates, t -> array_contains(above, t.family)), t -> named_struct('share', {share}, 'own', t.family = family, 'name', t.family)))")
    out = df.crossJoin(F.broadcast(_templates(df.sparkSession))).withColumn("shingles", F.expr(_shingles("words"))).withColumn("near", near)
    out = out.withColumn("confirmed", F.coalesce(F.col("near.share") >= MIN_OVERLAP, F.lit(False)))
    return out.withColumn("family", F.when(F.col("confirmed"), F.col("near.name")).otherwise(F.col("family"))).drop("templates", "shingles", "near", "above")


def train(df: DataFrame, text_col: str = "text", unknown_rows: int = UNKNOWN_ROWS) -> Model:
    """A classifier from the templates and a bounded sample of the corpus."""
    spark = df.sparkSession
    classes = [*TEMPLATES, UNKNOWN]
    seeds = F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in AROUND])
    # A template's number in its family is its fold, so that each fold leaves every family some templates.
    folds = F.expr("element_at(map(" + ", ".join(f"{_quoted(t)}, {k % FOLDS}" for texts in TEMPLATES.values() for k, t in enumerate(texts)) + "), text)")
    known = _literal(spark, [(f, t) for f, texts in TEMPLATES.items() for t in texts]).withColumn("fold", folds).withColumn("seed", seeds)
    # Variant 0 is the template; in others about every tenth word goes, chosen by a hash.
    # Of long templates every other variant is a stretch of 14 words, as in wrapped lines.
    dropped = F.expr("array_join(filter(split(text, ' '), (w, i) -> seed = 0 or pmod(xxhash64(text, i, seed), 10) > 0), ' ')")
    stretch = F.expr("if(seed % 2 = 1 and size(split(text, ' ')) > 18, array_join(slice(split(text, ' '), cast(1 + pmod(xxhash64(text, seed), size(split(text, ' ')) - 14) as int), 14), ' '), text)")
    known = known.withColumn("text", stretch).withColumn("put", around[F.expr(f"pmod(seed, {len(AROUND)})")]).select("family", F.trim(F.concat_ws(" ", "put.a", dropped, "put.b")).alias("text"), "fold")
    by_text = F.expr(f"cast(pmod(xxhash64(text), {FOLDS}) as int)")
    told = _literal(spark, [(UNKNOWN, t) for t in NOT_LICENCES]).withColumn("fold", by_text).withColumn("seed", seeds).withColumn("text", dropped)
    n = paragraphs(df, [], text_col).count()
    some = paragraphs(df, [], text_col).where(F.shiftrightunsigned(F.xxhash64("text", "pos"), 11) / F.lit(float(1 << 53)) < unknown_rows / max(1, n)).select("text")
    some = some.withColumn("words", _words(F.col("text"))).crossJoin(F.broadcast(_templates(spark))).withColumn("shingles", F.expr(_shingles("words")))
    alike = F.expr("exists(templates, t -> size(array_intersect(t.shingles, shingles)) >= 0.3 * least(size(t.shingles), size(shingles)))")
    own = some.where(~alike).select(F.lit(UNKNOWN).alias("family"), "text", by_text.alias("fold"))
    rows = known.unionByName(told.select("family", "text", "fold")).unionByName(own)
    label = F.expr("element_at(map(" + ", ".join(f"'{c}', {i}D" for i, c in enumerate(classes)) + "), family)")
    rows = materialise(rows.withColumn("label", label), "licence-rows")
    # Bounded: the templates' variants and the sample. In one partition and read from a table, a step of the optimiser is one
    # small task: without a shuffle of gradients, which have a number for each class and feature, and without the expressions
    # for the words, which would be sent along with each of some hundred jobs and stay with the driver's records of them.
    rows = materialise(_features(rows.coalesce(1)).select("label", "fold", "features"), "licence-features")
    ready = rows.coalesce(1)
    fit = LogisticRegression(maxIter=ITERATIONS, regParam=0.0005, elasticNetParam=0.5, standardization=False, family="multinomial").fit
    leads = []
    for fold in range(FOLDS):
        seen = Model(classes, fit(ready.where(F.col("fold") != fold)), 1.0, 0.0)
        leads.append(seen.lead(ready.where(F.col("fold") == fold)).select((F.col("label") < len(classes) - 1).cast("double").alias("label"), "lead"))
    held = materialise(functools.reduce(DataFrame.unionByName, leads), "licence-leads")
    line = LogisticRegression(maxIter=40, regParam=0.01, standardization=False).fit(VectorAssembler(inputCols=["lead"], outputCol="features").transform(held))
    model = Model(classes, fit(ready), float(line.coefficients[0]), float(line.intercept))
    return model


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, pos, text, family, probability, confirmed of the paragraphs that the classifier takes for a licence."""
    predicted = model.predict(paragraphs(df, keep, text_col)).where(F.col("probability") >= MIN_PROBABILITY)
    return _confirm(predicted).drop("words")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_predicted, n_confirmed, families (sorted, joined by commas; empty: none), probability (the
    highest of a confirmed paragraph, else null); one row per input row."""
    rows = with_row_id(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "rid")
    hits = found(rows, train(rows), ["rid"])
    per = hits.groupBy("rid").agg(
        F.count(F.lit(1)).alias("n_predicted"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.round(F.max(F.when(F.col("confirmed"), F.col("probability"))), 6).alias("probability"),
    )
    counted = rows.select("rid", "doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_paragraphs"))
    out = counted.join(materialise(per, "licences"), "rid", "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), "probability")
