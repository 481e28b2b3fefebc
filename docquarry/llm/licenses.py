"""Operator 3, license scans: sparse TF-IDF cosine to templates, then inheritance by path.

1. Terms are the templates' words.  A pass counts, over all documents, how many have each; a term that occurs n times weighs
   (1 + ln n) (ln((1 + documents) / (1 + documents with it)) + 1).  Words that no template has weigh 1, each apart.
2. Headers: each sentence or line of a text, and each two neighbouring ones, is compared with the header
   templates (cosine HEADER_COSINE).  Licence files: a whole text is compared with the notices of TEXTS and the whole licence texts, which are
   kept as term counts (licence_terms; not for AGPL, EPL and CC BY) (cosine FILE_COSINE);
   one named LICENSE, COPYING, NOTICE or the like also counts as a licence file by its best header.
3. For each template a few heaviest terms are such that without any of them the cosine stays below the
   threshold (by Cauchy-Schwarz); a text without any such term leaves the scan early.  That drops nothing.
4. A file without a licence of its own inherits that of the nearest ancestor directory which has a licence
   file: the distinct directories' ancestors are joined to the directories of licence files.

The path is column path if there is one, else source/doc_id.

Defined results: null and empty texts have no licence of their own, but inherit; a null path is '' (a file in the root);
of equal cosines the licence first in order wins, also among a directory's licence files; repeated rows
stay; cosines are rounded to 4 digits before they are compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import blocks
from docquarry.llm.licence_terms import TERMS

HEADER_COSINE = 0.8
FILE_COSINE = 0.8
_NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0",), "MIT": ("MIT License",), "ISC": ("ISC License",), "Unlicense": ("Unlicense",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"), "GPL-2.0": ("GNU General Public License, version 2",), "GPL-3.0": ("GNU General Public License, version 3",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",), "LGPL-3.0": ("GNU Lesser General Public License, version 3",), "AGPL-3.0": ("GNU Affero General Public License, version 3",), "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "EPL-2.0": ("Eclipse Public License, version 2.0",), "CC0-1.0": ("CC0 1.0 Universal",), "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
_PHRASES = ("Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "Distributed under the terms of the {}")
HEADERS = [(k, p.format(n)) for k, names in _NAMES.items() for n in names for p in _PHRASES] + [(k, f"SPDX-License-Identifier: {k}") for k in _NAMES]
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. The software is provided as is, without warranty of any kind."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version. This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means."),
]
WORD = "[a-z]+|[0-9]+(?:\\.[0-9]+)*"
_WORD = re.compile(WORD)
_END = re.compile("([.!?;])[ \\t\\r\\n]+")
FILE_NAME = "(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


HEADER_COUNTS = [(k, dict(Counter(terms(text)))) for k, text in HEADERS]
FILE_COUNTS = [(k, dict(Counter(terms(text)))) for k, text in TEXTS] + list(TERMS.items())
VOCABULARY = sorted({t for _, counts in HEADER_COUNTS + FILE_COUNTS for t in counts})


def idf_of(documents: DataFrame) -> dict[str, float]:
    """Weights of the vocabulary's terms, counted over all documents."""
    present = F.array_intersect(_words(), F.lit(VOCABULARY))
    n = dict(documents.select(F.explode(F.concat(F.array(F.lit("")), present)).alias("term")).groupBy("term").count().toArrow().to_pandas().itertuples(index=False, name=None))
    return {t: math.log((1 + n.get("", 0)) / (1 + n.get(t, 0))) + 1 for t in VOCABULARY}


def _words():
    """ASCII words of the text; ASCII letters alone are folded, so that all readers agree."""
    folded = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(WORD), 0)


class Index:
    """Unit vectors of templates, an inverted index, and the terms without which no template is reached."""

    def __init__(self, templates: list[tuple[str, dict[str, int]]], idf: dict[str, float], least: float):
        self.idf, self.least, self.names = idf, least, [k for k, _ in templates]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.anchors: set[str] = set()
        for at, (_, counts) in enumerate(templates):
            v = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            rest = 1.0
            for t, x in sorted(v.items(), key=lambda y: (-y[1], y[0])):
                if rest >= (least - 1e-4) ** 2:
                    self.anchors.add(t)
                    rest -= (x / norm) ** 2
                self.postings.setdefault(t, []).append((at, x / norm))

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """Highest cosine and its licence, if the threshold is reached."""
        if self.anchors.isdisjoint(words):
            return None
        tf = Counter(w for w in words if w in self.idf)
        weight = {t: (1 + math.log(n)) * self.idf[t] for t, n in tf.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()) + len(words) - tf.total())
        dot: dict[int, float] = {}
        for t, w in weight.items():
            for at, x in self.postings.get(t, ()):
                dot[at] = dot.get(at, 0.0) + w * x
        found = [(-math.floor(d / norm * 1e4 + 0.5) / 1e4, self.names[at]) for at, d in dot.items()]
        score, name = min(found, default=(0.0, ""))
        return (-score, name) if -score >= self.least else None


def _own(text: str, named: bool, headers: Index, texts: Index) -> tuple[str, str, float] | None:
    """(how, licence, cosine) of one text."""
    words = terms(text)
    if whole := texts.best(words):
        return "file", whole[1], whole[0]
    if headers.anchors.isdisjoint(words):
        return None
    units = [terms(u) for u in _END.sub("\\1\n", text).split("\n")]
    found = [b for k, u in enumerate(units) for b in (headers.best(u), headers.best(u + units[k + 1]) if k + 1 < len(units) else None) if b]
    if not found:
        return None
    cosine, name = min(found, key=lambda b: (-b[0], b[1]))
    return "file" if named else "header", name, cosine


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, path, dir, how, licence, cosine): each document's own licence, how being file or header, or nulls."""
    given = F.col("path").cast("string") if "path" in documents.columns else F.concat(F.coalesce(F.col("source").cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    idf = idf_of(documents)
    headers, texts = Index(HEADER_COUNTS, idf, HEADER_COSINE), Index(FILE_COUNTS, idf, FILE_COSINE)
    shared = documents.sparkSession.sparkContext.broadcast((headers, texts))
    near = F.arrays_overlap(_words(), F.lit(sorted(headers.anchors | texts.anchors)))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(given, F.lit("")).alias("path"), F.when(near, F.col("text")).alias("text"))
    d = d.select("doc_id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.col("path").rlike(FILE_NAME).alias("named"), "text")

    def run(batches):
        headers, texts = shared.value
        for batch in batches:
            own = [_own(t, n, headers, texts) if t else None for t, n in zip(batch.column("text").to_pylist(), batch.column("named").to_pylist(), strict=True)]
            columns = [pa.array([o and o[k] for o in own], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), batch.column("dir"), *columns], names=["doc_id", "path", "dir", "how", "licence", "cosine"])

    return d.mapInArrow(run, "doc_id long, path string, dir string, how string, licence string, cosine double")


def resolve(found: DataFrame) -> DataFrame:
    """(doc_id, path, how, licence, cosine, from_dir): own licences, else the nearest ancestor directory's."""
    by_dir = found.where("how = 'file'").groupBy(F.col("dir").alias("ancestor")).agg(F.min(F.struct((-F.col("cosine")).alias("far"), "licence")).alias("x")).select("ancestor", F.col("x.licence").alias("inherited"), (-F.col("x.far")).alias("near"))
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    dirs = found.where("licence is null").select("dir").distinct().withColumn("parts", parts)
    up = dirs.select("dir", F.explode(F.expr("transform(sequence(0, size(parts)), i -> struct(i as depth, array_join(slice(parts, 1, i), '/') as ancestor))")).alias("a")).select("dir", "a.*")
    nearest = up.join(by_dir, "ancestor").groupBy("dir").agg(F.max_by(F.struct("inherited", "near", "ancestor"), "depth").alias("n")).select("dir", "n.*")
    j = found.join(nearest, "dir", "left")
    own = F.col("licence").isNotNull()
    heir = ~own & F.col("inherited").isNotNull()
    return j.select(
        "doc_id", "path", F.when(own, F.col("how")).when(heir, F.lit("inherited")).otherwise(F.lit("none")).alias("how"), F.coalesce("licence", "inherited").alias("licence"),
        F.when(own, F.col("cosine")).otherwise(F.col("near")).alias("cosine"), F.when(heir, F.col("ancestor")).alias("from_dir"),
    )


def detect(documents: DataFrame) -> DataFrame:
    return resolve(blocks.written(scan(documents), "licences"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _rows(templates: list[tuple[str, dict[str, int]]], kind: str) -> str:
    counted = [(k, f"{kind}{at}", t, n) for at, (k, counts) in enumerate(templates) for t, n in counts.items()]
    return ", ".join(f"('{kind}', '{k}', '{i}', '{t}', {n})" for k, i, t, n in counted)


# a path made of source and doc_id never names a licence file
SQL = f"""
WITH tpl(kind, licence, id, term, n) AS (VALUES {_rows(HEADER_COUNTS, "header")}, {_rows(FILE_COUNTS, "file")}),
docs AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, coalesce(source, '') AS dir, coalesce(text, '') AS text FROM documents),
low AS (SELECT r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM docs),
vocab AS (SELECT DISTINCT term FROM tpl),
df AS (SELECT term, count(DISTINCT r) AS df FROM (SELECT r, unnest(list_distinct(regexp_extract_all(text, '{WORD}'))) AS term FROM low) JOIN vocab USING (term) GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + coalesce(df, 0))) + 1 AS idf FROM vocab LEFT JOIN df USING (term)),
tw AS (SELECT kind, licence, id, term, (1 + ln(n)) * idf AS w FROM tpl JOIN idf USING (term)),
tn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS x FROM tw),
seg AS (SELECT r, string_split(regexp_replace(text, '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM low),
units AS (SELECT r, s, unnest(range(1, len(s) + 1)) AS i FROM seg),
u AS (SELECT 'header' AS kind, r, s[i] AS text FROM units UNION ALL SELECT 'header', r, s[i] || ' ' || s[i + 1] FROM units WHERE i < len(s) UNION ALL SELECT 'file', r, text FROM low),
un AS (SELECT row_number() OVER () AS k, kind, r, regexp_extract_all(text, '{WORD}') AS words FROM u),
ut AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(words) AS term FROM un) GROUP BY ALL),
uw AS (SELECT k, term, tf, (1 + ln(tf)) * idf AS w FROM ut JOIN idf USING (term)),
norm AS (SELECT k, sqrt(sum(w * w) + any_value(len(words)) - sum(tf)) AS norm FROM uw JOIN un USING (k) GROUP BY k),
cosine AS (SELECT un.kind, r, k, id, any_value(licence) AS licence, floor(sum(uw.w * tn.x) / any_value(norm) * 1e4 + 0.5) / 1e4 AS cosine
  FROM uw JOIN un USING (k) JOIN norm USING (k) JOIN tn ON tn.term = uw.term AND tn.kind = un.kind GROUP BY un.kind, r, k, id),
own AS (SELECT * FROM cosine WHERE cosine >= CASE kind WHEN 'file' THEN {FILE_COSINE} ELSE {HEADER_COSINE} END
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY kind, cosine DESC, licence) = 1),
by_dir AS (SELECT dir AS from_dir, licence AS inherited, cosine AS near FROM own JOIN docs USING (r) WHERE kind = 'file' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence) = 1),
j AS (SELECT docs.*, kind, licence, cosine, inherited, near, from_dir FROM docs LEFT JOIN own USING (r) LEFT JOIN by_dir ON from_dir = dir OR from_dir = ''
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(from_dir) DESC NULLS LAST) = 1)
SELECT doc_id, dir || '/' || coalesce(CAST(doc_id AS VARCHAR), '') AS path, CASE WHEN licence IS NOT NULL THEN kind WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       coalesce(licence, inherited) AS licence, CASE WHEN licence IS NOT NULL THEN cosine ELSE near END AS cosine, CASE WHEN licence IS NULL THEN from_dir END AS from_dir
FROM j
"""
