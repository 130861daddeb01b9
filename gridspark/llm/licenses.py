"""Licences found by sparse TF-IDF cosine to templates, inherited from the nearest directory with a licence file."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import ascii_lower, attach_group, scratch, staged

# Short notices, licence texts and headers by which licences are named.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "Licensed under the GNU General Public License version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
]
#: Terms are runs of these after A-Z are lowered, in every step and in both languages.
TERM = "[a-z0-9]+"
_TERM, _LOWER = re.compile(TERM), {c: c + 32 for c in range(65, 91)}
#: Ends a sentence within a line.
STOP = re.compile(r"[.!?](?=[\x20\t])")


@dataclass(frozen=True)
class LicenseConfig:
    cosine: float = 0.6
    #: A text is a licence file if its licence passages hold at least this share of its terms.
    file_share: float = 0.5


def terms(text: str) -> list[str]:
    return _TERM.findall(text.translate(_LOWER))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all documents."""
    return docs.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n_docs: int) -> Column:
    return F.ln((1.0 + n_docs) / (1.0 + df)) + 1.0


def template_vectors(templates: list[tuple[str, str]], weight: dict[str, float]) -> list[dict[str, float]]:
    """Each template's unit vector of term weights."""
    out = []
    for _, text in templates:
        v = {t: n * weight[t] for t, n in Counter(terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()} if norm else {})
    return out


def anchors(vectors: list[dict[str, float]], weight: dict[str, float], cosine: float) -> list[str]:
    """Terms of which every passage with this cosine to a template holds one: of each template its rarest terms, until
    what is left is too short to reach the cosine on its own."""
    out: set[str] = set()
    for v in vectors:
        rest = sum(x * x for x in v.values())
        for t in sorted(v, key=lambda t: (-weight[t], t)):
            if rest < (cosine - 1e-9) ** 2:
                break
            out.add(t)
            rest -= v[t] * v[t]
    return sorted(out)


def passages(text: str) -> list[tuple[int, int]]:
    """(start, end) of every line, of the sentences of a line that has several, and of paragraphs of several lines."""
    out, start, lines = [], 0, []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            lines.append((start, start + len(line)))
            cuts = [start, *(m.end() for m in STOP.finditer(text, start, start + len(line))), start + len(line)]
            out += [(a, b) for a, b in zip(cuts, cuts[1:]) if text[a:b].strip()] if len(cuts) > 2 else []
        else:
            out += lines + ([(lines[0][0], lines[-1][1])] if len(lines) > 1 else [])
            lines = []
        start += len(line) + 1
    return out


def match_passages(found: DataFrame, df: DataFrame, vectors: list[dict[str, float]], names: list[str], n_docs: int, config: LicenseConfig) -> DataFrame:
    """row, license, score, start, end, covered (terms in licence passages) of rows (row, passages) that have any.

    Passages become rows of term counts, which take document frequencies by a join; one aggregate then gives a
    passage's norm and its dot products with all templates.
    """
    spark = found.sparkSession
    each = found.select("row", F.explode("passages").alias("p")).select("row", "p.start", "p.end", "p.text")
    counted = each.select("row", "start", "end", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("row", "start", "end", "term").agg(F.count("*").alias("tf"))
    counted = staged(counted, "license-terms")
    groups = counted.groupBy("term").agg(F.count("*").alias("uses")).join(df, "term")
    weighted = attach_group(counted, groups, "term", "uses", counted.count()).withColumn("w", F.col("tf") * idf(F.col("df"), n_docs))
    by_term = sorted({t for v in vectors for t in v})
    table = spark.createDataFrame([(t, [v.get(t, 0.0) for v in vectors]) for t in by_term], "term string, v array<double>")
    weighted = weighted.join(F.broadcast(table), "term", "left")
    dots = [F.sum(F.col("w") * F.coalesce(F.get("v", F.lit(k)), F.lit(0.0))) for k in range(len(vectors))]
    square = F.sqrt(F.sum(F.col("w") * F.col("w")))
    scored = weighted.groupBy("row", "start", "end").agg(F.sum("tf").alias("n"), F.array(*[F.round(d / square, 9) for d in dots]).alias("s"))
    top = F.array_max("s")
    scored = scored.select("row", "start", "end", "n", top.alias("score"), F.array_position("s", top).alias("k")).where(F.col("score") >= config.cosine)
    # Passages of a text are nested or apart, so those that no other one holds cover all of them, each term once.
    spans = F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "n")))
    outer = F.aggregate(
        spans, F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], -x["back"]).alias("end"), (s["n"] + F.when(-x["back"] > s["end"], x["n"]).otherwise(0)).alias("n")), lambda s: s["n"])
    first = F.min(F.struct((-F.col("score")).alias("score"), "k", "start", "end"))
    per = scored.groupBy("row").agg(first.alias("x"), outer.alias("covered"))
    licence = F.element_at(F.array(*map(F.lit, names)), F.col("x.k").cast("int"))
    return per.select("row", licence.alias("license"), (-F.col("x.score")).alias("score"), F.col("x.start").alias("start"), F.col("x.end").alias("end"), "covered")


def directory(path: Column) -> Column:
    """Path without its last part; the root is the empty string."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, down to the root."""
    parts = F.split(folder, "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.concat(up, F.array(F.lit(""))))


def inherit(found: DataFrame) -> DataFrame:
    """found (dir, license, score, is_file, doc_id, ...) with inherited_license and inherited_dir.

    The nearest directory at or above a document's own that holds a licence file gives its licence; of several
    files there the highest cosine counts, then the smallest id.  Directories are resolved once each, and
    documents then take their directory's result.
    """
    first = F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), "license")
    held = found.where("is_file").groupBy("dir").agg(F.min(first).getField("license").alias("dir_license"))
    held = held.select(F.col("dir").alias("above"), "dir_license")
    folders = staged(found.groupBy("dir").agg(F.count("*").alias("n_files")), "directories")
    each = folders.select("dir", "n_files", F.explode(ancestors(F.col("dir"))).alias("above"))
    near = each.join(held, "above").groupBy("dir", "n_files").agg(F.max_by(F.struct("above", "dir_license"), F.length("above")).alias("x"))
    near = staged(near.select("dir", "n_files", F.col("x.dir_license").alias("inherited_license"), F.col("x.above").alias("inherited_dir")), "inherited", keep=True)
    return attach_group(found, near, "dir", "n_files", found.count())


def scan_licenses(docs: DataFrame, config: LicenseConfig = LicenseConfig(), templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """One row per input row: doc_id, path, dir, license, score, start, end, is_file, inherited_license,
    inherited_dir, final_license (its own, else the inherited one).

    A passage (a sentence, a line or a paragraph) is compared with the templates by the cosine of their term counts
    weighted by inverse document frequency, which is counted over all documents for every term.  NULL text has no
    licence; a NULL path is at the root; NULL ids and repeated rows are kept; of equal cosines (to nine places) the
    first template, then the earliest and shortest passage counts; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = F.coalesce(F.col(path_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))
    with scratch(spark):
        df = staged(document_frequencies(slim), "document-frequencies")
        n_docs = slim.count()
        vocabulary = sorted({t for _, text in templates for t in terms(text)})
        seen = {r["term"]: r["df"] for r in df.where(F.col("term").isin(vocabulary)).collect()}  # at most the templates' terms
        weight = {t: math.log((1.0 + n_docs) / (1.0 + seen.get(t, 0))) + 1.0 for t in vocabulary}
        vectors = template_vectors(templates, weight)
        found = staged(_anchored(slim, anchors(vectors, weight, config.cosine)), "license-passages", keep=True)
        best = match_passages(found.where(F.size("passages") > 0), df, vectors, [name for name, _ in templates], n_docs, config)
        best = staged(best, "license-matches")
        held = found.select("row", "doc_id", "path", "n_terms")
        matched = held.join(best, "row")
        unmatched = held.join(best.select("row"), "row", "left_anti")
        is_file = F.col("covered") >= config.file_share * F.col("n_terms")
        shown = [F.col("score"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), is_file.alias("is_file")]
        matched = matched.select("doc_id", "path", "license", *shown)
        zero = F.lit(0).cast("long")
        unmatched = unmatched.select("doc_id", "path", F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("score"), zero.alias("start"), zero.alias("end"), F.lit(False).alias("is_file"))
        out = staged(matched.unionByName(unmatched).withColumn("dir", directory(F.col("path"))), "licenses", keep=True)
        out = inherit(out)
    return out.select(
        "doc_id", "path", "dir", "license", "score", "start", "end", "is_file", "inherited_license", "inherited_dir", F.coalesce("license", "inherited_license").alias("final_license")
    )


def _anchored(slim: DataFrame, wanted: list[str]) -> DataFrame:
    """row, doc_id, path, n_terms and passages (start, end, text) with an anchor; only texts with one reach Python."""
    words = "|".join(sorted(wanted, key=lambda t: (-len(t), t)))
    anchored = F.col("text").rlike(f"(?<![A-Za-z0-9])(?i:{words})(?![A-Za-z0-9])") if wanted else F.lit(False)
    rows = slim.select("doc_id", "path", F.when(anchored, F.col("text")).alias("text"))

    def run(batches):
        row, known = TaskContext.get().partitionId() << 40, set(wanted)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            spans = [[{"start": a, "end": b, "text": t[a:b]} for a, b in passages(t) if not known.isdisjoint(terms(t[a:b]))] if t else [] for t in texts]
            yield pd.DataFrame({"row": range(row, row + len(pdf)), "doc_id": pdf["doc_id"].astype("Int64"), "path": pdf["path"], "n_terms": [len(terms(t)) if p else 0 for t, p in zip(texts, spans)], "passages": spans})
            row += len(pdf)

    return rows.mapInPandas(run, "row long, doc_id long, path string, n_terms long, passages array<struct<start:long,end:long,text:string>>")
