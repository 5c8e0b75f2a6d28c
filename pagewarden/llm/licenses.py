"""License scans: TF-IDF cosine of notices to templates, then directory inheritance.

Notices are the lines, paragraphs and comment blocks that hold a licence word,
and the whole of a licence file; copyright statements are taken out first.
Notices and templates, one-sentence and full texts, are sparse TF-IDF vectors
with document frequencies of all their terms counted over all files; the cosine
to the nearest template decides. An SPDX identifier counts as it is written. A
file without a notice of its own inherits from the nearest directory above it
that has a licence file, found by joins on directory paths. All of it is built-in
DataFrame functions.
"""

from __future__ import annotations

import math
import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import scratch, written

THRESHOLD = 0.6
# Notices as they are commonly written.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("Proprietary", "All rights reserved."),
    ("Apache-2.0 OR MIT", "Licensed under MIT or Apache-2.0."),
    ("Apache-2.0 OR MIT", "Licensed under either of the Apache License, Version 2.0 or the MIT license at your option."),
    ("GPL-2.0 OR MIT", "Dual licensed under the MIT or GPL Version 2 licenses."),
)
# Names as they stand in sentences like these.
NAMES = (
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("GPL", "GNU General Public License"),
    ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License"), ("BSD", "BSD License"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"),
)
SENTENCES = ("Licensed under the {}.", "This project uses the {}.")
ANCHORS = ("license", "licensed", "licence", "licenced", "copyright", "reserved", "redistribution", "permission", "spdx", "cc")
MIT_TEXT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
    "so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License."
)
GPL_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
    "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
)
GNU_FAMILIES = (("GPL", "GNU General"), ("LGPL", "GNU Lesser General"), ("AGPL", "GNU Affero General"))
MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
    "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
# Headers and full texts; the files stand in license_texts.
TEXTS = (
    ("MIT", MIT_TEXT[0]), ("MIT", " ".join(MIT_TEXT[:2])), ("MIT", "MIT License " + " ".join(MIT_TEXT)),
    ("Apache-2.0", APACHE_HEADER), ("MPL-2.0", MPL_HEADER),
)
FILES = (
    ("Apache-2.0", "Apache-2.0"), ("GPL", "GPL-2"), ("GPL", "GPL-3"), ("LGPL", "LGPL-2.1"), ("LGPL", "LGPL-3"), ("MPL-2.0", "MPL-2.0"),
    ("BSD", "BSD"), ("CC0-1.0", "CC0-1.0"),
)
# Families of SPDX identifiers; others count as they are written.
SPDX = (("AGPL-", "AGPL"), ("LGPL-", "LGPL"), ("GPL-", "GPL"), ("BSD-", "BSD"), ("CC-BY-NC-4", "CC-BY-NC"), ("CC-BY-SA-", "CC-BY-SA"), ("CC-BY-4", "CC-BY"))
SPDX_LINE = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]*[A-Za-z0-9.+)])"
# From "Copyright" and a year or sign to the end of the sentence or line, or to the licence it names.
COPYRIGHT = r"(?im)(?:copyright[ \t]*(?:\(c\)|©|:)?|©|\(c\))[ \t]*\d{4}.*?(?=all rights reserved|\b(?:dual[ -])?licen[sc]ed\b|\breleased under\b|\bunder the\b|[.;](?:\s|$)|$)"
_MARK = r"[ \t]*(?://|/\*|\*|#|--|;|%|<!--)"
_BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)++"  # a line without letters ends a paragraph, though not a comment
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"
_SPLIT = r"[^a-z0-9]+"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")


def _terms(text: str) -> list[str]:
    return [t for t in re.split(_SPLIT, text.lower()) if t]


_ANCHOR = rf"(?i)(?<![a-z0-9])(?:{'|'.join(ANCHORS)})(?![a-z0-9])"


def templates() -> list[tuple[str, str]]:
    files = [(name, pkgutil.get_data(__package__, f"license_texts/{file}.txt").decode()) for name, file in FILES]
    named = [(key, sentence.format(name)) for key, name in NAMES for sentence in SENTENCES]
    gnu = [(key, GPL_HEADER.replace("GNU General", family)) for key, family in GNU_FAMILIES]
    short = [(key, text.split(" This program is distributed")[0]) for key, text in gnu]
    first = [(key, text.split(" as published by")[0]) for key, text in gnu]
    return [*TEMPLATES, *named, *TEXTS, *gnu, *short, *first, *files]


def notices(text: Column, whole: Column) -> Column:
    """Terms, joined by blanks, of the parts of a text that hold a licence word."""
    plain = F.regexp_replace(text, COPYRIGHT, " ")
    cut = F.regexp_replace(plain, rf"(?m)^({_MARK}.*)\n(?!{_MARK})", "$1\n\x01")
    cut = F.regexp_replace(cut, rf"(?m)^(?!{_MARK})(.*)\n(?={_MARK})", "$1\n\x01")
    parts = F.concat(
        F.split(plain, "\n"), F.split(plain, _BLANK), F.split(cut, r"\x01|\n[ \t\r]*\n"),
        # A licence file may name its licence in a sentence among others.
        F.when(whole, F.concat(F.array(plain), F.split(plain, r"(?<=[.!?])\s+"))).otherwise(F.array().cast("array<string>")),
    )
    held = F.filter(F.array_distinct(parts), lambda p: p.rlike(_ANCHOR))
    return F.array_distinct(F.transform(held, lambda p: F.array_join(terms(p), " ")))


def identified(text: Column) -> Column:
    """(1.0, license) of the SPDX identifiers of a text, the last by name."""
    def family(x: Column) -> Column:
        name = F.trim(x)
        one = ~name.contains(" ")
        known = F.coalesce(*(F.when(one & F.lower(name).startswith(p.lower()), F.lit(n)) for p, n in SPDX), name)
        return F.struct(F.lit(1.0).alias("similarity"), known.alias("license"))

    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(SPDX_LINE), F.lit(1)), family))


def judged(files: DataFrame, folder: str, threshold: float) -> DataFrame:
    """(k, whole, best): best (similarity, license) over the notices of each text that has one.

    ``files`` has text, k, a key of the text, and whole, true for licence files.
    """
    spark = files.sparkSession
    part = F.explode(notices(F.col("text"), F.col("whole")))
    parts = files.filter(F.col("text").rlike(_ANCHOR)).select("k", "whole", part.alias("c"))
    parts = written(parts.withColumn("h", F.unhex(F.md5("c"))), folder, "parts")
    distinct = parts.groupBy("h").agg(F.first("c").alias("c"))
    counts = written(
        distinct.select("h", F.explode(F.split("c", " ")).alias("t")).groupBy("h", "t").agg(F.count(F.lit(1)).alias("f")),
        folder, "terms",
    )
    known = [(name, _terms(re.sub(COPYRIGHT, " ", text))) for name, text in templates()]
    vocabulary = sorted({t for _, words in known for t in words})
    asked = counts.select("t").union(spark.createDataFrame([(t,) for t in vocabulary], "t string")).distinct()
    # Document frequencies of all terms of notices and templates, over all files.
    held = files.select(F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("t"))
    df = written(held.groupBy("t").agg(F.count(F.lit(1)).alias("df")).join(asked, "t", "left_semi"), folder, "frequencies")
    n = files.count()
    of = {r["t"]: r["df"] for r in df.filter(F.col("t").isin(vocabulary)).collect()}
    vectors = []
    for _, words in known:
        vector = {t: words.count(t) * (math.log((1 + n) / (1 + of.get(t, 0))) + 1) for t in set(words)}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        vectors.append({t: v / norm for t, v in vector.items()})
    rows = [(t, [v.get(t, 0.0) for v in vectors]) for t in vocabulary]
    own = written(spark.createDataFrame(rows, "t string, ws array<double>"), folder, "templates")
    value = F.col("f") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    weighed = counts.join(df, "t").select("h", "t", value.alias("v")).join(own, "t", "left")
    dots = [F.sum(F.col("v") * F.get("ws", F.lit(j))).alias(f"d{j}") for j in range(len(known))]
    sums = weighed.groupBy("h").agg(F.sum(F.col("v") * F.col("v")).alias("square"), *dots)
    best = F.array_max(F.array(*(
        F.struct(F.round(F.coalesce(f"d{j}", F.lit(0.0)) / F.sqrt("square"), 9).alias("similarity"), F.lit(name).alias("license"))
        for j, (name, _) in enumerate(known)
    )))
    verdict = written(sums.select("h", best.alias("best")).filter(F.col("best.similarity") >= threshold), folder, "verdicts")
    return parts.select("k", "whole", "h").join(verdict, "h").groupBy("k", "whole").agg(F.max("best").alias("best"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: id, path, license, similarity, origin, from_dir.

    ``files`` has id, path and text. Origin is own, inherited or none. A licence
    file (LICENSE, COPYING, NOTICE with any ending) stands for its directory with
    the licence found in it; of several the most similar, then the last by name.
    A null path is a file in no directory and inherits nothing; null and empty
    texts have no notice; repeated rows are judged alike. A notice inside running
    text is found where it is a line or paragraph of its own. Ties between templates
    go to the last licence by name.
    """
    folder = scratch(files.sparkSession)
    rows = files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    slash = F.length("path") - F.length(F.substring_index("path", "/", -1))
    rows = rows.withColumn("file", F.substring_index("path", "/", -1)).withColumn("whole", F.coalesce(F.col("file").rlike(LICENSE_FILE), F.lit(False)))
    rows = rows.withColumn("k", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    near = judged(rows, folder, threshold)
    # Identifiers are read before the join: no text goes through an exchange.
    rows = rows.withColumn("spdx", identified(F.col("text"))).drop("text")
    found = written(
        rows.join(near, ["k", "whole"], "left").select(
            "id", "path", F.when(F.col("path").isNotNull(), F.substring("path", F.lit(1), F.greatest(slash - 1, F.lit(0)))).alias("dir"),
            "file", F.array_max(F.array("best", "spdx")).alias("own"),
        ),
        folder, "found",
    )
    declared = (
        found.filter(F.col("own").isNotNull() & F.col("file").rlike(LICENSE_FILE))
        .groupBy(F.col("dir").alias("from_dir")).agg(F.max("own").alias("given"))
    )
    dirs = found.select("dir").filter("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = F.array_distinct(F.concat(
        F.array(F.lit("")),
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
    ))
    nearest = written(
        dirs.select("dir", F.explode(above).alias("from_dir")).join(declared, "from_dir")
        .groupBy("dir").agg(F.max_by(F.struct("from_dir", "given"), F.length("from_dir")).alias("near")),
        folder, "nearest",
    )
    out = found.join(nearest, "dir", "left")
    own, near = F.col("own"), F.col("near")
    return out.select(
        "id", "path", F.coalesce(own["license"], near["given"]["license"]).alias("license"),
        F.coalesce(own["similarity"], near["given"]["similarity"]).alias("similarity"),
        F.when(own.isNotNull(), "own").when(near.isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own.isNull(), near["from_dir"]).alias("from_dir"),
    )
