"""Licences of files by sparse TF-IDF cosine to templates, and inheritance along directories; DataFrame operations only.

Terms are runs of ASCII letters and digits, also joined by single dots or hyphens, A-Z in lower case. A term weighs its
count times ln((N + 1) / (df + 1)) + 1 over all N files, df being the number of files with the term. Compared with the
templates are the windows of 1, 4 and 16 lines (headers; they start at every line, second line and eighth line) and the whole text. The best window of at
least `least` names a file's own licence; a file whose whole text reaches it, or whose name says LICENSE, LICENCE or
COPYING and which has a licence of its own, is a licence file. A file without a licence of its own has that of the licence
files in the nearest directory above it.

Only windows that can reach `least` are scored. By Cauchy and Schwarz the squared cosine to a template is at most the share of the
template's squared length that the window's terms hold, times the share of the window's squared length that terms of templates hold;
each further word adds 1 at least to the latter length. Both follow from the templates' own terms within the row.
Equal windows are scored once.

Defined results: a NULL text is the empty text and has no licence of its own; a NULL path is the empty path, in the top
directory; scores are rounded to 6 places and equal ones go to the smaller name; repeated rows get equal results; only the
named columns are read.
"""

import json

from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom.llm.common import stored

TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOWS = ((1, 1), (4, 2), (16, 8))     # lines, and lines from one start to the next
LEAST = 0.6
NAMES = "(?i)^(licen[cs]e|copying)([.-].*)?$"

# fixed values: notices in common use and whole licence texts
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
            "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
            "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
            "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
            "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
            "THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
                     "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                     "or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
                     "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
                     "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
                     "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
                     "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
                     "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def terms(text):
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), 0)


def once(x):
    """The value as a row of its own, so that filters on it are not pushed below it, where it would be worked out again."""
    return F.explode(F.array(x))


def template_terms(spark, templates) -> DataFrame:
    """(template, license, term, tf)."""
    t = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(templates)], "template int, license string, text string")
    return t.select("template", "license", F.explode(terms("text")).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def scan(files: DataFrame, templates=TEMPLATES, least=LEAST, id_col="doc_id", path_col="path", text_col="text") -> DataFrame:
    """doc_id, path, license, how (header, inherited or NULL), score (of the own licence), licence_file, from_dir."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    rows = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), text.alias("text")).withColumn("key", F.md5(F.col("text").cast("binary")))
    n = rows.count()
    df = stored(rows.select(F.explode(F.array_distinct(terms("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    idf = F.log((n + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1
    weights = template_terms(files.sparkSession, templates).join(df, "term", "left").withColumn("idf", idf).withColumn("w", F.col("tf") * F.col("idf"))
    weights = stored(weights.withColumn("length", F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("template")))).drop("tf", "df"))
    table, floor = {}, (least - 1e-6) ** 2  # scores are rounded
    for r in weights.collect():  # of the templates alone
        table.setdefault(r["term"], {"idf": r["idf"], "held": [0.0] * len(templates)})["held"][r["template"]] = (r["w"] / r["length"]) ** 2
    known = F.from_json(F.lit(json.dumps(table)), "map<string,struct<idf:double,held:array<double>>>")

    def hits(ts):
        return F.array_intersect(ts, F.lit(sorted(table)))

    def held(hit):
        """The largest share of a template's squared length."""
        return F.array_max(F.aggregate(hit, F.lit([0.0] * len(templates)), lambda a, t: F.zip_with(a, known[t]["held"], lambda x, y: x + y)))

    found = rows.where(held(hits(terms("text"))) >= floor).select("key", "text").dropDuplicates(["key"])
    lines = F.split("text", "\n", -1)
    starts = lambda w, step: F.transform(F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(step)), lambda i: F.struct(F.lit(w).alias("w"), i.alias("i")))
    cut = found.select("key", lines.alias("lines"), F.explode(F.concat(F.array(F.struct(F.lit(0).alias("w"), F.lit(0).alias("i"))), *(starts(*x) for x in WINDOWS))).alias("at"))
    piece = F.when(F.col("at.w") == 0, F.array_join("lines", " ")).otherwise(F.array_join(F.slice("lines", F.col("at.i") + 1, F.greatest("at.w", F.lit(1))), " "))
    cut = cut.select("key", (F.col("at.w") == 0).alias("is_whole"), once(terms(piece)).alias("terms"))
    cut = cut.select("*", once(hits("terms")).alias("hit")).select("*", once(held(F.col("hit"))).alias("held")).where(F.col("held") >= floor)
    cut = cut.withColumn("hit", F.transform("hit", lambda t: F.struct(F.size(F.filter("terms", lambda x: x == t)).alias("tf"), known[t]["idf"].alias("idf"))))
    square = F.aggregate("hit", F.lit(0.0), lambda a, h: a + F.pow(h["tf"] * h["idf"], F.lit(2.0)))
    others = F.size("terms") - F.aggregate("hit", F.lit(0), lambda a, h: a + h["tf"])
    cut = cut.withColumn("square", square).where(F.col("held") * F.col("square") >= floor * (F.col("square") + others))
    cut = stored(cut.select("key", "is_whole", F.md5(F.concat_ws(" ", "terms").cast("binary")).alias("unit"), "terms"))

    count = cut.dropDuplicates(["unit"]).select("unit", F.explode("terms").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    valued = stored(count.join(df, "term").select("unit", "term", (F.col("tf") * idf).alias("x")))
    norm = valued.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = valued.join(weights, "term").groupBy("unit", "template", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"), F.max("length").alias("length"))
    score = F.round(F.col("dot") / F.col("norm") / F.col("length"), 6)
    near = dot.join(norm, "unit").withColumn("score", score).where(F.col("score") >= least)
    near = near.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("best"))
    best = lambda c: F.min(F.when(c, F.col("best")))
    own = cut.select("key", "is_whole", "unit").join(near, "unit").groupBy("key").agg(best(~F.col("is_whole")).alias("header"), best(F.col("is_whole")).alias("whole"))

    name, above = F.regexp_extract("path", "[^/]*$", 0), F.regexp_replace("path", "/?[^/]*$", "")
    marked = stored(rows.select("doc_id", "path", "key", name.alias("name"), above.alias("dir")).join(own, "key", "left"))
    marked = marked.withColumn("own", F.coalesce("header", "whole"))
    is_file = F.col("whole").isNotNull() | (F.col("own").isNotNull() & F.col("name").rlike(NAMES))
    granted = marked.where(is_file).groupBy("dir").agg(F.min(F.coalesce("whole", "own")).alias("grant")).select(F.col("dir").alias("from_dir"), F.col("grant.l").alias("granted"))
    steps = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    up = marked.select("dir").distinct().select("dir", F.explode(ups).alias("from_dir")).distinct()
    nearest = up.join(granted, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "granted"), F.length("from_dir")).alias("g"))
    out = marked.join(nearest, "dir", "left")
    return out.select("doc_id", "path", F.coalesce("own.l", "g.granted").alias("license"),
                      F.when(F.col("own").isNotNull(), "header").when(F.col("g").isNotNull(), "inherited").alias("how"), (-F.col("own.s")).alias("score"),
                      is_file.alias("licence_file"), F.when(F.col("own").isNull(), F.col("g.from_dir")).alias("from_dir"))
