"""Operator 6: license scans, with DataFrame functions only.

Lines that speak of licensing (headers, notices) are compared with the wordings of headers by the
cosine of sparse TF-IDF vectors, and so are blocks of commented lines that hold one; the whole texts of files that are
named LICENSE or COPYING, or that hold a phrase which a full license text has, are compared with full license texts. The frequencies are those of all of them. A file's license is that of its best line or
block at THRESHOLD or more, or of its whole text at WHOLE or more. A file that is a license text as a whole, most of
whose words are such lines or blocks, or which is named LICENSE or COPYING, is a license file, and
lends its license to its directory. A file without one of its own takes that
of its nearest ancestor directory, found by joins on paths.

Defined results: a null text counts as empty; a file without path has no directory; of several
license files in a directory the one with the smallest path counts, then the best cosine; a header's SPDX tag of a known name
counts as it stands, and where a line has a version, licenses of another one do not match it; equal
cosines go to the template with the smaller name; repeated rows agree; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from viewframe.llm.common import attach, table, text_of, written

THRESHOLD, WHOLE = 0.5, 0.75
LINE, BLOCK, FILE, TITLE = 0, 1, 2, 3  # what is compared
HEADERS, WHOLES, NAMES = 0, 1, 2  # what it is compared with
#: The first lines of a text, where a license names itself; and a header's tag, whose name is taken as it stands.
TITLE_LINES = 6
TAG = r"(?i)spdx-license-identifier:[\x20\t]*\(?([a-z0-9][a-z0-9.+-]*)"
TITLE_WORDS = r"(?i)(?:general|mozilla|eclipse)\x20+public|apache|creative\x20+commons|cc0"
#: A number that may be a license's version.
VERSION = r"^v?[0-9]{1,2}(?:\.[0-9]{1,2})*$"
LICENSE_LINE = r"(?i)\b(?:licen[sc]e[ds]?|licensing|copyright|permission\x20is\x20hereby|redistribution\x20and\x20use|public\x20domain|all\x20rights\x20reserved|spdx)\b"
TERM = "[^a-z0-9.+]+"
#: What a line of a comment begins with; a block is made of the lines between two empty ones.
MARK = r"(?m)^[\x20\t\r]*(?:#+|//+|/?\*+/?|--+|;+|%+|<!--)?[\x20\t\r]*"
COMMENTED = r"(?m)^(?![\x20\t]*(?:#|//|/?\*|--|;|%|<!--))[^\n]*$"  # lines that are no comments
#: A phrase of each full license text, which may be wrapped.
PHRASES = (
    "permission is hereby granted, free of charge", "redistributions of source code must retain", "permission to use, copy, modify", "free and unencumbered software",
    "altered source versions must be plainly marked", "you may not use this file except in compliance", "redistribute it and/or modify it under the terms",
)
PHRASE = "(?i)" + "|".join(r"[\s#*/;%-]+".join(p.split()) for p in PHRASES)
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[sc]es?|copying|unlicense)(?:[._-][^/]*)?$"

# Wordings by which the usual licenses are told.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "This work is in the public domain."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU General Public License version 3."),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License version 2.1."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "EPL-2.0": ("This program is made available under the terms of the Eclipse Public License 2.0.",),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorized copying is prohibited."),
}


# How the long licenses begin.
TITLES = {
    "AGPL-3.0": ("GNU Affero General Public License Version 3, 19 November 2007",),
    "Apache-2.0": ("Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License", "Attribution 4.0 International Creative Commons Public License"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License", "Attribution-NonCommercial 4.0 International Creative Commons Public License"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public License", "Attribution-ShareAlike 4.0 International Creative Commons Public License"),
    "CC0-1.0": ("Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal Creative Commons Public Domain License"),
    "EPL-2.0": ("Eclipse Public License - v 2.0",),
    "GPL-2.0": ("GNU General Public License Version 2, June 1991",),
    "GPL-3.0": ("GNU General Public License Version 3, 29 June 2007",),
    "LGPL-2.1": ("GNU Lesser General Public License Version 2.1, February 1999",),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3, 29 June 2007",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
}


# Full texts of licenses and of the notices that stand for them.
FULL = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.',
}


def terms(line: Column) -> Column:
    """Words in lower case, without full stops at their ends."""
    words = F.transform(F.split(F.lower(line), TERM), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.filter(words, lambda w: w != "")


def counted(lines: DataFrame) -> DataFrame:
    """(row, line, name, ...) with words -> one row per word with tf."""
    keys = [c for c in lines.columns if c != "words"]
    return lines.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("tf"))


def best_templates(files: DataFrame) -> DataFrame:
    """files: row, text, named (whether the file's name is that of a license). Per row with a line at THRESHOLD or more: row, license, cosine; whole: whether most of its words are such lines."""
    spark = files.sparkSession
    named = [(n, k, HEADERS, t) for n, wordings in TEMPLATES.items() for k, t in enumerate(wordings)] + [(n, 0, WHOLES, t) for n, t in FULL.items()]
    named += [(n, k, NAMES, t) for n, titles in TITLES.items() for k, t in enumerate(titles)]
    templates = counted(spark.createDataFrame(named, "name string, wording int, full int, t string").select("name", "wording", "full", terms(F.col("t")).alias("words")))
    split = F.split("text", "\n")
    blocks = F.filter(F.split(F.regexp_replace(F.regexp_replace("text", COMMENTED, ""), MARK, ""), "\n{2,}"), lambda x: F.trim(x).contains("\n"))
    candidate = F.coalesce("named", F.lit(False)) | F.col("text").rlike(PHRASE)
    unit = lambda what: lambda x: F.struct(F.lit(what).alias("what"), x.alias("content"))
    whole_blocks = F.transform(F.transform(blocks, lambda x: F.regexp_replace(x, "\n", " ")), unit(BLOCK))
    # a title takes one line or two; below the first lines there is none
    head = F.slice(F.filter(F.transform(split, lambda x: F.trim(F.regexp_replace(x, MARK, ""))), lambda x: x != ""), 1, TITLE_LINES)
    pairs = F.zip_with(F.slice(head, 1, F.greatest(F.size(head) - 1, F.lit(0))), F.slice(head, 2, TITLE_LINES), lambda a, b: F.concat_ws(" ", a, b))
    titles = F.transform(F.concat(head, pairs), unit(TITLE))
    titles = F.filter(titles, lambda x: x.content.rlike(TITLE_WORDS))
    # a sentence may be wrapped, so blocks of lines are compared as well as lines
    speaking = F.filter(F.concat(F.transform(split, unit(LINE)), titles, whole_blocks, F.transform(F.filter(F.array("text"), lambda _: candidate), unit(FILE))), lambda x: x.content.rlike(LICENSE_LINE))
    found = files.where(F.col("text").rlike(LICENSE_LINE)).select(
        "row", speaking.alias("units"), F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("n_words")
    )
    found = found.select("row", "n_words", F.explode("units").alias("unit"))
    # a digest stands for the content, which may be long and is repeated per word; equal lines are one vector: a notice that a third of all files carry is compared once
    found = found.select("row", "n_words", "unit.what", "unit.content")
    lines = written(found.select("row", "n_words", "what", F.when(F.col("what") == FILE, WHOLES).when(F.col("what") == TITLE, NAMES).otherwise(HEADERS).alias("full"), F.size(F.filter(F.split("content", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("own"), F.lower(F.trim("content")).alias("words")).withColumn("content", F.concat(F.sha2("words", 256), F.concat(F.lit(":"), F.col("full").cast("string")))), "lines")
    distinct = lines.groupBy("content", "full").agg(F.count("*").alias("often"), F.min("words").alias("words"))
    vectors = written(counted(distinct.select("content", "full", "often", terms(F.col("words")).alias("words"))), "vectors")
    total = lines.count()
    df = vectors.groupBy("word").agg(F.sum("often").alias("df"))
    idf = F.log((1.0 + total) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    of_templates = templates.join(df.join(F.broadcast(templates.select("word").distinct()), "word", "left_semi"), "word", "left")  # the templates' words only
    of_templates = of_templates.withColumn("weight", F.col("tf") * idf)
    of_templates = of_templates.withColumn("unit", F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("name", "wording", "full"))))
    of_lines = attach(vectors, df, "word").withColumn("weight", F.col("tf") * idf)
    number = F.when(F.col("word").rlike(VERSION), F.regexp_replace("word", r"^v|(?:\.0)+$", ""))
    norms = of_lines.groupBy("content").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.collect_set(number).alias("versions"))
    dots = of_lines.select("content", "full", "word", "weight").join(F.broadcast(of_templates.select("word", "full", "name", "wording", "unit")), ["word", "full"]).groupBy("content", "full", "name", "wording").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    scored = dots.join(norms, "content").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= F.when(F.col("full") == HEADERS, THRESHOLD).otherwise(WHOLE))
    # where the content has a version, a license of another one is no match however close its wording is
    own_version = F.regexp_replace(F.regexp_extract("name", r"-([0-9]+(?:\.[0-9]+)?)$", 1), r"(?:\.0)+$", "")
    scored = scored.where((own_version == "") | (F.size("versions") == 0) | F.array_contains("versions", own_version) | (F.col("full") == WHOLES))
    best = scored.groupBy("content").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("name").alias("name"))).alias("best"))
    told = attach(lines.drop("words"), best.select("content", F.col("best.name").alias("license"), (-F.col("best.c")).alias("cosine")), "content")
    # a tag names its license itself
    tags = lines.where(F.col("what") == LINE).select("content", "row", "n_words", "what", "full", "own", F.regexp_extract("words", TAG, 1).alias("tag")).where("tag <> ''")
    known = spark.createDataFrame([(n.lower(), n) for n in sorted({*TEMPLATES, *FULL, *TITLES})], "tag string, license string")
    tags = tags.withColumn("tag", F.regexp_replace("tag", r"-(?:only|or-later)$|\+$", "")).join(F.broadcast(known), "tag")
    told = told.unionByName(tags.select("content", "row", "n_words", "what", "full", "own", "license", F.lit(1.0).alias("cosine")).select(*told.columns))
    words_of = lambda what: F.sum(F.when(F.col("what") == what, F.col("own")).otherwise(0))
    whole = F.bool_or(F.col("full") != HEADERS) | (2 * F.greatest(words_of(LINE), words_of(BLOCK)) > F.max("n_words"))
    return told.groupBy("row").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("license"))).alias("best"), whole.alias("whole")
    ).select("row", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"), "whole")


def ancestors(path: Column) -> Column:
    """Array of (directory, depth) above a path."""
    steps = F.split(path, "/")
    many = F.size(steps) - 1
    return F.transform(F.sequence(F.lit(0), F.greatest(many, F.lit(0))), lambda k: F.struct(F.array_join(F.slice(steps, F.lit(1), k), "/").alias("directory"), k.alias("depth")))


def scanned(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the kept columns, path, license, cosine, inherited_from (a directory, null if the license is the file's own)."""
    # numbers are read from one table: a second scan might be split, and so numbered, otherwise
    said = F.when(text_of(text).rlike(LICENSE_LINE), text_of(text)).alias("text")
    numbered = written(files.select(F.monotonically_increasing_id().alias("row"), *keep, F.col(path).alias("path"), said), "numbered")
    own = written(best_templates(numbered.where("text is not null").select("row", "text", F.col("path").rlike(LICENSE_FILE).alias("named"))), "licenses")
    rows = numbered.drop("text").join(own, "row", "left")
    rows = written(rows, "scanned")
    lending = rows.where(F.col("license").isNotNull() & (F.col("whole") | F.col("path").rlike(LICENSE_FILE))).withColumn("directory", F.regexp_replace("path", "/?[^/]*$", "")).where("directory is not null")
    lent = lending.groupBy("directory").agg(F.min(F.struct("path", (-F.col("cosine")).alias("c"), F.col("license").alias("license"))).alias("one")).select("directory", F.col("one.license").alias("lent"))
    # every directory that holds files, once: its nearest ancestor with a license
    directories = rows.select(F.regexp_replace("path", "/?[^/]*$", "").alias("below")).where("below is not null").distinct()
    above = directories.select("below", F.explode(ancestors(F.concat("below", F.lit("/")))).alias("x")).select("below", "x.directory", "x.depth")
    nearest = attach(above, lent, "directory").groupBy("below").agg(F.max(F.struct("depth", "directory", "lent")).alias("x")).select("below", F.col("x.directory").alias("from"), F.col("x.lent").alias("lent"))
    out = attach(rows.withColumn("below", F.regexp_replace("path", "/?[^/]*$", "")), nearest, "below", "left")
    return out.select(
        *keep, "path", F.coalesce("license", "lent").alias("license"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"),
        F.when(F.col("license").isNull() & F.col("lent").isNotNull(), F.col("from")).alias("inherited_from"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents stand for files: a directory per source, in it one per language."""
    docs = table(spark, sf_dir, "documents")
    return scanned(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))), keep=("doc_id",))
