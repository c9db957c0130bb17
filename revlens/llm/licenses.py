"""License scans by canonical digest look-up (operator 9): DataFrame functions only.

A text is brought to a canonical form (case, copyright lines, punctuation and white space, equivalent spellings) and
its SHA-256 digest is hash-joined to the digests of known license texts and notices: entire texts, and each line.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key

# A line that only states a copyright: after lower-casing, "copyright", "(c)" or the sign at its beginning, then a
# year, a mark or "by".
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©)?|\(c\)|©)[ \t,]*(?:[0-9]{4}|\(c\)|©|by )[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"

# Equivalent spellings, applied in order to the canonical text. Fixed values.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non infring", "noninfring"), ("non commercial", "noncommercial"),
    ("organis", "organiz"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("favour", "favor"),
    ("behaviour", "behavior"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("whilst", "while"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http"),
]

# Short license texts, without their copyright lines. Fixed values.
TEXTS = {
    "MIT": """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

# Notices of one line are every opening followed by every name of a license. Fixed values.
OPENINGS = ["released under", "licensed under", "this work is licensed under", "distributed under", "available under"]
NAMES = {
    "MIT": ["the MIT License", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL, version 3", "GPL-3.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL, version 2", "GPL-2.0"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "MPL-2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
}
# Whole licenses whose texts come with variants: see ``known_texts``. Fixed values.
_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
{1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """{2} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {h} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TITLES = {
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["", "ISC License", "The ISC License", "ISC License (ISC)"],
    "Zlib": ["", "zlib License", "The zlib License", "zlib/libpng License"],
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The 2-Clause BSD License", "BSD License", "Simplified BSD License",
                     'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["", "BSD 3-Clause License", "The 3-Clause BSD License", "BSD License", "New BSD License",
                     "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License'],
    "Unlicense": ["", "The Unlicense", "Unlicense"],
}
LONG_TEXTS = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0")     # a file each in license_texts


def _bodies() -> list[tuple[str, str]]:
    """(license, text without a title) of the short licenses, in the forms they are met in."""
    out = [(lic, TEXTS[lic].split("\n", 1)[1]) for lic in ("MIT", "ISC", "Zlib")]
    for marks in (("*", "*", "*"), ("1.", "2.", "3.")):
        for h in ("HOLDER", "HOLDERS"):
            out += [("BSD-2-Clause", (_BSD_1 + _BSD_END).format(*marks, h=h)),
                    ("BSD-3-Clause", (_BSD_1 + _BSD_3 + _BSD_END).format(*marks, h=h))]
    link = "\nFor more information, please refer to <https://unlicense.org>"
    return [*out, ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + link)]


def _long_texts() -> list[tuple[str, str]]:
    """(license, text) of the long licenses, with and without what follows the end of their terms."""
    out = []
    for lic in LONG_TEXTS:                  # read as the package is shipped, as a folder or a zip; none may be missing
        text = files(__package__).joinpath("license_texts", f"{lic}.txt").read_text(encoding="utf-8")
        end = re.search("END OF TERMS AND CONDITIONS", text)
        out += [(lic, text), *([(lic, text[:end.start()]), (lic, text[:end.end()])] if end else [])]
    return out


MAX_BROADCAST_LICENSES = 100_000     # a row of the look-up is under 200 bytes


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of every built-in text and notice; the short licenses under each of their titles or none, with
    and without a line that all rights are reserved."""
    short = [(lic, f"{title}\n{rights}\n{body}") for lic, body in _bodies() for title in TITLES[lic]
             for rights in ("", "All rights reserved.")]
    return [*TEXTS.items(), *short, *_long_texts(), *((lic, f"{o} {n}.") for lic, names in NAMES.items() for n in names for o in OPENINGS)]


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, words joined by single spaces, equivalent spellings made one."""
    t = F.lower(text)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    t = F.trim(F.regexp_replace(t, NOT_WORD, " "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license, digest; a digest that several licenses share goes to the first in order of name."""
    rows = known_texts() if texts is None else texts
    return (spark.createDataFrame(rows, "license string, text string")
            .select("license", digest(F.col("text")).alias("digest"))
            .groupBy("digest").agg(F.min("license").alias("license")))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``text_digest``, ``text_license`` (the license that the entire text is, or
    null), ``n_license_lines`` and ``line_licenses`` (distinct, sorted, joined by commas; '' if none).

    A null text is the empty text; a text without words matches nothing. Rows that share an id are scanned each by
    their own text. The look-up is broadcast only when a count shows that it is small; lines that match are counted
    per text and license before any exchange, so a notice that a third of all rows carry is no hot key.
    """
    spark = docs.sparkSession
    known = known if known is not None else known_digests(spark)
    known = known.select(F.col("digest").alias("k_digest"), F.col("license").alias("k_license"))
    if known.count() <= MAX_BROADCAST_LICENSES:
        known = F.broadcast(known)
    t = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("d_id"), t.alias("t"), *row_key(id_col, text_col))
    lines = src.select("k1", "k2", F.explode(F.split("t", "\n", -1)).alias("line"))
    lines = lines.withColumn("canon", canonical(F.col("line"))).where("canon != ''")
    hits = (lines.join(known, F.sha2(F.col("canon"), 256) == F.col("k_digest"))
            .groupBy("k1", "k2", "k_license").agg(F.count("*").alias("n"))
            .groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("k_license")).alias("ls")))
    # rows that are alike in id and text count the lines of one of them
    copies = src.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    hits = hits.join(copies, ["k1", "k2"]).select(
        F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.expr("n div copies").alias("n_license_lines"),
        F.array_join("ls", ",").alias("line_licenses"))
    whole = src.select("d_id", "k1", "k2", digest(F.col("t")).alias("text_digest"))
    whole = whole.join(known, F.col("text_digest") == F.col("k_digest"), "left")
    return (whole.join(hits, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
            .select(F.col("d_id").alias(id_col), "text_digest", F.col("k_license").alias("text_license"),
                    F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
                    F.coalesce("line_licenses", F.lit("")).alias("line_licenses")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entire texts and lines of all of ``documents`` against the built-in licenses."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(expr: str) -> str:
    x = f"regexp_replace(lower({expr}), {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    x = f"trim(regexp_replace({x}, {_sql_text(NOT_WORD)}, ' ', 'g'))"
    for a, b in SPELLINGS:
        x = f"replace({x}, {_sql_text(a)}, {_sql_text(b)})"
    return x


def oracle_sql() -> str:
    values = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in known_texts())
    return f"""WITH known AS (
  SELECT sha256({_sql_canonical("text")}) AS digest, min(license) AS license
  FROM (VALUES {values}) v(license, text) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hits AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ls
  FROM (SELECT doc_id, {_sql_canonical("line")} AS canon FROM lines) JOIN known ON sha256(canon) = digest
  WHERE canon <> '' GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_sql_canonical("coalesce(text, '')")}) AS text_digest FROM documents)
SELECT doc_id, text_digest, license AS text_license, coalesce(n, 0) AS n_license_lines,
  coalesce(ls, '') AS line_licenses
FROM whole LEFT JOIN known ON text_digest = digest LEFT JOIN hits USING (doc_id)"""
