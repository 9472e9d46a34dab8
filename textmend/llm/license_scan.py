r"""License scans by canonical digest lookup.

A text's canonical form: copyright lines removed, case folded, equivalent spellings
unified, punctuation and white space reduced to single blanks.  The sha-256 of an
entire canonical text is hash-joined to the digests of known licences.  Beside that,
every entire line and paragraph is hashed and looked up in the same digests, within
its row and so without a shuffle, which finds notices and file headers inside other
texts.  No Python runs: both sides go through the same Column expression.

The known licences are texts (``KNOWN``, short ones) and digests of canonical forms
(``DIGESTS``, long ones); both are parameters, and ``read_known`` reads more texts from a folder.

Edge cases: null and empty texts have an empty canonical form, which matches nothing;
repeated rows give repeated results; a known form listed under two names matches the
smaller name; extra columns are kept, whatever their names, except those named as the
new ones.  The known lists have a bounded size (``MAX_KNOWN``, checked), so that they may
be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, without
from .licenses import DIGESTS

MAX_KNOWN = 20_000

# Spellings that count as equal when licences are matched (word or words, their common form).
SPELLINGS = [
    ("https", "http"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("maximise", "maximize"), ("merchantibility", "merchantability"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"),
    ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
]

# One-line notices and short licence texts, published by their stewards.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
]
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_COND = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MIT = f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"
TEXTS = [
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("MIT-0", f"{_MIT_GRANT}.\n\n{_AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_AS_IS}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC}"),
    ("ISC", f"ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC}"),
    ("BSD-2-Clause", f"{_COND}\n\n1. {_SOURCE}\n2. {_BINARY}\n\n{_BSD}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_COND}\n\n1. {_SOURCE}\n2. {_BINARY}\n\n{_BSD}"),
    ("BSD-3-Clause", f"{_COND}\n\n1. {_SOURCE}\n2. {_BINARY}\n3. {_NAME}\n\n{_BSD}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_COND}\n\n1. {_SOURCE}\n2. {_BINARY}\n3. {_NAME}\n\n{_BSD}"),
    ("Apache-2.0", _APACHE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <http://unlicense.org/>'),
]
KNOWN = NOTICES + TEXTS

COPYRIGHT = r"(?im)^[ \t]*(?:(?:copyright|©|\(c\))[^\n]*(?:\d{4}|all rights reserved|©|\(c\))[^\n]*|all rights reserved[. \t]*)$"
#: Everything but letters, digits and line ends parts words.
OTHER = r"[^\p{L}\p{N}\n]+"
#: A blank line ends a paragraph.
PARAGRAPH = r" *\n *\n[ \n]*"


def canonical(text: Column) -> Column:
    """Canonical form with lines kept: a blank before and after every word and line end.

    While spellings are unified, words are parted by two blanks, so that neighbours
    never share one and repeated words are all seen.
    """
    x = F.lower(F.regexp_replace(text, COPYRIGHT, ""))
    x = F.regexp_replace(F.regexp_replace(x, OTHER, "  "), r" *\n *", "  \n  ")
    x = F.concat(F.lit(" "), x, F.lit(" "))
    x = F.concat(F.lit(" "), F.trim(x), F.lit(" "))
    for word, common in SPELLINGS:
        x = F.replace(x, F.lit(f" {word.replace(' ', '  ')} "), F.lit(f" {common.replace(' ', '  ')} "))
    return F.regexp_replace(x, " +", " ")


def whole(canon: Column) -> Column:
    return F.trim(F.regexp_replace(canon, r"[ \n]+", " "))


def known_table(spark: SparkSession, known=None, digests=None) -> DataFrame:
    """(digest, license, n: the canonical form's length), one row per canonical form, from texts and from digests."""
    known = KNOWN if known is None else known
    digests = DIGESTS if digests is None else digests
    if len(known) + len(digests) > MAX_KNOWN:
        raise ValueError(f"{len(known) + len(digests)} known licences; the bound for broadcasting them is {MAX_KNOWN}")
    df = spark.createDataFrame(known, "license string, text string")
    form = whole(canonical(F.col("text")))
    df = df.withColumn("form", form).filter("form <> ''").select(F.sha2("form", 256).alias("digest"), "license", F.length("form").alias("n"))
    df = df.unionByName(spark.createDataFrame(digests, "license string, n int, digest string"))
    return df.groupBy("digest").agg(F.min("license").alias("license"), F.min("n").alias("n"))


def read_known(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Known texts (license, text) from a folder of files named like ``MIT.txt``: at most MAX_KNOWN of them."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]*?)(?:\.txt)?$", 1).alias("license"), F.decode("content", "UTF-8").alias("text")).limit(MAX_KNOWN + 1).collect()
    return [(r.license, r.text) for r in rows]


def scan(docs: DataFrame, *, text_col="text", known=None, digests=None) -> DataFrame:
    """``docs`` with canonical_sha256, license (of the whole text) and notices (of its lines and paragraphs).

    Columns of these names in ``docs`` are replaced; all others are kept.
    """
    spark = docs.sparkSession
    table_ = known_table(spark, known, digests)
    rows = table_.collect()  # at most MAX_KNOWN rows, from the parameters
    by_form = {r.digest: r.license for r in rows}
    sizes = F.array(*[F.lit(n) for n in sorted({r.n for r in rows})] or [F.lit(-1)])
    lo, hi = min((r.n for r in rows), default=1), max((r.n for r in rows), default=0)
    keep = without(docs.columns, ["canonical_sha256", "license", "notices"])
    canon, digest, name = fresh(docs.columns, "canon"), fresh(docs.columns, "digest"), fresh(docs.columns, "known")
    text_known = F.broadcast(table_.select(F.col("digest").alias(digest), F.col("license").alias(name)))
    # Only forms as long as some known one are hashed; others cannot match it.
    fit = lambda arr: F.filter(arr, lambda x: F.length(x).between(lo, hi) & F.array_contains(sizes, F.length(x)))
    lines = F.transform(F.split(canon, "\n"), lambda x: F.trim(x))
    paras = F.when(F.col(canon).rlike(r"\n *\n"), F.transform(F.split(canon, PARAGRAPH), lambda x: whole(x))).otherwise(F.array().cast("array<string>"))
    hits = F.array_intersect(F.transform(F.concat(fit(lines), fit(paras)), lambda x: F.sha2(x, 256)), F.array(*[F.lit(d) for d in by_form] or [F.lit("")]))
    names = F.create_map(*[F.lit(v) for kv in by_form.items() for v in kv]) if by_form else F.create_map(F.lit(""), F.lit(""))
    out = docs.withColumn(canon, canonical(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.select(*keep, F.sha2(whole(F.col(canon)), 256).alias("canonical_sha256"), F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda d: F.element_at(names, d)))), ",").alias("notices"))
    out = out.join(text_known, F.col("canonical_sha256") == F.col(digest), "left")
    return out.select(*keep, "canonical_sha256", F.col(name).alias("license"), "notices")


def op1_license_scan(spark, sf_dir) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "canonical_sha256", "license", "notices")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    canon = f"lower(regexp_replace(text, {q(COPYRIGHT)}, '', 'g'))"
    canon = f"regexp_replace(regexp_replace({canon}, {q(OTHER)}, '  ', 'g'), ' *\\n *', '  ' || chr(10) || '  ', 'g')"
    canon = f"' ' || trim({canon}, ' ') || ' '"
    for word, common in SPELLINGS:
        canon = f"replace({canon}, {q(' ' + word.replace(' ', '  ') + ' ')}, {q(' ' + common.replace(' ', '  ') + ' ')})"
    canon = f"regexp_replace({canon}, ' +', ' ', 'g')"
    whole_ = lambda c: f"trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'), ' ')"
    values = ", ".join(f"({q(n)}, {q(t)})" for n, t in KNOWN)
    return f"""
WITH k0(license, text) AS (VALUES {values}), k1 AS (SELECT license, {canon} AS canon FROM k0),
kd(license, n, digest) AS (VALUES {", ".join(f"({q(a)}, {b}, {q(c)})" for a, b, c in DIGESTS)}),
known AS (SELECT digest, min(license) AS license FROM (SELECT sha256({whole_("canon")}) AS digest, license FROM k1 WHERE {whole_("canon")} <> '' UNION ALL SELECT digest, license FROM kd) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT row_number() OVER () AS r, doc_id, strlen(text)::BIGINT AS n_bytes, {canon} AS canon FROM d),
w AS MATERIALIZED (SELECT *, sha256({whole_("canon")}) AS canonical_sha256 FROM c),
forms AS (SELECT r, trim(unnest(string_split(canon, chr(10))), ' ') AS form FROM w
    UNION ALL SELECT r, {whole_("p")} FROM (SELECT r, unnest(string_split_regex(canon, {q(PARAGRAPH)})) AS p FROM w WHERE regexp_matches(canon, '\\n *\\n'))),
notes AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
    FROM forms JOIN known ON digest = sha256(form) WHERE form <> '' GROUP BY r)
SELECT doc_id, n_bytes, canonical_sha256, license, coalesce(notices, '') AS notices
FROM w LEFT JOIN notes USING (r) LEFT JOIN known ON digest = canonical_sha256
"""


SQL = _sql()
