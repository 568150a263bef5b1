"""Licence scan by canonical digest look-up (DataFrame functions only).

A line's canonical form has one case, one space for each run of punctuation and white space,
and one of each pair of equivalent spellings; a line that only claims a copyright has none. A
text's canonical form is that of its lines, one space between them, so it doesn't depend on
where lines are broken. Its digest is joined with the digests of known licences: once for the
entire document, once for each of its lines, each line being an entire text of its own (a
notice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, write_shared

#: Spellings that count as equal (the left one is replaced).
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner"),
    ("https", "http"), ("organisation", "organization"), ("authoris", "authoriz"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("judgement", "judgment"), ("recognis", "recogniz"), ("whilst", "while"), ("wilful", "willful"), ("fulfil ", "fulfill "),
)

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_2, _BSD_3 = _BSD_TERMS + _BSD_WARRANTY, _BSD_TERMS + _BSD_NAME + _BSD_WARRANTY
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MORE = " For more information, please refer to <https://unlicense.org>"
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MOZILLA = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."


def _gnu(kind: str, version: str, later: bool) -> str:
    """The notice that the GNU licences ask for in each source file."""
    either = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation, {either} "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details. "
        f"You should have received a copy of the {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
#: Known licence texts and notices.
LICENSES = (
    ("MIT", _GRANT), ("MIT", "The MIT License (MIT) " + _GRANT), ("MIT", "MIT License " + _GRANT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC), ("ISC", "ISC License " + _ISC), ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-2-Clause", _BSD_2), ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_2), ("BSD-3-Clause", _BSD_3), ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_3),
    ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + _MORE), ("Zlib", _ZLIB), ("Zlib", "zlib License " + _ZLIB), ("BSL-1.0", _BOOST), ("MPL-2.0", _MOZILLA), ("0BSD", _ZERO), ("0BSD", "Zero-Clause BSD " + _ZERO),
    ("GPL-2.0-only", _gnu(_GPL, "2", False)), ("GPL-2.0-or-later", _gnu(_GPL, "2", True)), ("GPL-3.0-only", _gnu(_GPL, "3", False)), ("GPL-3.0-or-later", _gnu(_GPL, "3", True)),
    ("LGPL-2.1-or-later", _gnu(_LGPL, "2.1", True)), ("LGPL-3.0-or-later", _gnu(_LGPL, "3", True)), ("AGPL-3.0-or-later", _gnu(_AGPL, "3", True)),
)
#: Known digests are broadcast up to so many (some 50 MB); beyond, joined by hash.
MAX_BROADCAST_LICENSES = 500_000

#: Lines that only claim a copyright (after the word a sign, a year or "by"; a sign or
#: "(c)" with a year; a reservation of rights alone); what separates words.
COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright[^a-z0-9(]*(\(c\)|©|[0-9]{4}|by )|\(c\)[^a-z0-9]*[0-9]{4}|©|all rights reserved[^a-z0-9]*$)"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPLIT = "\n"


def _spelled(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


#: Of more than one word, so that a line break may stand inside.
_ACROSS = tuple(p for p in SPELLINGS if " " in p[0])


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line; '' for a claim of copyright."""

    def of(line: Column) -> Column:
        c = _spelled(F.regexp_replace(line, SEPARATORS, " "), SPELLINGS)
        return F.when(line.rlike(COPYRIGHT_LINE), "").otherwise(F.trim(c))

    return F.transform(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SPLIT), of)


def canonical_whole(lines: Column) -> Column:
    """The canonical form of a text from those of its lines; '' for null, and for claims of copyright only."""
    return F.trim(_spelled(F.concat(F.array_join(F.filter(lines, lambda c: c != ""), " "), F.lit(" ")), _ACROSS))


def known_licenses(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in LICENSES])
    return spark.range(1).select(F.inline(rows))


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, license_id, notices, n_notice_lines.

    license_id: the licence that the entire text is, or null. notices: the sorted distinct
    licences that entire lines are, joined by commas, '' for none; n_notice_lines: how many
    lines. licenses (license_id, text): what is known; by default LICENSES; of two licences
    with one canonical form the first by id counts, empty ones and null ids are ignored.
    Null and empty texts match nothing. What is found depends on a row's text alone, so null
    and repeated doc_ids are scanned like others. An empty table gives none; other columns are
    ignored.
    """
    given = known_licenses(docs.sparkSession) if licenses is None else licenses
    known = given.select("license_id", canonical_whole(canonical_lines(F.col("text"))).alias("c")).filter("c <> '' and license_id is not null")
    known = write_shared(known.groupBy(F.md5("c").alias("digest")).agg(F.min("license_id").alias("known_id")), "licenses")
    small = known.count() <= MAX_BROADCAST_LICENSES
    side = F.broadcast(known) if small else known
    # a text is named by its digest; place 0 is the whole, then come its lines
    texts = docs.select(F.md5("text").alias("of"), canonical_lines(F.col("text")).alias("lines")).filter("of is not null")
    digests = F.concat(F.array(F.md5(canonical_whole(F.col("lines")))), F.transform("lines", lambda c: F.md5(c)))
    hits = texts.select("of", F.posexplode(digests).alias("place", "digest")).join(side, "digest").select("of", "place", "known_id").distinct()
    line = F.col("place") > 0
    found = hits.groupBy("of").agg(
        F.max(F.when(~line, F.col("known_id"))).alias("license_id"), F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("known_id")))), ",").alias("notices"), F.count(F.when(line, 1)).alias("n")
    )
    out = docs.select("doc_id", F.md5("text").alias("own")).join(found, F.col("own") == F.col("of"), "left")
    return out.select("doc_id", "license_id", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notice_lines"))


def _spelled_sql(c: str, pairs) -> str:
    for old, new in pairs:
        c = f"replace({c}, '{old}', '{new}')"
    return c


def lines_sql(text: str) -> str:
    """canonical_lines() as DuckDB SQL."""
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    one = _spelled_sql(f"regexp_replace(x, '{SEPARATORS}', ' ', 'g')", SPELLINGS)
    return f"list_transform(string_split({low}, chr(10)), lambda x: case when regexp_matches(x, '{COPYRIGHT_LINE}') then '' else trim({one}) end)"


def whole_sql(lines: str) -> str:
    """canonical_whole() as DuckDB SQL."""
    joined = f"(coalesce(array_to_string(list_filter({lines}, lambda x: x <> ''), ' '), '') || ' ')"
    return f"trim({_spelled_sql(joined, _ACROSS)})"


def oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in LICENSES)
    return f"""
with known as (
  select md5(c) as digest, min(license_id) as known_id
  from (select license_id, {whole_sql('lines')} as c
        from (select license_id, {lines_sql('text')} as lines from (values {rows}) t(license_id, text)) l) k
  where c <> '' group by 1),
made as (select doc_id, {lines_sql('text')} as lines from documents),
hits as (select doc_id, known_id from (select doc_id, md5(unnest(lines)) as digest from made) m join known using (digest)),
notices as (
  select doc_id, string_agg(distinct known_id, ',' order by known_id) as notices, count(*) as n from hits group by doc_id)
select d.doc_id, k.known_id as license_id, coalesce(n.notices, '') as notices, coalesce(n.n, 0)::bigint as n_notice_lines
from (select doc_id, md5({whole_sql('lines')}) as digest from made) d
left join known k using (digest) left join notices n using (doc_id)
"""
