"""Licence scans: whole texts, and whole lines, looked up by the digest of their canonical form among known licences.

Canonical form: lower case, copyright lines dropped, equivalent spellings made one, everything but letters and digits made a
single space. Two texts of one canonical form are the same licence text.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Published equivalent spellings (one way of writing each, after lower-casing).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("non commercial", "noncommercial"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GNU_NAMES = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
_GNU_VERSIONS = [("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")]

#: Known licence texts and notices (licence, whole text). Copyright lines don't matter.
KNOWN = [
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD_2 + _WARRANTY_BSD),
    ("BSD-3-Clause", _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _WARRANTY_BSD),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((f"{k}-{v if '.' in v else v + '.0'}-or-later", _GNU.format(name=_GNU_NAMES[k], version=v)) for k, v in _GNU_VERSIONS),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

#: A line that says whose the copyright is: the word or a mark with a year, a mark, or a company or its like at the end; or that all
#: rights are reserved. Lines of a licence's own text that begin with the word stay. Applied after lower-casing; a line ends at \n.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(copyright[ \t:,]*[0-9<\[][^\n]*|(copyright[ \t]*)?(\(c\)|©)[^\n]*|copyright[^\n]*[ \t](authors|foundation|gmbh|inc|llc|ltd)\.?[ \t]*(\n|$)|all rights reserved\.?[ \t]*(\n|$))"
OTHER = r"[^a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    out = F.regexp_replace(F.replace(F.translate(text, UPPER, LOWER), F.lit("\n"), F.lit("\n\n")), COPYRIGHT_LINE, "\n")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, OTHER, " ")), F.lit(" "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """digest, license: one row for each distinct canonical form (the first licence of the list order by name)."""
    return spark.createDataFrame(texts, "license string, text string").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def hints(texts: list[tuple[str, str]]) -> list[str] | None:
    """A few words of which each text holds one, as it stands, whatever its spelling, case and marks: a unit without any of them is
    none of the texts. None if a text has no word of that kind; every unit is then looked up.

    A word counts if no equivalent spelling can make it, and if its line is not one that goes with the copyright lines.
    """
    spelt = {w for pair in SPELLINGS for side in pair for w in side.split()}
    bags = []
    for _, text in texts:
        lines = re.sub(COPYRIGHT_LINE, "\n", text.translate(str.maketrans(UPPER, LOWER)).replace("\n", "\n\n"))
        words = {w for w in re.findall("[a-z]{3,}", lines) if not any(w in s or s in w for s in spelt)}
        # Short words are in most texts.
        bags.append({w for w in words if len(w) >= 5} or words)
    if not all(bags):
        return None
    chosen: list[str] = []
    left = bags
    while left:
        counts = Counter(w for bag in left for w in bag)
        best = max(counts, key=lambda w: (counts[w], len(w), w))
        chosen.append(best)
        left = [bag for bag in left if best not in bag]
    return chosen


def scan(docs: DataFrame, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """doc_id, scope (text: the whole text; line: a whole line), line_no (from 1; 0 for text), license, digest, for each match.

    Null and empty texts match nothing; a null doc_id stays null. Repeated rows give repeated matches. Other columns of docs are
    dropped. The table of known digests is a literal of the caller, so it is broadcast. Texts and lines without any word that the
    known texts need (see hints) are not made canonical; that excludes no match.
    """
    base = docs.select("doc_id", "text").where("text is not null")
    words = hints(texts)
    hinted = (lambda c: c.rlike("(?i)" + "|".join(words))) if words else (lambda c: F.lit(True))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda line, k: F.struct((k + 1).alias("line_no"), line.alias("unit"))), lambda x: hinted(x["unit"]))
    units = F.concat(F.array(F.struct(F.lit(0).alias("line_no"), F.col("text").alias("unit"))), lines)
    looked = base.where(hinted(F.col("text"))).select("doc_id", F.explode(units).alias("x")).select("doc_id", "x.line_no", digest(F.col("x.unit")).alias("digest"))
    return looked.join(F.broadcast(known(docs.sparkSession, texts)), "digest").select("doc_id", F.when(F.col("line_no") == 0, "text").otherwise("line").alias("scope"), "line_no", "license", "digest")


def _sql_canonical(x: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(replace(translate({x}, '{UPPER}', '{LOWER}'), chr(10), chr(10) || chr(10)), {quote(COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"' ' || trim(regexp_replace({out}, {quote(OTHER)}, ' ', 'g')) || ' '"
    for one, other in SPELLINGS:
        out = f"replace({out}, {quote(one)}, {quote(other)})"
    return f"trim({out})"


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN)
    return f"""
WITH texts(license, text) AS (VALUES {values}),
known AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(license) AS license FROM texts GROUP BY 1),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, unnest(parts) AS unit, unnest(range(1, len(parts) + 1)) AS line_no FROM lines),
units AS (SELECT doc_id, 0 AS line_no, text AS unit FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, line_no, unit FROM split),
looked AS (SELECT doc_id, line_no, sha256({_sql_canonical("unit")}) AS digest FROM units)
SELECT doc_id, CASE WHEN line_no = 0 THEN 'text' ELSE 'line' END AS scope, cast(line_no AS int) AS line_no, license, digest
FROM looked JOIN known USING (digest)
"""


SQL = _sql()
