"""Operator 3, license scans: canonical digest lookup.

A text is brought to a canonical form: letter case, punctuation and white space are levelled,
copyright lines go, equivalent spellings become one. The SHA-256 digests of whole texts, and of the
lines in them, are hash-joined to the digests of known licence texts and one-line notices. Only
DataFrame functions are used; the known digests are a fixed list and are broadcast.

Defined results: a null text has no digest and no licence. A text without any word has the
digest of the empty form and no licence. If two known texts have one form, the smaller name counts.
Repeated rows are scanned alike. An empty table gives an empty result. Extra columns are passed through.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lines that name the owner; licences differ in them alone.
OWNER_LINE = r"(?m)^[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|<|\[|by )|\(c\)[ \t]*(?:[0-9]|copyright)|©|all rights reserved)[^\n]*$"
#: ASCII characters but letters, digits and line feed; typographic quotes, dashes, bullets, spaces.
BETWEEN_WORDS = r"[\x00-\x09\x0b-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\x{a0}\x{a9}\x{ab}\x{bb}\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2022}\x{2026}\x{3000}]+"

#: Spellings that count as equal (from, to).
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("http", "https"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("owner", "holder"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("while", "whilst"), ("wilful", "willful"),
]

#: Whole licence texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
}

#: The BSD family. Clause marks, the name in the third clause and the number of holders vary.
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_NAMES = ["the copyright holder", "the copyright holders", "the author", "the authors", "the University", "the project", "the organization", "the company", "the <organization>"]

#: Whole licence files in the folder ``licenses``, with the words that open their body and their appendix.
FILES = {
    "Apache-2.0": ("TERMS AND CONDITIONS FOR USE, REPRODUCTION", "APPENDIX: How to apply"),
    "GPL-2.0-only": ("Preamble", "How to Apply These Terms"),
    "GPL-3.0-only": ("Preamble", "How to Apply These Terms"),
    "LGPL-3.0-only": ("This version of the GNU Lesser", None),
    "MPL-2.0": ("1. Definitions", "Exhibit A - Source Code"),
    "CC0-1.0": ("Statement of Purpose", None),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public", None),
}

#: Spots in which published copies of one licence differ (licence, from, to).
COPIES = [
    ("MIT", "NONINFRINGEMENT", "NON-INFRINGEMENT"),
    ("MIT", "AUTHORS OR COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS OR AUTHORS"),
    ("MIT", "and this permission notice shall", "and this permission notice (including the next paragraph) shall"),
    ("ISC", "and/or distribute", "and distribute"),
    ("Apache-2.0", "Copyright [yyyy] [name of copyright owner]", "Copyright {yyyy} {name of copyright owner}"),
    ("Apache-2.0", '"[]"', '"{}"'),
    ("GPL-2.0-only", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"),
]

#: Title lines above the text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT", "License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "The ISC License (ISC)", "ISC License (ISC)", "License: ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License", "The BSD License"],
    "Apache-2.0": ["Apache License", "Apache License 2.0", "Apache License, Version 2.0"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
}

#: Names of licences in one-line notices.
NAMES = {
    "MIT License": "MIT",
    "Apache License, Version 2.0": "Apache-2.0",
    "Apache License 2.0": "Apache-2.0",
    "BSD 2-Clause License": "BSD-2-Clause",
    "BSD 3-Clause License": "BSD-3-Clause",
    "ISC License": "ISC",
    "Mozilla Public License, version 2.0": "MPL-2.0",
    "GNU General Public License, version 2": "GPL-2.0-only",
    "GNU General Public License, version 3": "GPL-3.0-only",
    "GNU Lesser General Public License, version 3": "LGPL-3.0-only",
    "GNU Affero General Public License, version 3": "AGPL-3.0-only",
    "CC0 1.0": "CC0-1.0",
    "CC BY 4.0": "CC-BY-4.0",
    "CC BY-SA 4.0": "CC-BY-SA-4.0",
    "CC BY-NC 4.0": "CC-BY-NC-4.0",
    "CC BY-ND 4.0": "CC-BY-ND-4.0",
    "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
}
FORMS = ["{} {}", "Released {} {}", "Licensed {} {}", "Available {} {}", "This work is licensed {} {}", "This software is licensed {} {}", "This project is licensed {} {}", "This software is released {} {}"]


def _bsd() -> list[tuple[str, str]]:
    clauses, end = BSD.split("3. Neither")[0], BSD[BSD.index("THIS SOFTWARE IS PROVIDED BY") :]
    third = BSD[len(clauses) : -len(end)]
    found = [("BSD-2-Clause", clauses + end)] + [("BSD-3-Clause", clauses + third.replace("the copyright holder", name) + end) for name in BSD_NAMES]
    regents = end.replace("THE COPYRIGHT HOLDERS AND", "THE REGENTS AND").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR")
    found.append(("BSD-3-Clause", clauses + third.replace("the copyright holder", "the University") + regents))
    found += [(k, x.replace("THE COPYRIGHT HOLDER OR", "THE COPYRIGHT HOLDERS OR")) for k, x in found]
    return found


def _files() -> list[tuple[str, str]]:
    """Licence files, also without the lines before their body and without their appendix."""
    found = []
    for ident, (body, appendix) in FILES.items():
        text = files("auctra.llm").joinpath("licenses", f"{ident}.txt").read_text(encoding="utf-8")
        # The appendix is named in the text's own references as well: its heading is the last mention that starts a line.
        ends = [len(text)] + ([max(m.start() for m in re.finditer(rf"(?m)^[ \t]*{re.escape(appendix)}", text))] if appendix else [])
        starts = [0, re.search(rf"(?m)^[ \t]*{re.escape(body)}", text).start()]
        found += [(ident, text[a:b]) for a in starts for b in ends]
    return found


def known() -> list[tuple[str, str]]:
    """(licence, text) of everything that is looked up; notices are built from names and forms, whole texts from their parts and titles."""
    notices = [(ident, form.format(under, name)) for name, ident in NAMES.items() for form in FORMS for under in ("under", "under the")]
    whole = [*TEXTS.items(), *_bsd()]
    whole += [(k, re.sub(r"(?m)^[123]\. ", "* ", x)) for k, x in whole] + _files()
    for ident, a, b in COPIES:
        whole += [(k, re.sub(r"\s+".join(map(re.escape, a.split())), lambda _: b, x)) for k, x in whole if k == ident]
    titled = [(k, f"{title}\n\n{x}") for k, x in whole for title in TITLES.get(k, [])]
    return list(dict.fromkeys([*whole, *titled, *notices]))


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, line by line (array of strings); lines without a word are left out.

    Every word has blanks of its own, so that neighbouring words are both levelled; spellings of two
    words also meet over the end of a line (and then stand at the end of the first).
    """
    c = F.regexp_replace(F.translate(text, _UPPER, _LOWER), OWNER_LINE, "")
    c = F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), BETWEEN_WORDS, "  ")
    c = F.regexp_replace(c, " *\n[ \n]*", " \n ")
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
        if " " in a:
            c = F.replace(c, F.lit(f" {a.replace(' ', ' ' + chr(10) + ' ')} "), F.lit(f" {b.replace(' ', '  ')} \n "))
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " "))), lambda x: x != "")


def digest_of(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known_digests(spark: SparkSession, entries: list[tuple[str, str]] | None = None) -> DataFrame:
    texts = spark.createDataFrame(entries or known(), "license string, text string")
    return texts.groupBy(digest_of(canonical_lines(F.col("text"))).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, entries: list[tuple[str, str]] | None = None) -> DataFrame:
    """Struct ``doc`` with the columns that came in; ``digest`` and ``license`` of the whole text, ``notices`` of its lines (sorted licences).

    One pass without a shuffle: the whole text is looked up by a broadcast hash join, its lines by hash against the same fixed list.
    """
    known_table = known_digests(docs.sparkSession, entries)
    by_digest = {r["digest"]: r["license"] for r in known_table.collect()}  # a fixed list
    table = F.create_map(*[F.lit(x) for kv in by_digest.items() for x in kv])
    rows = docs.select(F.struct("*").alias("doc"), canonical_lines(F.col("text")).alias("lines"))
    lines = F.transform(F.array_distinct("lines"), lambda x: F.sha2(x, 256))
    rows = rows.select("doc", digest_of(F.col("lines")).alias("digest"), F.array_intersect(lines, F.array(*map(F.lit, by_digest))).alias("hits"))
    notices = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.element_at(table, x))))
    rows = rows.join(F.broadcast(known_table), "digest", "left")
    return rows.select("doc", "digest", "license", F.coalesce(notices, F.array().cast("array<string>")).alias("notices"))


def sql() -> str:
    """DuckDB form of the query over documents (unique doc_ids): word by word, where the Spark form replaces in the text."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    words = {a: b for a, b in SPELLINGS if " " not in a}
    # A word is levelled until it no longer changes; the list has no longer chain than two.
    table = "MAP {" + ", ".join(f"'{a}': '{words.get(b, b)}'" for a, b in words.items()) + "}"
    form = f"regexp_replace(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), {quote(OWNER_LINE)}, '', 'g'), {quote(BETWEEN_WORDS)}, ' ', 'g')"
    tokens = f"list_filter(string_split(regexp_replace({form}, '\\n', ' ' || chr(10) || ' ', 'g'), ' '), lambda x: x != '')"
    level = f"list_transform({tokens}, lambda x: coalesce({table}[x], x))"
    joined = f"regexp_replace('  ' || array_to_string({level}, '  ') || '  ', '( *\\n *)+', '  ' || chr(10) || '  ', 'g')"
    for a, b in SPELLINGS:
        if " " in a:
            x, y = [words.get(w, w) for w in a.split(" ")]
            to = " ".join(words.get(w, w) for w in b.split(" ")).replace(" ", "  ")
            joined = f"replace(replace({joined}, ' {x}  {y} ', ' {to} '), ' {x}  ' || chr(10) || '  {y} ', ' {to}  ' || chr(10) || '  ')"
    lines = f"list_filter(list_transform(string_split({joined}, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x != '')"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known())
    return f"""
WITH k0(license, text) AS (VALUES {values}),
k AS (SELECT sha256(array_to_string({lines}, ' ')) AS digest, min(license) AS license FROM k0 GROUP BY 1),
d AS (SELECT doc_id, {lines} AS l, text FROM documents),
w AS (SELECT doc_id, l, CASE WHEN text IS NOT NULL THEN sha256(array_to_string(l, ' ')) END AS digest FROM d),
p AS (SELECT DISTINCT doc_id, sha256(unnest(l)) AS digest FROM w),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM p JOIN k USING (digest) GROUP BY 1)
SELECT w.doc_id, w.digest, k.license, coalesce(n.notices, '') AS notices FROM w LEFT JOIN k ON k.digest = w.digest LEFT JOIN n ON n.doc_id = w.doc_id
"""
