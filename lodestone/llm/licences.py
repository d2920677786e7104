"""Licence scans by canonical digests."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, ascii_lower, broadcast_below, checkpoint, read_table

#: Long licence texts, as their owners publish them, one file each.
FILES = Path(__file__).parent / "licence_texts"
# Licence texts and notices as their owners publish them.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause"],
}
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}
_CLAUSE_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("\n\nTHIS SOFTWARE", f"\n\n{_CLAUSE_3}\n\nTHIS SOFTWARE")
#: Titles that may stand before a text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"], "Zlib": ["zlib License", "The zlib/libpng License"],
}
#: Where the body of a text of FILES begins, after its title, and where it may end.
BODIES = {"Apache-2.0": ("TERMS AND CONDITIONS FOR USE", "END OF TERMS AND CONDITIONS"), "GPL-3.0": ("Preamble", "END OF TERMS AND CONDITIONS"), "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public\nLicense\n\nBy exercising", None)}
#: Equivalent spellings, each with the one that stands for it.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "centre": "center", "customise": "customize", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "licence": "license", "licenced": "licensed", "licences": "licenses", "modelled": "modeled",
    "noncommercial": "non commercial", "organisation": "organization", "organise": "organize", "percent": "per cent", "practise": "practice", "recognise": "recognize",
    "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "wilfull",
}
#: What follows a line break, or starts the text, in a line that states a copyright.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright [0-9(©]|copyright ©|\(c\) [0-9]|©)[^\n]*"
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F“”‘’–—©]+"


def whole_texts() -> dict[str, list[str]]:
    """Every licence's full texts: with and without a title, "All rights reserved." and, where there is one, an appendix."""
    out: dict[str, list[str]] = {}
    for name, body in TEXTS.items():
        rights = [body, f"All rights reserved.\n\n{body}"]
        out[name] = rights + [f"{title}\n\n{x}" for title in TITLES.get(name, []) for x in rights]
    for name, (begin, end) in BODIES.items():
        text = (FILES / f"{name}.txt").read_text()
        starts = {0, max(0, text.find(begin))}
        some = [text[i:] for i in sorted(starts)]
        some += [x[: x.index(end) + len(end)] for x in some if end and end in x]
        some += [x.replace("Copyright [yyyy] [name of copyright owner]\n", "") for x in some if "[yyyy]" in x]
        out[name] = some
    return out


def known_texts() -> dict[str, list[str]]:
    """All texts and notices of this module by licence."""
    full = whole_texts()
    return {k: [*NOTICES.get(k, []), *full.get(k, [])] for k in {**NOTICES, **full}}


def squeeze(text: Column) -> Column:
    """Lower case, no copyright lines, marks as single spaces; line breaks stay."""
    return F.regexp_replace(F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, ""), MARKS, " ")


def canonical(text: Column) -> Column:
    """Canonical words of a text, joined by one space, with its line breaks."""
    out = F.concat(F.lit(" "), F.replace(F.replace(squeeze(text), F.lit("\n"), F.lit(" \n ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.regexp_replace(out, " +", " ")


def one_line(canon: Column) -> Column:
    return F.trim(F.regexp_replace(canon, "[ \n]+", " "))


def digest(line: Column) -> Column:
    return F.sha2(line.cast("binary"), 256)


def known_digests(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, licence) of licence texts and notices; by default those of this module."""
    rows = spark.createDataFrame([(k, t) for k, ts in (known_texts() if texts is None else texts).items() for t in ts], "licence string, text string")
    return rows.select(digest(one_line(canonical(F.col("text")))).alias("digest"), "licence").distinct()


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document: doc_id, n_notices (lines that are known texts), licences (their ids and the whole text's, sorted,
    comma-joined), whole_licence (the id that the entire text is, else null).

    Every entire text and every line with a word is digested and looked up among the known digests, which are broadcast
    if they are measured to be small. Null and empty texts match nothing. Repeated rows stay; other columns play no
    part; no rows give no rows.
    """
    known = broadcast_below(checkpoint(known.select("digest", "licence")))
    canon = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), canonical(F.coalesce("text", F.lit(""))).alias("s"))
    unit = lambda u, whole: F.struct(u.alias("u"), F.lit(whole).alias("whole"))
    units = F.concat(F.array(unit(one_line(F.col("s")), True)), F.transform(F.split("s", "\n"), lambda u: unit(F.trim(u), False)))
    units = canon.select("doc_id", "text_hash", F.explode(units).alias("e")).where("e.u <> ''")
    found = units.select("doc_id", "text_hash", "e.whole", digest(F.col("e.u")).alias("digest")).join(known, "digest")
    per = checkpoint(found.groupBy("doc_id", "text_hash").agg(F.count(F.when(~F.col("whole"), 1)).alias("n"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"), F.max(F.when(F.col("whole"), F.col("licence"))).alias("whole_licence")))
    # Rows that repeat (doc_id, text) were counted together.
    times = checkpoint(docs.select("doc_id", F.xxhash64("text").alias("text_hash")).groupBy("doc_id", "text_hash").agg(F.count("*").alias("times")))
    out = times.join(broadcast_below(per.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})), times.doc_id.eqNullSafe(F.col("d")) & (times.text_hash == F.col("t")), "left")
    out = out.select("doc_id", F.coalesce((F.col("n") / F.col("times")).cast("bigint"), F.lit(0).cast("bigint")).alias("n_notices"), F.coalesce("licences", F.lit("")).alias("licences"), "whole_licence", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_t"))
    return out.drop("_t")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of all documents for the texts and notices of this module."""
    return scan(read_table(spark, sf_dir, "documents"), known_digests(spark))


def _sql_squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', '', 'g'), '{MARKS}', ' ', 'g')"


def _sql_respell(x: str) -> str:
    out = f"' ' || replace(trim(regexp_replace({x}, '[ \\n]+', ' ', 'g')), ' ', '  ') || ' '"
    for a, b in SPELLINGS.items():
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def op5_sql() -> str:
    pairs = [(k, t) for k, ts in known_texts().items() for t in ts]
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in pairs)
    return f"""
WITH raw(licence, text) AS (VALUES {rows}),
known AS (SELECT DISTINCT licence, {_sql_respell(_sql_squeeze('text'))} AS c FROM raw),
flat AS (SELECT doc_id, {_sql_squeeze("coalesce(text, '')")} AS s FROM documents),
units AS (SELECT doc_id, s AS u, true AS whole FROM flat UNION ALL SELECT doc_id, unnest(string_split(s, chr(10))) AS u, false FROM flat),
found AS (SELECT doc_id, whole, licence FROM units JOIN known ON {_sql_respell('u')} = c WHERE trim(u) <> ''),
per AS (SELECT doc_id, count(*) FILTER (NOT whole) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, max(CASE WHEN whole THEN licence END) AS whole_licence FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_notices, coalesce(licences, '') AS licences, whole_licence FROM documents LEFT JOIN per USING (doc_id)
"""
