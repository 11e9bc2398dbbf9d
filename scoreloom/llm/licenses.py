"""Licence scan: canonical digests of texts, paragraphs and lines joined to known licences.

The canonical form has lower-case ASCII letters, one blank for any stretch of ASCII
punctuation and white space, no copyright lines, no lines that are only a licence's title and
one spelling of words that licences spell in several ways. A whole text, a paragraph or a line is a licence if its canonical
form has the digest of a known one.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# pattern and replacement, in this order; the same in Java's and in RE2's syntax
RULES = (
    ("[^a-z0-9\\n\\x{80}-\\x{10FFFF}]+", " "),
    # wrapped lines of a licence that begin with the word, not with whose it is
    ("(?m)^ ?copyright (notices?|holders?|owners?|ownership|licen[cs]e[sd]?|laws?|statements?|interests?|treaty|treaties|doctrines?|disclaimer|protections?|infringements?"
     "|permission|like|and|or|as|in|on|to|is|are|of|for|under|that|which|if|may|shall)\\b", "qqcopyright $1"),
    ("(?m)^ ?(c )?(copyright|©|c [0-9]{4}) [^\\n]*[^ \\n][^\\n]*$", ""),
    ("qqcopyright", "copyright"),
    ("licenc", "licens"),
    ("organis", "organiz"),
    ("favour", "favor"),
    ("https", "http"),
    ("noncommercial", "non commercial"),
    (" v ?([0-9])", " version $1"),
    ("(?m)^ ?(the )?((mit|isc|zlib|expat|bsd|0bsd|bsd zero clause|zero clause bsd|((bsd )?[0-9] clause )?(simplified|new|modified|revised) bsd|[0-9] clause bsd|bsd [0-9] clause) licens(e|es)"
     "|zero clause bsd|bsd [0-9] clause|bsd zero clause)( (mit|isc|zlib|0bsd|expat|bsd [0-9] clause))? ?$", ""),
)
KNOWN_MOST = 100_000  # known texts that may be broadcast; beyond, digests are shuffled

# Short notices and short licence texts as published.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.{third}

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT {who} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {whose} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
LONG = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")  # files in texts
ENDS = "END OF TERMS AND CONDITIONS"  # what follows is advice, often left out


def _bsd() -> list[tuple[str, str]]:
    """With and without numbers, the line about rights and the s of holders, as files in use have them."""
    out = []
    for name, third in (("BSD-2-Clause", ""), ("BSD-3-Clause", _THIRD)):
        for who, whose in (("HOLDERS", "HOLDER"), ("HOLDERS", "HOLDERS"), ("HOLDERS", "OWNER")):
            text = _BSD.format(third=third, who=who, whose=whose)
            for mark in ("{}. ", "* ", ):
                marked = text
                for i in (1, 2, 3):
                    marked = marked.replace(f"\n{i}. ", "\n" + mark.format(i))
                out += [(name, marked), (name, "All rights reserved.\n\n" + marked)]
    return out


def _long() -> list[tuple[str, str]]:
    out = []
    for name in LONG:
        text = pkgutil.get_data(__package__, f"texts/{name}.txt").decode()
        out.append((name, text))
        if ENDS in text:
            out += [(name, text[:text.index(ENDS)]), (name, text[:text.index(ENDS) + len(ENDS)])]
    return out


KNOWN = (
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    *_bsd(),
    *_long(),
)


def loosened(text: Column) -> Column:
    """Canonical text that still has its line breaks."""
    out = F.translate(text, UPPER, LOWER)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return out


def canonical(loose: Column) -> Column:
    """One line: breaks and blanks around them become one blank."""
    return F.trim(F.regexp_replace(loose, "[ \\n]+", " "))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """license, digest of the known texts."""
    table = spark.createDataFrame(list(known), "license string, text string")
    return table.select("license", F.sha2(canonical(loosened(F.col("text"))), 256).alias("digest"), F.length(canonical(loosened(F.col("text")))).alias("size")).where("size > 0").distinct()


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, part (text, paragraph or line), number of the part in its text and license, for every part that is one.

    Paragraphs and lines are counted in the canonical text, from 0, blank ones included. Null
    and empty texts have no licence; a digest known under two names gives two rows; rows that
    share an id each give theirs; other columns play no part.
    """
    sizes = [r[0] for r in known.select("size").distinct().limit(10_001).collect()]
    few = known.count() <= KNOWN_MOST
    loose = docs.select(F.col(id_col).alias("id"), loosened(F.col(text_col)).alias("loose")).where("loose is not null")
    parts = loose.select("id", F.explode(F.array(
        F.struct(F.lit("text").alias("part"), F.array("loose").alias("units")),
        F.struct(F.lit("paragraph").alias("part"), F.split("loose", "\\n *(?:\\n *)+").alias("units")),
        F.struct(F.lit("line").alias("part"), F.split("loose", "\\n").alias("units")),
    )).alias("p")).select("id", "p.part", F.posexplode("p.units").alias("number", "unit"))
    parts = parts.withColumn("unit", canonical(F.col("unit")))
    if len(sizes) <= 10_000:  # a text of another length can't be a known one; saves its digest
        parts = parts.where(F.length("unit").isin(sizes))
    parts = parts.select("id", "part", "number", F.sha2("unit", 256).alias("digest"))
    names = known.select("digest", "license")
    return parts.join(F.broadcast(names) if few else names, "digest").select("id", "part", "number", "license")


def per_document(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_parts (lines, paragraphs and texts that are licences), licenses (sorted names) and whole (the text is one)."""
    each = found.groupBy("id").agg(F.countDistinct("part", "number").alias("n_parts"), F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("licenses"), F.max(F.col("part") == "text").alias("whole"))
    ids = docs.select(F.col(id_col).alias("doc"))
    return ids.join(each, ids["doc"] == each["id"], "left").select(F.col("doc").alias(id_col), F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("whole", F.lit(False)).alias("whole"))


def sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same over table documents."""
    def loose(x: str) -> str:
        out = f"translate({x}, '{UPPER}', '{LOWER}')"
        for pattern, to in RULES:
            out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        return out

    one = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known)
    return f"""
with known as (select distinct license, {one(loose('text'))} form from (values {rows}) t(license, text)),
loose as (select doc_id, {loose('text')} loose from documents),
parts as (select doc_id, 'text' part, 0 number, loose unit from loose
  union all select doc_id, 'paragraph', unnest(range(len(u))), unnest(u) from (select doc_id, regexp_split_to_array(loose, '\\n *(?:\\n *)+') u from loose)
  union all select doc_id, 'line', unnest(range(len(u))), unnest(u) from (select doc_id, string_split(loose, chr(10)) u from loose)),
hits as (select doc_id, part, number, license from parts join known on form = {one('unit')})
select d.doc_id, count(distinct part || number::varchar)::bigint n_parts, coalesce(string_agg(distinct license, ',' order by license), '') licenses, coalesce(bool_or(part = 'text'), false) whole
from documents d left join hits using (doc_id) group by d.doc_id"""
