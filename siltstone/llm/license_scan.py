"""Licence scan by canonical digest: a whole text against known licence texts.

A text is canonicalised by DataFrame functions: A-Z to lower case, lines that
begin with a copyright mark dropped, punctuation to spaces, words of equivalent
spelling to one of them, and runs of spaces to one.  The SHA-256 of what is left
is joined to the digests of the known texts, which go through the same steps.

The known digests are broadcast only while they are at most ``most_broadcast``
rows, which is counted; a longer list is joined by shuffle, from files, so that a
text which many documents share is split at run time.

Lines end at line feeds and carriage returns.

Defined cases: a null text has a null digest and no licence; an empty text, or one
of copyright lines and punctuation alone, has the digest of the empty text and no
licence; repeated documents are looked up alike; of known texts with the same
digest the first name in the alphabet is given; an empty table gives no rows.
Columns that the operator adds start with ``ls_`` and replace those of that name.
"""

from __future__ import annotations

from pathlib import Path

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import Scratch, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A line of a reflowed text may begin by "copyright notice", and a clause by (c); a mark, a year or a blank to fill in makes it a claim.
COPYRIGHT_LINE = r"^[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©|\d|by\b|[<\[{])|\(c\)[^a-z0-9\n]*(copyright|\d)|©|all rights reserved\b)[^\n]*$"
# ASCII signs and the typographic ones that stand for them; what is no word.
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©®–—‘’“”…]+"
# Words, and words in a row, that licence matching takes as equal.
EQUIVALENT = [
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
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourable", "favorable"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("merchantibility", "merchantability"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("recognised", "recognized"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_12 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Known texts by SPDX name, and the one-line grants of the corpus.
KNOWN: list[tuple[str, str]] = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_12 + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_12 + _BSD_3 + _BSD_END),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS,
    ),
    ("MIT", "Released under the MIT License."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
]


def whole_texts() -> list[tuple[str, str]]:
    """Known texts that are files of their own, by SPDX name; read on the driver."""
    return [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]


def _spaced(words: str) -> str:
    """Words as they stand between others while spellings are replaced."""
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    """The text's words in one spelling, a space between each two."""
    # Lines end at line feeds and at carriage returns, which become line feeds.
    lines = F.regexp_replace(F.translate(text, _UPPER + "\r", _LOWER + "\n"), "(?dm)" + COPYRIGHT_LINE, "")
    # Two spaces between words and one at each end let neighbours be replaced on their own.
    spaced = F.concat(F.lit(" "), F.regexp_replace(lines, SIGNS, "  "), F.lit(" "))
    for one, other in EQUIVALENT:
        spaced = F.replace(spaced, F.lit(_spaced(one)), F.lit(_spaced(other)))
    return F.trim(F.replace(spaced, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def known_digests(known: DataFrame) -> DataFrame:
    """ls_known, ls_name of a table of licences (name, text)."""
    return known.select(digest(F.col("text")).alias("ls_known"), "name").where(F.col("ls_known").isNotNull() & (F.col("ls_known") != EMPTY)).groupBy("ls_known").agg(F.min("name").alias("ls_name"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text", most_broadcast: int = 10_000) -> DataFrame:
    """``docs`` with ls_digest and ls_license (null where no known text has the digest)."""
    spark = docs.sparkSession
    if known is None:
        known = spark.createDataFrame([*KNOWN, *whole_texts()], "name string, text string")
    digests = known_digests(known)
    out = docs.drop("ls_digest", "ls_license", "ls_known", "ls_name").withColumn("ls_digest", digest(F.col(text_col)))
    if digests.limit(most_broadcast + 1).count() <= most_broadcast:
        digests = F.broadcast(digests)
    else:
        digests = Scratch(spark, "licenses").save(digests, "digests")
    return out.join(digests, F.col("ls_digest") == F.col("ls_known"), "left").withColumn("ls_license", F.col("ls_name")).drop("ls_known", "ls_name")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical digest of every document, and the licence that it is a text of."""
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("ls_digest").alias("canonical_sha256"), F.col("ls_license").alias("license"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"' ' || regexp_replace(regexp_replace(translate({text}, '{_UPPER}' || chr(13), '{_LOWER}' || chr(10)), {_quoted('(?m)' + COPYRIGHT_LINE)}, '', 'g'), {_quoted(SIGNS)}, '  ', 'g') || ' '"
    for one, other in EQUIVALENT:
        out = f"replace({out}, '{_spaced(one)}', '{_spaced(other)}')"
    return f"trim(replace({out}, '  ', ' '), ' ')"


def _sql(known: list[tuple[str, str]], documents: str) -> str:
    return f"""
WITH known(name, body) AS (VALUES {', '.join(f'({_quoted(n)}, {_quoted(t)})' for n, t in known)}),
digests AS (SELECT sha256({_sql_canonical('body')}) AS d, min(name) AS name FROM known GROUP BY 1),
docs AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS d FROM ({documents}))
SELECT doc_id, docs.d AS canonical_sha256, name AS license FROM docs LEFT JOIN digests ON docs.d = digests.d
"""


OP6_SQL = _sql(KNOWN, "SELECT doc_id, text FROM documents")

# Known texts in other clothes: how each is written in DataFrame functions and in SQL.
_CLOTHES = [
    (lambda text: text, "body"),
    (lambda text: F.upper(text), "upper(body)"),
    (lambda text: F.concat(F.lit("Copyright (c) 2020, 2021 Some Body\r\n\r\n"), F.replace(text, F.lit("\n"), F.lit("\r\n * "))), "'Copyright (c) 2020, 2021 Some Body' || chr(13) || chr(10) || chr(13) || chr(10) || replace(body, chr(10), chr(13) || chr(10) || ' * ')"),
    (lambda text: F.replace(F.replace(text, F.lit(" license "), F.lit(" licence ")), F.lit("copyright holder"), F.lit("copyright owner")), "replace(replace(body, ' license ', ' licence '), 'copyright holder', 'copyright owner')"),
    (lambda text: F.concat(text, F.lit(" And one sentence more.")), "body || ' And one sentence more.'"),
]


def license_known_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and, with ids below 0, each known text as it is, in capitals, as a comment under a copyright line, in British spelling, and with a sentence more."""
    known = [*KNOWN, *whole_texts()]
    body = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(known)], "k long, text string")
    dressed = [body.select((-(F.col("k") * len(_CLOTHES) + n + 1)).alias("doc_id"), dress(F.col("text")).alias("text")) for n, (dress, _) in enumerate(_CLOTHES)]
    out = table(spark, sf_dir, "documents").select("doc_id", "text")
    for rows in dressed:
        out = out.union(rows)
    out = scan_licenses(out)
    return out.select("doc_id", F.col("ls_digest").alias("canonical_sha256"), F.col("ls_license").alias("license"))


def known_texts_sql() -> str:
    known = [*KNOWN, *whole_texts()]
    rows = ", ".join(f"({k}, {_quoted(t)})" for k, (_, t) in enumerate(known))
    dressed = " UNION ALL ".join(f"SELECT -(k * {len(_CLOTHES)} + {n + 1}) AS doc_id, {sql} AS text FROM (VALUES {rows}) b(k, body)" for n, (_, sql) in enumerate(_CLOTHES))
    return _sql(known, f"SELECT doc_id, text FROM documents UNION ALL {dressed}")
