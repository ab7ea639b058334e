"""Operator 7: licence scan by canonical digests of entire texts, with DataFrame functions.

A text is normalised (A-Z to lower case, copyright lines dropped, equivalent spellings made one, punctuation and white space to
single blanks) and its SHA-256 is joined with the digests of known licence texts and notices.

Null and empty texts, or texts of nothing but copyright lines, have an empty normal form and match nothing. Repeated rows stay.
Two known texts with one normal form count once, by the smaller id, so a document has one row. The known table is that of KNOWN and
of the full texts in licence_texts.json, each with and without its title (its size is checked before it is broadcast). Only the key and text columns of the documents are read.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table, texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spellings that licence matching takes as equal.
SPELLINGS = {"licence": "license", "licenced": "licensed", "sub-license": "sublicense", "sub license": "sublicense", "organisation": "organization", "analyse": "analyze", "behaviour": "behavior", "favour": "favor", "merchantibility": "merchantability", "noncommercial": "non commercial", "copyright holder": "copyright owner", "owner": "owner", "https://": "http://", "(c)": "copyright"}
COPYRIGHT_LINE = r"(?m)^[^0-9a-z\n]*(copyright|\(c\)|all rights reserved)[^\n]*$"
MOST_KNOWN = 100_000

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Licence texts and notices, by SPDX id.
KNOWN = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


def full_texts() -> list[tuple[str, str]]:
    """SPDX id and text of the data file's licences, alone and below each of their titles."""
    entries = json.loads(Path(__file__).with_name("licence_texts.json").read_text(encoding="utf-8"))
    return [(x["license_id"], t) for x in entries for t in (x["text"], *(f"{title}\n\n{x['text']}" for title in x["titles"]))]


def normal(text: Column) -> Column:
    t = F.translate(text, UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    for a, b in SPELLINGS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    # blanks for ASCII punctuation and white space; letters of other scripts stay
    return F.trim(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def scan(df: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, license_id (null where no known text has the digest)."""
    if known is None:
        known = df.sparkSession.createDataFrame(KNOWN + full_texts(), "license_id string, text string")
    digests = known.select(F.col("license_id").cast("string").alias("license_id"), normal(F.col("text").cast("string")).alias("n")).where("n <> ''")
    digests = digests.groupBy(F.sha2("n", 256).alias("known_digest")).agg(F.min("license_id").alias("license_id"))
    if digests.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN:
        digests = F.broadcast(digests)
    docs = texts(df, key, text).select("doc_id", F.sha2(normal(F.coalesce("text", F.lit(""))), 256).alias("digest"))
    return docs.join(digests, F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "license_id")


def _sql_normal(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"translate({text}, '{UPPER}', '{LOWER}')"
    t = f"regexp_replace({t}, {quote(COPYRIGHT_LINE)}, '', 'g')"
    for a, b in SPELLINGS.items():
        t = f"replace({t}, {quote(a)}, {quote(b)})"
    return f"trim(regexp_replace({t}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"


def sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (
    SELECT sha256({_sql_normal('t')}) AS digest, min(i) AS license_id FROM (VALUES {rows}) v(i, t) GROUP BY 1
), docs AS (
    SELECT doc_id, sha256({_sql_normal("coalesce(text, '')")}) AS digest FROM documents
)
SELECT doc_id, digest, license_id FROM docs LEFT JOIN known USING (digest)"""


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
