"""Licence texts and notices in documents, by digest of their canonical form."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public licence texts and the notices that refer to longer ones, by SPDX identifier.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n")
KNOWN = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software.\n\n" + _WARRANTY),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
            + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted.\n\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_TERMS + "\n" + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written permission.\n\n"
                     + _BSD_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    # whole texts of longer licences, one file each, named by identifier
    *((p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "texts").glob("*.txt"))),
)
#: Spellings that mean the same in a licence, as whole words after punctuation is gone.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
             ("sub license", "sublicense"),
             ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("favour", "favor"),
             ("organisation", "organization"), ("v 2", "version 2"), ("v2", "version 2"), ("v3", "version 3"))
#: A line that only names the holder of a copyright: with its sign, a year or a place to fill in.
COPYRIGHT_LINE = r"(?m)^[\x20\t*#/;-]*(?:copyright[\x20\t]*(?:\(c\)|©|[0-9]{4}|[<\[])|\(c\)[\x20\t]|©)[^\n]*(?:\n|$)"
_PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2026}]+"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, punctuation as single spaces, spellings made equal."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, _PUNCTUATION, " ")), F.lit(" "))
    for other, usual in SPELLINGS:
        words = F.replace(words, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(words)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """licence and the digest of its canonical form; as many rows as ``known`` at most."""
    table = spark.createDataFrame(list(known), "licence string, t string")
    return (table.select("licence", F.sha2(canonical(F.col("t")), 256).alias("digest"))
            .groupBy("digest").agg(F.min("licence").alias("licence")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=KNOWN) -> DataFrame:
    """One row per input row: doc_id, canonical_sha256 (whole text), licence (whole text), notices (lines).

    A whole text, and each line of it, is brought to its canonical form and its digest joined to the known ones.
    ``licence`` is null if the text as a whole is none; ``notices`` are the sorted distinct licences of its lines joined
    by commas, or null. Null texts count as empty, which is no licence. Repeated rows get equal results; an empty table
    gives no rows.
    """
    table = F.broadcast(known_digests(docs.sparkSession, known))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    whole = rows.select("doc_id", "t", F.sha2(canonical(F.col("t")), 256).alias("canonical_sha256"))
    whole = (whole.join(table, F.col("canonical_sha256") == F.col("digest"), "left")
             .select("doc_id", F.xxhash64("t").alias("th"), "canonical_sha256", "licence"))
    lines = rows.select("doc_id", F.xxhash64("t").alias("th"), F.explode(F.split("t", "\n")).alias("line"))
    found = (lines.select("doc_id", "th", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(table, "digest")
             .groupBy(F.col("doc_id").alias("i"), F.col("th").alias("h"))
             .agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices")))
    return (whole.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left")
            .select("doc_id", "canonical_sha256", "licence", "notices"))
