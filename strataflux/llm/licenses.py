"""License scan by canonical digests.

A text is normalised (lower case, copyright lines removed, equivalent spellings
made one, punctuation and white space to single spaces) and hashed whole; so is
each of its lines, as notices stand alone on a line. Digests of the known texts,
made by the same expression, are hash-joined to them. Nothing but built-in
functions runs, and only digests are joined, never text.

The known texts are `KNOWN`, the licence texts of known_licenses.jsonl under
their usual headings, and the rows (license, text) or (license, digest) of a
table of one's own, given to `scan` or named by the setting TABLE.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.llm import common

# Spellings that licence matching treats as the same, on normalised text.
SPELLINGS = (("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"), ("version 2 0", "2 0"), ("version 3 0", "3 0"), ("version 4 0", "4 0"), ("version 3", "3"), ("version 2", "2"), ("v2 0", "2 0"), ("v3", "3"), ("v2", "2"))

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Fixed values: (licence, known text).
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
)

TABLE = "spark.strataflux.licenses"  # setting: path of a Parquet table of known texts or digests
BROADCAST_ROWS = 100_000  # about 10 MB of digests

# Usual headings of texts that carry none themselves.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)", "(MIT License)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause License", "New BSD License", "Modified BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "NCSA": ("University of Illinois/NCSA Open Source License", "NCSA Open Source License"),
}
# Identifiers that a line "SPDX-License-Identifier: ..." may name beyond the licence's own.
SPDX = {name: (f"{name}-only", f"{name}-or-later", f"{name}+") for name in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3")}
IDENTIFIED = ("AGPL-3.0", "EPL-1.0", "EPL-2.0", "MIT-0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC0-1.0")  # names known by their identifier, whether or not the text is


def with_headings(name: str, body: str) -> list[str]:
    """`body` alone and under its headings, each also behind "All rights reserved."; a copyright line between them is removed anyway."""
    return [f"{head}\n\n{rights}{body}" for head in ("", *HEADINGS.get(name, ())) for rights in ("", "All rights reserved.\n\n")]


def built_in() -> list[tuple[str, str]]:
    """(licence, text) of all known texts: KNOWN first, then the file's, with and without what follows the terms, then identifiers."""
    rows = list(KNOWN)
    filed = [(r["license"], r["text"]) for r in map(json.loads, Path(__file__).with_name("known_licenses.jsonl").read_text("utf-8").splitlines())]
    bodies = [("MIT", MIT), ("ISC", ISC), ("0BSD", ZERO_BSD), ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL)]
    bodies += [(name, "\n".join(line[3:] if line[1:3] == ". " else line for line in body.split("\n"))) for name, body in bodies if name.startswith("BSD")]  # bullets instead of numbers
    for name, text in filed:
        bodies.append((name, text))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            bodies += [(name, terms), (name, terms + end)]
    rows += [(name, text) for name, body in bodies for text in with_headings(name, body)]
    names = dict.fromkeys([name for name, _ in rows if name != "Proprietary"] + list(IDENTIFIED))
    return rows + [(name, f"SPDX-License-Identifier: {x}") for name in names for x in (name, *SPDX.get(name, ()))]


# Prose that a wrapped line may begin with behind the word "copyright".
PROSE = "notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|disclaimers?|protection|permission|treaty|treaties|and|or|in|to|is|on|of|as|for|the|remains?|material|works?"
COPYRIGHT_LINE = rf"(?m)^[^\p{{L}}\p{{N}}\n(©]*(?:copyright\b(?![ \t]+(?:{PROSE})\b(?![ \t]+(?:regents|authors?|contributors|developers)\b))|\(c\)[ \t,]*(?:copyright\b|[0-9]{{4}})|©)[^\n]*"


def canonical(text: Column) -> Column:
    """Normal form with line breaks kept; a line's and a whole text's form follow by trimming."""
    text = F.lower(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(text, COPYRIGHT_LINE, "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def whole_form(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def digests(rows: DataFrame) -> DataFrame:
    """license, digest of a table of known texts (license, text), of their digests (license, digest), or of both."""
    made = F.sha2(whole_form(canonical(F.col("text"))), 256) if "text" in rows.columns else F.lit(None).cast("string")
    given = F.lower("digest") if "digest" in rows.columns else F.lit(None).cast("string")
    named = rows.select("license", F.coalesce(given, F.when(F.col("text").isNotNull(), made) if "text" in rows.columns else made).alias("digest"))
    return named.where(F.col("license").isNotNull() & F.col("digest").isNotNull())


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """digest, license: one row per different digest of the built-in texts and of `texts`; the first built-in licence wins, then the smallest name."""
    own = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(built_in())], "i int, license string, text string")
    rows = own.select("i", "license", F.sha2(whole_form(canonical(F.col("text"))), 256).alias("digest"))
    if texts is not None:
        rows = rows.unionByName(digests(texts).withColumn("i", F.lit(2**31 - 1)))
    return rows.groupBy("digest").agg(F.min_by("license", F.struct("i", "license")).alias("license"))


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, digest (whole text), license (of the whole text, else null), n_notices, notices.

    `notices` lists the distinct licences of lines, sorted and comma-joined,
    n_notices the lines that match. Empty lines match nothing; a null text is an
    empty one.
    """
    form = canonical(F.col("text"))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", form.alias("form"))
    lines = F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.sha2(whole_form(F.col("form")), 256)
    units = F.concat(F.array(whole), F.transform(lines, lambda x: F.sha2(x, 256)))
    cut = rows.select("row_id", "doc_id", F.posexplode(units).alias("i", "digest"))
    names = common.stored(known(docs.sparkSession, texts), "known-licenses")
    if names.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    found = cut.join(names, "digest", "left")
    return found.groupBy("row_id", "doc_id").agg(
        F.max(F.when(F.col("i") == 0, F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("i") == 0, F.col("license"))).alias("license"),
        F.count(F.when(F.col("i") > 0, F.col("license"))).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("i") > 0, F.col("license")))), ",").alias("notices"),
    ).drop("row_id")


def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get(TABLE, None)
    return scan(common.read(spark, sf_dir, "documents").select("doc_id", "text"), spark.read.parquet(path) if path else None)


def _canonical_sql(text: str) -> str:
    text = f"regexp_replace(lower(coalesce({text}, '')), '(?m)^[ \\t]*(?:copyright|\\(c\\)|©)[^\\n]*', '', 'g')"
    text = f"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for old, new in SPELLINGS:
        text = f"replace({text}, '{old}', '{new}')"
    return text


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
with texts(i, license, body) as (values {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(KNOWN))}),
known as (
    select sha256(trim(regexp_replace({_canonical_sql("body")}, '[ \\n]+', ' ', 'g'))) as digest, arg_min(license, i) as license
    from texts group by 1),
forms as (select doc_id, {_canonical_sql("text")} as form from documents),
whole as (select doc_id, sha256(trim(regexp_replace(form, '[ \\n]+', ' ', 'g'))) as digest from forms),
lines as (
    select doc_id, license from (select doc_id, trim(unnest(string_split(form, chr(10)))) as line from forms)
    join known on digest = sha256(line) where line <> ''),
notices as (
    select doc_id, count(*) as n, string_agg(distinct license, ',' order by license) as list from lines group by doc_id)
select w.doc_id, w.digest, k.license, coalesce(n.n, 0) as n_notices, coalesce(n.list, '') as notices
from whole w left join known k using (digest) left join notices n using (doc_id)
"""
