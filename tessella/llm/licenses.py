"""Licence scans by canonical digests.

A text is normalised (case, punctuation and white space, copyright lines, equivalent
spellings) and hashed; entire texts, and each of their lines, are hash-joined to the digests
of known licence texts, normalised alike.
"""

from __future__ import annotations

import itertools
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import written

#: Spellings that licence matching takes for equal.
SPELLINGS = (
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("noncommercial", "non commercial"),
    ("percent", "per cent"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright holder", "copyright owner"),
)

#: Public licence texts and notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "notice:MIT": "Released under the MIT License.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:CC-BY-4.0": "Licensed under CC BY 4.0.",
    "notice:CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "notice:BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "notice:MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


#: The licences whose full texts lie in ``license_texts`` (those above have
#: theirs here): usual titles (none is one too), where the text may begin after its own
#: title and headers, and where an appendix begins that may be left out.
LAYOUTS = {
    "MIT": (("MIT License", "The MIT License", "The MIT License (MIT)"), (), None),
    "ISC": (("ISC License", "The ISC License"), (), None),
    "0BSD": (("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"), (), None),
    "BSD-2-Clause": (("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"), (), None),
    "BSD-3-Clause": (("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License"), (), None),
    "Zlib": (("zlib License", "The zlib License", "zlib/libpng license"), (), None),
    "Unlicense": (("The Unlicense", "Unlicense"), (), None),
    "BSL-1.0": (("Boost Software License",), ("Permission is hereby granted",), None),
    "Apache-2.0": (("Apache License", "Apache License Version 2.0, January 2004"), ("TERMS AND CONDITIONS FOR USE",), "APPENDIX: How to apply"),
    "MPL-2.0": (("Mozilla Public License, version 2.0",), ("1. Definitions",), "Exhibit A - Source Code Form"),
    "CC0-1.0": (("CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"), ("CREATIVE COMMONS CORPORATION", "Statement of Purpose"), None),
    "GPL-2.0": (("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",), ("Everyone is permitted", "Preamble"), "How to Apply These Terms"),
    "GPL-3.0": (("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",), ("Everyone is permitted", "Preamble"), "How to Apply These Terms"),
    "LGPL-2.1": (("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",), ("Everyone is permitted", "Preamble"), "How to Apply These Terms"),
    "LGPL-3.0": (("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",), ("Everyone is permitted", "This version of the GNU Lesser"), None),
}


def full_text(license_id: str) -> str:
    return KNOWN.get(license_id) or (Path(__file__).with_name("license_texts") / f"{license_id}.txt").read_text(encoding="utf-8")


def usual_forms(license_id: str) -> set[str]:
    """A licence's text with and without titles, headers, appendix and numbers of clauses,
    and with either scheme of its links."""
    if license_id not in LAYOUTS:
        return {KNOWN[license_id]}
    titles, starts, tail = LAYOUTS[license_id]
    text = full_text(license_id)
    ends = [len(text)] + ([text.rindex(tail)] if tail else [])
    bodies = [(text[:end], ("",)) for end in ends]
    for start, end in itertools.product(starts or ("",), ends):
        bodies.append((text[text.index(start) : end], ("", *titles)))
    if license_id.startswith("BSD-"):
        bodies += [(re.sub(r"(?m)^\d\. ", "", body), t) for body, t in bodies]
    forms = {f"{title}\n{body}" for body, titles_ in bodies for title in titles_}
    return forms | {re.sub("https?://", scheme, f) for f in forms for scheme in ("http://", "https://")}


def known_licenses(spark: SparkSession) -> DataFrame:
    """``license_id, text`` of the licences above, in their usual forms; their number is fixed."""
    rows = [(name, form) for name in sorted({*KNOWN, *LAYOUTS}) for form in sorted(usual_forms(name))]
    return spark.createDataFrame(rows, "license_id string, text string")


#: A copyright line that names no year, as it is written; other words that follow are text.
HOLDER = r"^[\s\p{Punct}]*Copyright:? (?!Holder|Owner|Licen[cs]e|Notice|Law|Act\b|Treat|Interest|Right|Disclaimer|Statement)[\p{Lu}<\[{]"


def _canonical(line: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}©]+", " "))
    for old, new in SPELLINGS:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    notice = plain.rlike(r"^(?:copyright (?:c |©|[0-9]|by )|c [0-9]{4}|©|all rights reserved$)") | line.rlike(HOLDER)
    return F.when(notice, F.lit("")).otherwise(F.trim(F.replace(plain, F.lit("©"), F.lit(""))))


def canonical_lines(text: Column) -> Column:
    """The text's lines, normalised, without empty ones and copyright lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), _canonical), lambda x: x != "")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def whole(lines: Column) -> Column:
    return F.array_join(lines, " ")


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``, ``known(license_id, text)`` -> one row per row of docs:
    ``doc_id, text_digest, license_id, line_licenses``.

    ``license_id`` is the smallest id whose whole canonical text equals the document's, else
    null; ``line_licenses`` lists, sorted, the licences that some line is. Null or empty
    texts, and those of copyright lines only, have the digest of the empty string and match
    nothing. Rows that share doc_id and text are told by a hash of the text. Other columns
    are ignored.
    """
    listed = known.select(F.col("license_id"), digest(whole(canonical_lines(F.col("text")))).alias("known")).where(F.col("known") != digest(F.lit("")))
    listed = written(listed.groupBy("known").agg(F.min("license_id").alias("license_id")), "license-digests")
    rows = docs.select("doc_id", F.xxhash64("text").alias("__h"), canonical_lines(F.col("text")).alias("lines"))
    # One pass: the whole text's digest (first) and its lines' are looked up together, and
    # come back together before anything is shuffled.
    digests = F.transform(F.concat(F.array(whole(F.col("lines"))), "lines"), digest)
    each = rows.select("doc_id", "__h", F.posexplode(digests).alias("pos", "known")).join(listed, "known", "left")
    first = F.col("pos") == 0
    out = each.groupBy("doc_id", "__h").agg(
        F.max(F.when(first, F.col("known"))).alias("text_digest"), F.min(F.when(first, F.col("license_id"))).alias("license_id"),
        F.sort_array(F.collect_set(F.when(~first, F.col("license_id")))).alias("line_licenses"), F.count_if(first).alias("__rows"),
    )
    return out.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows")))).select("doc_id", "text_digest", "license_id", "line_licenses")
