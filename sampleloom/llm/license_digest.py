"""Licence scans by canonical digest: entire texts, and entire lines of texts, are looked up among known licence texts.

A text's canonical form is lower-cased, loses its copyright lines, has equivalent spellings unified, and keeps only
letters, digits and line ends; runs of anything else become one space. The whole canonical text (line ends as spaces)
and each of its lines are hashed, and digests are matched with those of the known texts, so long texts cost one digest
and no text is compared with another. The known texts are one-line notices and the full licences of ``licenses``, with and
without title and appendix (``full_texts``). Digests are computed once and stored; whole texts and lines then meet the known
digests in hash joins, however many are known, and only matches are grouped, by a number of the row.

Null and empty texts have the digest of the empty text and match nothing; known texts that are empty in canonical form
are ignored. Repeated rows give equal rows. Ties between licences with equal canonical texts go to the smaller id.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, store, table

#: Equivalent spellings: the word on the left counts as the word on the right (fixed values).
EQUIVALENT = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("behaviour", "behavior"),
    ("per cent", "percent"),
    ("and or", "andor"),
    ("v2", "version 2"),
    ("v3", "version 3"),
]

#: Known licence texts: notices of one line, and short licences in full (fixed values).
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

#: What may stand before a notice in its line; what makes a line a notice anywhere; what is a notice only where a paragraph or
#: the text's second line begins, or after other notices. Wrapped lines of a body that begin with "copyright" are none.
_LEAD = r"[ \t\r#*/;-]*"
_YEAR = r"(?:19|20)\d\d"
SURE_NOTICE = rf"(^|\n){_LEAD}(?:©|(?:copyright[ \t:,-]*(?:©|\(c\))|copyright[ \t:,-]*(?:{_YEAR}|[<\[{{])|\(c\)[ \t:,-]*(?:copyright\b|{_YEAR}|[<\[{{])))[^\n]*"
FIRST_NOTICE = rf"(^|^[^\n]*\n|\n{_LEAD}\n)(?:{_LEAD}(?:copyright\b(?!\s+(?:holder|owner|notice|law|licen|statement|interest|protect|treat|act\b|and\b|or\b))|\(c\)[^\n]*\b{_YEAR}\b)[^\n]*(?:\n|$))+"
NOT_KEPT = r"[^\p{L}\p{N}\n]+"
EDGES = r" *\n[ \n]*"


def canonical(text: Column) -> Column:
    """Canonical lines of a text, separated by line ends; no spaces at their edges and no empty lines between."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SURE_NOTICE, "\n"), FIRST_NOTICE, "$1\n")
    return _tidy(_unified(F.regexp_replace(F.regexp_replace(x, NOT_KEPT, " "), "\n", " \n "), EQUIVALENT))


def _unified(x: Column, spellings: list[tuple[str, str]]) -> Column:
    """Every word has blanks of its own on both sides, so that one replacement takes none from the next."""
    x = F.concat(F.lit(" "), F.regexp_replace(x, " +", "  "), F.lit(" "))
    for word, same in spellings:
        x = F.replace(x, F.lit(f" {word.replace(' ', '  ')} "), F.lit(f" {same.replace(' ', '  ')} "))
    return x


def _tidy(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, " +", " "), EDGES, "\n"), "^[ \n]+|[ \n]+$", "")


def whole(lines: Column) -> Column:
    return F.sha2(F.replace(lines, F.lit("\n"), F.lit(" ")), 256)


def unwrapped(lines: Column) -> Column:
    """The digest by which whole texts are looked up: spellings of two words are unified where a line ended in them, too."""
    x = _unified(F.replace(lines, F.lit("\n"), F.lit(" ")), [(word, same) for word, same in EQUIVALENT if " " in word])
    return F.sha2(F.trim(F.regexp_replace(x, " +", " ")), 256)


#: Other titles of the licences that ``KNOWN`` has in full; the files of ``licenses`` begin with theirs.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "MIT/X11 License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
}
#: Wordings that differ between published copies of a text, the first of them in our files: each is tried in all of a text.
ADDRESS = r"51 Franklin St(?:reet)?, Fifth Floor, Boston, MA\s+02110-1301,?\s+USA"
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA"]


def _wordings(text: str) -> set[str]:
    """A body as it is, with other addresses of its publisher, without the one at its top, with other links, without numbers."""
    found = {text} | {re.sub(ADDRESS, x, text) for x in ADDRESSES}
    found |= {re.sub(rf"\A\s*(?:{'|'.join(map(re.escape, [*ADDRESSES, '<https://fsf.org/>']))}|{ADDRESS})", "", x) for x in found}
    if len(text) < 2000:
        found |= {re.sub(r"(?m)^[ \t]*\d\.", "", x) for x in found}
    return {re.sub("https?://", way, x) for x in found for way in ("http://", "https://")}


def full_texts() -> list[tuple[str, str]]:
    """(license, text): every full licence with and without title, "all rights reserved" (short ones) and appendix.

    A file is its titles, one to a paragraph, its body, and its appendix if it has one, separated by lines of ``%%``.
    """
    parts = [(k, TITLES[k], [t]) for k, t in KNOWN if "\n" in t]
    for file in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            titles, *rest = file.read_text(encoding="utf-8").split("\n%%\n")
            parts.append((file.name[:-4].removesuffix("-Regents"), titles.split("\n\n"), rest))
    found = set()
    for name, titles, (body, *appendix) in parts:
        for text in {x for whole_text in (body, "\n".join([body, *appendix])) for x in _wordings(whole_text)}:
            for title in ["", *titles]:
                found |= {(name, f"{title}\n\n{rights}\n\n{text}") for rights in ("", *(["All rights reserved."] if len(body) < 2000 else []))}
    return sorted(found)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(digest, license): digests of known texts, each once."""
    texts = known if isinstance(known, DataFrame) else spark.createDataFrame([*KNOWN, *full_texts()] if known is None else known, "license string, text string")
    lines = texts.select("license", canonical(F.col("text")).alias("lines")).where("lines <> ''")
    return lines.groupBy(unwrapped(F.col("lines")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, digest, license, notices): the digest of the canonical text, the licence that this text is, and the licences
    that lines of it are, sorted and comma-joined; empty where there is none."""
    lines = docs.select(F.col(key).alias("key"), canonical(F.col("text")).alias("lines"))
    each = F.array_distinct(F.transform(F.split("lines", "\n"), lambda line: F.sha2(line, 256)))
    digests = lines.select(F.monotonically_increasing_id().alias("row"), "key", whole(F.col("lines")).alias("digest"), unwrapped(F.col("lines")).alias("whole"), each.alias("each"))
    with scratch(docs.sparkSession, "licences") as keep:
        digests = keep(digests, "digests")
        notices = digests.select("row", F.explode("each").alias("line")).join(known.select(F.col("digest").alias("line"), "license"), "line")
        notices = notices.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
        found = digests.drop("each").join(known.select(F.col("digest").alias("whole"), "license"), "whole", "left").join(notices, "row", "left")
        return store(found.select(F.col("key").alias(key), "digest", F.coalesce("license", F.lit("")).alias("license"), F.coalesce("notices", F.lit("")).alias("notices")), "licences")


def op8_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest, whole-text licence and licence notices of every document."""
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


#: The SQL knows the texts of ``KNOWN`` alone and takes every line that begins with "copyright" for a notice.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright|©|\(c\))[^\n]*"


def _sql_canonical(x: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"regexp_replace(lower(coalesce({x}, '')), {q(COPYRIGHT_LINE)}, chr(10), 'g')"
    x = f"' ' || regexp_replace(regexp_replace(regexp_replace({x}, {q(NOT_KEPT)}, ' ', 'g'), chr(10), ' ' || chr(10) || ' ', 'g'), ' +', '  ', 'g') || ' '"
    for word, same in EQUIVALENT:
        x = f"replace({x}, {q(' ' + word.replace(' ', '  ') + ' ')}, {q(' ' + same.replace(' ', '  ') + ' ')})"
    return f"regexp_replace(regexp_replace(regexp_replace({x}, ' +', ' ', 'g'), {q(EDGES)}, chr(10), 'g'), {q('^[ \\n]+|[ \\n]+$')}, '', 'g')"


_VALUES = ",\n  ".join("('{}', '{}')".format(k, t.replace("'", "''").replace("\n", "' || chr(10) || '")) for k, t in KNOWN)
OP8_SQL = f"""
WITH known AS (
  SELECT sha256(replace(lines, chr(10), ' ')) AS digest, min(license) AS license
  FROM (SELECT license, {_sql_canonical('text')} AS lines FROM (VALUES
  {_VALUES}) k(license, text)) WHERE lines <> '' GROUP BY 1),
d AS (SELECT doc_id, {_sql_canonical('text')} AS lines FROM documents),
e AS (SELECT doc_id, sha256(replace(lines, chr(10), ' ')) AS digest, lines FROM d),
l AS (SELECT DISTINCT e.doc_id, e.digest, known.license FROM (SELECT doc_id, digest, sha256(unnest(string_split(lines, chr(10)))) AS line FROM e) e
      JOIN known ON known.digest = e.line),
n AS (SELECT doc_id, digest, string_agg(license, ',' ORDER BY license) AS notices FROM l GROUP BY 1, 2)
SELECT e.doc_id, e.digest, coalesce(known.license, '') AS license, coalesce(n.notices, '') AS notices
FROM e LEFT JOIN known ON known.digest = e.digest LEFT JOIN n ON n.doc_id = e.doc_id AND n.digest = e.digest
"""
