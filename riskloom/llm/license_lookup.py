"""Licence scans by canonical digest lookup.

Known licence texts and scanned texts go through one canonical form: lower
case, no copyright statements, equivalent spellings unified, punctuation and
white space folded.  Ahead of the body every title line and every line that
begins like a notice goes; in the body, whose wrapped lines may begin with "copyright" too, only
statements with a sign or a year.  The SHA-256 of the whole form is joined with the digests of the
known texts.  The scanned texts are each document and each of its lines (a
document often carries a notice on a line of its own).  DataFrame expressions
only; the same rules run in any SQL engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare

# Pairs of spellings that licence matching treats as one word.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"),
    ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisation", "capitalization"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("merchantability", "merchantability"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("rights holder", "rightsholder"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"),
    ("https", "http"),
]

# Short public licence texts and the customary one-line notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
KNOWN = [
    ("MIT", MIT),
    ("ISC", ISC),
    ("0BSD", ZERO_BSD),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

# The licences whose published texts are in ``licenses/``.
PUBLISHED = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only",
             "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib"]
END = "END OF TERMS AND CONDITIONS"


def bodies() -> list[tuple[str, str]]:
    """(licence, text) of the published texts in ``licenses/``, and as they are
    often shortened: without what follows the terms, without the notice ahead
    of CC0, and BSD lists with bullets.  They are package data, read wherever
    the package is installed, also from a zip; it is an error if one is missing."""
    out = []
    folder = resources.files(__package__) / "licenses"
    for name in PUBLISHED:
        text = (folder / f"{name}.txt").read_text(encoding="utf-8")
        out.append((name, text))
        if END in text:
            terms = text[:text.index(END)]
            out += [(name, terms), (name, terms + END)]
        if name == "CC0-1.0":
            out.append((name, text[text.index("Statement of Purpose"):]))
        if name.startswith("BSD"):
            out.append((name, re.sub(r"(?m)^\s*\d\.\s", "* ", text)))
    return out


# Folded title lines (and the publisher's address below them), which
# texts have or lack ahead of the body.
TITLES = [
    "mit license", "the mit license", "the mit license mit", "mit license mit", "expat license",
    "isc license", "the isc license", "isc license isc", "the isc license isc", "isc license iscl",
    "bsd zero clause license", "zero clause bsd", "zero clause bsd license", "0bsd license", "bsd zero clause license 0bsd",
    "bsd license", "the bsd license", "bsd 2 clause license", "the bsd 2 clause license", "the 2 clause bsd license",
    "2 clause bsd license", "simplified bsd license", "bsd 2 clause simplified license", "bsd 3 clause license",
    "the bsd 3 clause license", "the 3 clause bsd license", "3 clause bsd license", "new bsd license", "modified bsd license",
    "revised bsd license", "bsd 3 clause new or revised license", "zlib license", "the zlib license", "unlicense", "the unlicense",
    "apache license", "version 2 0 january 2004", "http www apache org licenses", "https www apache org licenses",
    "apache license version 2 0", "apache license version 2 0 january 2004",
    "gnu general public license", "gnu lesser general public license", "version 2 june 1991", "version 2 1 february 1999",
    "version 3 29 june 2007", "51 franklin street fifth floor boston ma 02110 1301 usa",
    "59 temple place suite 330 boston ma 02111 1307 usa", "http fsf org", "https fsf org",
    "mozilla public license", "version 1 1", "version 2 0", "mozilla public license version 1 1", "mozilla public license version 2 0",
    "creative commons legal code", "cc0 1 0 universal", "creative commons cc0 1 0 universal",
]
TITLES = sorted({*TITLES, *(t.replace("license", "licence") for t in TITLES)})

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOTICE = r"^[^a-z0-9]*(copyright|\(c\)|©|all rights reserved)"
STATEMENT = (r"^[^a-z0-9]*((\(c\)[^a-z0-9]*)?copyright[^a-z0-9]*(\(c\)|©|[0-9]{4}|yyyy|year\b)"
             r"|\(c\)[^a-z0-9]*([0-9]{4}|yyyy|year\b)|©|all rights reserved[^a-z0-9]*$)")
SQL_NOTICE_LINE = r"^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not once per line."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lower_lines(text: Column) -> Column:
    return F.split(F.translate(text, UPPER, LOWER), "\n")


def _fold(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, PUNCTUATION, " "))


def folded_lines(text: Column) -> Column:
    """A text's lines, each as a text of its own: in lower case with punctuation
    and white space folded; copyright lines are empty."""
    return F.transform(_lower_lines(text), lambda x: F.when(x.rlike(NOTICE), F.lit("")).otherwise(_fold(x)))


def _in_body(folded: Column) -> Column:
    return (folded != "") & ~folded.isin(TITLES)


def body_lines(text: Column) -> Column:
    """The folded lines of a whole text; empty are the titles and copyright lines
    ahead of the first other line, and after it the copyright statements.  A
    text of titles only keeps them."""
    def keep(lines: Column) -> Column:
        # From 1; 0 if there is no body.
        first = F.array_position(F.transform(lines, lambda x: ~x.rlike(NOTICE) & _in_body(_fold(x))), F.lit(True))
        rest = lambda x, i, f: F.when(f == 0, x.rlike(NOTICE)).when(i < f - 1, F.lit(True)).otherwise(x.rlike(STATEMENT))
        return _let(first, lambda f: F.transform(lines, lambda x, i: F.when(rest(x, i, f), F.lit("")).otherwise(_fold(x))))
    return _let(_lower_lines(text), keep)


def unify(folded: Column) -> Column:
    """Equivalent spellings of a folded text made one."""
    c = F.concat(F.lit(" "), folded, F.lit(" "))
    for a, b in SPELLINGS:
        if a != b:
            c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(c)


def _join(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    return unify(_join(body_lines(text)))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN + bodies(), "license string, text string")


def license_matches(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text_license (licence whose canonical text is
    the whole document's), line_licenses (sorted, comma-joined licences of its
    lines) and n_license_lines.

    Null texts, and texts that are empty in canonical form, match nothing; a
    line that repeats counts each time; known texts with one form give the
    smallest of their names; null and repeated ids stay rows of their own; an
    empty table on either side is allowed.  Other columns are not read."""
    prepare(df.sparkSession)
    scratch = Scratch(df.sparkSession, "licenses")
    forms = known.select("license", canonical(F.col("text")).alias("form")).filter("form <> ''")
    digests = scratch.write(forms.groupBy("form").agg(F.min("license").alias("license"))
                            .select("license", "form", F.length("form").alias("n"), F.sha2("form", 256).alias("digest")))
    # Equal texts have equal lengths and bodies that begin with the same word, up to its
    # spelling: only such texts are unified and digested.  Both lists have at most
    # one entry per known text.
    lengths = [r[0] for r in digests.select("n").distinct().collect()]
    heads = {r[0] for r in digests.select(F.substring_index("form", " ", 1)).distinct().collect()}
    for _ in SPELLINGS:  # a spelling may lead to another one's
        heads |= {a.split()[0] for a, b in SPELLINGS if b.split()[0] in heads}
    begins = lambda c: F.substring_index(c, " ", 1).isin(sorted(heads)) if heads else F.lit(False)
    fits = lambda c: F.length(c).isin(lengths) if lengths else F.lit(False)
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    split = src.select(F.monotonically_increasing_id().alias("row"), "id", "text", folded_lines(F.col("text")).alias("lines"))
    near = split.select("row", "id", F.filter("lines", begins).alias("lines"), F.when(
        begins(F.coalesce(*[F.get(F.filter("lines", f), F.lit(0)) for f in (_in_body, lambda x: x != "")])) if heads else F.lit(False), _join(body_lines(F.col("text")))).alias("whole"))
    whole = F.when(F.col("whole").isNotNull(), unify(F.col("whole")))
    rows = scratch.write(near.select("row", "id", whole.alias("whole"), F.transform("lines", unify).alias("lines")).select(
        "row", "id", F.when(fits(F.col("whole")), F.sha2("whole", 256)).alias("whole"),
        F.transform(F.filter("lines", fits), lambda c: F.sha2(c, 256)).alias("lines")))
    found = (rows.select("row", F.explode("lines").alias("digest")).join(digests, "digest")
             .groupBy("row").agg(F.count(F.lit(1)).alias("n_license_lines"),
                                 F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses")))
    # A row has at most one whole-text digest, so this join cannot multiply rows.
    named = rows.select("row", "id", "whole").join(
        digests.select(F.col("digest").alias("whole"), F.col("license").alias("text_license")), "whole", "left")
    return (named.join(found, "row", "left")
            .select(F.col("id").alias(id_col), "text_license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
                    F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines")))


def canonical_sql(expr: str) -> str:
    """The canonical form as an SQL expression."""
    c = f"regexp_replace(translate({expr}, '{UPPER}', '{LOWER}'), '{SQL_NOTICE_LINE}', '', 'gm')"
    c = f"' ' || trim(regexp_replace({c}, '{PUNCTUATION}', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        if a != b:
            c = f"replace({c}, ' {a} ', ' {b} ')"
    return f"trim({c})"
