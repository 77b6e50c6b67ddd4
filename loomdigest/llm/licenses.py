"""Whole texts that are a known licence, found by the digest of their canonical form.

Canonical: A-Z lowered, copyright notices and titles dropped, equivalent spellings made one,
punctuation and white space runs made one blank. Null and empty texts match nothing; tied rows
each get their match; rows of any column names are read for doc_id and text alone; an empty
table gives no rows. Columns of functions only. The catalogue is the bundled texts, broadcast
as digests and names: some tens of rows, as it is part of the program. SQL knows only the two
of KNOWN.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
# Texts of public licences.
KNOWN = {
    "ISC": f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_AUTHOR}",
    "0BSD": f"{_GRANT}.\n{_AUTHOR}",
}
#: Name and whole text of the bundled licences; a file name's part after @ tells variants of a licence apart.
CATALOGUE = [*KNOWN.items(), *((p.stem.split("@")[0], p.read_text("utf-8")) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt")))]
# Spellings that mean the same.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("https:", "http:"), ("and/or", "and"), ("merchantibility", "merchantability"))
# More of these, for the form that licences are told by.
MORE_SPELLINGS = (("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("emphasis", "emphasiz"), ("favour", "favor"), ("fulfill", "fulfil"), ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"), ("maximis", "maximiz"), ("non-commercial", "noncommercial"), ("offence", "offense"), ("optimis", "optimiz"), ("organis", "organiz"), ("per cent", "percent"), ("programme", "program"), ("realis", "realiz"), ("recognis", "recogniz"), ("sub license", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"))
_NOTICE, _MARKS = "(?m)^[ \\t]*(copyright|\\(c\\)|©)[^\\n]*$", "[\\x00-/:-@\\[-`{-\\x7f\\x{2018}\\x{2019}\\x{201c}\\x{201d}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def canonical(text: Column) -> Column:
    x = F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), _NOTICE, "")
    for other, one in SPELLINGS:
        x = F.replace(x, F.lit(other), F.lit(one))
    return F.trim(F.regexp_replace(x, _MARKS, " "))


#: Punctuation also of other alphabets, and every blank; only the form that licences are told by uses it.
_WIDE_MARKS = "(?:[\\x00-/:-@\\[-`{-\\x7f]|[\\p{P}\\p{Z}])+"
# A notice names a year, mark or holder; on one long line it ends where a licence's text begins.
_BODY = "not|notices?|holders?|owners?|law|laws|and|or|licen[cs]es?|licensed|statements?|interests?|in|to|of|on|by|for|is|the|as|permission|treaty|resulting|disclaimer"
_STARTS = "permission (?:is hereby granted|to use)|redistribution and use|this software is provided|everyone is permitted|$"
_NOTICE_ONLY = f"(?m)^[ \\t]*(?:(?:\\(c\\)|©)[ \\t]*(?:copyright|[0-9]{{4}})|copyright(?![ \\t]+(?:{_BODY})\\b)[ \\t:]+[^ \\t\\n])[^\\n]*?(?={_STARTS})"


# Titles that files put before a licence, in canonical form, and how the texts behind them begin.
_TITLE = "^(?:the )?(?:isc|mit|x11|zlib|0bsd|bsd zero clause|zero clause bsd|bsd [0-9] clause|[0-9] clause bsd|(?:(?:new|modified|revised|simplified|freebsd) )?bsd)(?: (?:new|original|old) or (?:new|revised|original|old))?(?: license)?(?: (?:mit|isc|bsd|x11|0bsd))? (?=permission |redistribution and use |this software is provided )"


def matched(text: Column) -> Column:
    """The canonical form that licences are told by.

    Lines of the body that begin with 'copyright' stay. A title line before the text goes, as
    do lines of which "all rights reserved" is all that a notice leaves.
    """
    x = F.translate(text, _UPPER, _UPPER.lower())
    x = F.regexp_replace(x, _NOTICE_ONLY, "")
    x = F.regexp_replace(x, "(?m)^[ \\t]*all rights reserved\\.?[ \\t]*\\r?$", "")
    for other, one in SPELLINGS + MORE_SPELLINGS:
        x = F.replace(x, F.lit(other), F.lit(one))
    return F.regexp_replace(F.trim(F.regexp_replace(x, _WIDE_MARKS, " ")), _TITLE, "")


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest (of the canonical text, hex) and license (null where none is known, of CATALOGUE or those given)."""
    spark = docs.sparkSession
    pairs = [F.struct(F.lit(k).alias("license"), F.lit(v).alias("known")) for k, v in sorted(CATALOGUE if known is None else known.items())]
    names = spark.range(1).select(F.inline(F.array(*pairs)))
    found = []
    # what the digest's own form finds, as SQL does, stays found
    for form, key in ((matched, "match"), (canonical, "digest")):
        found.append(F.broadcast(names.groupBy(F.sha2(form(F.col("known")), 256).alias(key)).agg(F.min("license").alias(f"by_{key}"))))
    text = F.coalesce("text", F.lit(""))
    digests = docs.select("doc_id", F.sha2(canonical(text), 256).alias("digest"), F.sha2(matched(text), 256).alias("match"))
    return digests.join(found[0], "match", "left").join(found[1], "digest", "left").select("doc_id", "digest", F.coalesce("by_match", "by_digest").alias("license"))


def _canonical_sql(x: str) -> str:
    x = f"regexp_replace(translate({x}, '{_UPPER}', '{_UPPER.lower()}'), '{_NOTICE}', '', 'g')"
    for other, one in SPELLINGS:
        x = f"replace({x}, '{other}', '{one}')"
    return f"sha256(trim(regexp_replace({x}, '{_MARKS}', ' ', 'g')))"


_TEXT = "coalesce(text, '')"
_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in KNOWN.items())
SQL = f"WITH c AS (SELECT {_canonical_sql('t')} AS digest, min(n) AS license FROM (VALUES {_ROWS}) AS k(n, t) GROUP BY 1), d AS (SELECT doc_id, {_canonical_sql(_TEXT)} AS digest FROM documents) SELECT doc_id, d.digest, license FROM d LEFT JOIN c USING (digest)"
