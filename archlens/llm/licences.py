"""Licences of documents by canonical digests.

A text is reduced to its words: letter case, punctuation, comment markers,
copyright lines and spelling variants go. The digest of what is left is hash-joined with the
digests of known licences. Lines are looked up the same way, as licence
notices often stand alone in one.
"""
from __future__ import annotations

import functools
import hashlib
import re
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from archlens.llm.batches import bounded
from archlens.llm.registry import query, table
from archlens.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
COPYRIGHT = re.compile(
    r"^[^\w\n]*(?:copyright[ \t]*(?:\(c\)|©|\d{4}|by\b|[\[{<]|notice[ \t]*>"
    r"|(?-i:(?<=Copyright)[ \t]+(?!Holder|Owner|Law|Notice|License|Act)[A-Z]))"
    r"|\(c\)[ \t]*\d{4}|©|all rights reserved\b)[^\n]*",
    re.IGNORECASE | re.MULTILINE)

# fixed values: spellings taken as equal
EQUAL_WORDS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "behaviour": "behavior", "centre": "center", "favour": "favor", "fulfil": "fulfill",
    "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "licence": "license", "licenced": "licensed", "licences": "licenses", "licencing": "licensing",
    "merchantibility": "merchantability", "noncommercial": "non commercial", "organisation": "organization",
    "organisations": "organizations", "recognised": "recognized", "sublicence": "sublicense", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful"}

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE.")

# fixed values: licences and notices known from the start, (name, text); the published forms are in full_texts
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
            "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
            "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
            "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
            "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. "
            f"{_NO_WARRANTY}"),
    ("0BSD", f"{_GRANT}. {_NO_WARRANTY}"),
]


def _text(name: str) -> str:
    return resources.files(__package__).joinpath("licence_texts", f"{name}.txt").read_text(encoding="utf-8")


def _titled(name: str, bodies: list[str], titles: list[str]) -> list[tuple[str, str]]:
    return [(name, f"{title}\n{body}") for body in bodies for title in ["", *titles]]


def _with(bodies: list[str], old: str, *new: str) -> list[str]:
    """The bodies, and each with the words ``old`` in other published wordings."""
    words = re.compile(r"\s+".join(map(re.escape, old.split())))
    return bodies + [words.sub(lambda _, n=n: n, body) for body in bodies if words.search(body) for n in new]


def _without_end(text: str, marks: str) -> list[str]:
    """The text whole, and up to each line that starts what is often left out."""
    return [text, *(text[:m.start()] for m in re.finditer(marks, text, re.MULTILINE))]


@functools.cache
def full_texts() -> list[tuple[str, str]]:
    """Entire licences in the forms in which they are published: with and without title, appendix and numbers."""
    body = {n: t for n, t in KNOWN if len(t) > 300}
    known = _titled("MIT", [body["MIT"]], [
        "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "The MIT License:",
        "Expat License", "The Expat License", "Licensed under the MIT License", "This software is released under the MIT License"])
    isc = _with([body["ISC"]], "and/or distribute", "and distribute")
    known += _titled("ISC", isc, ["ISC License", "The ISC License", "ISC License (ISC)", "ISC", "Internet Systems Consortium license"])
    known += _titled("0BSD", [body["0BSD"]], ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD"])

    unnumbered = lambda texts: texts + [re.sub(r"^\d\.", "*", t, flags=re.MULTILINE) for t in texts]
    two = _with(unnumbered([_text("BSD-2-Clause")]), "COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR", "COPYRIGHT HOLDERS OR", "AUTHOR OR")
    two += [x.replace("COPYRIGHT HOLDERS AND", "AUTHOR AND") for x in two if "AUTHOR OR" in x]
    known += _titled("BSD-2-Clause", two, [
        "BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause", "Simplified BSD License", "FreeBSD License", "BSD License",
        "The BSD License", "BSD-2-Clause", "BSD 2-Clause \"Simplified\" License"])
    three = _text("BSD-3-Clause")
    held = [three] + [re.sub(r"REGENTS\s+OR", f"{one} OR", re.sub(r"REGENTS\s+AND", "COPYRIGHT HOLDERS AND", three))
                      for one in ("COPYRIGHT HOLDER", "COPYRIGHT OWNER", "COPYRIGHT HOLDERS")]
    held = _with(unnumbered(held), "the name of the University", "the name of the copyright holder",
                 "the name of the copyright holders", "the names of the copyright holders", "the name of the organization",
                 "the name of the author", "the name of the owner")
    held = _with(held, "names of its contributors may", "names of the contributors may", "names of any contributors may")
    known += _titled("BSD-3-Clause", held, [
        "BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause", "The 3-Clause BSD License", "New BSD License", "Modified BSD License",
        "Revised BSD License", "BSD License", "The BSD License", "BSD-3-Clause", "BSD 3-Clause \"New\" or \"Revised\" License"])

    apache = _without_end(_text("Apache-2.0"), r"^\s*(?:END OF TERMS AND CONDITIONS|APPENDIX: )")
    known += [("Apache-2.0", x) for x in apache]
    known += _titled("Apache-2.0", [apache[0][apache[0].index("Licensed under the Apache License"):]], [])
    ends = r"^\s*(?:END OF TERMS AND CONDITIONS|(?:Appendix: )?How to Apply These Terms)"
    offices = ["59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
               "<https://fsf.org/>", ""]
    for name in ("GPL-2.0", "LGPL-2.1"):
        texts = _with([_text(name)], "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", *offices)
        known += [(name, x) for text in texts for x in _without_end(text, ends)]
    known += [("GPL-3.0", x) for x in _without_end(_text("GPL-3.0"), ends)] + [("LGPL-3.0", _text("LGPL-3.0"))]
    known += [("MPL-2.0", x) for x in _without_end(_text("MPL-2.0"), r"^Exhibit [AB] - ")]
    known += [("CC0-1.0", _text("CC0-1.0"))]
    free = _text("Unlicense")
    return known + _titled("Unlicense", _without_end(free, "^For more information"), ["The Unlicense", "Unlicense"])


def canonical(text: str) -> str:
    """The words that tell a licence apart."""
    words = WORD.findall(COPYRIGHT.sub("", text).casefold())
    return " ".join([EQUAL_WORDS.get(w, w) for w in words])


def digest(text: str) -> bytes | None:
    """Digest of a canonical text; none where no word is left."""
    return hashlib.blake2b(text.encode(), digest_size=16).digest() if text else None


DIGESTS = T.StructType([T.StructField("whole", T.BinaryType()), T.StructField("lines", T.ArrayType(T.BinaryType()))])


@F.arrow_udf(DIGESTS)
def _digests(texts: pa.Array) -> pa.Array:
    whole, lines = [], []
    for text in texts.to_pylist():
        own = [canonical(x) for x in (text or "").split("\n")]
        # the copyright rule and the words both stop at line ends, so lines joined are the whole text
        own = [x for x in own if x]
        whole.append(digest(" ".join(own)))
        lines.append([digest(x) for x in own] if len(own) > 1 else [])
    return pa.StructArray.from_arrays([pa.array(whole, pa.binary()), pa.array(lines, pa.list_(pa.binary()))],
                                      DIGESTS.names)


def known_licences(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(licence, known) of a fixed list of texts (default: all that are known from the start); of texts that are equal in canonical form the first counts."""
    rows: dict[bytes, str] = {}
    for name, text in KNOWN + full_texts() if known is None else known:
        key = digest(canonical(text))
        if key:
            rows.setdefault(key, name)
    return spark.createDataFrame([(v, k) for k, v in rows.items()], "licence string, known binary")


def find_licences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                  known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, licence, notices) per row of ``docs``.

    ``licence`` is that of the entire text, null if it is none; ``notices`` are
    the licences that single lines of a longer text state, each once, sorted.
    Null and empty texts have neither. The list of known texts is part of the
    program, so its few digests are broadcast, and only hits are shuffled.
    """
    read = cut_lineage(bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
                       .withColumn("d", _digests.asNondeterministic()("text"))
                       .select("doc_id", "d.whole", "d.lines"))
    names = F.broadcast(known_licences(docs.sparkSession, known))
    hits = (read.select("doc_id", "whole", F.explode("lines").alias("known")).join(names, "known")
            .groupBy(F.col("doc_id").alias("hit_id"), F.col("whole").alias("hit_whole"))
            .agg(F.sort_array(F.collect_set("licence")).alias("notices")))  # at most the known names
    entire = read.join(names.withColumnRenamed("known", "whole"), "whole", "left").drop("lines")
    return (entire.join(hits, entire["doc_id"].eqNullSafe(hits["hit_id"])
                        & (entire["whole"] == hits["hit_whole"]), "left")
            .select("doc_id", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices")))


@query("op6_licences")
def op6_licences(spark, sf_dir: str) -> DataFrame:
    """Licence of every document and the licences its lines state."""
    return find_licences(table(spark, sf_dir, "documents"))
