"""Licence scan by canonical digest: whole texts, and whole lines of texts, looked up among known licences.

A text is made canonical (case, copyright lines, punctuation, spacing, equivalent spellings, also across line ends), its digest
is taken, and documents are hash-joined to the digests of the known licences.  Notices stand in documents as lines
of their own, so each line is looked up the same way; a line longer than every known notice isn't hashed, as it is none.
DataFrame functions only; nothing is shuffled: the known licences are a table of at most KNOWN_ROWS rows, which is what
bounds the broadcast.

Defined results: null, empty or blank text, and text of copyright lines alone, has no digest and no licence; of several
known licences with one digest the first by name counts; repeated rows are scanned one by one, whatever their ids; a very long
text is worked on whole (a few copies of it); extra columns are kept unless they have the name of a result
column, which replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table of known licences may have.
KNOWN_ROWS = 20_000

# Spellings that count as equal, as in the SPDX matching guidelines, when punctuation is single spaces.
EQUIVALENT = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("per cent", "percent"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("http ", "https "),
]
#: Lines that begin like this state who holds the rights, not under which terms.  A sign or a year has to follow, as
#: "copyright holders" may well begin a wrapped line of the terms.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"

_WARRANTY = (
    'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of '
    "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any "
    "claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the "
    "software or the use or other dealings in the software."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited '
    "to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or "
    "contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, "
    "procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of "
    "liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this "
    "software, even if advised of the possibility of such damage."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of '
    "merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages "
    "whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or "
    "in connection with the use or performance of this software."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
    'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
    "the specific language governing permissions and limitations under the License."
)

# Known licence texts and notices (licence, whole text).
FULL_TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT),
    ("MIT", "The MIT License (MIT) " + _MIT),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("0BSD", _ISC + ". " + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL),
    ("Apache-2.0", _APACHE),
]
# Names that notices use (licence, name).
NAMES = [
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
]
#: Sentences that give a name as the terms of the work around them.
FRAMES = [
    "{}",
    "Licensed under {}",
    "Licensed under the {}",
    "Released under {}",
    "Released under the {}",
    "Distributed under the {}",
    "This work is licensed under {}",
    "This work is licensed under the {}",
    "This software is licensed under the {}",
    "This project is licensed under the {}",
]


# Digests of the canonical full texts of further licences (from the collection of common licences that Linux
# distributions carry), which take too much room here.
FULL_DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "808c2341a5af49e02957457fcc086dc6"),
    ("Artistic-1.0-Perl", "c1b81bf4478b19597097b63e59382266"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "0ddc974af2022d1eb483df77268fc903"),
    ("GFDL-1.3", "6dcd514fc8d59959d92fedf319737026"),
    ("GPL-1.0", "b37a688f44419d3168b23775b65749eb"),
    ("GPL-2.0", "422f821c6c0b1812cbde7c1c3be04922"),
    ("GPL-3.0", "e21beb57088fc774cab16ba014b70f2d"),
    ("LGPL-2.0", "ebf358251bfe9161668a8c8251261977"),
    ("LGPL-2.1", "1ff066c677365f47fea81c911a7c822e"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "9cdb0c94cb45abb55c616e067859d4ad"),
    ("MPL-2.0", "db12a21e89062c14ac06f7d6aa8123d5"),
]


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): full texts, each name in each frame, and SPDX tags."""
    tags = sorted({x for x, _ in NAMES + FULL_TEXTS + FULL_DIGESTS})
    return [*FULL_TEXTS, *((x, f.format(n)) for x, n in NAMES for f in FRAMES), *((x, f"SPDX-License-Identifier: {x}") for x in tags)]


def _lines(text: Column) -> Column:
    """The text in canonical form, line ends kept."""
    x = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    x = F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\n]+", " ")
    for old, new in EQUIVALENT:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def _whole(lines: Column) -> Column:
    """Lines in canonical form as one: spellings that a line end had parted are made equal as well."""
    x = F.regexp_replace(lines, r"[ \n]+", " ")
    for old, new in EQUIVALENT:
        if " " in old.strip():
            x = F.replace(x, F.lit(old), F.lit(new))
    return F.nullif(F.trim(x), F.lit(""))


def canonical(text: Column) -> Column:
    """The text without case, copyright lines, variant spellings, punctuation and spacing; null if nothing is left."""
    return _whole(_lines(text))


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """licence, digest, size (of the canonical text; null where only its digest is known); one row per digest.

    texts: further known licences (licence, text).
    """
    rows = spark.createDataFrame(known_texts(), "licence string, t string")
    if texts is not None:
        rows = rows.union(texts.select("licence", "text"))
    rows = rows.withColumn("t", canonical(F.col("t"))).where("t is not null").select("licence", F.md5("t").alias("digest"), F.length("t").alias("size"))
    if FULL_DIGESTS:
        rows = rows.union(spark.createDataFrame([(*x, None) for x in FULL_DIGESTS], "licence string, digest string, size int"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"), F.max("size").alias("size"))


def licence_scan(docs: DataFrame, text: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """The documents with `digest` of the canonical text, `licence` whose text it is (or null), `notices` (sorted
    licences that lines of it state) and `notice_lines` (how many lines do).

    texts: known licences (licence, text) beside those of this module.
    """
    spark = docs.sparkSession
    lookup = known(spark, texts).orderBy("digest").limit(KNOWN_ROWS + 1).collect()
    if len(lookup) > KNOWN_ROWS:
        raise ValueError(f"at most {KNOWN_ROWS} known texts")
    notices = [r for r in lookup if r["size"] is not None]
    longest = max(r["size"] for r in notices)
    pairs = F.map_from_arrays(F.array(*(F.lit(r.digest) for r in notices)), F.array(*(F.lit(r.licence) for r in notices)))
    names, results = docs.columns, ("digest", "licence", "notices", "notice_lines")
    base = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("lines", _lines(F.col(f"c{names.index(text)}").cast("string")))
    short = F.filter(F.transform(F.split("lines", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x).between(1, longest))
    # a set first, as looking up in a map goes through all of it
    stated = F.filter(F.transform(short, F.md5), lambda x: x.isin(*(r.digest for r in notices)))
    stated = F.coalesce(F.transform(stated, lambda x: F.element_at(pairs, x)), F.array().cast("array<string>"))
    table = spark.createDataFrame([(r.digest, r.licence) for r in lookup], "known string, licence string")
    out = base.withColumn("digest", F.md5(_whole(F.col("lines")))).withColumn("stated", stated).join(F.broadcast(table), F.col("digest") == F.col("known"), "left")
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in results]
    return out.select(*kept, "digest", "licence", F.array_sort(F.array_distinct("stated")).alias("notices"), F.size("stated").alias("notice_lines"))
