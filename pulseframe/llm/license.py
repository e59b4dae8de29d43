"""License scans by canonical digests: an entire text, made canonical, either has the digest of a known one or not.

Canonical: ASCII lower case; lines that claim a copyright go, with a year or without; equivalent spellings become one; whatever isn't
a letter or digit becomes one space. Only DataFrame functions are used; the known digests come from the same
functions, so that both sides agree.

Defined results: a null text and a text without letters or digits have no digest and no licence; repeated
rows give the same result each; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without
from .license_texts import full_texts

# Spellings that licences use for one another; the left becomes the right.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("sub license", "sublicense"),
    ("utilise", "utilize"), ("whilst", "while"), ("wilful", "willful"), ("non commercial", "noncommercial"), ("per cent", "percent"),
]

# Texts of public licences, and notices that stand for one.
KNOWN = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]
KNOWN += full_texts(KNOWN[0][1], KNOWN[1][1])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words that follow "copyright" where a line of a licence's own text begins with it.
NOT_CLAIMS = ("notice", "holder", "owner", "law", "licen", "statement", "interest", "permission", "protection", "and", "or ", "in ", "is ", "to ", "on ", "as ", "treaty", "disclaimer", "act ", "control", "claim", "work", "management", "conditions", "information", "resulting", "doctrine")
CLAIM = r"(?m)^[^a-z0-9\n]*(copyright([^a-z_\n][^\n]*)?|\(c\)[^\n]*|©[^\n]*)$"


def canonical(text: Column) -> Column:
    c = F.translate(text, UPPER, LOWER)
    own = c
    for word in NOT_CLAIMS:
        own = F.replace(own, F.lit(f"copyright {word}"), F.lit(f"copyright_{word}"))
    claims = F.contains(c, F.lit("copyright")) | F.contains(c, F.lit("(c)")) | F.contains(c, F.lit("©"))
    c = F.when(claims, F.regexp_replace(own, CLAIM, " ")).otherwise(c)  # most texts have none
    c = F.concat(F.lit(" "), F.regexp_replace(c, r"[^a-z0-9]+", " "), F.lit(" "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.regexp_replace(F.trim(c), " +", " ")


def digest(text: Column) -> Column:
    c = canonical(text)
    return F.when(c != "", F.sha2(c, 256))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(license_digest, license_id), a row for each known text; as many as `known` has."""
    rows = spark.createDataFrame(known, "license_id string, t string")
    return rows.groupBy(digest(F.col("t")).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def _sources(word: str) -> set[str]:
    """Words of which a line holds at least one if its canonical text holds word."""
    found = {word}
    while True:
        more = {max(a.split(), key=len) for a, b in SPELLINGS for w in found if w in b.split()}
        if more <= found:
            return found
        found |= more


def needed(texts: list[str]) -> str:
    """A pattern that every line matches whose canonical text is one of texts: long words, together in all texts, those in most of them first.

    Canonical words stand in their line as they are but for case, or come from other spellings.
    """
    words = [set(t.split()) for t in texts if t]
    left = [{x for x in w if len(x) > 5} or {max(sorted(w), key=len)} for w in words]
    chosen: set[str] = set()
    while left:
        counts = Counter(x for w in left for x in w)
        best = min(counts, key=lambda x: (-counts[x], -len(x), x))
        chosen |= _sources(best)
        left = [w for w in left if best not in w]
    return "(?i)" + "|".join(sorted(chosen)) if chosen else "(?!)"


def scan(texts: DataFrame, text_col: str = "text", known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """Adds license_digest, and license_id where the entire text is a known licence."""
    table = known_digests(texts.sparkSession, known)
    texts = without(texts, "license_digest", "license_id")
    return texts.withColumn("license_digest", digest(F.col(text_col))).join(F.broadcast(table), "license_digest", "left")


def scan_lines(texts: DataFrame, text_col: str = "text", known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """Adds line_licenses array<string>: the known licences that an entire line states, distinct and sorted.

    Only lines with a word that some known text needs are made canonical.
    """
    spark = texts.sparkSession
    table = {r["license_digest"]: r["license_id"] for r in known_digests(spark, known).collect()}  # as many as known
    pattern = needed([r["c"] for r in spark.createDataFrame(known, "license_id string, t string").select(canonical(F.col("t")).alias("c")).collect()])
    ids = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")), lambda x: F.rlike(x, F.lit(pattern)))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(ids, digest(x))), lambda x: x.isNotNull())
    return texts.withColumn("line_licenses", F.array_sort(F.array_distinct(found)))
