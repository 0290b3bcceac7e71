"""Licence scan by sentence rules.

A text is normalised to lower-case words of letters and digits, one blank between. Known licence sentences, normalised
alike, are found in that stream of words wherever they begin, whether or not a line or sentence ends there; where one is
the beginning of another the longer counts, and sentences don't overlap. Each is mapped to its identifier, and the
identifiers, in order, form the document's sequence, in which more than ``GAP`` words between two known sentences make a
break. Ordered rules, longest sequences first, are matched against it; what a rule has matched is no longer there for
the next. Known sentences that no rule takes are reported as ``UNMATCHED``.

Some sentences name an owner. There up to ``SLOT_WORDS`` words may stand where the usual wording has "the copyright holder"
and the like; they are given the usual wording first. A tag ``SPDX-License-Identifier:`` is a sentence whose identifier is the whole expression
behind it, of identifiers, AND, OR, WITH and brackets, and so is its rule: "GPL-2.0-only OR MIT" is reported as that.

Only DataFrame functions are used. Sentences are found by one pattern, a tree of their common beginnings, so a text is
read once, in memory of a few times its size, however long its lines or sentences are. The tables of sentences and
rules are fixed and small and are part of the plan.

Nulls: null and empty texts hold no sentence and give no row; a null id is kept. Of rows with equal id and text one
counts. An empty table gives an empty result. Extra columns are ignored. Very long texts are read whole.
"""

from __future__ import annotations

import itertools
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 16
SLOT_WORDS = 12
UNMATCHED = "UNMATCHED"

#: Licences by identifier and the names under which notices cite them.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3",),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1",),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}
#: Sentences that cite a licence by name, and what follows a name that later versions may replace.
CITATIONS = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "Distributed under the {}.", "This project is licensed under the {}.")
OR_LATER = ("or later", "or any later version", "or (at your option) any later version")
#: A tag and the expression behind it, and the short names of versions with a plus.
_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?\)*"
TAG = rf"(?i:SPDX-License-Identifier:)[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"
PLUS = r"(?i:\b(A?L?GPL ?v?[0-9](?:\.[0-9])?)\+)"
#: What stands before and after an owner's name, and the usual wording for it.
SLOTS = (
    ("neither the name of", "nor the names of its contributors may be used", "the copyright holder"),
    ("this software is provided by", "as is and any express or implied warranties", "the copyright holders and contributors"),
    ("in no event shall", "be liable for any direct indirect incidental", "the copyright holder or contributors"),
    ("in no event shall", "be liable for any claim damages or other liability", "the authors or copyright holders"),
    ("in no event shall", "be liable for any special direct indirect", "the author"),
)
#: Notices of the GNU licences: identifier, name, version as its notice writes it, and the title of its text.
GNU = (
    ("GPL-2.0", "General", "2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "General", "3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "Library General", "2", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "Lesser General", "2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "Lesser General", "3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "Affero General", "3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
)
GNU_GRANT = "This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License {terms}"
GNU_TERMS = (
    ("or-later", "as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."),
    ("only", "as published by the Free Software Foundation; version {v} of the License."),
    ("only", "as published by the Free Software Foundation; version {v}."),
    ("only", "version {v} as published by the Free Software Foundation."),
)
GNU_WARRANTY = "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
GNU_DETAILS = "See the GNU {name} Public License for more details."
GNU_COPY = "You should have received a copy of the GNU {name} Public License along with this {thing}."
THINGS = ("program", "library", "file")

#: Sentences of licence texts and notices.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "apache-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "mpl-title": "Mozilla Public License Version 2.0 1. Definitions",
    "mpl-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "reserved": "All rights reserved.",
}
#: Ordered rules over sentences.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-warranty", "apache-limits")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("ISC", ("isc-grant", "isc-warranty", "isc-liability")),
    ("0BSD", ("0bsd-grant", "isc-warranty", "isc-liability")),
    ("MPL-2.0", ("mpl-grant", "mpl-copy")),
    ("MPL-2.0", ("mpl-grant", "mpl-copy-https")),
    ("Unlicense", ("unlicense-grant", "unlicense-free")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-grant",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Apache-2.0", ("apache-title",)),
    ("MPL-2.0", ("mpl-title",)),
    ("MPL-2.0", ("mpl-grant",)),
    ("Unlicense", ("unlicense-grant",)),
    ("All-Rights-Reserved", ("reserved",)),
)
#: Every known sentence holds one of these words, so texts without any need no closer look.
ANCHORS = ("licens", "copyright", "public", "warrant", "redistribut", "reserved", "permission", "liable", "released", "distributed", "unlicense", "compile", "free software")


def normalise(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def gnu_notices() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences of the GNU licences' notices by identifier, and ordered rules: the whole notice, its grant, a title."""
    sentences: dict[str, str] = {}
    whole: list[tuple[str, list[str]]] = []
    grants: list[tuple[str, list[str]]] = []
    for spdx, name, version, title in GNU:
        kind = name.lower().replace(" ", "-")
        sentences[f"{spdx} title"] = title
        grants.append((f"{spdx}-only", [f"{spdx} title"]))
        for thing in THINGS:
            ends = [f"warranty {thing}", f"details {kind}", f"copy {kind} {thing}"]
            sentences |= dict(zip(ends, (GNU_WARRANTY.format(thing=thing), GNU_DETAILS.format(name=name), GNU_COPY.format(name=name, thing=thing))))
            for i, (suffix, terms) in enumerate(GNU_TERMS):
                grant = f"{spdx} grant {i} {thing}"
                sentences[grant] = GNU_GRANT.format(thing=thing, name=name, terms=terms.format(v=version))
                whole += [(f"{spdx}-{suffix}", [grant, *ends]), (f"{spdx}-{suffix}", [grant, *ends[:2]])]
                grants.append((f"{spdx}-{suffix}", [grant]))
    return sentences, sorted(whole, key=lambda r: -len(r[1])) + grants


def known_sentences() -> list[tuple[str, str]]:
    """(normalised sentence, code): the identifiers of the tables above, coded as letters with brackets."""
    found: dict[str, str] = {}
    for name, sentence in sorted((SENTENCES | gnu_notices()[0]).items()):
        found[normalise(sentence)] = f"<{name}>"
    for spdx, names in cited().items():
        for text in [c.format(n) for n in names for c in CITATIONS]:
            found.setdefault(normalise(text), f"<cites {spdx}>")
    return sorted(found.items())


def cited() -> dict[str, tuple[str, ...]]:
    """``NAMES``, and the names that are followed by leave to use later versions."""
    later = {k.removesuffix("-only") + "-or-later": tuple(f"{n} {x}" for n in names for x in OR_LATER) for k, names in NAMES.items() if k.endswith("-only")}
    return NAMES | later


def rules() -> list[tuple[str, str]]:
    """(licence, sequence of codes), in the order of matching."""
    listed = [(licence, "".join(f"<{s}>" for s in parts)) for licence, parts in [*RULES, *gnu_notices()[1]]]
    return [*sorted(listed, key=lambda r: -r[1].count("<")), *[(spdx, f"<cites {spdx}>") for spdx in cited()]]


def slots() -> list[tuple[str, str]]:
    """(pattern, usual wording) of the sentences with an owner's name, in normalised words."""
    return [(rf"\b{a}(?: [a-z0-9]+){{1,{SLOT_WORDS}}}? {b}\b", f"{a} {usual} {b}") for a, b, usual in SLOTS]


def sentence_pattern(sentences: list[str]) -> str:
    """A regular expression that finds any of the sentences, the longest that begins at a place: their common beginnings
    are written once, and of two that begin alike the longer comes first."""

    def tree(rest: list[str]) -> str:
        out, ends = [], "" in rest
        for _, group in itertools.groupby(sorted(x for x in rest if x), key=lambda x: x[0]):
            same = list(group)
            shared = os.path.commonprefix(same)
            out.append(shared + tree([x[len(shared) :] for x in same]))
        if not out:
            return ""
        return out[0] if len(out) == 1 and not ends else "(?:" + "|".join([*out, *([""] if ends else [])]) + ")"

    # words are of letters and digits, so a bound stands at both ends of each
    return r"\b" + tree(sentences) + r"\b"


def _sequences(docs: DataFrame) -> DataFrame:
    """doc_id, tags and the sequence of each text that holds a known sentence or a tag."""
    known = dict(known_sentences())
    pattern = sentence_pattern(sorted(known))
    text = F.col("text")
    near = docs.select("doc_id", "text").where(F.lower(text).rlike("|".join(ANCHORS)))
    plain = F.regexp_replace(F.regexp_replace(text, TAG, " "), PLUS, "$1 or later")
    words = F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))
    for slot, usual in slots():
        words = F.regexp_replace(words, slot, usual)
    spelt = F.create_map(*[F.lit(x) for k in cited() for x in (k.lower(), k)])
    expression = lambda e: F.array_join(F.transform(F.split(e, "[ \t]+"), lambda t: F.coalesce(F.try_element_at(spelt, F.lower(t)), t)), " ")
    tags = F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), expression)
    words = near.select("doc_id", F.md5(text.cast("binary")).alias("h"), tags.alias("tags"), words.alias("words"))
    hits = words.where(F.col("words").rlike(pattern) | (F.size("tags") > 0)).dropDuplicates(["doc_id", "h"])
    # what stands before each sentence found, and the sentences: one more of the former than of the latter
    cut = hits.select("doc_id", "tags", F.split("words", pattern).alias("between"), F.regexp_extract_all("words", F.lit(pattern), F.lit(0)).alias("found"))
    code = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    before = lambda i: F.size(F.filter(F.split(F.element_at("between", i + 1), " "), lambda w: w != ""))
    part = lambda s, i: F.concat(F.when((i > 0) & (before(i) > GAP), F.lit("_")).otherwise(F.lit("")), F.element_at(code, s))
    return cut.select("doc_id", "tags", F.array_join(F.transform("found", part), "").alias("codes"))


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, licence and matches: how often rules of the licence match in the document."""
    listed = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(codes).alias("codes")) for licence, codes in rules()])
    none = F.array().cast("array<struct<licence:string,n:int>>")

    def match(acc, rule):
        left = F.replace(acc["rest"], rule["codes"], F.lit("#"))
        # what went, over what one match takes away
        n = ((F.length(acc["rest"]) - F.length(left)) / (F.length(rule["codes"]) - 1)).cast("int")
        more = F.when(n > 0, F.concat(acc["out"], F.array(F.struct(rule["licence"].alias("licence"), n.alias("n"))))).otherwise(acc["out"])
        return F.struct(left.alias("rest"), more.alias("out"))

    done = F.aggregate(listed, F.struct(F.col("codes").alias("rest"), none.alias("out")), match)
    matched = _sequences(docs).select("doc_id", "tags", done.alias("m"))
    orphans = F.length("m.rest") - F.length(F.replace(F.col("m.rest"), F.lit("<"), F.lit("")))
    tagged = F.transform("tags", lambda t: F.struct(t.alias("licence"), F.lit(1).alias("n")))
    every = F.concat(F.col("m.out"), tagged, F.array(F.struct(F.lit(UNMATCHED).alias("licence"), orphans.alias("n"))))
    rows = matched.select("doc_id", F.inline(every)).where("n > 0")
    return rows.groupBy("doc_id", "licence").agg(F.sum("n").alias("matches"))
