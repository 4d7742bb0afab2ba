"""Licence recognition by sentence rules (DataFrame functions only).

A text is cut at line ends and behind [.!?:;] with blanks; the pieces are normalised (lower case, runs
of other characters than a-z and 0-9, so also comment marks, become one blank; dnl and rem in front of
a line go).  One or more pieces that follow each other and make up a known licence sentence are it, the
longest first: so sentences are found wrapped over lines, behind comment marks and with such signs
inside.  The identifiers of those found,
in order, form a sequence, which ordered rules consume: a rule names a licence and the identifiers
that must follow each other; what it matched is taken out before the next rule is tried, so the rules
for longer sequences come first.  Sentences that no rule took are reported as left over.

Documents without any of the anchor words, one of which every known sentence has, skip the lookup;
anchors of several words, which a line end may part, are not asked for.  All is
done within the row: no join, no shuffle.

Defined cases: a null or empty text has no sentences, so licences and sequence are empty; repeated
rows and repeated sentences count as often as they stand; a licence found more than once is named
once, in order of its rule; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, as public licence texts and notices have them.
SENTENCES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "asis-software": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-may": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-may": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-nowarranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-intro": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain and free of any licence.",
    "reserved": "Copyright, all rights reserved.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
}
# Ordered rules, each a licence and the sentences that must follow each other.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-keep", "asis-software", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-keep", "asis-software"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("BSL-1.0", ["boost-grant"]),
    ("ISC", ["isc-grant", "isc-warranty", "isc-liability"]),
    ("ISC", ["isc-grant", "asis-software"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-intro", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-may", "gpl-nowarranty", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-may"]),
    ("GPL-2.0-or-later", ["gpl2-may", "gpl-nowarranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-may"]),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("Apache-2.0", ["apache-grant", "apache-comply", "apache-copy"]),
    ("Apache-2.0", ["apache-unless", "apache-see"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("Unlicense", ["unlicense-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("Unlicense", ["unlicense-notice"]),
    ("LicenseRef-all-rights-reserved", ["reserved"]),
]
# Each known sentence, normalised, has one of these.
ANCHORS = ["licen", "copyright", "permission", "merchantab", "redistribut", "free software", "warrant", "liable", "unencumbered", "mpl", "gnu"]
# Names that notices give to licences, and how notices are worded.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU GPL version 2", "GPLv2 license"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU GPL version 3", "GPLv3 license"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1 license"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPLv3 license"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPLv3 license"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal license"],
    "CC-BY-4.0": ["CC BY 4.0 license", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}
NOTICES = ["Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "This project is licensed under the {}.", "This work is licensed under a {}."]
IDENTIFIED = "SPDX-License-Identifier: {}"


def plain(sentence: str) -> str:
    """A sentence as texts are normalised."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised sentence to identifier; the first identifier of equal sentences wins."""
    out: dict[str, str] = {}
    for name, text in sentences.items():
        out.setdefault(plain(text), name)
    return out


def with_notices(sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """The sentences and rules, and a sentence and a rule for every notice of every name that isn't among them."""
    held, more, last = known(sentences), {}, []
    for licence, names in NAMES.items():
        texts = [notice.format(name) for name in names for notice in NOTICES] + [IDENTIFIED.format(licence)]
        for k, text in enumerate(texts):
            if plain(text) not in held:
                name = f"{licence.lower()}-said-{k}"
                held[plain(text)] = name
                more[name] = text
                last.append((licence, [name]))
    return sentences | more, rules + last


SENTENCES, RULES = with_notices(SENTENCES, RULES)
if dead := [names for _, names in RULES if not set(names) <= set(known(SENTENCES).values())]:
    raise ValueError(f"rules of sentences that are not known: {dead}")


def sequence(text: Column, sentences: dict[str, str], anchors: list[str]) -> Column:
    """The identifiers of known sentences of a text, in order."""
    anchors = [a for a in anchors if " " not in a]
    if bare := [s for s in known(sentences) if not any(a in s for a in anchors)]:
        raise ValueError(f"no anchor word in: {bare}")
    low = F.lower(text)
    lines = F.regexp_replace(F.translate(low, "|", ","), r"(?m)^([^a-z0-9\n]*)@?(?:dnl|rem)(?=[ \t\r]|$)", "$1")
    cut = F.concat(F.lit("|"), F.regexp_replace(lines, r"[.!?:;][ \t\r\n]+|\n", "|"), F.lit("|"))
    whole = F.regexp_replace(F.regexp_replace(cut, "[^a-z0-9|]+", " "), r" ?\|[ |]*", "|")
    longest = sorted(known(sentences), key=len, reverse=True)
    wanted = r"(?<=\|)(?:" + "|".join(s.replace(" ", "[ |]") for s in longest) + r")(?=\|)"
    ids = F.create_map(*[F.lit(x) for pair in known(sentences).items() for x in pair])
    found = F.transform(F.regexp_extract_all(whole, F.lit(wanted), F.lit(0)), lambda s: F.element_at(ids, F.translate(s, "|", " ")))
    may = F.lit(False)
    for a in anchors:
        may = may | low.contains(a)
    return F.when(may, found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, anchors: list[str] = ANCHORS) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licences, left_over: all strings blank-joined."""
    seq = docs.select("doc_id", F.coalesce(sequence(F.col("text"), sentences, anchors), F.array().cast("array<string>")).alias("ids"))
    # one blank around every identifier, so that a rule never matches within one
    text = F.when(F.size("ids") > 0, F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))).otherwise(F.lit(""))
    book = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(" " + "  ".join(names) + " ").alias("want")) for i, (_, names) in enumerate(rules)])
    start = F.struct(text.alias("rest"), F.array().cast("array<int>").alias("took"))
    names = F.array(*[F.lit(name) for name, _ in rules])

    def step(acc: Column, rule: Column) -> Column:
        hit = acc["rest"].contains(rule["want"])
        return F.struct(
            F.when(hit, F.replace(acc["rest"], rule["want"], F.lit(" | "))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.array_append(acc["took"], rule["i"])).otherwise(acc["took"]).alias("took"),
        )

    done = F.when(F.size("ids") > 0, F.aggregate(book, start, step))
    out = seq.select("doc_id", "ids", done.alias("done"))
    found = F.array_distinct(F.transform(F.col("done.took"), lambda i: F.element_at(names, i + 1)))
    left = F.trim(F.regexp_replace(F.regexp_replace("done.rest", r"\|", " "), " +", " "))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", " ").alias("sentence_ids"),
        F.coalesce(F.array_join(found, " "), F.lit("")).alias("licences"),
        F.coalesce(left, F.lit("")).alias("left_over"),
    )
