"""Licence scan: Dice coefficient over word bigrams (DataFrame functions only).

A text is normalised (lower case, runs of anything but letters and digits become
one space), so line breaks of any kind and indents play no part. A template is a
whole licence or notice, and also each opening of it of one or more paragraphs,
since many texts stop short. A passage of the text and a template are compared
by the Dice coefficient of their sets of word bigrams, ``2 |A n B| / (|A| + |B|)``.

Since the overlap is at most the smaller set, a template of b bigrams can reach a
coefficient t only in passages of ``b t / (2 - t)`` to ``b (2 - t) / t`` bigrams
that share ``b t / (2 - t)`` of them with it. So a text's bigrams are first
looked up among those of all templates, once; a template is compared only where
enough of its own follow each other within its length. Passages begin at a
shared bigram, are as long as the template at most, and end at a shared bigram:
words around them would only lower the coefficient. The template table is short
and fixed; it is part of the plan, and documents are never shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

_AS_IS = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {kind} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.

This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

{last}"""
_ALONG = "You should have received a copy of the GNU {name} along with this {kind}. If not, see <https://www.gnu.org/licenses/>."
_WRITE = "You should have received a copy of the GNU {name} along with this {kind}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"


def _gnu(name: str, version: str, last: str, kind: str = "program", stop: str = ":", comma: str = ",") -> str:
    return _GNU.format(kind=kind, stop=stop, name=name, comma=comma, version=version, last=last.format(name=name, kind=kind))


# Whole short licences, the notices of long ones, and one-line notices, as their texts have them.
TEMPLATES = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        + _AS_IS,
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0.",
    ],
    "BSD-2-Clause": [_BSD.format(third="")],
    "BSD-3-Clause": [
        _BSD.format(third="\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n")
    ],
    "GPL-2.0": [_gnu("General Public License", "2", _WRITE, stop=";", comma=";"), "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [_gnu("General Public License", "3", _ALONG), "This work is licensed under the GNU General Public License, version 3."],
    "AGPL-3.0": [_gnu("Affero General Public License", "3", _ALONG)],
    "LGPL-2.1": [_gnu("Lesser General Public License", "2.1", _WRITE, kind="library", stop=";", comma=";")],
    "LGPL-3.0": [_gnu("Lesser General Public License", "3", _ALONG)],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License."],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ],
    "CC-BY-4.0": ["This work is licensed under the Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "All-rights-reserved": ["All rights reserved."],
}
#: An opening of fewer bigrams is no template of its own.
OPENING = 12


def normalise(text: str) -> str:
    """The same rule as in the plan, for templates and tests (ASCII letters are lower-cased)."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", low).strip(" ")


def bigrams(text: str) -> list[str]:
    """In order, with repeats."""
    words = normalise(text).split(" ")
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def size_bounds(size: int, least: float) -> tuple[float, float]:
    return size * least / (2 - least), size * (2 - least) / least


def openings(templates: dict[str, list[str]]) -> list[tuple[str, list[str], int]]:
    """(licence, distinct bigrams, length in bigrams) by licence; openings with the same bigrams count once."""
    out, seen = [], set()
    for name, texts in sorted(templates.items()):
        for text in texts:
            parts = text.split("\n\n")
            for n in range(len(parts), 0, -1):
                grams = bigrams("\n\n".join(parts[:n]))
                key = frozenset(grams)
                if grams and key not in seen and (n == len(parts) or len(key) >= OPENING):
                    seen.add(key)
                    out.append((name, sorted(key), len(grams)))
    return out


def _normal(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " "))


MATCH = "struct<rank:int,license:string,start_word:int,n_words:int,shared:int,score:double>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, score, n_matches, matches; one row for each row of ``docs``.

    Each template is looked for at its best place: the highest coefficient, at
    least ``least``, then the first. Of matches that overlap only the one with
    the most shared bigrams stays (then the higher coefficient, then the first
    name), so the versions of a licence are told apart by the bigrams that
    differ, and a notice inside a licence isn't counted beside it. ``matches``
    lists what stays (license, start_word, n_words, score) in that order, and
    ``license`` and ``score`` are of its first, null without one. Words are
    counted in the normalised text. Null and empty texts match nothing. Repeated
    rows get one result each; an empty table gives no rows; other columns are
    ignored.
    """
    known = openings(TEMPLATES if templates is None else templates)
    if not known:
        known = [("", ["\0"], 1)]  # in no normalised text
    every = sorted({g for _, grams, _ in known for g in grams})
    needs = [math.ceil(size_bounds(len(g), least)[0] - 1e-9) for _, g, _ in known]
    smallest = min(needs)
    table = F.array(
        *[
            F.struct(F.lit(r).alias("rank"), F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(length).alias("length"), F.lit(need).alias("need"))
            for r, ((name, grams, length), need) in enumerate(zip(known, needs, strict=True))
        ]
    )

    holders = F.array(*[F.array(*[F.lit(r) for r, (_, grams, _) in enumerate(known) if g in grams]) for g in every])  # of each bigram, the templates

    def scan(words: Column) -> Column:
        gram = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 2), lambda i: gram(i).isin(every))
        none = F.array().cast(f"array<{MATCH}>")
        named = lambda a: F.transform(a, lambda i: F.struct((F.array_position(F.array(*map(F.lit, every)), gram(i)).cast("int") - 1).alias("g"), i.alias("at")))

        def before(by_gram: Column) -> Column:
            """Hits (at, g, prev: the place of the same bigram before, or -1), in order."""
            at = lambda j: F.get(by_gram, j)
            back = lambda x, j: F.when((j > 0) & (at(j - 1)["g"] == x["g"]), at(j - 1)["at"]).otherwise(-1)
            return F.array_sort(F.transform(by_gram, lambda x, j: F.struct(x["at"].alias("at"), x["g"].alias("g"), back(x, j).alias("prev"))))

        hits = let(at, lambda a: F.when(F.size(a) >= smallest, let(F.array_sort(named(a)), before)))

        def compare(t: Column, hits: Column) -> Column:
            b, length = F.size(t["grams"]), t["length"]
            bound = lambda shared: 2 * shared / (shared + b)  # noqa: E731  a passage has no fewer bigrams than it shares

            def windows(own: Column) -> Column:
                place = lambda k: F.get(own, k)["at"]
                starts = F.filter(F.sequence(F.lit(0), F.size(own) - t["need"]), lambda k: place(k + t["need"] - 1) - place(k) < length)
                inside = lambda k: F.filter(F.slice(own, k + 1, length), lambda x: x["at"] < place(k) + length)  # noqa: E731  a place has one hit at most

                def step(best: Column, k: Column) -> Column:
                    """The best window so far, and where the last one was counted: each place further adds one shared bigram at most."""
                    first = place(k)

                    def counted(shared: Column) -> Column:
                        def sized(last: Column) -> Column:
                            size = F.size(F.array_distinct(F.transform(F.sequence(first, last), gram)))
                            score = 2 * shared / (size + b)
                            own = F.struct(score.alias("score"), first.alias("first"), (last - first + 2).alias("n_words"), shared.alias("shared"), first.alias("seen_at"), shared.alias("seen"))
                            return let(own, lambda o: F.when(o["score"] > best["score"], o).otherwise(passed))

                        passed = F.struct(best["score"].alias("score"), best["first"].alias("first"), best["n_words"].alias("n_words"), best["shared"].alias("shared"), first.alias("seen_at"), shared.alias("seen"))
                        return F.when(bound(shared) > best["score"], let(F.element_at(inside(k), -1)["at"], sized)).otherwise(passed)

                    shared = F.size(F.filter(F.slice(own, k + 1, length), lambda x: (x["at"] < first + length) & (x["prev"] < first)))
                    most = F.least(b, best["seen"] + first - best["seen_at"])
                    return F.when(bound(most) <= best["score"], best).otherwise(let(shared, counted))

                none_yet = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("first"), F.lit(0).alias("n_words"), F.lit(0).alias("shared"), F.lit(0).alias("seen_at"), F.lit(1 << 24).alias("seen"))
                best = F.aggregate(starts, none_yet, step)
                return let(best, lambda m: F.when(m["score"] >= least, F.struct(
                    t["rank"].alias("rank"), t["license"].alias("license"), m["first"].alias("start_word"), m["n_words"].alias("n_words"), m["shared"].alias("shared"), m["score"].alias("score"))))

            return let(F.filter(hits, lambda x: F.array_contains(F.get(holders, x["g"]), t["rank"])), lambda own: F.when(F.size(own) >= t["need"], windows(own)))

        # only templates that the text shares enough bigrams for
        found = lambda h: F.filter(F.transform(F.filter(table, lambda t: t["need"] <= F.size(h)), lambda t: compare(t, h)), lambda m: m.isNotNull())
        return let(hits, lambda h: F.when(h.isNotNull(), found(h)).otherwise(none))

    ahead = lambda o, m: (o["shared"] > m["shared"]) | ((o["shared"] == m["shared"]) & ((o["score"] > m["score"]) | ((o["score"] == m["score"]) & (o["rank"] < m["rank"]))))
    meets = lambda o, m: (o["start_word"] < m["start_word"] + m["n_words"]) & (m["start_word"] < o["start_word"] + o["n_words"])
    words = F.split(_normal(F.coalesce(F.col(text_col), F.lit(""))), " ")
    matches = let(words, lambda w: F.when(F.size(w) > smallest, scan(w)).otherwise(F.array().cast(f"array<{MATCH}>")))
    stay = let(matches, lambda ms: F.filter(ms, lambda m: ~F.exists(ms, lambda o: ahead(o, m) & meets(o, m))))
    by_rank = F.array_sort(F.transform(stay, lambda m: F.struct((-m["shared"]).alias("less"), (-m["score"]).alias("low"), m["rank"].alias("rank"), m.alias("m"))))
    found = docs.select(F.col(id_col).alias("doc_id"), by_rank.alias("ranked"))
    listed = F.transform("ranked", lambda x: F.struct(x["m"]["license"].alias("license"), x["m"]["start_word"].alias("start_word"), x["m"]["n_words"].alias("n_words"), x["m"]["score"].alias("score")))
    first = F.get("ranked", F.lit(0))["m"]
    return found.select("doc_id", first["license"].alias("license"), first["score"].alias("score"), F.size("ranked").cast("bigint").alias("n_matches"), listed.alias("matches"))
