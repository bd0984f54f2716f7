"""Licence scan: Dice coefficient over word bigrams against templates, pruned by size."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of licences and the notices under which works are released, as their publishers word them. Longer texts, such
# as the whole of the Apache or GNU licences, are read from files by ``read_templates``.
_AS_IS_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_NOTICE_MIT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CONDITIONS_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ENDORSE_BSD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _gnu(name: str, version: str) -> str:
    """The notice that programs under one of the GNU licences carry."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""


def _creative_commons(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} International License."


TEMPLATES: dict[str, str] = {
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": f"{_CONDITIONS_BSD}\n{_AS_IS_BSD}",
    "BSD-3-Clause": f"{_CONDITIONS_BSD}\n{_ENDORSE_BSD}\n{_AS_IS_BSD}",
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0": _creative_commons("Attribution 4.0"),
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": _creative_commons("Attribution-NonCommercial 4.0"),
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": _creative_commons("Attribution-ShareAlike 4.0"),
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": _gnu("General Public License", "3"),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": f"{_GRANT_MIT}\n{_NOTICE_MIT}\n{_AS_IS_MIT}",
    "MIT-grant": _GRANT_MIT,
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: Words of any prose, which anchor nothing where others do.
COMMON = frozenset(
    "a an and any are as at be by for from have if in is it its may must no not of on or other provided shall that the their this to under use used was were which will with without you your"
    " author claim copy damages each event express file following form free general hope including international kind language law made names party person public purpose see source subject terms version work".split()
)
THRESHOLD = 0.8


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def read_templates(folder: str) -> dict[str, str]:
    """Texts of licences by the names of the files in a folder of the driver, to be given as templates."""
    found = {}
    for path in sorted(Path(folder).iterdir()):
        if path.is_file():
            found[path.stem] = path.read_text("utf-8", "replace")
    return found


def anchor_words(templates: Mapping[str, str], threshold: float) -> list[str]:
    """Words one of which stands in anything that reaches the threshold with some template.

    A match shares at least threshold / (2 - threshold) of a template's bigrams. So once
    the bigrams that hold an anchor outweigh the rest that may be missing, each match holds one. Common words are taken only where a template
    has no others left.
    """
    need = threshold / (2 - threshold)
    grams = {k: bigrams_of(t) for k, t in templates.items()}
    chosen: list[str] = []

    def open_(k: str) -> bool:
        held = sum(any(w in chosen for w in g.split()) for g in grams[k])
        return held <= (1 - need) * len(grams[k]) + 1e-9

    while still := [k for k in grams if open_(k)]:
        gain: dict[str, int] = {}
        for k in still:
            for g in grams[k]:
                if not any(w in chosen for w in g.split()):
                    for w in dict.fromkeys(g.split()):
                        gain[w] = gain.get(w, 0) + 1
        chosen.append(max(sorted(gain), key=lambda w: (w not in COMMON and not w.isdigit(), len(w) >= 3, gain[w], len(w))))
    return sorted(chosen)


def normalised(text: Column) -> Column:
    """Lower case, and anything but letters a-z and digits as one space."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[^a-z0-9]+", " "))


def _bigrams(unit: Column) -> Column:
    return _bigrams_of(F.split(unit, " "))


def _bigrams_of(words: Column) -> Column:
    return F.array_distinct(
        F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    )


def branches(words: list[str]) -> str:
    """A pattern that any of ``words`` matches, with their common beginnings once."""
    out = []
    for first in sorted({w[0] for w in words if w}):
        rest = [w[1:] for w in words if w[:1] == first]
        inner = branches(rest)
        out.append(re.escape(first) + (inner if len(rest) == 1 else f"(?:{inner})" + "?" * ("" in rest)))
    return "|".join(out)


def anchored(templates: Mapping[str, str], anchors: list[str]) -> dict[str, dict[str, list[int]]]:
    """Of each template, where in its words the bigrams stand that hold an anchor."""
    out: dict[str, dict[str, list[int]]] = {}
    for name, text in templates.items():
        words = words_of(text)
        for i, (a, b) in enumerate(zip(words, words[1:], strict=False)):
            if a in anchors or b in anchors:
                out.setdefault(name, {}).setdefault(f"{a} {b}", []).append(i)
    return out


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """Licences named in every whole text of ``docs`` (doc_id, text).

    Compared are the whole text, its paragraphs (parted by blank lines) and its lines,
    each normalised to words; and, for notices that run on over lines or within one, windows of the words of the text as long as a
    template, laid so that a bigram that holds an anchor word stands where the template has it. A unit whose number of distinct bigrams is so far from a
    template's that the threshold is out of reach is not compared with it; nor is one without
    any anchor word, which no match lacks. All of it happens within the row: nothing is
    shuffled, and the templates (a parameter) are constants of the plan.

    Returns doc_id, licenses (names by code point, comma-joined), n_licenses and best, the highest
    coefficient (0 if none reaches the threshold). Null and empty texts have none. Every row returns once, repeated ones too.
    """
    anchors = anchor_words(templates, threshold)
    pattern = rf"(?i)(?<![a-z0-9])(?:{'|'.join(re.escape(w) for w in anchors)})(?![a-z0-9])"
    # Most texts have no anchor, so how fast that is told decides: in lower case, where a word begins, letter by letter.
    quick = rf"[^a-z0-9](?=[{''.join(sorted({w[0] for w in anchors}))}])(?:{branches(anchors)})(?![a-z0-9])"
    longest = max(len(words_of(t)) for t in templates.values())
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    text = F.coalesce(F.col("text"), F.lit(""))
    lines, paragraphs = F.split(text, r"\n|\r"), F.split(text, r"\n[ \t\r]*\n")
    held = lambda array: F.filter(array, lambda u: u.rlike(pattern))
    # A paragraph or text of one line is compared as that line.
    several = lambda array: F.filter(array, lambda u: u.rlike(r"\n|\r"))
    units = F.array_distinct(F.transform(F.concat(held(lines), several(held(paragraphs)), several(F.array(text))), normalised))
    # Repeated words make distinct bigrams fewer than words, so only the bigrams decide on size; a unit without
    # a template's bigrams is cut off by the bounds, whatever its length.
    named = F.col("named")
    found = docs.select("doc_id", "text", F.concat(F.lit(" "), F.lower(text)).rlike(quick).alias("named")).select(
        "doc_id",
        F.when(named, F.transform(units, _bigrams)).otherwise(F.expr("cast(array() as array<array<string>>)")).alias("units"),
        F.when(named, F.split(normalised(text), " ")).otherwise(F.expr("cast(array() as array<string>)")).alias("words"),
    )
    places = anchored(templates, anchors)
    telling = sorted({g for own in places.values() for g in own})
    word = lambda i: F.get("words", i)
    near = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: word(i).isin(*anchors))
    begins = F.array_distinct(F.flatten(F.transform(near, lambda i: F.array(i - 1, i))))
    grams = F.transform(begins, lambda i: F.struct(i.alias("at"), F.concat(word(i), F.lit(" "), word(i + 1)).alias("gram")))
    found = found.withColumn("units", F.filter("units", lambda u: F.size(u) <= F.lit(longest * high))).withColumn(
        "met", F.when(F.size("words") > 1, F.filter(grams, lambda g: g["gram"].isin(*telling)))
    )

    def score(name: str) -> Column:
        grams = bigrams_of(templates[name])
        n, constant = len(grams), F.array(*[F.lit(g) for g in grams])
        own, length = places[name], len(words_of(templates[name]))
        offsets = F.create_map(*[x for g, at in own.items() for x in (F.lit(g), F.array(*[F.lit(k) for k in at]))])
        none = F.expr("cast(array() as array<int>)")
        starts = F.array_distinct(
            F.flatten(F.transform("met", lambda g: F.transform(F.coalesce(F.try_element_at(offsets, g["gram"]), none), lambda k: F.greatest(g["at"] - k, F.lit(0)))))
        )
        laid = F.transform(starts, lambda s: _bigrams_of(F.slice("words", s + 1, F.lit(length))))
        near = F.filter(F.concat("units", F.coalesce(laid, F.expr("cast(array() as array<array<string>>)"))), lambda u: (F.size(u) >= F.lit(low * n - 1e-9)) & (F.size(u) <= F.lit(high * n + 1e-9)))
        dice = F.transform(near, lambda u: 2.0 * F.size(F.array_intersect(u, constant)) / (F.size(u) + n))
        return F.struct(F.lit(name).alias("name"), F.coalesce(F.array_max(dice), F.lit(0.0)).alias("dice"))

    scores = [score(name) for name in sorted(templates)]
    hits = F.filter(F.array(*scores), lambda s: s["dice"] >= F.lit(threshold))
    return (
        found.select("doc_id", F.when((F.size("units") > 0) | (F.coalesce(F.size("met"), F.lit(0)) > 0), hits).alias("hits"))
        .select(
            "doc_id",
            F.coalesce(F.array_join(F.transform("hits", lambda h: h["name"]), ","), F.lit("")).alias("licenses"),
            F.greatest(F.coalesce(F.size("hits"), F.lit(0)), F.lit(0)).cast("long").alias("n_licenses"),
            F.coalesce(F.array_max(F.transform("hits", lambda h: h["dice"])), F.lit(0.0)).alias("best"),
        )
    )
