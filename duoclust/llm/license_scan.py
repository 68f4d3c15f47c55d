"""Licences of files: statements by sparse TF-IDF cosine to templates, then inheritance down the directories.

Each sentence or line of a file, between its first and last word of any template, is a sparse vector of its words, weighted
by their document frequency in the whole corpus. One pass counts the documents of every word; a second one finds the
nearest template of each statement and leaves the words that no template has, whose weights a join brings, so
that the cosine is that of the corpus for every statement that can reach the threshold. A file has the licence of its best
statement. A file that says that it is under some licence which no template resembles has the licence "unknown". A file
with the name of a licence file and a statement, or one whose words as a whole are those of a licence's whole text, is a
licence file and speaks for its directory; files without a statement take the licence of the nearest ancestor directory
that has one, by joins of paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Licence statements as they are usually worded.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "This file is released under the terms of the MIT license."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "Licensed under the EPL 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
]
#: Licences by their titles and short names, and the notice of the GNU licences.
TITLES = {
    "Apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0", "Apache License"], ["Apache 2.0", "Apache-2.0"]), "MIT": (["MIT License"], ["MIT"]),
    "BSD-2-Clause": (["BSD 2-Clause License", "Simplified BSD License"], ["BSD 2-Clause", "BSD-2-Clause"]), "BSD-3-Clause": (["BSD 3-Clause License", "New BSD License"], ["BSD 3-Clause", "BSD-3-Clause"]),
    "ISC": (["ISC License"], ["ISC"]), "EPL-2.0": (["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"], ["EPL 2.0", "EPL-2.0"]),
    "MPL-2.0": (["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"], ["MPL 2.0", "MPL, version 2.0", "MPL-2.0"]),
    "GPL-2.0": (["GNU General Public License, version 2", "GNU GPL, version 2"], ["GPL v2", "GPLv2", "GPL 2.0", "GPL-2.0"]), "GPL-3.0": (["GNU General Public License, version 3", "GNU GPL, version 3"], ["GPL v3", "GPLv3", "GPL 3.0", "GPL-3.0"]),
    "LGPL-2.1": (["GNU Lesser General Public License, version 2.1", "GNU Lesser GPL, version 2.1"], ["LGPL v2.1", "LGPLv2.1", "LGPL-2.1"]), "LGPL-3.0": (["GNU Lesser General Public License, version 3", "GNU Lesser GPL, version 3"], ["LGPL v3", "LGPLv3", "LGPL-3.0"]),
    "AGPL-3.0": (["GNU Affero General Public License, version 3"], ["AGPL v3", "AGPLv3", "AGPL-3.0"]),
}
NOTICE = "This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
TEMPLATES += [(name, form.format(t)) for name, (titles, _) in TITLES.items() for t in titles for form in ("The {}", "Licensed under the {}.", "Released under the {}.", "This file is licensed under the terms of the {}.", "License: {}")]
TEMPLATES += [(name, f"{form} {t}") for name, (_, shorts) in TITLES.items() for t in shorts for form in ("License:", "Licensed under", "Licensed under the", "Released under the")]
TEMPLATES += [("MIT", "The MIT License (MIT)"), *((name, t) for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for t in TITLES[name][1][:2])]
TEMPLATES += [(name, NOTICE.format(thing=t, kind=kind, version=v)) for name, kind, v in [
    ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"),
] for t in ("program", "library", "file")]
for _kind, _title in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _v, _port in (("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES += [(f"CC-{_kind}-{_v}", t) for t in (f"Licensed under CC {_kind} {_v}.", f"License: CC {_kind} {_v}", f"This work is licensed under a Creative Commons {_title} {_v} {_port} License.")]
TEMPLATES += [(name, f"{key}: {name}") for name in sorted({name for name, _ in TEMPLATES} - {"proprietary"}) for key in ("SPDX-License-Identifier", "SPDX")]
TEMPLATES += [(name, f"{key}: {name}-{how}") for name in TITLES if "GPL" in name for how in ("only", "or-later") for key in ("SPDX-License-Identifier", "SPDX")]
TEMPLATES = sorted(set(TEMPLATES))
_WARRANTY = " THE SOFTWARE IS PROVIDED {what} AND {who} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {who} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Whole texts of short licences; longer ones are known by the name of their file.
WHOLE = [
    ("MIT", 'MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + _WARRANTY.format(what='"AS IS"', who="THE AUTHOR")),
]
#: A licence whose text holds that of another one.
HOLDS = {"BSD-2-Clause": "BSD-3-Clause"}
#: Least cosine of a statement and of a whole text, words a task counts at once.
COSINE, WHOLE_COSINE, COUNTED = 0.75, 0.85, 300_000
#: Names of files that speak for their directory.
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying)([^a-z].*)?$"
_WORD = re.compile(r"\w+")
_CUT = re.compile(r"\n+|(?<=[.!?])\s+(?=[^\W\da-z_])")
_STATED = re.compile(r"\b(?i:licen[cs]ed|released|distributed|available) (?i:under) (?i:the )?(?i:terms of (?:the )?)?[^.\n]{0,60}?(?:(?i:licen[cs]e)\b|\b[A-Z]{2,}[\w.-]*)|\bSPDX-License-Identifier:")
_HINT = re.compile(r"(?i)licen[cs]e|permission|redistribut|reserved")
_MARGIN = re.compile(r"\n[ \t]*(?:[*#;%/]+|//+|--+)?[ \t]*")
#: What _STATED cannot do without.
_SAYS = frozenset(["under", "spdx"])
_VOCABULARY = frozenset(w for _, t in TEMPLATES + WHOLE for w in _WORD.findall(t.lower()))
#: Words that name a family of licences or a variant in it: a statement and its template name the same ones.
_FAMILIES = {name: re.compile(p) for name, p in {
    "apache": r"(?i)\bapache\b", "mit": r"\bMIT\b|(?i:\bmit licen[cs]e)", "bsd": r"(?i)\bbsd\b", "isc": r"\bISC\b|(?i:\bisc licen[cs]e)", "epl": r"\bEPL\b|(?i:\beclipse public)", "mpl": r"\bMPL\b|(?i:\bmozilla public)",
    "gpl": r"(?i)\bgeneral public licen[cs]e|\b[al]?gpl", "lgpl": r"(?i)\blesser (?:general|gpl)|\blibrary general|\blgpl", "agpl": r"(?i)\baffero|\bagpl", "cc": r"\bCC\b|(?i:\bcreative commons)", "cc0": r"(?i)\bcc0", "sa": r"(?i)\bby(?:-nc)?-sa\b|share-?alike",
    "nc": r"(?i)\bby-nc\b|non-?commercial", "nd": r"(?i)\bby(?:-nc)?-nd\b|no-?deriv", "two": r"(?i)\b(?:2|two)-clause|simplified bsd", "three": r"(?i)\b(?:3|three)-clause|new bsd",
}.items()}
_NUMBER = re.compile(r"(?i)(?:\bversion|\bv\.?|licen[cs]e,?|gpl-?v?|\bby(?:-[a-z]{2})*-?|attribution[a-z-]*|\b[me]pl-?|apache-?|cc0-?)[ ,]*v?\.?[ ]*(\d+(?:\.\d+)?)")


def _families(text: str) -> frozenset[str]:
    return frozenset(name for name, p in _FAMILIES.items() if p.search(text))


def _versions(text: str) -> frozenset[str]:
    return frozenset(v.removesuffix(".0") for v in _NUMBER.findall(text))


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(word, docs): in how many rows each word occurs; "" stands for all rows. Null texts count as empty."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "docs": pa.array(list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                counts.update(set(_WORD.findall((text or "").lower())))
                if len(counts) > COUNTED:
                    yield rows(counts)
                    counts = Counter()
        counts[""] += n
        yield rows(counts)

    return texts.mapInArrow(run, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))


def idf(n: int, docs: int) -> float:
    return math.log((1 + n) / (1 + docs)) + 1


class Matcher:
    """Statements against templates, and whole files against whole texts, with the weights of the templates' words."""

    def __init__(self, n: int, docs: dict[str, int]):
        self.idf = {w: idf(n, docs.get(w, 0)) for w in _VOCABULARY}
        self.sets = [self._set(t) for t in (TEMPLATES, WHOLE)]
        self.keys = self._keys()

    def _keys(self) -> frozenset[str]:
        """Words of which every statement that is near enough to a template has one: common words are left out as long as
        those left out of a template, even if all of them occur, have a cosine under the least one with it."""
        of_word: dict[str, list[tuple[int, int, float]]] = {}
        for which, (_, posting) in enumerate(self.sets):
            for w, found in posting.items():
                of_word.setdefault(w, []).extend((which, k, x * x) for k, x in found)
        left, keys = {}, set()
        for w in sorted(_VOCABULARY, key=lambda w: (self.idf[w], w)):
            sums = {(which, k): left.get((which, k), 0.0) + share for which, k, share in of_word[w]}
            if all(s < (COSINE, WHOLE_COSINE)[which] ** 2 - 1e-9 for (which, _), s in sums.items()):
                left |= sums
            else:
                keys.add(w)
        return frozenset(keys)

    def _set(self, templates: list[tuple[str, str]]) -> tuple[list, dict[str, list[tuple[int, float]]]]:
        posting: dict[str, list[tuple[int, float]]] = {}
        for k, (_, text) in enumerate(templates):
            tf = Counter(_WORD.findall(text.lower()))
            norm = math.sqrt(sum((c * self.idf[w]) ** 2 for w, c in tf.items()))
            for w, c in tf.items():
                posting.setdefault(w, []).append((k, c * self.idf[w] / norm))
        # what a template names, what its licence may be called beside, and its version
        named = [(name, _families(text), _families(text + " " + name), (re.search(r"-(\d+(?:\.\d+)?)$", name) or [None, ""])[1].removesuffix(".0")) for name, text in templates]
        return named, posting

    def statement(self, words: list[str], piece: str, whole: bool = False) -> tuple[str, float, float, list[tuple[str, int]]] | None:
        """(licence, dot product with its template, squares of the templates' words, other words and their numbers) of
        the words from the first to the last that a template has, if their cosine can reach the least one: other words
        weigh 1 at least. A template whose family, variant or version the piece contradicts is none. Ties to the
        smaller name."""
        at = [i for i, w in enumerate(words) if w in _VOCABULARY]
        if not at:
            return None
        wanted = WHOLE_COSINE if whole else COSINE
        tf = Counter(words[at[0] : at[-1] + 1])
        others = [(w, c) for w, c in tf.items() if w not in _VOCABULARY]
        shared = sum((c * self.idf[w]) ** 2 for w, c in tf.items() if w in _VOCABULARY)
        least = shared + sum(c * c for _, c in others)
        if shared < wanted * wanted * least:  # the cosine is at most sqrt(shared / least)
            return None
        (named, posting), dot = self.sets[whole], {}
        for w in tf.keys() & posting.keys():
            for k, x in posting[w]:
                dot[k] = dot.get(k, 0.0) + x * tf[w] * self.idf[w]
        near = sorted((-round(v, 12), named[k][0], k) for k, v in dot.items() if v >= wanted * math.sqrt(least))
        said, numbers = (_families(piece), _versions(piece)) if near else (frozenset(), frozenset())
        for v, name, k in near:
            _, has, may, version = named[k]
            if whole or (has <= said <= may and not (version and numbers and version not in numbers)):
                return name, -v, shared, others
        return None

    def file(self, text: str | None) -> tuple[int, list[tuple]]:
        """(words, statements) of a whole text. A statement has its number of words, whether it says that there is a
        licence - then the licence is None if no template is near enough - and whether it is the whole file."""
        text = text or ""
        every, found = _WORD.findall(text.lower()), []
        if self.keys.isdisjoint(every) and _SAYS.isdisjoint(every):
            return len(every), found
        pieces, hinted = _CUT.split(text), _HINT.search(text)
        for paragraph in re.split(r"\n[ \t]*\n", text) if hinted and "\n" in text else ():  # a sentence may go over lines
            if "\n" in paragraph and _HINT.search(paragraph):
                pieces += _CUT.split(_MARGIN.sub(" ", paragraph))
        for piece in pieces:
            words = _WORD.findall(piece.lower())
            got = None if self.keys.isdisjoint(words) else self.statement(words, piece)
            stated = not _SAYS.isdisjoint(words) and bool(_STATED.search(piece))
            if got or stated:
                found.append((*(got or (None, 0.0, 1.0, [])), len(words), stated, False))
        if hinted and (got := self.statement(every, "", whole=True)):
            found.append((*got, len(every), False, True))
        return len(every), found


_PIECE = "struct<name: string, dot: double, shared: double, others: array<struct<word: string, n: int>>, words: int, stated: boolean, whole: boolean>"


def scan(files: DataFrame) -> DataFrame:
    """(id, path, licence, cosine, licence_file) for every row of files (id, path, text). The licence is null where there
    is no statement and "unknown", with a cosine of 0, where there are only such of other licences."""
    words = written(document_frequencies(files.select("text")), "licence-words")
    docs = {r["word"]: r["docs"] for r in words.where(F.col("word").isin("", *sorted(_VOCABULARY))).collect()}  # the templates' words
    n = docs.pop("", 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(n, docs)
        kind = pa.list_(pa.struct([("name", pa.string()), ("dot", pa.float64()), ("shared", pa.float64()), ("others", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))), ("words", pa.int32()), ("stated", pa.bool_()), ("whole", pa.bool_())]))
        names = [f.name for f in kind.value_type]
        for batch in batches:
            got = [matcher.file(t) for t in batch.column("text").to_pylist()]
            pieces = [[dict(zip(names, (*p[:3], [{"word": w, "n": c} for w, c in p[3]], *p[4:]), strict=True)) for p in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("path"), pa.array([g[0] for g in got], pa.int64()), pa.array(pieces, kind)], ["row", "id", "path", "total", "pieces"])

    found = files.select(F.monotonically_increasing_id().alias("row"), "id", "path", "text").mapInArrow(run, f"row long, id long, path string, total long, pieces array<{_PIECE}>")
    found = written(found, "licence-pieces")
    pieces = found.where(F.size("pieces") > 0).select("row", "total", F.posexplode("pieces").alias("k", "p")).select("row", "total", "k", "p.*")
    weight = F.ln((1 + n) / (1 + F.coalesce("docs", F.lit(0)))) + 1
    others = pieces.where("name is not null").select("row", "k", F.explode("others").alias("o")).select("row", "k", "o.word", F.col("o.n").alias("c"))
    squares = others.join(words, "word", "left").groupBy("row", "k").agg(F.sum((F.col("c") * weight) * (F.col("c") * weight)).alias("more"))
    cosine = F.col("dot") / F.sqrt(F.col("shared") + F.coalesce("more", F.lit(0.0)))
    each = pieces.drop("others").join(squares, ["row", "k"], "left").withColumn("cosine", F.round(cosine, 6))
    each = each.withColumn("name", F.when(F.col("cosine") >= F.when(F.col("whole"), WHOLE_COSINE).otherwise(COSINE), F.col("name"))).where("name is not null or stated")
    named = F.col("name").isNotNull()
    best = F.min(F.when(named, F.struct(~F.col("whole"), (-F.col("cosine")).alias("c"), "name"))).alias("b")  # a whole text before a sentence of it
    of_file = each.groupBy("row").agg(best, F.collect_set("name").alias("names"), F.max(named & F.col("whole")).alias("whole"))
    licence = F.col("b.name")
    for name, other in HOLDS.items():
        licence = F.when((F.col("b.name") == name) & F.array_contains("names", other), F.lit(other)).otherwise(licence)
    of_file = of_file.select("row", F.coalesce(licence, F.lit("unknown")).alias("licence"), F.coalesce(-F.col("b.c"), F.lit(0.0)).alias("cosine"), F.col("b").isNotNull().alias("known"), "whole")
    out = found.select("row", "id", "path").join(of_file, "row", "left")
    by_name = F.regexp_extract(F.coalesce("path", F.lit("")), "[^/]*$", 0).rlike(LICENCE_FILE) & F.col("known")
    out = out.select("id", "path", "licence", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce(by_name | F.col("whole"), F.lit(False)).alias("licence_file"))
    return written(out, "licence-scan", words, found)


def licences(files: DataFrame) -> DataFrame:
    """(id, path, own, cosine, licence, via, from_dir) for every row of files (id, path, text). `via` is "header",
    "licence file", "inherited" or "none". A file whose own licence is "unknown" inherits none. Of several licence files in
    a directory the highest cosine speaks, ties to the smaller licence. A null path is the root directory; a null or empty
    text has no statement; repeated rows give repeated results; an empty table gives none."""
    scanned = scan(files).withColumn("dir", F.regexp_replace(F.coalesce("path", F.lit("")), "/?[^/]*$", ""))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")
    speaking = scanned.where("licence_file").groupBy("dir").agg(best).select(F.col("dir").alias("ancestor"), F.col("b.licence").alias("inherited"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = scanned.select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "ancestor")).join(speaking, "ancestor")
    nearest = Window.partitionBy("dir").orderBy(F.desc("depth"))
    dirs = dirs.withColumn("k", F.row_number().over(nearest)).where("k = 1").select(F.col("dir").alias("at"), F.col("ancestor").alias("from_dir"), "inherited")
    out = scanned.join(written(dirs, "licence-dirs"), F.col("dir") == F.col("at"), "left")
    own = F.col("licence").isNotNull()
    via = F.when(F.col("licence_file"), "licence file").when(own, "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", F.col("licence").alias("own"), "cosine", F.coalesce("licence", "inherited").alias("licence"), via.alias("via"), F.when(~own, F.col("from_dir")).alias("from_dir"))
