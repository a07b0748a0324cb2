"""Licence scans: sparse TF-IDF cosine of licence passages to templates, then inheritance from the nearest directory.

A text is one sequence of words; line ends and comment marks are not words. Around every cue of every
whole text the windows that lay a template's cue on it, each as long as that template, are snippets,
and so is every line with a cue (long ones are cut into overlapping windows of words). Templates are
wordings (``TEMPLATES``) and whole headers and licence texts (``TEXTS``). Inverse document frequencies
are counted over all windows of ``WORDS`` words, in steps of half of that, that hold a cue. A
snippet's licence is the template of greatest cosine, if it is at least ``SURE``; a file's own
licence is that of its best snippet, or of one at most ``CLOSE`` below that fits a template of twice
the words or more: licences share first sentences. A licence file - one with a licence name, or one
whose licence passages are at least ``SHARE`` of its words - also declares its directory's licence. A
file without its own licence takes that of the nearest ancestor directory that has one, by an
equi-join of directories with their exploded ancestors.

Texts are read once: those with a cue, and the other columns of all files, are stored; so are the
judged rows, and what is known of a directory before it is joined, so that the files of a very large
directory, and the directories below one ancestor, can be split over tasks.

Defined cases: null and empty texts have no own licence; a null path is in no directory and inherits
nothing; equal cosines go to the first template by name, equal declarations to the least path;
repeated rows are judged each; empty tables give empty results. Only path and text are used; other
columns are carried through, whatever their names, but those of the names of added ones, which they
replace.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastercat.llm.storage import column, dropped, kinds, mapped, stored, unused

SURE, CLOSE, SHARE = 0.55, 0.05, 0.5
WORDS = 60
CUE = r"(?i)licen[cs]|copyright|spdx|redistribut|permission[^\p{L}0-9]+is[^\p{L}0-9]+hereby|public[^\p{L}0-9]+domain"
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|notice)(?:[.-][^/]*)?$"

# Wordings of licence headers, by SPDX name.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"),
    "MIT": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"),
}


# Whole headers, licence texts, or the opening of those of many pages.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-2-Clause": (_BSD + _BSD_END,),
    "BSD-3-Clause": (_BSD + _BSD_NAMES + _BSD_END,),
    "GPL-2.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ),
}


def terms(text: str) -> list[str]:
    return re.findall(r"[0-9]+(?:\.[0-9]+)?|[^\W\d_]+", text.lower())


_ONE = re.compile("licen[cs]|copyright|spdx|redistribut")


def cues(words: list[str]) -> list[tuple[int, str]]:
    """Positions of words that a cue begins in, with the kind of cue; the words of a phrase may lie in two lines."""
    one = {w: m[0][:5] for w in set(words) if (m := _ONE.search(w))} | {"permission": "", "public": ""}
    kinds = ((i, one[w] or ("permission" if words[i + 1 : i + 3] == ["is", "hereby"] else "public" if words[i : i + 2] == ["public", "domain"] else "")) for i, w in enumerate(words) if w in one)
    return [(i, kind) for i, kind in kinds if kind]


class Templates:
    """TF-IDF vectors of the templates; ``frequency`` has how many of n snippets hold a term."""

    def __init__(self, templates: dict[str, tuple[str, ...]], frequency: dict[str, int], n: int, texts: dict[str, tuple[str, ...]] | None = None):
        whole = [(name, terms(text)) for some in (templates, texts or {}) for name, x in sorted(some.items()) for text in x]
        self.idf = {t: math.log((1 + n) / (1 + frequency.get(t, 0))) + 1 for _, x in whole for t in x}
        self.other = math.log(1 + n) + 1
        self.vectors = [(name, self._vector(Counter(terms(text)))) for name, x in sorted(templates.items()) for text in x]
        self.aligned = sorted(((name, len(x), cues(x), self._vector(Counter(x))) for name, x in whole), key=lambda t: t[0])
        self.cosine = functools.lru_cache(1 << 14)(self._cosine)

    def _vector(self, counts: Counter) -> dict[str, float]:
        raw = {t: (1 + math.log(c)) * self.idf.get(t, self.other) for t, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        return {t: v / norm for t, v in raw.items()}

    def _cosine(self, template: int, words: tuple[str, ...]) -> float:
        other = self.aligned[template][3]
        vector = self._vector(Counter(words))
        return sum(v * vector.get(t, 0.0) for t, v in other.items())

    def found(self, text: str, sure: float) -> Iterator[tuple[str, float, int, int, int]]:
        """(licence, cosine, words of its template, first word, end) of every snippet of a text that fits one."""
        words, at = [], 0
        for line in text.split("\n"):
            some = terms(line)
            words += some
            if _ONE.search(line.lower()) or cues(some):
                for i in range(0, max(len(some) - WORDS // 2, 1), WORDS // 2):
                    name, top = self.best(some[i : i + WORDS])
                    if name and top >= sure:
                        yield name, top, len(some), at + i, at + min(i + WORDS, len(some))
            at += len(some)
        places = cues(words)
        for k, (name, size, own, _) in enumerate(self.aligned):
            for start in sorted({i - j for i, kind in places for j, same in own if kind == same}):
                first, end = max(start, 0), min(start + size, len(words))
                cosine = self.cosine(k, tuple(words[first:end]))
                if cosine >= sure:
                    yield name, cosine, size, first, end

    def judged(self, text: str, sure: float) -> tuple[str | None, float, int, int]:
        """(licence, cosine, words inside snippets that fit, all words) of a text."""
        snippets = list(self.found(text, sure))
        n = len(terms(text))
        if not snippets:
            return None, 0.0, 0, n
        best = _first(snippets)
        longer = [x for x in snippets if x[2] >= 2 * best[2] and x[1] >= best[1] - CLOSE]
        best = _first(longer) if longer else best
        inside = bytearray(n)
        for _, _, _, first, end in snippets:
            inside[first:end] = b"\x01" * (end - first)
        return best[0], best[1], sum(inside), n

    def best(self, words: list[str]) -> tuple[str | None, float]:
        """The closest template to any window of a snippet's words."""
        name, top = None, 0.0
        for i in range(0, max(len(words) - WORDS // 2, 1), WORDS // 2):
            vector = self._vector(Counter(words[i : i + WORDS]))
            for template, other in self.vectors:
                cosine = sum(v * vector.get(t, 0.0) for t, v in other.items())
                if cosine > top + 1e-12:
                    name, top = template, cosine
        return name, top


def _first(snippets: list[tuple[str, float, int, int, int]]) -> tuple[str, float, int, int, int]:
    """The snippet of greatest cosine; of equal ones the first template by name, the longer one of a name."""
    top = max(x[1] for x in snippets)
    return min((x for x in snippets if x[1] >= top - 1e-12), key=lambda x: (x[0], -x[2]))


def counted(texts: DataFrame, vocabulary: set[str]) -> DataFrame:
    """term, n: how many windows that hold a cue have a term of the vocabulary; the term '' has the number of windows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = terms(text)
                last = max(-(-(len(words) - WORDS) // (WORDS // 2)), 0)
                at = {min(w, last) for i, _ in cues(words) for w in (i // (WORDS // 2) - 1, i // (WORDS // 2)) if w >= 0}
                for w in at:
                    n.update(vocabulary.intersection(words[w * (WORDS // 2) : w * (WORDS // 2) + WORDS]))
                n[""] += len(at)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    return texts.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"(?s)/[^/]*\z", "")).when(path.isNotNull(), F.lit(""))


_ADDED = ("own_licence", "own_score", "declares", "licence", "inherited_from")


def own_licences(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, sure: float = SURE, texts: dict[str, tuple[str, ...]] = TEXTS, share: float = SHARE) -> DataFrame:
    """files(path, text, more) without text, with own_licence, own_score and declares (whether it speaks for its directory); stored."""
    kept = [c for c in files.columns if c != "text" and c.lower() not in _ADDED]
    name, size, n_words = unused(files, "text", "size", "n_words")
    narrow = stored(files.select(*map(column, kept), F.when(F.col("text").rlike(CUE), F.col("text")).alias(name)), "cues")
    vocabulary = {t for some in (templates, texts) for x in some.values() for y in x for t in terms(y)}
    held = narrow.select(column(name)).filter(F.col(name).isNotNull())
    frequency = {r["term"]: r["n"] for r in counted(held, vocabulary).collect()}  # of the templates' terms only
    shared = files.sparkSession.sparkContext.broadcast((templates, frequency, frequency.pop("", 0), texts))
    names = [*kept, "own_licence", "own_score", size, n_words]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(*shared.value)
        for batch in batches:
            found = [known.judged(text, sure) if text else (None, 0.0, 0, 0) for text in batch.column(batch.num_columns - 1).to_pylist()]
            new = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=names)

    out = mapped(narrow, judge, names, [*kinds(narrow)[:-1], "string", "double", "long", "long"])
    speaks = F.col("own_licence").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(FILE_NAME) | (F.col(size) >= share * F.col(n_words)))
    judged = stored(out.withColumn("declares", F.coalesce(speaks, F.lit(False))).drop(n_words, size), "licences")
    dropped(narrow)
    return judged


def with_inherited(files: DataFrame) -> DataFrame:
    """files(path, own_licence, own_score, declares, more) with licence and inherited_from (a directory; null where its own)."""
    at, up = unused(files, "dir", "up")
    places = files.select(_parent(F.col("path")).alias("dir"), "path", "own_licence", "own_score", "declares")
    declared = places.filter("declares").groupBy(F.col("dir").alias("ancestor")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_licence"))["own_licence"].alias("found"))
    declared = stored(declared, "declared")
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("ancestor")))
    chains = places.filter("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(ancestors)).alias("x")).select("dir", "x.*")
    nearest = stored(chains.join(declared, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "found")).alias("up")), "nearest")
    joined = files.withColumn(at, _parent(F.col("path"))).join(nearest.toDF(at, up), at, "left")
    own = F.col("own_licence").isNotNull()
    return joined.withColumns({"licence": F.coalesce("own_licence", f"{up}.found"), "inherited_from": F.when(~own, F.col(f"{up}.ancestor"))}).drop(at, up)


def with_licences(files: DataFrame, **options) -> DataFrame:
    """files(path, text, more) without text, with own_licence, own_score, declares, licence and inherited_from."""
    return with_inherited(own_licences(files, **options))


def op9_licences(spark, sf_dir: str) -> DataFrame:
    """Every document's licence.

    Documents have no paths: here they lie in source/language, in source/language/part or in
    source/language/part/part, by a hash of the id. There are no licence files among them either: a
    document that is at least a fiftieth licence passage speaks for its directory.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    parts = F.repeat(F.lit("part/"), F.pmod(F.crc32(name("doc_id").cast("binary")), F.lit(3)).cast("int"))
    files = docs.select("doc_id", F.concat(name("source"), F.lit("/"), name("lang"), F.lit("/"), parts, name("doc_id"), F.lit(".txt")).alias("path"), "text")
    return with_licences(files, share=0.02).select("doc_id", "path", "own_licence", "own_score", "licence", "inherited_from")
