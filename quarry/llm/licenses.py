"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance along directories."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import slices, written
from quarry.session import small_batches

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_COPYING = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: Licence notices and whole licence texts by name, as they are commonly given: fixed values. Any passage may match them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", _GPL_HEADER.replace("GNU General", "GNU Affero General").format(3)),
    "All-rights-reserved": ("All rights reserved.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", f"{_BSD_TERMS}\n{_BSD_DISCLAIMER}"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", _BSD_TERMS.split("\n")[0], f"{_BSD_TERMS}\n{_BSD_THIRD}\n{_BSD_DISCLAIMER}"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _GPL_HEADER.format(2)),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _GPL_HEADER.format(3)),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", _GPL_HEADER.replace("GNU General", "GNU Lesser General").replace("program", "library").format(3)),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", _MIT_BODY),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
}
#: How long licence texts begin, where the whole is not given above: fixed values. The first words of a file are compared with them.
OPENINGS: dict[str, str] = {
    "AGPL-3.0": f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_COPYING}",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "CC0-1.0": "Creative Commons Legal Code CC0 1.0 Universal",
    "GPL-2.0": f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_COPYING}",
    "GPL-3.0": f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_COPYING}",
    "LGPL-3.0": f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_COPYING}",
    "MPL-2.0": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
}
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+)")
#: Words share 2^18 counters of documents; one that fewer than a thousandth of the documents hold weighs like one that a thousandth hold.
_BITS, _RAREST = 18, 1e-3


def words_of(text: str) -> list[str]:
    """ASCII words and version numbers of the lower-case text."""
    return _WORD.findall(text.lower())


def counter_of(word: str) -> int:
    return zlib.crc32(word.encode()) >> (32 - _BITS)


class Matcher:
    """Templates as sparse vectors. A word weighs 1 - ln of the share of all documents that hold it, whatever the number of documents."""

    def __init__(self, templates: dict[str, tuple[str, ...]], openings: dict[str, str], held: np.ndarray, documents: int, threshold: float):
        self.threshold, self.documents = threshold, documents
        self.weight = (1 - np.log(np.clip(held / max(documents, 1), _RAREST, 1.0))).astype(np.float64)
        every = sorted([(name, False, words_of(t)) for name, texts in templates.items() for t in texts] + [(name, True, words_of(t)) for name, t in openings.items()])
        every = [x for x in every if x[2]]
        self.names, self.opening, self.lengths = [x[0] for x in every], [x[1] for x in every], [len(x[2]) for x in every]
        self.licences = {x.lower(): x for x in {**templates, **openings}}
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for *_, words in every for w in words}))}
        self.idf = np.array([self.weight[counter_of(w)] for w in self.vocabulary])
        self.matrix = np.zeros((len(every), len(self.vocabulary)))
        for row, (*_, words) in enumerate(every):
            for w in words:
                self.matrix[row, self.vocabulary[w]] += 1
        self.matrix *= self.idf
        self.matrix /= np.maximum(np.linalg.norm(self.matrix, axis=1, keepdims=True), 1e-300)
        self.squares = self.matrix**2

    def cosine(self, row: int, words: list[str]) -> float:
        """The cosine of a passage to a template."""
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        dot = norm = 0.0
        for w, n in counts.items():
            k = self.vocabulary.get(w)
            x = n * (self.idf[k] if k is not None else self.weight[counter_of(w)])
            norm += x * x
            if k is not None:
                dot += x * self.matrix[row, k]
        return min(1.0, round(dot / norm**0.5, 12)) if norm else 0.0

    def _window(self, row: int, words: list[str], known: np.ndarray, least: float) -> float:
        """The highest cosine, least or more, of any run of as many words as the template has, else 0.

        The squared length of a run is at least the sum of its squared weights, so prefix sums bound all cosines at once; runs are
        looked at in the order of their bounds until none can be higher.
        """
        n = min(self.lengths[row], len(words))
        weights = np.where(known >= 0, self.idf[known], 0.0)
        weights[known < 0] = [self.weight[counter_of(words[i])] for i in np.flatnonzero(known < 0).tolist()]
        dots = np.concatenate(([0.0], np.cumsum(np.where(known >= 0, weights * self.matrix[row, known], 0.0))))
        norms = np.concatenate(([0.0], np.cumsum(weights**2)))
        bounds = (dots[n:] - dots[:-n] + 1e-9) / np.sqrt(np.maximum(norms[n:] - norms[:-n], 1e-300))
        best = 0.0
        for at in np.argsort(-bounds, kind="stable").tolist():
            if bounds[at] < max(least, best):
                break
            found = self.cosine(row, words[at : at + n])
            best = found if found >= least and found > best else best
        return best

    def scan(self, text: str) -> tuple[str | None, float, bool]:
        """The licence of a text, its score, and whether the text is a licence file: (None, 0, False) if none reaches the threshold."""
        words = words_of(text)
        own = sorted(self.vocabulary[w] for w in self.vocabulary.keys() & set(words))
        # The cosine of any passage is at most the length of the template's part in the words that the text holds at all.
        rows = np.flatnonzero(self.squares[:, own].sum(axis=1) >= self.threshold**2 - 1e-9).tolist() if own else []
        files, headers = [], []
        if rows:
            known = np.array([self.vocabulary.get(w, -1) for w in words])
            for row in rows:
                whole = self.cosine(row, words[: self.lengths[row]] if self.opening[row] else words)
                if whole >= self.threshold:
                    files.append((-whole, self.names[row]))
                elif not self.opening[row] and not files:
                    headers.append((-self._window(row, words, known, self.threshold), self.names[row]))
        if files:
            return min(files)[1], -min(files)[0], True
        for tag in _TAG.findall(text):
            if (name := self.licences.get(re.sub(r"(-only|-or-later|\+)$", "", tag.lower()))) is not None:
                headers.append((-1.0, name))
        score, name = min(headers, default=(0.0, ""))
        return (name, -score, False) if score < 0 else (None, 0.0, False)


def _held(files: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents words of each counter stand, and how many documents there are: at most a row for each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kept = np.zeros((1 << _BITS) + 1, np.int64), 0, {}
        for batch in batches:
            for _, texts in slices(batch):
                for text in texts:
                    own = set(words_of(text))
                    new = own.difference(kept)
                    if len(kept) > 300_000:
                        kept, new = {}, own
                    kept.update((w, counter_of(w)) for w in new)
                    held[list({kept[w] for w in own})] += 1
                    n += 1
        held[-1] = n
        has = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(held[has])], ["counter", "n"])

    held = np.zeros((1 << _BITS) + 1, np.int64)
    sums = files.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    for batch in sums.toArrow().to_batches():
        held[batch.column("counter").to_numpy()] = batch.column("n").to_numpy()
    return held[:-1], int(held[-1])


def scanned(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.8, salts: int = 32, openings: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, path, license, score, basis, directory) for each row of files (doc_id, path, text; other columns are not looked at).

    Passages are compared with each template by the cosine of TF-IDF vectors of all their words; document frequencies are counted over
    all files. A text that reaches the threshold as a whole, or whose first words reach it for the opening of a long licence, is a
    licence file (basis `file`); one in which any run of as many words as a template has does, or that has an SPDX tag of a known name
    (score 1), has a header (`header`). A file without either takes the licence of the nearest directory above it that holds a
    licence file (`inherited`, with the directory). Scores are rounded to 12 digits; of equal ones the first name counts, in a text
    and in a directory. Otherwise license, basis and directory are null and score is 0. Null texts count as empty; a null path
    inherits and hands down nothing; repeated rows and null doc_ids give a row each; an empty table gives no rows. The join that
    hands licences down divides each directory into `salts` parts.
    """
    small_batches(files.sparkSession)
    held, documents = _held(files)
    matcher = Matcher(TEMPLATES if templates is None else templates, (OPENINGS if templates is None else {}) if openings is None else openings, held, documents, threshold)
    shared = files.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scan(t) for _, texts in slices(batch) for t in texts]
            columns = [batch.column("doc_id"), batch.column("path"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "path", "license", "score", "whole"])

    cut = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = written(cut.mapInArrow(run, "doc_id long, path string, license string, score double, whole boolean"), "licenses", documents)
    first = F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))
    holders = own.where("whole and path is not null").groupBy(_parent("path").alias("directory")).agg(F.min_by(F.struct("license", "score"), first).alias("given"))
    bare = own.where("license is null and path is not null").select(_parent("path").alias("home")).distinct()
    above = bare.select("home", F.explode(_ancestors("home")).alias("directory"))
    nearest = above.join(holders, "directory").groupBy("home").agg(F.max_by(F.struct("directory", "given"), F.length("directory")).alias("from"))
    # A directory may hold a third of all files, and files with a licence have no home to look up: both are spread over the salts.
    salted = own.select("*", F.when(F.col("license").isNull(), _parent("path")).alias("home"), F.pmod(F.xxhash64("doc_id", "path"), F.lit(salts)).alias("salt"))
    joined = salted.join(nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), ["home", "salt"], "left")
    basis = F.when(F.col("license").isNotNull(), F.when(F.col("whole"), "file").otherwise("header")).when(F.col("from").isNotNull(), "inherited")
    return joined.select("doc_id", "path", F.coalesce("license", "from.given.license").alias("license"), "score", basis.alias("basis"), F.col("from.directory").alias("directory"))


def _parent(path: str) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _ancestors(path: str) -> Column:
    """The directory itself and all above it; the root is empty."""
    parts = F.split(path, "/")
    return F.when(F.col(path) == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    )
