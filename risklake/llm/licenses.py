"""License scans over a positional index of rare template words.

Templates are tokenised into an index from word to (template, position) postings. A first pass counts, over all documents,
in how many each template word occurs. Each template keeps postings of its rarest words only: as many as weigh, by IDF, more
than the 1 - MIN_SCORE that a place may miss. So every place that can reach MIN_SCORE has one of them, however common the
template is. In the second pass each occurrence of such a word proposes the relative place document place - template place,
and all proposed places are verified: each of the template's mandatory key phrases must stand where the template has it, give
or take a few words, and the share of template words that match, weighted by IDF, must reach MIN_SCORE. Base phrases are
found at all places, rare or not.

Bounds. Index and counts have one entry per template word; templates beyond MAX_TEMPLATE_WORDS words are refused.

Cases. A null or empty text has no words, no labels and score 0. Rows that repeat whole are scanned each. An empty table
gives no rows. Columns of the documents that bear one of the output's names are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklake.llm.common import table
from risklake.llm.decontaminate import Index
from risklake.llm.wordhash import Words, alphanumeric_table, text_groups

MAX_TEMPLATE_WORDS = 200_000
MIN_SCORE = 0.6
#: Words compared at a time when a template's places are verified.
COMPARED = 1_000_000
#: A base phrase without a verified template.
BASE_SCORE = 0.5

#: Phrase and label; fixed.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Template:
    """label, its notice, and the phrases without which a place is not accepted."""

    label: str
    text: str
    keys: tuple[str, ...]


TEMPLATES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template(
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.""",
        ("gnu general public license", "free software foundation", "version 3"),
    ),
    Template(
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.""",
        ("gnu general public license", "free software foundation", "version 2"),
    ),
    Template(
        "gpl-3.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license", "free software foundation", "version 3"),
    ),
    Template(
        "lgpl",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Template(
        "agpl-3.0",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu affero general public license", "version 3"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        ("apache license", "version 2 0", "in compliance with the license"),
    ),
    Template(
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
        a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
        ("apache license", "version 2 0", "in compliance with the license"),
    ),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge",),
    ),
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Bodies of short public licences, whole: label, text, key phrases.
BODIES = (
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
        OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
        of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
        this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
        as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
        ("permission is granted to anyone to use this software for any purpose",),
    ),
    Template(
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
        license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the
        above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
        Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
        ("any person or organization obtaining a copy",),
    ),
    Template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
        source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"),
    ),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
        this software under copyright law.""",
        ("free and unencumbered software",),
    ),
)
#: Identifier of the short form, label, and the title under which a licence's text begins, if it has one of its own; fixed.
SHORT = (
    ("MIT", "mit", None), ("Apache-2.0", "apache-2.0", "Apache License Version 2.0, January 2004"), ("ISC", "isc", None), ("Zlib", "zlib", None), ("BSL-1.0", "bsl-1.0", "Boost Software License Version 1.0"),
    ("BSD-2-Clause", "bsd", None), ("BSD-3-Clause", "bsd", None), ("Unlicense", "unlicense", None), ("MPL-2.0", "mpl-2.0", "Mozilla Public License Version 2.0"), ("EPL-2.0", "epl-2.0", "Eclipse Public License v 2.0"),
    ("GPL-2.0", "gpl-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "gpl-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "lgpl", "GNU Lesser General Public License Version 2.1, February 1999"), ("LGPL-3.0", "lgpl", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "agpl-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("CC0-1.0", "cc0-1.0", None), ("CC-BY-4.0", "cc-by-4.0", None), ("CC-BY-SA-4.0", "cc-by-sa-4.0", None), ("CC-BY-NC-4.0", "cc-by-nc-4.0", None),
)


def _plain(text: str) -> str:
    return " ".join(re.findall("[0-9a-z]+", text.lower()))


def short_forms() -> tuple[Template, ...]:
    """A template for each identifier's line and for each title; all of their words are mandatory."""
    lines = [(label, f"SPDX-License-Identifier: {name}") for name, label, _ in SHORT] + [(label, title) for _, label, title in SHORT if title]
    return tuple(Template(label, text, (_plain(text),)) for label, text in lines)


TEMPLATES = (*TEMPLATES, *BODIES, *short_forms())


def load_templates(rows: DataFrame) -> tuple[Template, ...]:
    """Templates from rows (label, text, keys), as Parquet or JSON hold them; more words than MAX_TEMPLATE_WORDS in all are refused, as is a template
    without a key phrase."""
    found = [Template(r["label"], r["text"], tuple(r["keys"] or ())) for r in rows.select("label", "text", "keys").orderBy("label", "text").limit(MAX_TEMPLATE_WORDS + 1).toLocalIterator()]
    if sum(len(template_words(t.text)) for t in found) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
    if bad := [t.label for t in found if not any(map(_plain, t.keys))]:
        raise ValueError(f"templates without a key phrase: {bad}")
    return tuple(Template(t.label, t.text, tuple(_plain(k) for k in t.keys)) for t in found)


def template_words(text: str) -> list[bytes]:
    """Words as documents have them, of a template in ASCII."""
    return [w.encode() for w in re.findall("[0-9a-z]+", text.lower())]


def _places_of(words: list[bytes], key: list[bytes]) -> list[int]:
    return [k for k in range(len(words) - len(key) + 1) if words[k : k + len(key)] == key]


class Lexicon:
    """The templates' words with their hashes, sorted by hash, and each template as a sequence of them."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.words = [template_words(t.text) for t in templates]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words in all")
        vocabulary = sorted({w for words in self.words for w in words})
        groups = list(text_groups(pa.array(vocabulary, pa.large_binary()), alphanumeric_table()))
        hashes = np.concatenate([g.hashes() for _, _, g in groups])
        order = np.argsort(hashes)
        self.hashes, self.vocabulary = hashes[order], [vocabulary[k] for k in order]
        number = {w: k for k, w in enumerate(self.vocabulary)}
        self.sequences = [np.array([number[w] for w in words]) for words in self.words]
        #: Of each template the places of each key phrase, and how far from them a phrase may stand.
        self.key_places = [{key: _places_of(words, template_words(key)) for key in t.keys} for t, words in zip(templates, self.words, strict=True)]
        self.slack = [max(1, len(words) // 10) for words in self.words]
        for t, places in zip(templates, self.key_places, strict=True):
            if not all(places.values()):
                raise ValueError(f"a key phrase is not in its template: {t.label}")

    def find(self, words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the chosen vocabulary words (sorted numbers) in a group of documents."""
        if not len(words) or not len(chosen):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, hashes = self.hashes[chosen], words.hashes()
        near = np.zeros(1 << 16, bool)
        near[(keys >> np.uint64(48)).astype(np.int64)] = True
        places = np.flatnonzero(near[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(keys, hashes[places]), len(keys) - 1)
        same = keys[at] == hashes[places]
        return places[same], chosen[at[same]]


def document_frequencies(docs: DataFrame, lexicon: Lexicon) -> tuple[int, np.ndarray]:
    """Number of documents, and for each vocabulary word the number that contain it; one small row per word and task is shuffled."""
    n = len(lexicon.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(n + 1, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for _, _, words in text_groups(batch.column(0), alphanumeric_table()):
                places, numbers = lexicon.find(words, np.arange(n))
                rows = np.searchsorted(words.docs, places, side="right") - 1
                seen = np.unique(rows * n + numbers) % n
                found[:n] += np.bincount(seen, minlength=n)
        found[n] = total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(found)], names=["word", "docs"])

    counted = docs.select("text").mapInArrow(count, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    by_word = {row["word"]: row["docs"] for row in counted.toLocalIterator()}
    return by_word.get(n, 0), np.array([by_word.get(k, 0) for k in range(n)], np.float64)


ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


class Matcher:
    def __init__(self, lexicon: Lexicon, n_docs: int, frequencies: np.ndarray):
        self.lexicon = lexicon
        self.idf = np.log((n_docs + 1) / (frequencies + 1)) + 1e-9
        #: For each template, positions of its rarest words: without all of them no place reaches MIN_SCORE.
        self.rare = []
        for words in lexicon.sequences:
            weights = self.idf[words]
            order = np.argsort(-weights, kind="stable")
            missed = np.cumsum(weights[order]) / weights.sum()
            self.rare.append(order[: int(np.searchsorted(missed, 1 - MIN_SCORE + 1e-6, side="right")) + 1])
        self.base = Index([(label, phrase) for phrase, label in BASE], 10)
        keys = sorted({k for t in lexicon.templates for k in t.keys})
        # A phrase is one window, however long.
        self.keys = Index([(k, k) for k in keys], max((len(k.split()) for k in keys), default=1))

    def document(self, places: np.ndarray, numbers: np.ndarray, keys: list[tuple[int, int, str]], words: Words, first: int, last: int) -> list[tuple[str, float]]:
        """Labels and scores of one document, its words first to last - 1, from its template words' places and its key phrases' places."""
        stands: dict[str, list[int]] = defaultdict(list)
        for a, _, phrase in sorted(keys):
            stands[phrase].append(a)
        at = np.full(last - first, -1, np.int64)
        at[places - first] = numbers
        found = []
        for template, said, sequence, rare, key_places, slack in zip(self.lexicon.templates, self.lexicon.words, self.lexicon.sequences, self.rare, self.lexicon.key_places, self.lexicon.slack, strict=True):
            if not all(phrase in stands for phrase in template.keys):
                continue
            length = len(sequence)
            offsets = np.unique(np.concatenate([places[numbers == sequence[q]] - q for q in rare]))
            for phrase, where in key_places.items():
                starts = np.array(stands[phrase])
                near = np.zeros(len(offsets), bool)
                for q in where:
                    next_one = np.minimum(np.searchsorted(starts, offsets + q - slack), len(starts) - 1)
                    near |= np.abs(starts[next_one] - offsets - q) <= slack
                offsets = offsets[near]
            weights = self.idf[sequence]
            scores = [np.empty(0)]
            for k in range(0, len(offsets), max(1, COMPARED // length)):
                here = offsets[k : k + max(1, COMPARED // length), None] + np.arange(length) - first
                same = (here >= 0) & (here < len(at)) & (at[np.clip(here, 0, len(at) - 1)] == sequence)
                scores.append((same * weights).sum(axis=1) / weights.sum())
            scores = np.concatenate(scores)
            for k in np.argsort(-scores, kind="stable").tolist():
                if scores[k] < MIN_SCORE - 1e-6:
                    break
                offset = int(offsets[k])
                same = np.array([first <= offset + q < last and words.word(offset + q) == w for q, w in enumerate(said)])
                score = float(weights[same].sum() / weights.sum())
                if score >= MIN_SCORE:
                    found.append((template.label, score))
                    break
        return found


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """docs(text, ...) -> docs with ADDED: words, places of base phrases, labels and a score from 0 to 1."""
    docs = docs.select(*[c for c in docs.columns if c not in ADDED.names])
    lexicon = Lexicon(templates)
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(lexicon, *document_frequencies(docs, lexicon)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher.value
        for batch in batches:
            n = batch.num_rows
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            ends: list[list] = [[None] * n, [None] * n]
            base: list[set] = [set() for _ in range(n)]
            more: list[list] = [[] for _ in range(n)]
            for first, upto, words in text_groups(batch.column(batch.schema.get_field_index("text")), alphanumeric_table()):
                n_words[first:upto] = np.diff(words.docs)
                starts, _, named = match.base.hits(words)
                rows = np.searchsorted(words.docs, starts, side="right") - 1
                for row, start, item in zip(rows.tolist(), (starts - words.docs[rows]).tolist(), named, strict=True):
                    n_base[first + row] += 1
                    ends[0][first + row] = min(start, ends[0][first + row] if ends[0][first + row] is not None else start)
                    ends[1][first + row] = max(start, ends[1][first + row] if ends[1][first + row] is not None else start)
                    base[first + row].add(match.base.items[item])
                starts, sizes, named = match.keys.hits(words)
                keys = defaultdict(list)
                for row, a, b, item in zip((np.searchsorted(words.docs, starts, side="right") - 1).tolist(), starts.tolist(), (starts + sizes).tolist(), named, strict=True):
                    keys[row].append((a, b, match.keys.items[item]))
                places, numbers = match.lexicon.find(words, np.arange(len(match.lexicon.vocabulary)))
                rows = np.searchsorted(words.docs, places, side="right") - 1
                for row in sorted(keys):  # a document without any key phrase has no template to verify
                    own = slice(*np.searchsorted(rows, [row, row + 1]))
                    more[first + row] = match.document(places[own], numbers[own], keys[row], words, words.docs[row], words.docs[row + 1])
            labels = [",".join(sorted(base[k] | {label for label, _ in more[k]})) for k in range(n)]
            scores = [max([BASE_SCORE * bool(base[k]), *(score for _, score in more[k])]) for k in range(n)]
            made = [pa.array(n_words), pa.array(n_base), pa.array(ends[0], pa.int64()), pa.array(ends[1], pa.int64())]
            made += [pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *ADDED.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *ADDED.fields]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *ADDED.names)
