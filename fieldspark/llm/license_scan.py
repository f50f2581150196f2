"""License scan: exact containment join of text blocks with license templates, and sentences word by word.

Templates are the paragraphs that licenses are put on files with. A block is a stretch of words of the whole text (or, without ``across_lines``,
of a line), twice as long as the longest template, the next one beginning half a block later; so every place as long as a template
lies whole in a block, and hard-wrapped or commented headers are found. A block matches a template when it holds at least ``THRESHOLD`` of
its distinct words, and all of its key words if it has any (by which it differs from its kin). The join is exact: words are ordered by how
often the whole corpus uses them, rare ones first; a matching block must hold one of the first n - o + 1 words of the template (o: words
needed of n), have o template words at all (length filter), and have enough words left behind the first common one on either side
(positional filter). Only blocks that pass are counted out. A template's label does not count in a text that also matches a more specific
one, which holds its words and has key words besides: a header of the lesser or the network license is not one of the general license, too.

Statements, one sentence or less, are found only with their words in order, one after the other, wherever lines break; so are the base
phrases. Templates, statements and phrases are a fixed, small list, so their tables go to every task; the corpus frequencies are one
number per template word.

Odd inputs: null texts are empty; empty texts give no words, no labels, score 0; repeated rows each give their row; other columns
stay, those that clash with the new ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.common import table
from fieldspark.llm.queries import query
from fieldspark.llm.words import ALNUM, split_words, with_columns

BLOCK, STEP, THRESHOLD = 64, 32, 0.9

#: Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Statements of a license, their words in order, and their labels.
STATEMENTS = [
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("to the extent possible under law the author has waived all copyright and related rights to this work", "cc0"),
    ("all rights reserved", "reserved"),
]

_GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either"
    " version 3 of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY"
    " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
    " You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."
)
_CC = (
    "This work is licensed under the Creative Commons {0} 4.0 International License. To view a copy of this license, visit"
    " http://creativecommons.org/licenses/{1}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
)

#: The paragraphs by which licenses are put on files, their labels, and key words.
PARAGRAPHS = [
    (_GNU.format("program", "General Public License"), "gpl", ""),
    (_GNU.format("library", "Lesser General Public License"), "lgpl", "lesser"),
    (_GNU.format("program", "Affero General Public License"), "agpl", "affero"),
    (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a'
        " copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed"
        ' under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for'
        " the specific language governing permissions and limitations under the License.",
        "apache", "apache",
    ),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        ' "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,'
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "mit", "",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in"
        " binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution.",
        "bsd", "",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"
        " copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH"
        " REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "isc", "",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You"
        " can obtain one at https://mozilla.org/MPL/2.0/.",
        "mpl", "mozilla",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute"
        " this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense", "unencumbered",
    ),
    (_CC.format("Attribution", "by"), "cc-by", ""),
    (_CC.format("Attribution-ShareAlike", "by-sa"), "cc-by-sa", "sharealike"),
    (_CC.format("Attribution-NonCommercial", "by-nc"), "cc-by-nc", "noncommercial"),
    (_CC.format("Attribution-NoDerivatives", "by-nd"), "cc-by-nd", "noderivatives"),
]


def words_only(text: str) -> str:
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text)))


TEMPLATES = [(words_only(text), label, keys) for text, label, keys in PARAGRAPHS]

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def needed(n: int, threshold: float) -> int:
    """Words of n that make at least the threshold."""
    return math.ceil(n * threshold - 1e-9)


class Vocabulary:
    """The distinct words of the templates by their hash."""

    def __init__(self, templates: list[tuple]):
        sets = [sorted(set(t[0].split())) for t in templates]
        words = sorted({w for s in sets for w in s})
        hashes = split_words(pa.array(words), ALNUM).hashes()
        order = np.argsort(hashes)
        self.words = [words[i] for i in order]
        self.hashes = hashes[order]
        number = {w: i for i, w in enumerate(self.words)}
        self.sets = [np.array([number[w] for w in s]) for s in sets]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words that no template has."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def corpus_frequencies(docs: DataFrame, text: str, vocabulary: Vocabulary) -> np.ndarray:
    """How often all texts use each template word: one pass, counted per task and summed; one number per template word comes back."""

    def count(batches):
        n = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                found = vocabulary.numbers(split_words(batch.column(0).slice(lo, 256), ALNUM).hashes())
                n += np.bincount(found[found >= 0], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["word", "n"])

    out = np.zeros(len(vocabulary.words), np.int64)
    for word, n in docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out


class Index:
    """Templates with their words in global order, and the inverted index of their prefixes.

    ``templates``: (words, label) or (words, label, key words).
    """

    def __init__(self, vocabulary: Vocabulary, frequencies: np.ndarray, templates: list[tuple], threshold: float):
        labels = [t[1] for t in templates]
        order = np.lexsort((np.arange(len(frequencies)), frequencies))
        self.vocabulary, self.labels, self.rank = vocabulary, labels, np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.size = np.array([len(s) for s in vocabulary.sets])
        self.needed = np.array([needed(n, threshold) for n in self.size])
        self.holds = np.zeros((len(labels), len(order)), bool)
        prefix: list[list[tuple[int, int]]] = [[] for _ in order]
        for k, s in enumerate(vocabulary.sets):
            ranks = np.sort(self.rank[s])
            self.holds[k, ranks] = True
            for place, r in enumerate(ranks[: self.size[k] - self.needed[k] + 1]):
                prefix[r].append((k, place))
        keys = [set(t[2].split()) if len(t) > 2 else set() for t in templates]
        number = {w: i for i, w in enumerate(vocabulary.words)}
        self.key = np.zeros_like(self.holds)
        for k, own in enumerate(keys):
            self.key[k, [self.rank[number[w]] for w in own]] = True
        self.n_keys = self.key.sum(1)
        sets = [set(t[0].split()) for t in templates]
        #: by template: those that are more specific
        self.above = [
            [a for a in range(len(sets)) if keys[a] and not keys[a] <= sets[b] and len(sets[a] & sets[b]) >= self.needed[b]] for b in range(len(sets))
        ]
        self.prefix_at = np.concatenate(([0], np.cumsum([len(p) for p in prefix])))
        flat = [x for p in prefix for x in p]
        self.prefix = np.array(flat, np.int64).reshape(-1, 2)

    def matches(self, block: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, containment) for all matches; block and rank: distinct pairs in order."""
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        number = np.cumsum(np.concatenate(([False], block[1:] != block[:-1])))
        size = np.diff(np.concatenate((first, [len(block)])))
        n = self.prefix_at[rank + 1] - self.prefix_at[rank]
        pair = np.repeat(np.arange(len(block)), n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.prefix_at[rank], n)
        template, place = self.prefix[entry].T
        which = number[pair]
        long_enough = size[which] >= self.needed[template]
        pair, template, place, which = pair[long_enough], template[long_enough], place[long_enough], which[long_enough]
        _, once = np.unique(which * len(self.labels) + template, return_index=True)  # the first common word of each candidate
        pair, template, place, which = pair[once], template[once], place[once], which[once]
        left = np.minimum(self.size[template] - place, size[which] - (pair - first[which]))
        template, which = template[left >= self.needed[template]], which[left >= self.needed[template]]
        n = size[which]
        word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[which], n)
        hit = self.holds[np.repeat(template, n), rank[word]]
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n) if len(n) else np.zeros(0, np.int64)
        key = self.key[np.repeat(template, n), rank[word]]
        keys = np.add.reduceat(key.astype(np.int64), np.cumsum(n) - n) if len(n) else np.zeros(0, np.int64)
        ok = (common >= self.needed[template]) & (keys == self.n_keys[template])
        return block[first[which[ok]]], template[ok], common[ok] / self.size[template[ok]]


def block_pairs(new: np.ndarray, known: np.ndarray, rank: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct block * width + rank of the known words, and the first word of each block's stretch.

    ``new`` marks the words that begin a stretch (a line or a text); blocks of 2 * step words begin every step words of it.
    """
    start = np.flatnonzero(new)
    stretch = np.cumsum(new) - 1
    blocks = np.maximum(1, -(-(np.diff(np.concatenate((start, [len(new)]))) - step) // step))
    block_at = np.cumsum(blocks) - blocks
    k = (known - start[stretch[known]]) // step
    own, before = k < blocks[stretch[known]], k >= 1
    at = block_at[stretch[known]] + k
    pairs = np.unique(np.concatenate((at[own] * width + rank[own], (at - 1)[before] * width + rank[before])))
    return pairs, np.repeat(start, blocks)


def occurrences(phrase: np.ndarray, hashes: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """First words of all places where the words of a phrase follow each other in a row."""
    upto = max(0, len(hashes) - len(phrase) + 1)
    here = np.flatnonzero(hashes[:upto] == phrase[0])
    for j in range(1, len(phrase)):
        here = here[hashes[here + j] == phrase[j]]
    return here[row_of[here] == row_of[here + len(phrase) - 1]]


def scan_texts(column: pa.Array, index: Index, phrases: list, statements: list, step: int = STEP, across_lines: bool = False) -> list:
    words = split_words(column, ALNUM)
    hashes, row_of = words.hashes(), words.rows()
    n_rows = len(column)
    n_base, first, last = np.zeros(n_rows, np.int64), np.full(n_rows, np.iinfo(np.int64).max), np.full(n_rows, -1)
    base: list[set] = [set() for _ in range(n_rows)]
    for phrase, label in phrases:
        here = occurrences(phrase, hashes, row_of)
        row, place = row_of[here], here - words.row_at[row_of[here]]
        np.add.at(n_base, row, 1)
        np.minimum.at(first, row, place)
        np.maximum.at(last, row, place)
        for r in np.unique(row):
            base[r].add(label)
    found = index.vocabulary.numbers(hashes)
    known = np.flatnonzero(found >= 0)
    labels, score = [set(b) for b in base], np.where(n_base > 0, 1.0, 0.0)
    for phrase, label in statements:
        for r in np.unique(row_of[occurrences(phrase, hashes, row_of)]):
            labels[r].add(label)
            score[r] = 1.0
    if len(known):
        # lines: a new one begins with each row and after each line break
        breaks = np.cumsum(words.raw == 10)[words.start] if len(words.raw) else np.zeros(0, np.int64)
        text_start = np.concatenate(([True], row_of[1:] != row_of[:-1]))
        line_start = text_start | np.concatenate(([True], breaks[1:] != breaks[:-1]))
        rank, width = index.rank[found[known]], len(index.rank)
        pairs, first_of = block_pairs(text_start if across_lines else line_start, known, rank, width, step)
        block, template, share = index.matches(pairs // width, pairs % width)
        row = row_of[first_of[block]]
        np.maximum.at(score, row, share)
        matched = set(zip(row.tolist(), template.tolist(), strict=True))
        for r, t in matched:
            if not any((r, a) in matched for a in index.above[t]):
                labels[r].add(index.labels[t])
    none = n_base == 0
    return [
        pa.array(words.per_row(), pa.int64()),
        pa.array(n_base),
        pa.array(first, pa.int64(), mask=none),
        pa.array(last, pa.int64(), mask=none),
        pa.array([",".join(sorted(b)) for b in base]),
        pa.array([",".join(sorted(x)) for x in labels]),
        pa.array(score),
    ]


def scan_licenses(
    docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=PHRASES, statements=STATEMENTS, threshold: float = THRESHOLD, across_lines: bool = True
) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score (the largest containment found)."""
    step = step_of(templates)
    vocabulary = Vocabulary(templates)
    index = Index(vocabulary, corpus_frequencies(docs, text, vocabulary), templates, threshold)
    coded, said = ([(split_words(pa.array([phrase]), ALNUM).hashes(), label) for phrase, label in own] for own in (phrases, statements))
    return with_columns(docs, text, FIELDS, lambda column: scan_texts(column, index, coded, said, step, across_lines))


def step_of(templates: list[tuple]) -> int:
    return max(STEP, *[len(t[0].split()) for t in templates])


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), w AS (
  SELECT doc_id, k, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d
), p AS (
  SELECT string_split(phrase, ' ') AS phrase, label, true AS base FROM (VALUES {_values(PHRASES)}) AS v(phrase, label)
  UNION ALL SELECT string_split(phrase, ' '), label, false FROM (VALUES {_values(STATEMENTS)}) AS v(phrase, label)
), found AS (
  SELECT k, s - 1 AS place, label, base
  FROM (SELECT k, words, phrase, label, base, unnest(range(1, len(words) - len(phrase) + 2)) AS s FROM w, p
        WHERE len(words) >= len(phrase) AND contains(' ' || array_to_string(words, ' ') || ' ', ' ' || array_to_string(phrase, ' ') || ' '))
  WHERE words[s : s + len(phrase) - 1] = phrase
), places AS (
  SELECT k, place, label FROM found WHERE base
), base AS (
  SELECT k, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM places GROUP BY k
), blocks AS (
  SELECT k, list_distinct(words[s + 1 : s + {2 * step_of(TEMPLATES)}]) AS b
  FROM (SELECT k, words, unnest(range(0, greatest(len(words) - {step_of(TEMPLATES)}, 1), {step_of(TEMPLATES)})) AS s FROM w WHERE len(words) > 0)
), tm AS (
  SELECT n, list_distinct(string_split(template, ' ')) AS t, label, list_filter(string_split(keys, ' '), lambda x: x <> '') AS keys
  FROM (SELECT *, row_number() OVER () AS n FROM (VALUES {_values(TEMPLATES)}) AS v(template, label, keys))
), above AS (
  SELECT a.n AS a, b.n AS b FROM tm a, tm b
  WHERE len(a.keys) > 0 AND len(list_intersect(a.keys, b.t)) < len(a.keys) AND len(list_intersect(a.t, b.t)) >= ceil(len(b.t) * {THRESHOLD} - 1e-9)
), m AS (
  SELECT k, n, label, max(len(list_intersect(b, t)) / len(t)) AS share FROM blocks, tm
  WHERE len(b) >= ceil(len(t) * {THRESHOLD} - 1e-9) AND len(list_intersect(b, t)) >= ceil(len(t) * {THRESHOLD} - 1e-9) AND len(list_intersect(b, keys)) = len(keys)
  GROUP BY k, n, label
), own AS (
  SELECT k, label FROM m WHERE NOT EXISTS (SELECT 1 FROM m x JOIN above ON above.a = x.n WHERE x.k = m.k AND above.b = m.n)
), s AS (
  SELECT k, max(share) AS score FROM (SELECT k, share FROM m UNION ALL SELECT k, 1 FROM found) GROUP BY k
), bl AS (
  SELECT k, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT k, label FROM places) GROUP BY k
), al AS (
  SELECT k, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM found UNION SELECT k, label FROM own) GROUP BY k
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (k) LEFT JOIN s USING (k) LEFT JOIN bl USING (k) LEFT JOIN al USING (k)
"""


@query("op4_license_scan", ORACLE)
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
