"""Licence scans: an exact set-similarity join of text blocks with licence templates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.common import bounded_batches, keyed_texts, renamed

# Phrases that the base rule looks for, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Sentences of public licences and notices, and their labels.
SENTENCES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
)
# Whole texts of short public licences, and the notices that longer ones ask for, as words.
NOTICES = (
    (
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the software the software is provided as is without warranty of any
        kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose
        and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
        other dealings in the software""",
        "mit",
    ),
    (
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and
        the following disclaimer in the documentation and or other materials provided with the distribution neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission this software is provided by the copyright holders and contributors as
        is and any express or implied warranties including but not limited to the implied warranties of merchantability and
        fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any
        direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
        substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
        liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the
        use of this software even if advised of the possibility of such damage""",
        "bsd",
    ),
    (
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is
        and the author disclaims all warranties with regard to this software including all implied warranties of merchantability
        and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any
        damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
        tortious action arising out of or in connection with the use or performance of this software""",
        "isc",
    ),
    (
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or
        agreed to in writing software distributed under the license is distributed on an as is basis without warranties or
        conditions of any kind either express or implied see the license for the specific language governing permissions and
        limitations under the license""",
        "apache",
    ),
    (
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation either version 3 of the license or at your option any later version this
        program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public license for more details you should have
        received a copy of the gnu general public license along with this program if not see http www gnu org licenses""",
        "gpl",
    ),
    (
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
        with this file you can obtain one at http mozilla org mpl 2 0""",
        "mpl",
    ),
)
TEMPLATES = (*SENTENCES, *((" ".join(text.split()), label) for text, label in NOTICES))
#: A block holds a template if it has at least this share of the template's distinct words.
THRESHOLD = 0.8
#: Blocks for templates of up to `step` words are windows of two steps that start every step of words, across line ends, so that
#: each place of a template lies in one. The steps are powers of two from this one on; lines are blocks for the first step too.
FIRST_STEP = 32

#: Lower-cases A-Z; every byte that is no word byte becomes a space, but line ends stay.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256))


def normal(text: bytes) -> bytes:
    """The text with words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in lower case and only spaces and line ends between them."""
    return text.translate(_WORD_BYTES)


def step_of(template: str) -> int:
    step = FIRST_STEP
    while step < len(template.split()):
        step *= 2
    return step


def windows(words: list[bytes], step: int) -> Iterator[list[bytes]]:
    yield words[: 2 * step]
    for at in range(step, max(len(words) - step, 0), step):
        yield words[at : at + 2 * step]


def blocks(text: bytes, words: list[bytes], step: int) -> Iterator[list[bytes]]:
    """The blocks of a normal() text and its words for templates of up to `step` words."""
    yield from windows(words, step)
    if step == FIRST_STEP:
        lines = text.split(b"\n")
        for line in lines if len(lines) > 1 else ():
            yield from windows(line.split(), step)


class TemplateIndex:
    """Templates as sets of tokens in the corpus' order of frequency, rarest first, with an index on their prefixes."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], threshold: float) -> None:
        vocabulary = sorted({w for text, _ in templates for w in text.encode().split()}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.labels = [label for _, label in templates]
        self.sets = [frozenset(self.rank[w] for w in text.encode().split()) for text, _ in templates]
        self.need = [next(n for n in range(1, len(s) + 1) if n / len(s) >= threshold) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.sets):
            for i, token in enumerate(sorted(s)[: len(s) - self.need[t] + 1]):
                self.prefix.setdefault(token, []).append((t, i))
        self.prefix_words = frozenset(w for w in vocabulary if self.rank[w] in self.prefix)

    def reachable(self, words: set[bytes]) -> bool:
        """Whether a text of these words can have a block that holds a template: the filters, for the text as one block."""
        return not self.prefix_words.isdisjoint(words) and any(True for _ in self.matches(words))

    def matches(self, words: Iterable[bytes]) -> Iterator[tuple[int, float]]:
        """(template, containment) of every template of which the block has enough tokens."""
        have = {self.rank[w] for w in words if w in self.rank}
        seen: dict[int, int] = {}
        for j, token in enumerate(sorted(have)):
            for t, i in self.prefix.get(token, ()):
                if len(have) < self.need[t] or seen.get(t) == -1:  # length filter; ruled out before
                    continue
                shared = seen.get(t, 0)
                reach = shared + 1 + min(len(self.sets[t]) - i - 1, len(have) - j - 1)  # positional filter
                seen[t] = shared + 1 if reach >= self.need[t] else -1
        for t, shared in seen.items():
            if shared > 0 and (both := len(self.sets[t] & have)) >= self.need[t]:
                yield t, both / len(self.sets[t])


def base_places(spaced: bytes, phrases: tuple[tuple[str, str], ...]) -> tuple[int, int | None, int | None, set[str]]:
    """(places, first start, last start, labels) of the phrases in words that single spaces separate and surround."""
    n, starts, labels = 0, [], set()
    for phrase, label in phrases:
        sought = b" " + phrase.encode() + b" "
        at = first = spaced.find(sought)
        if at < 0:
            continue
        while at >= 0:
            n, last, at = n + 1, at, spaced.find(sought, at + 1)
        starts += [spaced.count(b" ", 0, first), spaced.count(b" ", 0, last)]
        labels.add(label)
    return n, min(starts, default=None), max(starts, default=None), labels


def token_frequency(docs: DataFrame, templates: tuple[tuple[str, str], ...], text_col: str) -> dict[bytes, int]:
    """In how many texts each template token stands, over all texts. One row for each template token reaches the driver."""
    vocabulary = frozenset(w for text, _ in templates for w in text.encode().split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(vocabulary, 0)
        for b in batches:
            for text in b.column(0).to_pylist():
                for w in vocabulary.intersection(normal(text or b"").split()):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    found = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "token binary, n long")
    return {bytes(r["token"]): r["n"] for r in found.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score), one for each row of docs.

    A first pass counts the template tokens over all texts; that order of frequency fixes the prefixes. The second pass joins
    every block of every text with the templates through prefix, length and positional filters and an exact check; a text
    that does not hold a template as a whole has no block that does. The templates are a fixed list, so tasks carry them and
    no text is shuffled. Blocks are windows at least twice as long as the template, so notices wrapped over lines are found. score: the highest containment found, 0 if none.

    Null texts count as empty; null ids and repeated rows are passed on; a text without words has no labels, null first_word
    and last_word and score 0; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    keyed = keyed_texts(docs, id_col, text_col)
    frequency = token_frequency(docs, templates, text_col)
    steps = {step: tuple(t for t in templates if step_of(t[0]) == step) for step in sorted({step_of(t) for t, _ in templates})}
    indexes = {step: TemplateIndex(some, frequency, threshold) for step, some in steps.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                lines = normal(text or b"")
                words = lines.split()
                n, first, last, base = base_places(b" ".join([b"", *words, b""]), phrases)
                labels, score = set(base), 0.0
                mine = set(words)
                for step, index in indexes.items():
                    if index.reachable(mine):
                        for block in blocks(lines, words, step):
                            for t, share in index.matches(block):
                                labels.add(index.labels[t])
                                score = max(score, share)
                rows.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType()]
    schema = T.StructType([renamed(keyed.schema["id"], "id"), *(T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=True))])
    return keyed.mapInArrow(scan, schema).select(F.col("id").alias(id_col), *names[1:])
