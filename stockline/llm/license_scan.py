"""Licence texts in documents, found with a generalised suffix automaton over their words.

All templates and base phrases are put into one automaton: its states are the distinct sets of places where a sequence
of template words ends. A document's words are streamed through it; at each word the automaton knows the longest
sequence of words ending there that stands in any template (the matching statistics). From these come

* base places: a phrase stands wherever it is a suffix of the longest match (told by the state's suffix links);
* long matches: those of ``LEAST_MATCH`` words and more that the next word does not lengthen, with all places of
  their template. Matches of one template that follow each other in both, not more than ``GAP`` words apart, are
  chained so that as many of the template's words as possible are covered. A chain that covers ``LEAST_SHARE`` of a
  template is a span and gives the document the template's label.

``score`` is the largest share of any template, or phrase, that a chain covers; phrases count whole or not at all.

The automaton is walked only where it can leave its first states: words and pairs of neighbouring words that no template
holds are told apart in arrays (a match of two words and more consists of template pairs only, so nothing is lost), and
the words that are left are compared letter by letter. It has at most two states per template word, so every task
builds its own; no document leaves its task. A text is worked on whole; memory follows the longest single text.

Defined cases: null, empty and wordless texts have no words, no places, empty labels and score 0. Repeated rows give
repeated results; a null doc_id stays null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockline.llm.common import LOWER, UPPER, RangeHash, blocks, fold_bytes, worker_value
from stockline.llm.words import byte_class, spans

LEAST_MATCH, GAP, LEAST_SHARE = 4, 24, 0.7
#: Words are runs of letters, digits and everything beyond ASCII.
WORD_BYTES = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The base phrases with their labels, and public licence notices word by word.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.",
        "Licensed under the MIT License."],
    "apache": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0."],
    "gpl": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with
        this program. If not, see https://www.gnu.org/licenses/.""",
        "This work is licensed under the GNU General Public License, version 3."],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written
        permission."""],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""],
    "cc-by": ["Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(str.maketrans(UPPER, LOWER)))


class SuffixAutomaton:
    """States of all subsequences of consecutive words of some sequences, with the places where they end."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for number, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self.next[state][word]
                self.ends[state].append((number, place + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def _state(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        new = self._state(self.length[last] + 1, 0, {}) if known is None else None
        at = last
        while known is None and at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            return new
        target = self.next[at][word]
        if self.length[target] != self.length[at] + 1:
            twin = self._state(self.length[at] + 1, self.link[target], dict(self.next[target]))
            self.link[target] = twin
            while at >= 0 and self.next[at].get(word) == target:
                self.next[at][word] = twin
                at = self.link[at]
            target = twin
        if new is None:
            return target
        self.link[new] = target
        return new

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each word, the state and length of the longest match that ends with it."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


@dataclass(frozen=True)
class Chain:
    """Words ``first`` to ``last`` of a document that cover ``covered`` words of a template."""

    template: int
    first: int
    last: int
    covered: int


def best_chains(template: int, matches: list[tuple[int, int, int]]) -> list[Chain]:
    """Chains that don't share words, the best ones if they would. ``matches`` has (end in document, end in template, words), by ends."""
    best: list[tuple[int, int]] = []
    for j, (end, place, size) in enumerate(matches):
        top = (size, -1)
        for k in range(j - 1, -1, -1):
            before, earlier, long = matches[k]
            if before < end - size - GAP:
                break
            if before - long < end - size and earlier - long < place - size and before < end and earlier < place:
                more = size - max(0, before - (end - size), earlier - (place - size))
                top = max(top, (best[k][0] + more, k))
        best.append(top)
    chains, used = [], set()
    firsts: list[int] = []
    for j in sorted(range(len(matches)), key=lambda j: (-best[j][0], j)):
        path, k = [], j
        while k >= 0 and k not in used:
            path.append(k)
            k = best[k][1]
        if path and k < 0:
            used.update(path)
            start = matches[path[-1]]
            found = Chain(template, start[0] - start[2], matches[j][0] - 1, best[j][0])
            at = bisect.bisect_right(firsts, found.first)
            if (at == 0 or chains[at - 1].last < found.first) and (at == len(chains) or found.last < firsts[at]):
                chains.insert(at, found)
                firsts.insert(at, found.first)
    return chains


class LicenseScanner:
    """The automaton of templates and base phrases, and what follows from a document's matching statistics."""

    def __init__(self):
        self.templates = [(label, words_of(text)) for label, texts in TEMPLATES.items() for text in texts]
        self.phrases = [(label, words_of(phrase)) for phrase, label in PHRASES.items()]
        vocabulary = sorted({w for _, words in self.templates + self.phrases for w in words})
        self.ids = {w: k for k, w in enumerate(vocabulary)}
        self.bytes = [w.encode() for w in vocabulary]
        sequences = [[self.ids[w] for w in words] for _, words in self.templates + self.phrases]
        self.automaton = SuffixAutomaton(sequences)
        self.phrase_of: dict[int, list[int]] = {}
        for number, (_, words) in enumerate(self.phrases):
            state = 0
            for w in words:
                state = self.automaton.next[state][self.ids[w]]
            self.phrase_of.setdefault(state, []).append(number)
        data = np.frombuffer(b" ".join(self.bytes), np.uint8)
        sizes = np.array([len(b) for b in self.bytes])
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        hashes = RangeHash(data).of(begins, begins + sizes)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        n = len(vocabulary)
        self.pairs = np.zeros((n + 1, n + 1), bool)
        self.phrase_pairs = np.zeros((n + 1, n + 1), bool)
        for k, sequence in enumerate(sequences):
            for a, b in zip(sequence, sequence[1:], strict=False):
                self.pairs[a, b] = True
            if k >= len(self.templates):
                self.phrase_pairs[sequence[-2], sequence[-1]] = True

    def suffixes(self, state: int, length: int) -> Iterator[int]:
        """Numbers of the phrases that end where the match does."""
        while state > 0:
            for number in self.phrase_of.get(state, ()):
                if len(self.phrases[number][1]) <= length:
                    yield number
            state = self.automaton.link[state]

    def scan(self, stretches: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, int]], list[Chain]]:
        """Base places (word, phrase) and chains of a document; a stretch has its first word's place and word ids."""
        places, matches = [], {}
        for begin, words in stretches:
            found = list(self.automaton.stream(words))
            for k, (state, length) in enumerate(found):
                for number in self.suffixes(state, length):
                    places.append((begin + k + 1 - len(self.phrases[number][1]), number))
                if length >= LEAST_MATCH and (k + 1 == len(found) or found[k + 1][1] <= length):
                    for template, end in sorted(self.automaton.ends[state]):
                        if template < len(self.templates):
                            matches.setdefault(template, []).append((begin + k + 1, end, length))
        return places, [c for template, of in sorted(matches.items()) for c in best_chains(template, of)]

    def share(self, chain: Chain) -> float:
        return chain.covered / len(self.templates[chain.template][1])

    def documents(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list, list]]]:
        """Words of each text of a block; base places and chains of those that have any."""
        data = fold_bytes(data)
        begins, ends, row = spans(data, starts, WORD_BYTES)
        counts = np.bincount(row, minlength=len(starts) - 1)
        if len(begins) < 2:
            return counts, {}
        hashes = RangeHash(data).of(begins, ends)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        word = np.where(self.hashes[place] == hashes, self.by_hash[place], len(self.ids))
        joined = self.pairs[word[:-1], word[1:]] & (row[:-1] == row[1:])
        edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        telling = np.concatenate([[0], np.cumsum(joined & self.phrase_pairs[word[:-1], word[1:]])])
        worth = (end - begin >= LEAST_MATCH) | (telling[end - 1] > telling[begin])
        firsts = np.concatenate([[0], np.cumsum(counts)])
        stretches: dict[int, list] = {}
        for b, e in zip(begin[worth].tolist(), end[worth].tolist(), strict=True):
            of, run = int(row[b]), []
            at = b - int(firsts[of])
            for k in range(b, e):
                if data[begins[k]:ends[k]].tobytes() == self.bytes[word[k]]:
                    run.append(int(word[k]))
                    continue
                stretches.setdefault(of, []).append((at, run))  # two words of one hash
                at, run = k + 1 - int(firsts[of]), []
            stretches.setdefault(of, []).append((at, run))
        return counts, {of: self.scan(found) for of, found in stretches.items()}


def _scanner() -> LicenseScanner:
    return worker_value("licence scanner", LicenseScanner)


def _digest(scanner: LicenseScanner, places: list, chains: list) -> tuple:
    base = {scanner.phrases[number][0] for _, number in places}
    own = {scanner.templates[c.template][0] for c in chains if scanner.share(c) >= LEAST_SHARE}
    words = [word for word, _ in places]
    return (len(places), min(words, default=None), max(words, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | own)), max([scanner.share(c) for c in chains] + [1.0 if places else 0.0]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = _scanner()
    for batch in batches:
        n_words, rows = [], []
        for first, end, data, starts in blocks(batch["text"]):
            counts, found = scanner.documents(data, starts)
            n_words.append(counts)
            rows += [_digest(scanner, *found.get(k, ([], []))) for k in range(end - first)]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
            "n_base": pa.array(columns[0], pa.int64()), "first_word": pa.array(columns[1], pa.int64()),
            "last_word": pa.array(columns[2], pa.int64()), "base_labels": pa.array(columns[3], pa.string()),
            "labels": pa.array(columns[4], pa.string()), "score": pa.array(columns[5], pa.float64())})


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = _scanner()
    for batch in batches:
        ids, rows = [], []
        for first, _, data, starts in blocks(batch["text"]):
            for k, (_, chains) in sorted(scanner.documents(data, starts)[1].items()):
                for c in chains:
                    if scanner.share(c) >= LEAST_SHARE:
                        ids.append(first + k)
                        rows.append((scanner.templates[c.template][0], c.template, c.first, c.last, c.covered, scanner.share(c)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        names = ("label", "template", "first_word", "last_word", "covered_words", "share")
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(ids, pa.int64())), **{
            name: pa.array(column, kind) for name, column, kind in zip(names, columns, kinds, strict=True)}})


def _read(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: its words, base places and labels, labels by templates, and the score."""
    return _read(docs).mapInArrow(_digests, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                            "base_labels string, labels string, score double")


def license_spans(docs: DataFrame) -> DataFrame:
    """One row per licence text found in a document: its label, the words it covers and how much of the template."""
    return _read(docs).mapInArrow(_spans, "doc_id long, label string, template int, first_word long, last_word long, "
                                          "covered_words long, share double")
