"""Operator 10: licence scans by matching statistics over a generalised suffix automaton.

Words are runs of the characters that [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] allows, after lower-casing A-Z. The
licence templates and the base phrases form one generalised suffix automaton of words. A document streams
through it: after each word the automaton tells the longest suffix read so far that occurs in a template.
Two words in a row that are nowhere neighbours in a template can't be part of a longer match, so only the
stretches between such places are walked. Maximal matches of at least `min_words` words are chained in
document order for each template, and a chain that covers enough of the template is a span of its label, if one
of its matches tells the label: it occurs in templates of no other label, as a common opening does.
Base phrases are recognised at the automaton's states; they label the document as they stand.

Edge cases: null and empty texts have no words, labels or spans and score 0; repeated rows give a row each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mediasift.llm.common import in_batches
from mediasift.llm.licence_texts import PHRASES, TEMPLATES

MIN_WORDS, MAX_GAP, LEAST_SHARE = 5, 8, 0.5
BATCH_WORDS = 1_000_000
#: Bytes that are no part of a word become spaces, the rest stays (other characters are words).
_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

SPANS = "array<struct<label:string,first_word:bigint,last_word:bigint,covered:double>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_WORD).split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, sequences: list[list[int]], phrases: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # sequence → positions of the last word of each occurrence
        for sequence in [*sequences, *phrases]:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for number, sequence in enumerate(sequences):
            state = 0
            for at, word in enumerate(sequence):
                state = s = self.next[state][word]
                while s > 0:
                    self.ends[s].setdefault(number, []).append(at)
                    s = self.link[s]
        own: dict[int, list[tuple[int, int]]] = {}
        for number, phrase in enumerate(phrases):
            state = 0
            for word in phrase:
                state = self.next[state][word]
            own.setdefault(state, []).append((len(phrase), number))
        self.phrases: list[list[tuple[int, int]]] = []
        for state in range(len(self.next)):
            found, s = [], state
            while s > 0:
                found += own.get(s, [])
                s = self.link[s]
            self.phrases.append(found)

    def _state(self, size: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # the prefix read so far has been met in another sequence
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, word)
        return new

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest suffix that occurs in a template."""
        state = length = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


class Scanner:
    """Templates and phrases as an automaton, and the scan of word lists."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES, min_words: int = MIN_WORDS, max_gap: int = MAX_GAP, least_share: float = LEAST_SHARE):
        self.ids, self.labels, sequences = _Ids(), [], []
        self.min_words, self.max_gap, self.least_share = min_words, max_gap, least_share
        for label, texts in templates.items():
            for text in texts:
                self.labels.append(label)
                sequences.append([self.ids.setdefault(w, len(self.ids)) for w in words(text)])
        self.lengths = [len(s) for s in sequences]
        self.phrase_labels = list(phrases.values())
        spoken = [[self.ids.setdefault(w, len(self.ids)) for w in words(p)] for p in phrases]
        self.single = [(p[0], k) for k, p in enumerate(spoken) if len(p) == 1]
        self.automaton = Automaton(sequences, spoken)
        self.telling = [len({self.labels[t] for t in ends}) == 1 for ends in self.automaton.ends]
        n = len(self.ids)
        self.near = np.zeros((n, n), bool)
        for s in [*sequences, *spoken]:
            self.near[s[:-1], s[1:]] = True

    def scan_batch(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[tuple[str, int, int, float]]]]:
        """For each document: base places (first word, phrase), spans (label, first word, last word, share)."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        at = np.cumsum(sizes + 1) - (sizes + 1)
        look, flat = self.ids.__getitem__, np.full(int((sizes + 1).sum()), -1, np.int32)
        for i, d in enumerate(docs):
            flat[at[i] : at[i] + sizes[i]] = np.fromiter(map(look, d), np.int32, len(d))
        known = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0)) if len(flat) > 1 else np.zeros(0, np.int64)
        pair = known[self.near[flat[known], flat[known + 1]]]
        found: list[tuple[list, list]] = [([], []) for _ in docs]
        for word, phrase in self.single:
            for i in np.flatnonzero(flat == word).tolist():
                d = int(np.searchsorted(at, i, "right")) - 1
                found[d][0].append((i - int(at[d]), phrase))
        cut = np.flatnonzero(np.diff(pair) > 1) + 1
        doc_of = np.searchsorted(at, pair[np.concatenate([[0], cut])] if len(pair) else pair, "right") - 1
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for stretch, d in zip(np.split(pair, cut) if len(pair) else [], doc_of.tolist(), strict=True):
            first = int(stretch[0] - at[d])
            self._walk(flat[stretch[0] : stretch[-1] + 2].tolist(), first, found[d][0], matches.setdefault(d, []))
        for d, got in matches.items():
            found[d][1].extend(self._chain(got))
        return found

    def _walk(self, stretch: list[int], first: int, base: list, matches: list) -> None:
        a = self.automaton
        stats = list(a.statistics(stretch))
        for i, (state, length) in enumerate(stats):
            for size, phrase in a.phrases[state]:
                if size > 1 and length >= size:
                    base.append((first + i - size + 1, phrase))
            if length >= self.min_words and (i + 1 == len(stats) or stats[i + 1][1] != length + 1):
                matches.append((first + i - length + 1, length, state))

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of maximal matches, in document order, that cover enough of a template.

        Matches are (first word, words, state). A chain goes on with the next match that begins at most max_gap words
        after its end, at the earliest place in the template after its own; words that two matches share count once.
        """
        chains: dict[int, tuple[int, int, int, int, bool]] = {}  # template → first word, word after, place after, words covered, told
        spans = []

        def close(template: int) -> None:
            first, after, _, covered, told = chains.pop(template)
            share = covered / self.lengths[template]
            if share >= self.least_share and told:
                spans.append((self.labels[template], first, after - 1, share))

        for start, size, state in matches:
            for template, ends in self.automaton.ends[state].items():
                fresh = (start, start + size, ends[0] + 1, size, self.telling[state])
                if template not in chains:
                    chains[template] = fresh
                    continue
                first, after, place, covered, told = chains[template]
                shared = max(0, after - start)
                i = bisect_left(ends, place + size - shared - 1)
                if shared >= size:
                    continue
                if start - after > self.max_gap or i == len(ends):
                    close(template)
                    chains[template] = fresh
                else:
                    chains[template] = (first, start + size, ends[i] + 1, covered + size - shared, told or self.telling[state])
        for template in list(chains):
            close(template)
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and labels, all labels, score and covered spans of every document.

    score: 1 where a base phrase stands, else the largest share of a template that a span covers.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()

        def rows(ids: list, held: list[list[bytes]]) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(9)]
            for doc_id, d, (base, spans) in zip(ids, held, scanner.scan_batch(held), strict=True):
                own = {scanner.phrase_labels[p] for _, p in base}
                both = own | {s[0] for s in spans}
                score = 1.0 if base else max((s[3] for s in spans), default=0.0)
                places = [p for p, _ in base]
                row = (doc_id, len(d), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(both)), score, [dict(zip(("label", "first_word", "last_word", "covered"), s, strict=True)) for s in spans])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(span)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

        for b in batches:
            ids, held, n = [], [], 0
            for i in range(b.num_rows):
                ids.append(b.column(0)[i].as_py())
                held.append(words(b.column(1)[i].as_py()))
                n += len(held[-1])
                if n >= BATCH_WORDS:
                    yield rows(ids, held)
                    ids, held, n = [], [], 0
            if ids:
                yield rows(ids, held)

    return in_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))).mapInArrow(scan, SCHEMA)
