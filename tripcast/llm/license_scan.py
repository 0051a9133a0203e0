"""Operator 5, licence scans: a generalised suffix automaton of licence tokens.

The automaton holds every stretch of every template. A file's words stream
through it; at each word it gives the matching statistic, the longest stretch of
a template that ends there. Maximal matches are chained per template (in order,
with small gaps) into spans; a template whose chain covers enough of it labels
the file, if the chain also holds the template's marks: its words that the fewest
labels share (all of up to ``FEW``, else half of them), or a base phrase. Ordinary
words that many templates share never label a file by themselves. Base phrases are found from the same statistics and always count.

Words outside the templates' vocabulary, and pairs of neighbours that stand in
no template, end a match; both are found for a whole batch at once, and only
the stretches between them are streamed.

Scale: one map, no shuffle; the automaton's size depends on the templates only.
Memory is bounded by an Arrow batch.

Defined cases: null text is empty (no words, null places, empty labels, score
0); repeated rows get equal results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .common import id_and_text, prepare, utf8
from .license_texts import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIN_MATCH = 2  # words of a match that may join a chain
MAX_GAP = 12  # words between neighbouring matches of a chain
MIN_COVER = 0.6  # share of a template that a chain must cover to label the file
FEW = 3
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans string")


def words_of(text: str) -> list[str]:
    """A-Z lower-cased, then maximal runs of digits, a-z and characters beyond ASCII."""
    return WORD.findall(text.translate(_LOWER))


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


class SuffixAutomaton:
    """Suffix automaton over several token sequences; ``places`` are (sequence, end) of the state's first occurrences."""

    def __init__(self):
        self.length, self.link, self.next, self.places = [0], [-1], [{}], [set()]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(step)
        self.places.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """A copy of q that is reached by the shorter strings through p."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, number: int, tokens: list[int]) -> None:
        last = 0
        for end, token in enumerate(tokens, 1):
            q = self.next[last].get(token)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][token]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
                last = new
            self.places[last].add((number, end))

    def finish(self) -> None:
        """Occurrences of a state are also those of every state whose suffix link leads to it."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.places[self.link[s]] |= self.places[s]

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest stretch of a sequence that ends at each token."""
        state = length = 0
        out = []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                state = length = 0
            out.append((length, state))
        return out


class Scanner:
    def __init__(self, templates=tuple(TEMPLATES), phrases=tuple(PHRASES)):
        self.labels = [label for label, _ in templates]
        texts = [words_of(t) for _, t in templates] + [words_of(p) for p, _ in phrases]
        self.ids = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}), 1)}
        coded = [[self.ids[w] for w in t] for t in texts]
        self.sizes = [len(t) for t in coded[: len(templates)]]
        self.tokens = coded[: len(templates)]
        labels_of: dict[int, set[str]] = {}
        for t, label in zip(self.tokens, self.labels):
            for w in t:
                labels_of.setdefault(w, set()).add(label)
        #: Words of every template that the fewest labels share.
        self.marks = [{w for w in t if len(labels_of[w]) == min(len(labels_of[x]) for x in t)} for t in self.tokens]
        self.automaton = SuffixAutomaton()
        for number, tokens in enumerate(coded):
            self.automaton.add(number, tokens)
        self.automaton.finish()
        self.phrases = [(tuple(t), label) for t, (_, label) in zip(coded[len(templates):], phrases)]
        size = len(self.ids) + 1
        self.pair = np.zeros((size, size), bool)
        for t in coded:
            self.pair[t[:-1], t[1:]] = True
        vocabulary = [w.encode() for w in self.ids]
        raw, bounds = utf8(pa.array(vocabulary, pa.large_binary()))
        hashes = tb.Prefix(raw).stretches(bounds[:-1], bounds[1:])
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], np.arange(1, size)[order]
        self.raw, self.bounds = raw, bounds

    def code(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Vocabulary id of every word, 0 for others."""
        h = tb.Prefix(raw).stretches(starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        code = np.where(self.hashes[at] == h, self.codes[at], 0)
        hit = np.flatnonzero(code)  # a hash may lie: the lengths must agree too
        size = (self.bounds[1:] - self.bounds[:-1])[code[hit] - 1]
        code[hit[size != (ends - starts)[hit]]] = 0
        return code

    def stretches(self, code: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of maximal stretches of two or more words whose neighbours all stand together in a template."""
        if len(code) < 2:
            zero = np.zeros(0, np.int64)
            return zero, zero
        joined = self.pair[code[:-1], code[1:]]
        edge = words[(words > 0) & (words < len(code))]
        joined[edge - 1] = False
        step = np.diff(np.concatenate([[0], joined.view(np.int8), [0]]))
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1

    def scan(self, stretches: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Base places (word, label) and covered spans (label, first word, end, coverage) that hold their template's marks, or
        a base phrase of their label, of one file."""
        base, matches = [], {}
        for first, tokens in stretches:
            stats = self.automaton.statistics(tokens)
            for j, (length, state) in enumerate(stats):
                for phrase, label in self.phrases:
                    k = len(phrase)
                    if length >= k and tuple(tokens[j + 1 - k: j + 1]) == phrase:
                        base.append((first + j + 1 - k, label))
                if length >= MIN_MATCH and (j + 1 == len(stats) or stats[j + 1][0] <= length):  # maximal to the right
                    for number, end in self.automaton.places[state]:
                        if number < len(self.sizes):
                            matches.setdefault(number, []).append((first + j + 1 - length, end - length, length))
        spans = []
        for number, found in matches.items():
            named = [f for f, label in base if label == self.labels[number]]
            spans += [s for marked, s in self._chains(number, sorted(found)) if marked or any(s[1] <= f < s[2] for f in named)]
        return base, spans

    def marked(self, number: int, chain: list[tuple[int, int, int]]) -> bool:
        """Does the chain hold enough of its template's marks?"""
        words = {w for _, t, n in chain for w in self.tokens[number][t: t + n]}
        marks = self.marks[number]
        return len(marks & words) >= (len(marks) if len(marks) <= FEW else -(-len(marks) // 2))

    def _chains(self, number: int, found: list[tuple[int, int, int]]) -> list[tuple[bool, tuple[str, int, int, float]]]:
        """(holds the marks, span) of the best chains of matches that are in order in file and template; overlaps count once."""
        best: list[tuple[int, int]] = []  # (words covered, predecessor)
        reach = self.sizes[number] + MAX_GAP  # no match is longer than its template
        for i, (f, t, n) in enumerate(found):
            score, came = n, -1
            for j in range(i - 1, -1, -1):
                pf, pt, pn = found[j]
                if f - pf > reach:
                    break
                if f - (pf + pn) > MAX_GAP:
                    continue
                if pf < f and pt < t and f + n > pf + pn and t + n > pt + pn:
                    new = n - max(0, pf + pn - f, pt + pn - t)
                    if best[j][0] + new > score:
                        score, came = best[j][0] + new, j
            best.append((score, came))
        spans, used = [], set()
        for i in sorted(range(len(found)), key=lambda x: -best[x][0]):
            chain, at = [], i
            while at >= 0 and at not in used:
                chain.append(at)
                at = best[at][1]
            used.update(chain)
            cover = min(1.0, (best[i][0] - (best[at][0] if at >= 0 else 0)) / self.sizes[number]) if chain else 0
            if cover > 0:
                span = self.labels[number], found[chain[-1]][0], found[i][0] + found[i][2], cover
                spans.append((self.marked(number, [found[j] for j in chain]), span))
        return spans


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, base places and labels, the method's labels, score and spans (label:first:end, in words)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            raw, bounds = utf8(batch.column(1))
            raw = tb.LOWER[raw]
            starts, ends, words = tb.word_spans(raw, bounds, tb.ALNUM)
            code = scanner.code(raw, starts, ends)
            first, end = scanner.stretches(code, words)
            owner = np.searchsorted(words, first, "right") - 1
            found: dict[int, list[tuple[int, list[int]]]] = {}
            for r, a, b in zip(owner.tolist(), first.tolist(), end.tolist()):
                found.setdefault(r, []).append((a - int(words[r]), code[a:b].tolist()))
            n = len(bounds) - 1
            out = {k: [None] * n for k in ("first", "last")} | {"base": [0] * n, "bl": [""] * n, "labels": [""] * n, "score": [0.0] * n, "spans": [""] * n}
            for r, stretches in found.items():
                base, spans = scanner.scan(stretches)
                good = [s for s in spans if s[3] >= MIN_COVER]
                names = {label for _, label in base}
                out["labels"][r] = ",".join(sorted(names | {s[0] for s in good}))
                out["spans"][r] = ",".join(sorted({f"{label}:{a}:{b}" for label, a, b, _ in good}))
                out["score"][r] = max([s[3] for s in spans], default=0.0)
                if base:
                    out["base"][r] = len(base)
                    out["first"][r], out["last"][r] = min(base)[0], max(base)[0]
                    out["bl"][r] = ",".join(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(words), pa.int64()), pa.array(out["base"], pa.int64()), pa.array(out["first"], pa.int64()),
                 pa.array(out["last"], pa.int64()), *(pa.array(out[k], pa.string()) for k in ("bl", "labels")),
                 pa.array(out["score"], pa.float64()), pa.array(out["spans"], pa.string())],
                [f.split()[0] for f in SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
