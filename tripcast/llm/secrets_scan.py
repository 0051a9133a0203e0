"""Operator 10, secret scans: fixed base patterns and a linear-chain conditional random field.

Tokens are tagged O (outside), B (begins a secret) or I (inside one) from their
shape, length and digits, their neighbours and features of the file; Viterbi
gives the best tags of all tokens of a text. I follows B or I; nothing else is
ruled out, so short secrets, letters only and secrets of several tokens (signs,
quoted words, wrapped keys) can be found anywhere. The parts of a model span that
no base match covers are added.

The model is fitted on the texts of a bounded sample: B is the first token of a
base match's value, I the following ones, all else is O. Each window with a
secret is also seen with seeded secrets of other shapes (short, one kind of
characters, split by signs, logins, wrapped keys) and with seeded plain text.

Scale: the scan is one map without a shuffle, bounded by an Arrow batch. The fit
uses the ``train_rows`` documents with base matches or long mixed tokens, and a
third as many of all, of smallest id hash; windows of those rows meet in one task
of bounded size, and only the weights (a fixed number) come back to the driver.

Defined cases: null text is empty (no spans; the digest of the empty text);
without positive or negative windows to learn from, only the base patterns count;
repeated rows get equal results; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import id_and_text, prepare, utf8

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+=*|=+|[^\sA-Za-z0-9+/_.=-]")
GAPPED = re.compile(r"\s?(?:" + TOKEN.pattern + ")")  # a token with the white space before it
TAIL = re.compile(r"(?:[!@#$%&:~^*?]+[A-Za-z0-9+/_.=-]+)*")  # what goes on behind a base value that a sign ends
KEY_WORD = re.compile(r"pass|pwd|secret|token|key|auth|cred|login", re.I)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

MIN_LENGTH = 16
TRAIN_ROWS = 1_500
PER_ROW = 8  # windows of a training row
PLAIN = 3  # more windows of it at any place
SEEDED = 8  # versions of a window with a secret
REACH = 6  # tokens on either side of the middle that a window holds
LONGEST = 40  # tokens of a training window
LONG_WINDOW = 4_000  # characters of a training window
KNOWN = 400_000  # token types whose weights a task keeps
PAD = 16  # edges between two texts
STRETCH = 1 << 16  # tokens whose weights for their neighbours are held at once
SLOTS = 1 << 18
EPOCHS = 60
RIDGE = 1e-3  # keeps features of single windows small: weak tags are wrong at times; a share of the mean over all windows

_KEY = np.zeros(256, bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_HEXCHAR = np.zeros(256, bool)
_HEXCHAR[list(b"0123456789abcdef")] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, in code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def base_rows(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mask of the rows that may hold a base match."""
    some = np.zeros(len(bounds) - 1, bool)
    if len(raw) == 0:
        return some
    low = tb.LOWER[raw].tobytes()
    for word, where in [(w, low) for w in _WORDS] + [(b"AKIA", raw.tobytes())]:
        at = where.find(word)
        while at >= 0:
            row = int(np.searchsorted(bounds, at, "right")) - 1
            some[row] = True
            at = where.find(word, int(bounds[row + 1]))
    starts, ends, _ = tb.word_spans(raw, bounds, _HEXCHAR)
    some[np.searchsorted(bounds, starts[ends - starts >= 32], "right") - 1] = True
    return some


def candidate_rows(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that may hold a base match, rows with a long mixed token to train on), as masks."""
    some, cand = base_rows(raw, bounds), np.zeros(len(bounds) - 1, bool)
    if len(raw) == 0:
        return some, cand
    starts, ends, _ = tb.word_spans(raw, bounds, _KEY)
    long = ends - starts >= MIN_LENGTH
    starts, ends = starts[long], ends[long]
    if len(starts):
        at = np.stack([starts, ends], 1).ravel()
        at = at[:-1] if at[-1] == len(raw) else at
        good = np.logical_and(*(np.logical_or.reduceat(t[raw], at)[::2] for t in (_DIGIT, _LETTER)))
        cand[np.searchsorted(bounds, starts[good], "right") - 1] = True
    return some, cand


def is_candidate(token: str) -> bool:
    """A long mixed token: rows that hold one are looked for to train on. Any token may be part of a secret."""
    return len(token) >= MIN_LENGTH and any("0" <= c <= "9" for c in token) and any("a" <= c.lower() <= "z" for c in token)


@functools.lru_cache(1 << 16)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % SLOTS


def _word_codes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))


def _word_slots(h: np.ndarray, place: int) -> np.ndarray:
    """Slots of words (their codes) at a place beside a token (0: the token itself)."""
    return ((h ^ np.uint64(0x9E3779B9 * (place + 8) % (1 << 32))) * np.uint64(0x9E3779B1) % np.uint64(1 << 32) % np.uint64(SLOTS)).astype(np.int64)


def word_class(token: str) -> str:
    """What neighbours see of a token: key words, numbers and mixed tokens count as classes, other words as themselves."""
    if len(token) >= MIN_LENGTH:
        return "<long>"
    if KEY_WORD.search(token):
        return "<key=>" if token[-1] == "=" else "<key>"
    if any("0" <= c <= "9" for c in token):
        return "<num>" if token.isdigit() else "<mix>"
    return token.lower()


_CLASSES = str.maketrans({**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"),
                          **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")})
_RUN = re.compile("0+|a+|A+|[^0aA]", re.S)
_HEXED = re.compile(r"[0-9a-fA-F]+")
_ALPHA = {(n, lower, upper): (f"len{n}", f"mix{lower}{upper}", "alpha") for n in range(-(-MIN_LENGTH // 4)) for lower in (False, True)
          for upper in (False, True)}


def shape_names(token: str) -> tuple[str, ...]:
    n = len(token)
    if n < MIN_LENGTH and token.isalpha():
        return _ALPHA[n // 4, token.islower(), token.isupper()]
    head, classes = token[:64], token.translate(_CLASSES)
    runs = "".join([x[0] for x in _RUN.findall(classes[:64])])
    if token.isascii():
        digits, lower, upper = map(classes.count, "0aA")
        turns = 2 * runs.count("0") - (runs[0] == "0") - (runs[-1] == "0")
    else:
        digits, lower, upper = (sum(map(f, token)) for f in (str.isdigit, str.islower, str.isupper))
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(head, head[1:]))
    return (f"len{min(n, 40) // 4}", f"dig{10 * digits // n}", f"mix{bool(lower)}{bool(upper)}{bool(digits)}", f"turn{min(9, 20 * turns // len(head))}",
            f"kinds{min(9, 10 * len(set(head)) // len(head))}", f"dots{min(3, token.count('.'))}",
            f"seps{min(4, token.count('-') + token.count('_') + token.count('/'))}",
            "hex" if _HEXED.fullmatch(token) else "nohex", "shape:" + runs[:8])


NEAR = (-3, -2, -1, 1, 2)  # neighbours whose words count
KEY_REACH = 4  # tokens before this one that may hold a key word


def gap(token: str) -> str:
    return "line" if token[0] in "\r\n" else "space" if token[0].isspace() else "none"


KEY, LONG, SEPARATOR, QUOTE, COLON, AT, GLUED = (1 << k for k in range(7))


def flags_of(token: str) -> int:
    core = token.strip()
    out = GLUED * (core == token) + KEY * bool(KEY_WORD.search(core)) + LONG * is_candidate(core) + COLON * (core == ":")
    return out + QUOTE * (core in "\"'`") + SEPARATOR * (core in (":", "=", "is", ">") or core in "\"'`" or core.strip("=") == "") + AT * (core == "@")


def classes_and_flags(cores: list[str]) -> tuple[list[str], list[int]]:
    """``word_class`` and ``flags_of`` of tokens without white space; key words are looked for in all of them at once."""
    ends = np.cumsum(np.fromiter(map(len, cores), np.int64, len(cores)) + 1)
    key = np.zeros(len(cores), bool)
    key[np.searchsorted(ends, [m.start() for m in KEY_WORD.finditer("\n".join(cores))], "right")] = True
    words, flags = [], []
    for core, k in zip(cores, key.tolist()):
        if core.isalpha() and len(core) < MIN_LENGTH:
            words.append("<key>" if k else core.lower())
            flags.append(GLUED | SEPARATOR * (core == "is") | KEY * k)
        else:
            words.append(word_class(core))
            flags.append(flags_of(core))
    return words, flags


CONTEXT = ("key", "assigned", "opened", "login")


def context(flags: np.ndarray) -> np.ndarray:
    """Per token: is a key word near before it; does it follow one, at once (1) or behind separators (2); is it in quotes
    that opened there; does it stand between a colon and an at sign without white space."""
    def before(x: np.ndarray, d: int = 1) -> np.ndarray:
        return np.concatenate([np.zeros(d, x.dtype), x[:-d]])[: len(x)]

    key, separator, quote, colon, sign, glued = ((flags & f) > 0 for f in (KEY, SEPARATOR, QUOTE, COLON, AT, GLUED))
    near, behind = np.zeros(len(flags), bool), before(key)
    for d in range(1, KEY_REACH + 1):
        near |= before(key, d)
    at_once, separated = behind.copy(), np.zeros(len(flags), bool)
    for _ in range(4):
        behind = before(behind & separator)
        separated |= behind
    opened = start = before(quote & (at_once | separated))
    for _ in range(12):
        opened = start | before(opened & ~quote)
    login, ahead = np.zeros(len(flags), bool), np.append((sign & glued)[1:], [False])[: len(flags)]
    for _ in range(4):
        login |= ahead
        ahead = np.append((ahead & glued)[1:], [False])[: len(flags)]
    follows = before(colon) & glued
    run = follows.copy()
    for _ in range(4):
        run = follows | (before(run) & glued)
    return np.stack([near, np.where(separated, 2, at_once), opened & ~quote, login & run], 1).astype(np.int64)


def window_features(tokens: list[str], file: list[str]) -> list[list[int]]:
    """Slots of each token (with the white space before it): its own shape, its neighbours' words, its context, the file."""
    cores = [t.strip() for t in tokens]
    words = ["<edge>"] * 3 + [word_class(t) for t in cores] + ["<edge>"] * 3
    codes = _word_codes(words)
    near = [_word_slots(codes, d).tolist() for d in (0, *NEAR)]
    around = context(np.array([flags_of(t) for t in tokens], np.int64)).tolist()
    gaps = [gap(t) for t in tokens] + ["edge"]
    return [[_slot(x) for x in (*shape_names(t), "gap:" + gaps[i], "next:" + gaps[i + 1], *file, *map("{}{}".format, CONTEXT, around[i]))]
            + [near[k][i + 3 + d] for k, d in enumerate((0, *NEAR))] for i, t in enumerate(cores)]


def file_features(n_chars: int, n_candidates: int) -> list[str]:
    return [f"cands{min(4, n_candidates)}", f"size{min(6, len(str(n_chars)))}"]


class Windows:
    """Tokens of one text and which of them are long and mixed."""

    def __init__(self, text: str):
        self.spans = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        self.tokens = [text[a:b] for a, b in self.spans]
        self.cand = [i for i, t in enumerate(self.tokens) if is_candidate(t)]
        self.file = file_features(len(text), len(self.cand))


class Crf:
    """Weights of slots x (O, B, I) and of transitions. Any token may get any tag."""

    def __init__(self, emit: np.ndarray, trans: np.ndarray):
        self.emit, self.trans = emit, trans
        self._forget()

    def __getstate__(self) -> dict:
        return {"emit": self.emit, "trans": self.trans}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["emit"], state["trans"])

    def _forget(self) -> None:
        """Rows of the known token types: own weights, weights given to each neighbour; row 0 is the edge of a text."""
        self.ids: dict[str, int] = {}
        self.shapes: dict[tuple, int] = {}
        self.shape_rows: list[np.ndarray] = []
        self.own = np.zeros((1, 3), np.float32)
        self.near = np.stack([self.emit[_word_slots(_word_codes(["<edge>"]), d)] for d in NEAR], 1)
        self.near[:, NEAR.index(1)] += self.emit[_slot("next:edge")]
        self.flags = np.zeros(1, np.int64)

    def _learn(self, tokens: list[str]) -> None:
        """Add token types; at most ``KNOWN`` are kept between batches."""
        cores = [t.strip() for t in tokens]
        number = {c: i for i, c in enumerate(dict.fromkeys(cores))}  # white space apart, many tokens are the same
        of = np.fromiter(map(number.__getitem__, cores), np.int64, len(cores))
        shapes = [shape_names(c) for c in number]
        words, flags = classes_and_flags(list(number))
        codes = _word_codes(words)
        for names in set(shapes) - self.shapes.keys():
            self.shapes[names] = len(self.shape_rows)
            self.shape_rows.append(self.emit[[_slot(x) for x in names]].sum(0))
        gaps = [("none", "space", "line").index(gap(t)) for t in tokens]
        own = np.array(self.shape_rows, np.float32)[list(map(self.shapes.__getitem__, shapes))] + self.emit[_word_slots(codes, 0)]
        own = own[of] + self.emit[[_slot("gap:" + g) for g in ("none", "space", "line")]][gaps]
        near = np.stack([self.emit[_word_slots(codes, d)] for d in NEAR], 1)[of]
        near[:, NEAR.index(1)] += self.emit[[_slot("next:" + g) for g in ("none", "space", "line")]][gaps]
        flags = np.array(flags, np.int64)[of]
        glued = np.fromiter(map(len, cores), np.int64, len(cores)) == np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.ids.update(zip(tokens, range(len(self.own), len(self.own) + len(tokens))))
        self.own, self.near = np.concatenate([self.own, own]), np.concatenate([self.near, near])
        self.flags = np.concatenate([self.flags, np.where(glued, flags | GLUED, flags & ~GLUED)])

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """Best tags of all tokens of each text."""
        if len(self.ids) > KNOWN:
            self._forget()
        found = [GAPPED.findall(t) for t in texts]
        sizes = np.array([len(f) for f in found])
        flat = list(itertools.chain.from_iterable(found))
        del found
        ids = np.fromiter(map(self.ids.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(ids < 0)
        if len(new):
            missing = list(map(flat.__getitem__, new.tolist()))
            self._learn(list(dict.fromkeys(missing)))
            ids[new] = list(map(self.ids.__getitem__, missing))
        del flat
        # edges between texts: no text sees another one's tokens
        starts = PAD * np.arange(1, len(texts) + 1) + np.cumsum(sizes) - sizes
        edge = np.ones(len(ids) + PAD * (len(texts) + 1), bool)
        for a, n in zip(starts.tolist(), sizes.tolist()):
            edge[a: a + n] = False
        at = np.zeros(len(edge), np.int64)
        at[~edge] = ids
        e = self.own.take(at, 0)
        for a in range(0, len(at), STRETCH):  # what each token gives to its neighbours, read once
            given = self.near.take(at[a: a + STRETCH], 0)
            for k, d in enumerate(NEAR):
                low, high = max(0, a - d), min(len(at), a + len(given) - d)
                e[low:high] += given[low + d - a: high + d - a, k]
        flags = self.flags.take(at)
        around = context(flags)
        for k, name in enumerate(CONTEXT):
            e += self.emit[[_slot(f"{name}{v}") for v in range(3)]].take(around[:, k], 0)
        for a, n, text in zip(starts.tolist(), sizes.tolist(), texts):
            cands = int(np.count_nonzero(flags[a: a + n] & LONG))
            e[a: a + n] += self.emit[[_slot(x) for x in file_features(len(text), cands)]].sum(0)
        e[edge] = [0, -1e9, -1e9]
        best = best_tags(e, self.trans)
        return [best[a: a + n] for a, n in zip(starts.tolist(), sizes.tolist())]

    def spans_of(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of the model's secrets in each text."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for spans, text, tags in zip(out, texts, self.tags(texts)):
            if not tags.any():
                continue
            for m, tag in zip(TOKEN.finditer(text), tags.tolist()):
                if tag == 1:
                    spans.append((m.start(), m.end()))
                elif tag == 2:
                    spans[-1] = (spans[-1][0], m.end())
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.spans_of([text])[0]


_FORBID = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]])  # from (O, B, I) to (O, B, I)


def doubtful(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Mask of the tokens that may get B or I in the best tags of a sequence. A run of such tags is in them only if it scores
    no less than O in its place, so a token counts if some stretch around it reaches that with the best weights it could get."""
    inside = trans[1:, 1:].max() - trans[0, 0]  # between two tokens of a run, against O
    ends = trans[0, 1:].max() + trans[1:, 0].max() - 2 * trans[0, 0]  # before and behind it
    gain = np.maximum(e[:, 1], e[:, 2]).astype(float) - e[:, 0] + inside
    total = np.cumsum(np.maximum(gain, -1e3))
    best = np.maximum.accumulate(total[::-1])[::-1] - np.minimum.accumulate(np.append(0.0, total[:-1]))
    return best + ends - inside > -1e-3


def best_tags(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """As ``viterbi``: the tokens that are O in any case are left out, one O stands for all between two others."""
    out = np.zeros(len(e), np.int8)
    some = doubtful(e, trans)
    if not some.any():
        return out
    kept = some.copy()
    kept[:-1] |= some[1:]
    part = np.concatenate([e[kept], np.zeros((1, 3), e.dtype)])
    part[~np.append(some[kept], False)] = [0, -1e9, -1e9]
    out[kept] = viterbi(part, trans)[:-1]
    return out


def viterbi(e: np.ndarray, trans: np.ndarray, length: int = 64) -> np.ndarray:
    """Best tags of one sequence that starts and ends with O: all stretches of ``length`` tokens at once, for each tag
    before them, then the best way through the stretches."""
    n = -(-len(e) // length)
    full = np.full((n * length, 3), [0.0, -1e9, -1e9])
    full[: len(e)] = e
    full = full.reshape(n, length, 3)
    score = np.broadcast_to(np.where(np.eye(3) > 0, 0.0, -1e12), (n, 3, 3))  # stretch, tag before it, tag now
    back = np.zeros((length, n, 3, 3), np.int8)
    for j in range(length):
        new = np.empty((n, 3, 3))
        for to in range(3):
            ways = [score[..., s] + trans[s, to] for s in range(3)]
            two = ways[1] > ways[0]
            best = np.where(two, ways[1], ways[0])
            three = ways[2] > best
            back[j, ..., to] = np.where(three, 2, two)
            new[..., to] = np.where(three, ways[2], best) + full[:, j, to, None]
        score = new
    v, came = [0.0, -1e12, -1e12], []
    for s in score.tolist():
        ways = [max((v[f] + s[f][t], -f) for f in range(3)) for t in range(3)]
        came.append([-w[1] for w in ways])
        top = max(w[0] for w in ways)
        v = [w[0] - top for w in ways]
    before, after = np.zeros(n, int), np.zeros(n, int)
    tag = 0
    for c in range(n - 1, -1, -1):
        after[c], before[c] = tag, came[c][tag]
        tag = came[c][tag]
    out, every = np.empty((n, length), np.int8), np.arange(n)
    for j in range(length - 1, -1, -1):
        out[:, j] = after
        after = back[j, every, before, after].astype(int)
    return out.reshape(-1)[: len(e)]


def _slot_rows(slots: list[list[int]]) -> np.ndarray:
    """The slots of a window's tokens, a row each, filled up with ``SLOTS``."""
    out = np.full((len(slots), max(map(len, slots))), SLOTS, np.int32)
    for row, found in zip(out, slots):
        row[: len(found)] = found
    return out


def fit(sequences: Iterable[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS) -> Crf | None:
    """Maximum likelihood by forward-backward over all windows at once (Adam). A sequence: slots of its tokens, tags.

    Memory follows the tokens, about 300 bytes each: sequences are taken one at a time and kept as 4-byte slots and
    1-byte tags; potentials and messages are held for real tokens only, those of a place in the sequence together."""
    held = sorted(((_slot_rows(s), np.array(y, np.int8)) for s, y in sequences), key=lambda s: -len(s[1]))
    tags = np.concatenate([y for _, y in held]) if held else np.zeros(0, np.int8)
    if not {0, 1} <= set(np.unique(tags).tolist()):
        return None
    sizes = np.array([len(y) for _, y in held])
    n, length, width = len(held), int(sizes[0]), max(s.shape[1] for s, _ in held)
    flat, end = np.full((width, len(tags)), SLOTS, np.int32), 0
    for s, y in held:
        flat[: s.shape[1], end: end + len(y)] = s.T
        end += len(y)
    del held
    # slots of the real tokens only; those in use are numbered, the last row of the weights stays 0
    number = np.zeros(SLOTS + 1, np.int32)
    number[SLOTS] = 1
    for k in flat:
        number[k] = 1
    used = np.flatnonzero(number)
    number[used] = np.arange(len(used))
    for k in flat:
        k[:] = number[k]
    reach = [int((sizes > j).sum()) for j in range(length)]  # sequences with a token at place j: the first so many
    place = np.arange(len(tags)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.concatenate([[0], np.cumsum(reach)])  # tokens by place, then sequence: where each place begins
    to = at[place] + np.repeat(np.arange(n), sizes)
    steps = np.bincount((tags[:-1].astype(int) * 3 + tags[1:])[place[1:] > 0], minlength=9).reshape(3, 3)
    del place
    emit, trans = np.zeros((len(used), 3)), np.zeros((3, 3))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (emit, trans)]
    e, a, b = (np.empty((len(tags), 3)) for _ in range(3))
    for t in range(1, epochs + 1):
        x = emit.take(flat[0], 0)
        for k in flat[1:]:
            x += emit.take(k, 0)
        x -= x.max(1, keepdims=True)
        e[to] = np.exp(np.maximum(x, -60, out=x), out=x)  # potentials; each step is scaled to sum 1
        tr = np.exp(trans + _FORBID)
        a[:n] = e[:n] * [1, 1, 0]
        for j in range(1, length):
            m = reach[j]
            step = (a[at[j - 1]: at[j - 1] + m] @ tr) * e[at[j]: at[j + 1]]
            a[at[j]: at[j + 1]] = step / step.sum(1, keepdims=True)
        b[:] = 1
        for j in range(length - 2, -1, -1):
            m = reach[j + 1]
            step = (e[at[j + 1]: at[j + 2]] * b[at[j + 1]: at[j + 2]]) @ tr.T
            b[at[j]: at[j] + m] = step / step.sum(1, keepdims=True)
        gt = -steps.astype(float)
        for j in range(1, length):
            left, right = a[at[j - 1]: at[j - 1] + reach[j]], e[at[j]: at[j + 1]] * b[at[j]: at[j + 1]]
            gt += tr * (left.T @ (right / ((left @ tr) * right).sum(1, keepdims=True)))
        np.multiply(a, b, out=a)
        np.take(a, to, 0, out=x)
        x /= x.sum(1, keepdims=True)
        x[np.arange(len(tags)), tags] -= 1
        x /= n
        grad = np.zeros_like(emit)
        for c in range(3):
            err = np.ascontiguousarray(x[:, c])
            for k in flat:
                grad[:, c] += np.bincount(k, err, len(used))
        for w, g, (m, v) in zip((emit, trans), (grad + RIDGE * emit, gt / n + RIDGE * trans), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        emit[-1] = 0
    out = np.zeros((SLOTS + 1, 3), np.float32)
    out[used] = emit
    return Crf(out[:SLOTS], trans + _FORBID)


_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789-_")
_LETTERS, _SMALL, _DIGITS, _SIGNS = _ALPHABETS[2][:52], _ALPHABETS[2][26:52], "0123456789", "!@#$%&:~^*"
_KEYS = ("password", "passwd", "pwd", "pass", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "credential", "auth",
         "login", "client_secret", "db_password", "auth_token")
_SEPARATORS = (": ", ":", "=", " = ", " : ", " is ", ": ", " = ")


def _draw(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(low, high)))


def _seeded_value(rng: random.Random, words: list[str]) -> str:
    """A value of another common shape, for training only: long, short, one kind of characters, or of several tokens."""
    kind = rng.randrange(10)
    if kind < 2:
        return rng.choice(["", "", "ghp_", "sk-", "xoxb-", "glpat-"]) + _draw(rng, rng.choice(_ALPHABETS), 20, 64)
    if kind == 2:  # short and mixed
        return _draw(rng, _LETTERS, 3, 8) + _draw(rng, _DIGITS, 1, 3) + _draw(rng, _SMALL, 0, 4)
    if kind == 3:
        return _draw(rng, _ALPHABETS[2], 6, 15)
    if kind in (4, 8, 9):  # letters only or digits only
        return _draw(rng, rng.choice([_LETTERS, _SMALL, _DIGITS]), 6, 32)
    if kind == 5:  # a passphrase
        return rng.choice("-_.") .join(rng.choice(words) for _ in range(rng.randint(3, 5)))
    parts = [_draw(rng, _ALPHABETS[2], 1, 8) for _ in range(rng.randint(2, 5))]  # signs split it
    return "".join(x + _draw(rng, _SIGNS, 1, 2) for x in parts[:-1]) + parts[-1] + rng.choice(["", "", "!", "$"])


def _seeded_secret(rng: random.Random, words: list[str]) -> tuple[str, str, str]:
    """(text before, secret, text after)."""
    kind, value = rng.randrange(8), _seeded_value(rng, words)
    if kind == 0:
        return f"{rng.choice(['', 'https://', 'postgres://', 'ftp://'])}{rng.choice([*words, 'user', 'root', 'admin'])}:", value.replace("@", "a"), \
            f"@{rng.choice(['host', 'localhost', 'db', rng.choice(words) + '.example.com'])}"
    if kind == 1:  # a wrapped key
        lines = [_draw(rng, _ALPHABETS[3], 64, 64) for _ in range(rng.randint(1, 4))] + [_draw(rng, _ALPHABETS[3], 8, 60) + rng.choice(["", "=", "=="])]
        name = rng.choice(["RSA ", "EC ", "", "OPENSSH "]) + "PRIVATE KEY"
        return f"-----BEGIN {name}-----\n", "\n".join(lines), f"\n-----END {name}-----"
    key, quote = rng.choice(_KEYS), rng.choice(["", "", '"', "'"])
    if kind == 2:
        quote, value = rng.choice("\"'"), " ".join(rng.choice(words) for _ in range(rng.randint(3, 5)))
    if kind == 3:
        value = "\n".join(_draw(rng, _ALPHABETS[3], 40, 64) for _ in range(rng.randint(2, 4)))
    return rng.choice([key, key, key.upper(), key.capitalize()]) + rng.choice(_SEPARATORS) + quote, value, quote


def _seeded_plain(rng: random.Random, words: list[str]) -> str:
    """Text without a secret that looks a little like one."""
    w, v, number = rng.choice(words), rng.choice(words), _draw(rng, _DIGITS, 1, 16)
    key, quote = rng.choice(_KEYS), rng.choice(["", '"'])
    if rng.random() < 0.15:
        return " ".join(rng.choice(words) + rng.choice("!@#$%&*") * 3 for _ in range(6))
    return rng.choice([f"the {key} of {w} {v}", f"a {key}, {w} {v}", f"{key}s and {w}", f"{w}: {v}", f"{w} = {quote}{v}{quote}", f"{w}={number[:4]}",
                       f"{number[:2]}:{number[2:4]}", f"{w}.{number[:2]}@mail{number[:1]}.example.com", f"https://{w}.example.com/{v}/{number[:4]}",
                       f"+{number}", f"{w} {number}", f"{w}{number[:3]} {v}", f"{w}!!! {v}$$$ {w}### {v}&&&", f"{w}$$$\n{v}%%%\n{w}***", f"v{number[:1]}.{number[1:2]}.0", w + v + w + v])


def known_secrets(text: str) -> list[tuple[int, int]]:
    """Merged (start, end) of the values in base matches; a value that signs split goes on behind them."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            found.append((m.start(2), TAIL.match(text, m.end(2)).end()))
    found += [(a, b) for a, k, b in base_spans(text) if k]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def tagged(text: str, secrets: list[tuple[int, int]], low: int, high: int, file: list[str]) -> tuple[list[list[int]], list[int]]:
    """(slots, tags) of the tokens that start in low..high: B on the first token of a secret, I on those that follow."""
    found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    tokens = GAPPED.findall(text)
    every, slots, tags, last = window_features(tokens, file), [], [], None
    for i, (a, b) in enumerate(found):
        of = next((k for k, (s, e) in enumerate(secrets) if s < b and e > a), None)
        if low <= a < high:
            slots.append(every[i])
            tags.append(0 if of is None else 2 if of == last and tags else 1)
        last = of
    return slots[:LONGEST], tags[:LONGEST]


def training_windows(text: str, seed: int) -> list[tuple[str, list[tuple[int, int]], int, int, list[str]]]:
    """Windows of one text with the values of its base matches, and seeded versions of them: other secrets, other plain
    text. As what ``tagged`` takes."""
    rng = random.Random(seed)
    w, secrets = Windows(text), known_secrets(text)
    n = len(w.tokens)
    if not n:
        return []
    words = [t for t in w.tokens[:400] if t.isascii() and t.isalpha()] or ["word"]
    starts = [a for a, _ in w.spans]
    own = [max(0, bisect.bisect_right(starts, a) - 1) for a, _ in secrets]
    wrapped = "PRIVATE KEY-----" in text
    picks = [(i, True) for i in own[:PER_ROW]] + [(i, False) for i in w.cand[:PER_ROW] if i not in own]
    picks = picks[:PER_ROW] + [(rng.randrange(n), False) for _ in range(PLAIN)]
    out = []
    for i, positive in picks:
        low, high = w.spans[max(0, i - REACH)][0], w.spans[min(n - 1, i + REACH)][1]
        a, b = w.spans[max(0, i - REACH - KEY_REACH)][0], w.spans[min(n - 1, i + REACH + KEY_REACH)][1]
        if b - a > LONG_WINDOW:
            continue
        held = [x for x in secrets if x[0] < b and x[1] > a]
        around = context(np.array([flags_of(t) for t in GAPPED.findall(text[a:b])], np.int64))
        if not held and (wrapped or (around[:, 1] == 2).any() or around[:, 3].any()):
            continue  # may be a secret that no base pattern knows: its tags are not known
        out.append((text[a:b], [(s - a, e - a) for s, e in held], low - a, high - a, w.file))
        end = next((e for s, e in secrets if s <= w.spans[i][0] < e), w.spans[i][1])
        j = bisect.bisect_left(starts, end)
        left = text[w.spans[max(0, i - 8)][0]: w.spans[max(0, i - 4)][1]]
        right = text[w.spans[min(n - 1, j + 1)][0]: w.spans[min(n - 1, j + 6)][1]]
        if len(left) + len(right) > LONG_WINDOW or known_secrets(left) or known_secrets(right):
            continue
        for _ in range(SEEDED if positive else 0):
            before, value, after = _seeded_secret(rng, words)
            at = len(left) + 1 + len(before)
            out.append((f"{left} {before}{value}{after} {right}", [(at, at + len(value))], 0, 1 << 30, w.file))
        for _ in range(SEEDED // 2 if positive else 1):
            out.append((f"{left} {_seeded_plain(rng, words)} {right}", [], 0, 1 << 30, w.file))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> Crf | None:
    """Fit on the rows with base matches or long mixed tokens whose id hashes are smallest, and on a third as many of all
    rows, chosen in the same way. Ids are chosen first; only windows of the chosen rows leave them, never a text. Rows
    without an id are not trained on; of rows that share an id the smallest text is."""
    limits = {"marked": train_rows, "any": max(1, train_rows // 3)}
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {kind: {} for kind in limits}  # the task's own smallest hashes are enough
        for batch in batches:
            ids = batch.column(0).to_pylist()
            ranks = [_rank(i) for i in ids]
            some, cand = candidate_rows(*utf8(batch.column(1)))
            for kind, rows in (("marked", np.flatnonzero(some | cand).tolist()), ("any", range(len(ids)))):
                held[kind].update((ids[r], ranks[r]) for r in rows)
                if len(held[kind]) > 2 * limits[kind]:
                    held[kind] = dict(sorted(held[kind].items(), key=lambda x: (x[1], x[0]))[: limits[kind]])
        rows = [(i, r, kind) for kind, found in held.items() for i, r in found.items()]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["doc_id", "rank", "kind"])

    order = Window.partitionBy("kind").orderBy("rank", "doc_id")
    limit = F.when(F.col("kind") == "any", limits["any"]).otherwise(limits["marked"])
    # a row of either kind, or both; at most train_rows and a third as many rows, so that a broadcast is bounded
    picked = (texts.mapInArrow(ranked, "doc_id long, rank long, kind string").distinct()
              .withColumn("nth", F.row_number().over(order)).where((F.col("nth") <= train_rows) & (F.col("nth") <= limit)).drop("nth"))
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "rank", "kind").agg(F.min("text").alias("text"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            found = [json.dumps(training_windows(t, r)) for t, r in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["doc_id", "rank", "windows"])

    sample = sample.select("doc_id", "rank", "text").mapInArrow(windows, "doc_id long, rank long, windows string")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        import json

        frame = frame.sort_values(["rank", "doc_id", "windows"])
        crf = fit((s for x in frame["windows"] for w in json.loads(x) if (s := tagged(*w))[1]), epochs)
        if crf is None:
            return pd.DataFrame({"emit": [], "trans": []})
        return pd.DataFrame({"emit": [crf.emit.tobytes()], "trans": [crf.trans.tobytes()]})

    found = sample.withColumn("whole", F.lit("all")).groupBy("whole").applyInPandas(one, "emit binary, trans binary").collect()
    if not found:
        return None
    return Crf(np.frombuffer(bytes(found[0]["emit"]), np.float32).reshape(-1, 3), np.frombuffer(bytes(found[0]["trans"])).reshape(3, 3))


def _rank(doc_id: int | None) -> int:
    return int.from_bytes(hashlib.blake2b(str(doc_id).encode(), digest_size=7).digest(), "little")


def outside(spans: list[tuple[int, int]], fixed: list[tuple[int, int, int]], text: str) -> list[tuple[int, int]]:
    """The parts of sorted spans that no base span covers, without white space at their ends."""
    starts, ends = [], []  # stretches that base spans cover, merged
    for a, _, b in fixed:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    out = []
    for a, b in spans:
        k = bisect.bisect_right(ends, a)  # the first stretch that ends behind a
        while a < b:
            stop = min(b, starts[k]) if k < len(starts) else b
            part = text[a:stop]
            if part.strip():
                out.append((a + len(part) - len(part.lstrip()), stop - len(part) + len(part.rstrip())))
            if k >= len(starts) or starts[k] >= b:
                break
            a, k = max(a, ends[k]), k + 1
    return out


def spans_of(texts: list[str], crf: Crf | None, base: list[bool]) -> list[tuple[list, list]]:
    """Per text: (base spans, all spans) as (start, kind number, end); the model adds what base spans do not cover."""
    found = crf.spans_of(texts) if crf is not None and texts else [[] for _ in texts]
    out = []
    for text, some, model in zip(texts, base, found):
        fixed = base_spans(text) if some else []
        out.append((fixed, sorted(fixed + [(a, 3, b) for a, b in outside(model, fixed, text)])))
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def scan(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the base spans and all spans of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column(1))
            some = base_rows(raw, bounds)
            rows = []
            for doc_id, (fixed, every) in zip(batch.column(0).to_pylist(), spans_of(batch.column(1).to_pylist(), crf, some.tolist())):
                n = [sum(k == j for _, k, _ in every) for j in range(4)]
                rows.append((doc_id, *n[:3], hashlib.sha256(join_spans(fixed).encode()).hexdigest(), join_spans(every), n[3]))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def secret_scan(docs: DataFrame, **options) -> DataFrame:
    prepare(docs.sparkSession)
    return scan(docs, train(docs, **options))


def redact(docs: DataFrame, crf: Crf | None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each secret span of ``text_col`` replaced by ``mark``; null stays null."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column(at))
            some = base_rows(raw, bounds)
            texts = batch.column(at).to_pylist()
            for i, (_, spans) in enumerate(spans_of([t or "" for t in texts], crf, some.tolist())):
                if not spans:
                    continue
                text = texts[i]
                out, end = [], 0
                for a, _, b in spans:
                    if b > end:
                        out += [text[end:a], mark] if a >= end else []
                        end = b
                texts[i] = "".join([*out, text[end:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
