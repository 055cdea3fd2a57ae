"""Secret scans: fixed patterns, and a linear-chain conditional random field over all tokens.

Patterns give the base spans.  The field tags every token of a text as begin, inside or outside of a secret, from its
shape, the words and marks beside it and features of the whole text; its spans are added where no base span lies.
It is decoded by Viterbi exactly, though only where that is in doubt: a token whose score for outside leads by more
than all that the scores of moves and the next token could make up for is outside on every best path, so the chain
falls apart there (``sure_outside``).

The field is trained by maximum likelihood (forward-backward, Adam) on windows of a sample of at most TRAIN_DOCS texts
of at most TRAIN_CHARS characters each, labelled by the base patterns, on the same windows with their hint words masked,
and on secrets of known formats and look-alikes planted among the words of those texts.

Edge cases: null texts are empty and have no spans; texts are scanned whole, however long; repeated rows are scanned
each; an empty table gives an empty result (the field is then trained on planted examples alone); columns that
bear a result's name are replaced, others are kept.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS, TRAIN_CHARS, ROUNDS, SEED = 1000, 20_000, 80, 42
#: Tokens of a training window, and planted examples of each format.
SPAN, PLANTS = 24, 80
#: Texts are tagged in groups of about so many characters.
GROUP_CHARS = 1 << 18

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Greedy runs of at least the wanted length are the runs that pass.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[\w+/.\-@#$%&*!?~^]+(?:={1,2}(?![\w\"'=]))?|[^\w\s]")
TAIL = ".,;:)]}>"
#: Words before a secret: those that name one, and those that may.
STRONG = ("password", "passwd", "pwd", "pass", "passphrase", "secret", "bearer", "apikey", "api_key", "access_key", "private_key", "credential", "credentials")
WEAK = ("token", "key", "auth", "access", "private", "authorization")
PLAIN = ("http", "https", "mailto", "www", "tel", "phone", "isbn", "doi", "version", "date", "id")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "sk_test_", "xox", "eyJ", "AIza", "glpat-", "npm_")
O, B, I = 0, 1, 2
IMPOSSIBLE = -1e9


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost matches without overlap in each kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


# Features.  Each token has one feature of each group.


def _buckets(edges: tuple[int, ...]) -> Callable[[int], int]:
    return lambda n: bisect_right(edges, n)


_length = _buckets((4, 6, 8, 12, 16, 20, 28, 40))
N_KINDS, N_LENGTHS, N_ENTROPY, N_SWITCHES, N_CLASSES, N_WAYS, N_CROWDS = 20, 9, 12, 9, 12, 6, 5
#: Classes of tokens as neighbours; EDGE is before and after a text.
WORD, STRONG_HINT, WEAK_HINT, PLAIN_HINT, SET, COLON, QUOTE, MARK, NUMBER, ODD, JOINED, EDGE = range(N_CLASSES)
#: Kinds that count for the crowd of odd tokens of a text.
CROWDED = (4, 5, 6, 7, 8, 9, 11, 12, 13, 17, 18)
OWN = {"one": 1, "kind": N_KINDS, "kind_length": N_KINDS * N_LENGTHS, "length_entropy": N_LENGTHS * N_ENTROPY, "length_switches": N_LENGTHS * N_SWITCHES,
       "prefix": len(PREFIXES) + 1, "marks": 256}
AROUND = {"left": N_CLASSES, "left2": N_CLASSES**2, "left3": N_CLASSES**3, "right": N_CLASSES, "crowd": N_CROWDS * N_KINDS, "hinted": 2 * N_KINDS}
WAY = {"way_kind": N_WAYS * N_KINDS, "way_length": N_WAYS * N_LENGTHS, "way_entropy": N_WAYS * N_ENTROPY, "way_switches": N_WAYS * N_SWITCHES}
GROUPS = {**OWN, **AROUND, **WAY}
FIRST = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])[:-1].tolist()))
N_FEATURES = sum(GROUPS.values())


def _entropy(word: str) -> float:
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values())


def kind_of(word: str) -> int:
    """The kind of characters that a token is made of."""
    if word.isalpha():
        return 0 if word.islower() else 1 if word[1:].islower() or len(word) == 1 else 2 if word.isupper() else 3
    if word.isdigit():
        return 4
    digit, upper, lower = (any(map(f, word)) for f in (str.isdigit, str.isupper, str.islower))
    if word.isalnum():
        return 5 if re.fullmatch("[0-9a-f]+", word) else 8 if upper and lower else 7 if upper else 6
    if not (digit or upper or lower):
        return 19
    if "//" in word or word.startswith("www."):
        return 15
    if re.fullmatch(r"[^@]+@[\w-]+(\.[\w-]+)+", word):
        return 14
    if word.rstrip("*#%&$!?").isalpha():
        return 16
    if re.fullmatch(r"[0-9+./-]+", word):
        return 9
    if re.fullmatch(r"[\w+/.=-]+", word):
        return (12 if upper and lower else 11) if digit else (13 if upper and lower else 10)
    return 17 if digit else 18


HINTS = {name: kind for names, kind in ((PLAIN, PLAIN_HINT), (WEAK, WEAK_HINT), (STRONG, STRONG_HINT)) for name in names}
ENDING = re.compile("(?:^|[_-])(?:" + "|".join(f"({'|'.join(sorted(names, key=len, reverse=True))})" for names in (STRONG, WEAK, PLAIN)) + ")$")


def class_of(word: str, kind: int) -> int:
    if len(word) == 1 and word in "=:\"'":
        return SET if word == "=" else COLON if word == ":" else QUOTE
    if kind < 4 or kind in (10, 13):
        low = word.lower().strip("_-.")
        if low in HINTS:
            return HINTS[low]
        if ("_" in low or "-" in low) and (m := ENDING.search(low)):
            return (STRONG_HINT, WEAK_HINT, PLAIN_HINT)[m.lastindex - 1]
    return WORD if kind < 4 or kind == 16 else NUMBER if kind in (4, 9) else MARK if kind == 19 else JOINED if kind in (10, 14, 15) else ODD


def word_row(word: str) -> tuple[int, ...]:
    """Own features of a token, then kind, length, entropy, switches and class."""
    if word.isalpha() and (word.islower() or word[1:].islower()):
        return _plain_row(0 if word.islower() else 1, _length(len(word)), HINTS.get(word.lower(), WORD))
    core = word.rstrip(TAIL + "!?") or word
    kind, n = kind_of(core), len(core)
    entropy = switches = 0
    if n >= 6 and kind not in (0, 1):
        entropy = min(N_ENTROPY - 1, int(2 * _entropy(core)))
        shape = [c.isdigit() + 2 * c.isupper() + 4 * c.islower() for c in core]
        switches = min(N_SWITCHES - 1, sum(a != b for a, b in zip(shape, shape[1:])) // 2)
    prefix = next((i + 1 for i, p in enumerate(PREFIXES) if core.startswith(p)), 0) if n >= 12 and kind > 1 else 0
    marks = sum(1 << i for i, c in enumerate("+/_.-@=") if c in core) | 128 * any(map(core.__contains__, "#$%&*!?~^"))
    return _row(kind, _length(n), entropy, switches, prefix, marks, class_of(core if kind != 19 else word, kind))


def _row(kind: int, length: int, entropy: int, switches: int, prefix: int, marks: int, cls: int) -> tuple[int, ...]:
    own = (0, kind, kind * N_LENGTHS + length, length * N_ENTROPY + entropy, length * N_SWITCHES + switches, prefix, marks)
    return (*(FIRST[g] + x for g, x in zip(OWN, own)), kind, length, entropy, switches, cls)


@lru_cache(maxsize=None)
def _plain_row(kind: int, length: int, cls: int) -> tuple[int, ...]:
    return _row(kind, length, 0, 0, 0, 0, cls)


EDGE_ROW = (*(FIRST[g] for g in OWN), 19, 0, 0, 0, EDGE)


class Words(dict):
    """Numbers of the tokens seen so far, with their rows; "" stands for the edge of a text."""

    def __init__(self, most: int = 60_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[""] = 0
        self.fresh, self.rows = [], np.array([EDGE_ROW], np.int32)

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = number = len(self)
        return number

    def look_up(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self.rows = np.concatenate([self.rows, np.array([word_row(w) for w in self.fresh], np.int32)])
            self.fresh = []
        return at


#: Edges before a text, so that no token has one of another text to its left.
EDGES = 4


def tokens(texts: list[str]) -> tuple[list[str], list[int]]:
    """All tokens with edges before each text and after the last, and the place of the last edge before each text."""
    out, edges = [], []
    for text in texts:
        out += [""] * EDGES
        edges.append(len(out) - 1)
        out += TOKEN.findall(text)
    return out + [""] * EDGES, edges


class Around:
    """Where the tokens of texts stand: classes to the left (numbered together) and right, crowd and hints of the text, way from a hint word."""

    def __init__(self, rows: np.ndarray, edges: list[int]):
        self.kind, cls = rows[:, -5], rows[:, -1]
        left = np.concatenate([np.full(4, EDGE, cls.dtype), cls])
        c1, c2, c3, c4 = (left[4 - k : len(left) - k] for k in range(1, 5))
        self.left = (c1 * N_CLASSES + c2) * N_CLASSES + c3
        self.right = np.append(cls[1:], EDGE)
        starts = np.array([e - EDGES + 1 for e in edges] or [0])
        sizes = np.diff(np.append(starts, len(rows)))
        crowd = np.add.reduceat(IS_CROWDED[self.kind], starts)
        hint = IS_HINT[cls]
        self.text = np.repeat(2 * np.searchsorted([1, 2, 4, 8], crowd, side="right") + (np.add.reduceat(hint, starts) > 0), sizes)
        # Only a token near a hint word has a way.
        near = np.flatnonzero((IS_HINT[c1] | IS_HINT[c2] | IS_HINT[c3] | IS_HINT[c4]) & ~IS_JOIN[cls])
        self.way = np.zeros(len(rows), np.int64)
        for i in near.tolist():
            a, b, c, d = (int(x[i]) for x in (c1, c2, c3, c4))
            strong = STRONG_HINT in (a, b, c, d)
            if IS_HINT[a]:
                self.way[i] = 1
            elif a in (SET, COLON) and (IS_HINT[b] or b == QUOTE and IS_HINT[c]):
                self.way[i] = 2
            elif a == QUOTE and (IS_HINT[b] or b in (SET, COLON) and (IS_HINT[c] or c == QUOTE and IS_HINT[d])):
                self.way[i] = 3
                close = np.flatnonzero(cls[i : i + 10] == QUOTE)  # the other words of a quoted value
                if len(close) and close[0] > 1 and not (cls[i : i + close[0]] == EDGE).any():
                    self.way[i + 1 : i + close[0]] = 5
            if not strong and self.way[i] in (1, 2, 3):
                self.way[i] = 4


IS_HINT, IS_JOIN, IS_CROWDED = np.zeros(N_CLASSES, np.int32), np.zeros(N_CLASSES, np.int32), np.zeros(N_KINDS, np.int32)
IS_HINT[[STRONG_HINT, WEAK_HINT]] = IS_JOIN[[SET, COLON, QUOTE]] = IS_CROWDED[list(CROWDED)] = 1


def way_features(way: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    sizes = (N_KINDS, N_LENGTHS, N_ENTROPY, N_SWITCHES)
    return [FIRST[g] + way * n + rows[:, len(OWN) + k] for k, (g, n) in enumerate(zip(WAY, sizes))]


def features(rows: np.ndarray, edges: list[int]) -> np.ndarray:
    """All features of the tokens, a column for each group."""
    x = Around(rows, edges)
    left2 = x.left // N_CLASSES
    around = (left2 // N_CLASSES, left2, x.left, x.right, x.text // 2 * N_KINDS + x.kind, x.text % 2 * N_KINDS + x.kind)
    return np.stack([*rows[:, : len(OWN)].T, *(FIRST[g] + f for g, f in zip(AROUND, around)), *way_features(x.way, rows)], axis=1)


class Field:
    """Weights of a chain over (outside, begin, inside), and the sums of them that tokens need."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        self.words, self.summed = Words(), np.empty((0, 3))
        of = lambda group, n: emit[FIRST[group] : FIRST[group] + n]
        c, k = N_CLASSES, N_KINDS
        self.left = np.repeat(of("left", c), c * c, axis=0) + np.repeat(of("left2", c * c), c, axis=0) + of("left3", c**3)
        self.right = of("right", c)
        self.text = (of("crowd", N_CROWDS * k).reshape(N_CROWDS, 1, k, 3) + of("hinted", 2 * k).reshape(1, 2, k, 3)).reshape(-1, 3)

    def __reduce__(self):
        return Field, (self.emit, self.move)

    def scores(self, words: list[str], edges: list[int]) -> np.ndarray:
        """The sum of each token's weights, for each tag."""
        if len(self.words) > self.words.most:
            self.words.forget()
            self.summed = np.empty((0, 3))
        at, rows = self.words.look_up(words), self.words.rows
        if len(self.summed) < len(rows):  # what a token has in itself, away from hint words, is added up once
            new = rows[len(self.summed) :]
            own = self.emit[new[:, : len(OWN)]].sum(axis=1) + sum(self.emit[f] for f in way_features(np.zeros(len(new), np.int64), new))
            self.summed = np.concatenate([self.summed, own])
        x = Around(rows[at], edges)
        out = self.summed[at] + self.left[x.left] + self.right[x.right] + self.text[x.text * N_KINDS + x.kind]
        if len(i := np.flatnonzero(x.way)):
            mine = rows[at[i]]
            for there, away in zip(way_features(x.way[i], mine), way_features(np.zeros(len(i), np.int64), mine)):
                out[i] += self.emit[there] - self.emit[away]
        return out


def _allowed(move: np.ndarray) -> np.ndarray:
    return move + np.array([[0, 0, IMPOSSIBLE], [0, 0, 0], [0, 0, 0]])


def sure_outside(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Tokens that are outside on every best path.

    To put such a token outside can cost its three moves at most, and the next one its change from inside to begin.
    """
    spread = move.max() - np.where(np.arange(9).reshape(3, 3) == 3 * O + I, np.inf, move).min()
    change = np.append(np.maximum(0, scores[1:, I] - scores[1:, B]), 0)
    return scores[:, O] - np.maximum(scores[:, B], scores[:, I]) > 3 * spread + change


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """Best tags of a chain that stands between tokens outside."""
    move = _allowed(move)
    best, back = scores[0] + move[O], []
    for now in scores[1:]:
        step = best[:, None] + move
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + now
    tags = [int((best + move[:, O]).argmax())]
    for pointers in reversed(back):
        tags.append(int(pointers[tags[-1]]))
    return tags[::-1]


def tagged(texts: list[str], field: Field) -> Iterator[list[list[tuple[int, int]]]]:
    """The field's spans of each text, as the places of their tokens."""
    words, edges = tokens(texts)
    scores = field.scores(words, edges)
    scores[[k for e in (*edges, len(words) - 1) for k in range(e - EDGES + 1, e + 1)], B:] = IMPOSSIBLE
    doubt = np.flatnonzero(~sure_outside(scores, field.move))
    found: dict[int, list[tuple[int, int]]] = {}
    for run in np.split(doubt, np.flatnonzero(np.diff(doubt) > 1) + 1) if len(doubt) else []:
        tags = viterbi(scores[run], field.move)
        if any(tags):
            found.setdefault(bisect_right(edges, int(run[0])) - 1, []).extend((int(i), t) for i, t in zip(run, tags) if t)
    for number, text in enumerate(texts):
        spans: list[list[tuple[int, int]]] = []
        if number in found:
            places, last = [m.span() for m in TOKEN.finditer(text)], None
            for i, tag in found[number]:
                place = places[i - edges[number] - 1]
                if tag == I and last == i - 1:
                    spans[-1].append(place)
                else:
                    spans.append([place])
                last = i
        yield spans


# Training


def windows(texts: list[str], spans: list[list[tuple[int, int]]], thin: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Features (windows, SPAN, groups) and tags of the texts' windows; of those with plain words alone every ``thin``-th."""
    words, edges = tokens(texts)
    known = Words()
    at = known.look_up(words)
    rows = known.rows[at]
    ids = features(rows, edges)
    gold = np.zeros(len(words), np.int64)
    for edge, text, own in zip(edges, texts, spans):
        last = None
        for k, m in enumerate(TOKEN.finditer(text) if own else ()):
            hit = next((s for s in own if s[0] < m.end() and m.start() < s[1]), None)
            if hit:
                gold[edge + 1 + k] = I if hit == last else B
            last = hit
    odd = (rows[:, -5] >= 4) & ~np.isin(rows[:, -5], (16, 19)) | np.isin(rows[:, -1], (STRONG_HINT, WEAK_HINT))
    # Each text begins a window; its last one is filled with edges.
    sizes = np.diff([*edges, len(words) - 1]) - EDGES + 1
    many = -(-sizes // SPAN)
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.full((int(many.sum()), SPAN), -1)
    place.ravel()[np.repeat(np.cumsum(many) - many, sizes) * SPAN + step] = np.repeat(np.array(edges), sizes) + step
    place = place[(odd[place] & (place >= 0)).any(axis=1) | (np.arange(len(place)) % thin == 0)]
    tags = np.where(place >= 0, gold[place], O)
    tags[:, 0] = np.where(tags[:, 0] == I, B, tags[:, 0])
    return ids[np.maximum(place, 0)], tags


def train(ids: np.ndarray, gold: np.ndarray, rounds: int = ROUNDS, l2: float = 1e-4) -> Field:
    """The field of greatest penalised likelihood for windows that stand between tokens outside."""
    n, length, groups = ids.shape
    # Equal tokens in equal places are added up once.
    raw, width = np.ascontiguousarray(ids).tobytes(), groups * ids.itemsize
    seen: dict[bytes, int] = {}
    which = np.fromiter((seen.setdefault(raw[i : i + width], len(seen)) for i in range(0, len(raw), width)), np.int64, n * length)
    kinds = np.frombuffer(b"".join(seen), ids.dtype).reshape(-1, groups)
    columns = np.ascontiguousarray(kinds.T)
    weights, moves = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    rows, flat = n * length, gold.ravel()
    wanted = np.zeros((3, 3))
    np.add.at(wanted, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    np.add.at(wanted, (np.full(n, O), gold[:, 0]), 1)
    np.add.at(wanted, (gold[:, -1], np.full(n, O)), 1)
    for t in range(1, rounds + 1):
        move = np.exp(_allowed(moves))
        s = sum(weights[c] for c in columns)
        e = np.exp(s - np.maximum(np.maximum(s[:, 0], s[:, 1]), s[:, 2])[:, None])[which].reshape(n, length, 3).transpose(1, 0, 2).copy()
        forward, backward, scale = np.empty_like(e), np.empty_like(e), np.empty((length, n, 1))
        last = np.repeat(np.eye(3)[[O]], n, axis=0)
        for k in range(length):
            last = (last @ move) * e[k]
            scale[k] = last.sum(axis=1, keepdims=True)
            last = forward[k] = last / scale[k]
        last = np.repeat(move[None, :, O], n, axis=0)
        for k in range(length - 1, -1, -1):
            backward[k] = last
            last = ((e[k] * last) @ move.T) / scale[k]
        # The scaled products sum up to the same whole at every place of a window.
        whole = forward[-1] @ move[:, O, None]
        slope = forward * (backward / whole)
        ahead = e[1:] * backward[1:] / (scale[1:] * whole)
        moved = move * (forward[:-1].reshape(-1, 3).T @ ahead.reshape(-1, 3)) - wanted
        moved[O] += slope[0].sum(axis=0)
        moved[:, O] += slope[-1].sum(axis=0)
        slope = slope.transpose(1, 0, 2).reshape(-1, 3).copy()
        slope[np.arange(rows), flat] -= 1
        slope = np.stack([np.bincount(which, weights=slope[:, tag], minlength=len(kinds)) for tag in range(3)], axis=1)
        grad = np.zeros_like(weights)
        for column in columns:
            for tag in range(3):
                grad[:, tag] += np.bincount(column, weights=slope[:, tag], minlength=N_FEATURES)
        for x, g, mean, square in ((weights, grad / rows + l2 * weights, *state[:2]), (moves, moved / rows + l2 * moves, *state[2:])):
            mean[:] = 0.9 * mean + 0.1 * g
            square[:] = 0.999 * square + 0.001 * g**2
            x -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return Field(weights, moves)


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ANY = UPPER + LOWER + DIGITS


class Plants:
    """Secrets and look-alikes of named formats, with what leads to them; the seed decides all."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def some(self, low: int, high: int = 0, chars: str = ANY) -> str:
        return "".join(self.draw.choice(chars) for _ in range(self.draw.randint(low, max(low, high))))

    def word(self, low: int = 2, high: int = 9) -> str:
        return self.some(low, high, LOWER)

    def lead(self, hints: str, ways: str = "free") -> str:
        """A hint word and how the value is joined to it."""
        hint = self.draw.choice(hints.split())
        hint = self.draw.choice((hint, hint, hint.upper(), hint.capitalize(), "db_" + hint, "MY_" + hint.upper()))
        return hint + self.draw.choice({"set": (": ", " = ", "=", ":"), "quoted": (': "', ' = "', "='", '="'), "blank": (" ",), "free": (": ", " = ", "=", ': "', ' = "', '="')}[ways])

    def joined(self, sep: str, low: int, high: int, make: Callable[[], str]) -> str:
        return sep.join(make() for _ in range(self.draw.randint(low, high)))

    def secret(self, name: str) -> tuple[str, str]:
        """(lead, value)"""
        strong, weak = "pwd pass passphrase credential private_key access_key", "key auth access token_key"
        some, pick, lead = self.some, self.draw.choice, self.lead
        free = lambda: pick(("", "", "is ", lead(weak), lead(strong), "Bearer ", "use "))
        marks = "!@#$%&*?"
        made = {
            "github": lambda: (free(), pick(("ghp_", "gho_")) + some(36)), "github_pat": lambda: (free(), "github_pat_" + some(22) + "_" + some(59)),
            "payment": lambda: (free(), pick(("sk_live_", "sk_test_")) + some(24, 32)), "model": lambda: (free(), "sk-" + some(32, 48)),
            "chat": lambda: (free(), f"xox{pick('bap')}-{some(10, 12, DIGITS)}-{some(24)}"), "web_token": lambda: (free(), f"eyJ{some(20, 40)}.eyJ{some(30, 80)}.{some(43)}"),
            "maps": lambda: (free(), "AIza" + some(35, 35, ANY + "_-")), "gitlab": lambda: (free(), "glpat-" + some(20)), "registry": lambda: (free(), "npm_" + some(36)),
            "base64": lambda: (free(), some(30, 80, ANY + "+/") + pick(("", "=", "=="))), "bearer": lambda: (pick(("Bearer ", "bearer ", "Authorization: Bearer ")), some(20, 60)),
            "key_block": lambda: (pick(("", "key: ", "private_key = ")), self.joined(" ", 2, 6, lambda: some(64, 64, ANY + "+/"))),
            "letters": lambda: (pick((lead(strong), lead(weak), "Bearer ", "bearer ")), some(14, 40, UPPER + LOWER)),
            "short": lambda: (lead(strong + " " + weak), pick((self.word(3, 6) + some(1, 3, DIGITS) + pick(marks), some(1, 2, UPPER) + some(3, 6) + some(1, 2, DIGITS), some(1, 1) + some(1, 1, DIGITS) + some(1, 1, UPPER) + some(2, 5), some(1, 1, LOWER) + pick(marks) + some(2, 2, DIGITS) + self.word(3, 4) + pick(marks)))),
            "tiny": lambda: (lead(strong + " " + weak), "".join(self.draw.sample(some(1, 2, UPPER) + some(2, 3, LOWER) + some(1, 2, DIGITS), k=4)) + some(1, 3, UPPER + LOWER + DIGITS)),
            "word": lambda: (lead("pwd pass passphrase", "set"), self.word(8, 14)), "short_hex": lambda: (lead(strong + " " + weak), some(16, 23, "0123456789abcdef")),
            "phrase": lambda: (lead("pwd pass passphrase credential", "quoted"), self.joined(" ", 3, 6, lambda: self.word(3, 8))),
            "grouped": lambda: (lead(strong + " " + weak), self.joined("-", 4, 6, lambda: some(4, 6, UPPER + DIGITS))),
        }
        return made[name]()

    def plain(self, name: str) -> tuple[str, str]:
        some, pick, word = self.some, self.draw.choice, self.word
        made = {
            "date": lambda: (pick(("", "on ", "date: ")), f"20{some(2, 2, DIGITS)}-0{some(1, 1, DIGITS)}-1{some(1, 1, DIGITS)}"), "mail": lambda: (pick(("", "mail ")), f"{word()}.{some(2, 2, DIGITS)}@mail1.example.com"),
            "card": lambda: ("", some(13, 19, DIGITS)), "url": lambda: (pick(("", "see ")), f"https://example.com/{word()}/{word()}-{some(4, 4, DIGITS)}"), "phone": lambda: ("", pick(("+", "")) + some(7, 12, DIGITS)),
            "name": lambda: ("", self.joined("_", 2, 4, word) + some(0, 2, DIGITS)), "version": lambda: ("", f"v{some(1, 1, DIGITS)}.{some(2, 2, DIGITS)}.{some(3, 3, DIGITS)}"), "address": lambda: ("", self.joined(".", 4, 4, lambda: some(1, 3, DIGITS))),
            "uuid": lambda: (pick(("", "id: ", "id = ")), "-".join(some(k, k, "0123456789abcdef") for k in (8, 4, 4, 4, 12))), "path": lambda: ("", "/" + self.joined("/", 2, 4, word) + pick((".py", ".txt", ""))),
            "camel": lambda: ("", self.joined("", 2, 4, lambda: word(3, 8).capitalize())), "shout": lambda: ("", self.some(4, 12, UPPER)), "starred": lambda: ("", word() + pick(("***", "###", "%%%", "$$$", "&&&"))),
            "said": lambda: (pick(("the ", "a ", "")) + pick(("key ", "token ", "access ", "secret ", "password ", "pass ", "auth ")), pick((word(), "to", "of", "is", word() + ","))),
            "label": lambda: (pick(("key: ", "access: ", "token: ", "key = ")), word()), "order": lambda: (pick(("order ", "no ", "")), some(2, 3, UPPER) + some(4, 6, DIGITS)), "quote": lambda: ('"', self.joined(" ", 2, 5, word) + '"'),
        }
        return made[name]()

    def text(self, words: list[str], lead: str, value: str) -> tuple[str, tuple[int, int]]:
        """The value among words of a text, and where it is."""
        at = self.draw.randrange(max(1, len(words) - 30))
        before, after = words[at : at + self.draw.randint(3, 14)], words[at + 15 : at + self.draw.randint(17, 30)]
        head = " ".join([*before, lead])
        quote = next((c for c in "\"'" if lead.endswith(c)), "")
        return f"{head}{value}{quote} {' '.join(after)}", (len(head), len(head) + len(value))


SECRET_FORMATS = "github github_pat payment model chat web_token maps gitlab base64 bearer key_block letters short tiny word short_hex phrase".split()
#: Formats that no example shows.
UNSEEN_FORMATS = "registry grouped".split()
PLAIN_FORMATS = "date mail card url phone name version address uuid path camel shout starred said label order quote".split()


def examples(texts: list[str], plants: int = PLANTS, seed: int = SEED) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Texts and their secrets: the texts as the base patterns label them, with their hint words masked, and planted ones."""
    own = [[(a, b) for a, b, _ in base_spans(t)] for t in texts]
    plant = Plants(seed)
    words = [w for t in texts for w in t.split() if w.isalpha()] or [plant.word() for _ in range(2000)]
    out, spans = list(texts), []
    for text, found in zip(texts, own):
        spans.append([(m.start(2), m.end(2)) if (m := ASSIGN.match(text, a)) else (a, b) for a, b in found])
    hidden = [(re.sub("|".join(KEYWORDS), lambda m: plant.word(len(m[0]), len(m[0])), t, flags=re.I), s) for t, s in zip(texts, spans) if s]
    out += [t for t, _ in hidden]
    spans += [s for _, s in hidden]
    for name in SECRET_FORMATS:
        for _ in range(plants):
            text, span = plant.text(words, *plant.secret(name))
            out.append(text)
            spans.append([span])
    for name in PLAIN_FORMATS:
        for _ in range(plants):
            out.append(plant.text(words, *plant.plain(name))[0])
            spans.append([])
    return out, spans


def fit(docs: DataFrame, n: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Field:
    """The field trained on the n texts (doc_id, text) first in the order of a hash, but for those too long, and on planted examples.

    Ids are chosen first, so that what a partition offers is n ids and not n texts.
    """
    ids = docs.where("doc_id is not null").select(F.xxhash64(F.lit(SEED), "doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(n)
    chosen = F.broadcast(ids.select("doc_id").distinct())  # at most n ids
    sample = docs.where(F.length("text") <= chars).select("doc_id", "text").join(chosen, "doc_id", "left_semi").orderBy("doc_id", "text").limit(n)
    return train(*windows(*examples([row.text for row in sample.toLocalIterator()])))


# Scanning


def with_base(text: str, own: list[list[tuple[int, int]]]) -> list[tuple[int, int, str]]:
    """All spans by start, then kind: the base patterns' and what no base span touches of the field's."""
    spans = base_spans(text)
    taken: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if taken and a <= taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    starts = [a for a, _ in taken]
    for tokens_of in own:
        begun = None
        for a, b in tokens_of:
            k = bisect_right(starts, b - 1) - 1
            if k >= 0 and taken[k][1] > a:
                begun = None
                continue
            end = max(a + 1, a + len(text[a:b].rstrip(TAIL)))
            if begun is None:
                begun = a
                spans.append((a, end, "crf"))
            else:
                spans[-1] = begun, end, "crf"
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_all(texts: list[str], field: Field) -> Iterator[list[tuple[int, int, str]]]:
    """The spans of each text, tagged in groups."""
    group, size = [], 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size > GROUP_CHARS or i == len(texts) - 1:
            yield from (with_base(t, own) for t, own in zip(group, tagged(group, field)))
            group, size = [], 0


def scan(text: str, field: Field) -> list[tuple[int, int, str]]:
    return next(scan_all([text], field))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"


def find_secrets(docs: DataFrame, field: Field, redact: bool = False) -> DataFrame:
    """docs with counts of base spans, the digest of their list, all spans and (if asked for) the redacted text."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in names]

    @F.pandas_udf(RESULT)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        whole = [t or "" for t in texts]
        for text, spans in zip(whole, scan_all(whole, field)):
            base = [s for s in spans if s[2] != "crf"]
            n = Counter(s[2] for s in base)
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                         redacted(text, spans) if redact and spans else None))
        return pd.DataFrame(rows, columns=names).astype({c: "int64" for c in names[:3]})

    return docs.select(*kept).withColumn("_found", scanned(F.col("text"))).select(*kept, "_found.*")
