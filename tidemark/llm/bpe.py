"""Byte-pair vocabularies: merge tables, pair compatibility, a backtracking encoder and a counting transducer.

Two adjacent tokens are compatible if encoding their joined text gives the same two tokens again. A
sequence of tokens is the exact result of the merges if and only if all its neighbours are compatible.
Symbols are characters of a str: a byte b is chr(b), a byte that ends a word is chr(256 + b) where the
vocabulary marks word ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import ahocorasick
import numpy as np

WORD_END = "</w>"
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ends_words = model.get("end_of_word_suffix") == WORD_END
        alphabet = byte_alphabet()

        def symbols(token: str) -> str:
            end = self.ends_words and token.endswith(WORD_END)
            out = [alphabet[c] for c in (token[: -len(WORD_END)] if end else token)]
            return "".join(chr(b + 256 * (end and i == len(out) - 1)) for i, b in enumerate(out))

        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.raw = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.ids = {symbols(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = map(symbols, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank[a, b] = i
            self.parts.setdefault(a + b, (a, b))
        # Only tokens that merges can build take part in matches.
        self.reachable = {t for t in self.ids if len(t) == 1 or t in self.parts}
        self._spines: dict[str, tuple[list, list]] = {}
        self._fits: dict[tuple[str, str], bool] = {}

    def spines(self, token: str) -> tuple[list, list]:
        """(left, right) edges of a token's merge tree, outermost first: (subtoken, rank of the merge that absorbs it)."""
        if (got := self._spines.get(token)) is None:
            edges = []
            for side in (0, 1):
                edge, now, taken = [], token, NEVER
                while True:
                    edge.append((now, taken))
                    if now not in self.parts:
                        break
                    taken = self.rank[self.parts[now]]
                    now = self.parts[now][side]
                edges.append(edge)
            got = self._spines[token] = (edges[0], edges[1])
        return got

    def fits(self, a: str, b: str) -> bool:
        """Whether a|b stays as it is: no merge across the border comes before both its sides are absorbed. Equal ranks go from the left."""
        if (got := self._fits.get((a, b))) is None:
            got = True
            rank = self.rank.get
            left, right = self.spines(a)[1], self.spines(b)[0]
            for x, x_taken in left:
                for y, y_taken in right:
                    r = rank((x, y))
                    if r is not None and r < x_taken and r <= y_taken:
                        got = False
                        break
                if not got:
                    break
            if len(self._fits) > 500_000:
                self._fits.clear()
            self._fits[a, b] = got
        return got

    def word(self, pretoken: str) -> str:
        """A pretoken's symbols."""
        raw = pretoken.encode("utf-8", "surrogatepass").decode("latin-1")
        return raw[:-1] + chr(ord(raw[-1]) + 256) if self.ends_words and raw else raw


class BacktrackingEncoder:
    """Exact merges without merging: the automaton lists the tokens that start at each symbol; the longest that fits its predecessor is taken, with steps back from dead ends."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for t in vocabulary.reachable:
            self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()

    def encode(self, symbols: str) -> list[int]:
        v = self.vocabulary
        ids, fits, n = v.ids, v.fits, len(symbols)
        matches: list[list[int]] = [[] for _ in range(n)]
        for end, size in self.automaton.iter(symbols):
            matches[end - size + 1].append(size)  # ends come in order, so sizes rise
        dead = bytearray(n + 1)
        out: list[str] = []
        at, choice = 0, [len(matches[0]) - 1] if n else []
        while at < n:
            sizes, k = matches[at], choice[-1]
            taken = False
            while k >= 0:
                size = sizes[k]
                if not dead[at + size]:
                    token = symbols[at : at + size]
                    if not out or fits(out[-1], token):
                        out.append(token)
                        choice[-1] = k - 1  # the next to try here
                        at += size
                        choice.append(len(matches[at]) - 1 if at < n else -1)
                        taken = True
                        break
                k -= 1
            if not taken:
                if not out:
                    raise ValueError("a symbol is not in the vocabulary")
                # Whatever comes before, the exact encoding of the text up to here ends in another token.
                dead[at] = 1
                choice.pop()
                at -= len(out.pop())
        return [ids[t] for t in out]


class CountingTransducer:
    """Numbers of tokens by a deterministic finite-state transducer that is compiled as texts need it.

    After a prefix, its encoding's last token is unique: the longest token that ends there and fits the
    last token of what comes before it. What a later symbol can change depends only on the longest suffix
    that begins some token (the automaton node) and, for each position in it, the last token and the number
    of tokens there, relative to now. These make the state; a transition carries the change in the count.
    Transitions are rows of two tables, next state and change, so that many words advance at once.
    """

    #: States after which compilation begins anew, symbols that are read between two looks at their number, and words below which they are read one by one.
    MOST, BATCH, FEW = 300_000, 100_000, 24

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.prefixes = {t[:i] for t in vocabulary.reachable for i in range(len(t) + 1)}
        self.reset()

    def reset(self) -> None:
        #: A state: (suffix, for each position before, in and after it: (last token there, count there - count now)).
        self.states: list[tuple[str, tuple]] = []
        self.number: dict[tuple[str, tuple], int] = {}
        self.column = np.full(512, -1, np.int64)  # of a symbol in the tables
        self.symbols: list[int] = []
        self.to, self.delta = np.full((1024, 64), -1, np.int32), np.zeros((1024, 64), np.int16)
        self.add(("", (("", 0),)))

    def add(self, key: tuple[str, tuple]) -> int:
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
            if at == len(self.to):
                self._grow(2 * at, self.to.shape[1])
        return at

    def _grow(self, rows: int, columns: int) -> None:
        to, delta = np.full((rows, columns), -1, np.int32), np.zeros((rows, columns), np.int16)
        to[: self.to.shape[0], : self.to.shape[1]], delta[: self.to.shape[0], : self.to.shape[1]] = self.to, self.delta
        self.to, self.delta = to, delta

    def learn(self, symbols: np.ndarray) -> None:
        """Columns for all these symbols."""
        for x in np.flatnonzero(np.bincount(symbols, minlength=512)).tolist():
            if self.column[x] < 0:
                if len(self.symbols) == self.to.shape[1]:
                    self._grow(self.to.shape[0], 2 * len(self.symbols))
                self.column[x] = len(self.symbols)
                self.symbols.append(x)

    def compile(self, state: int, column: int) -> None:
        v, symbol = self.v, chr(self.symbols[column])
        suffix, trail = self.states[state]
        grown = suffix + symbol
        drop = 0
        while grown[drop:] not in self.prefixes:
            drop += 1
        for begin in range(drop, len(grown)):
            token = grown[begin:]
            if token in v.reachable and (not trail[begin][0] or v.fits(trail[begin][0], token)):
                break
        else:
            raise ValueError("a symbol is not in the vocabulary")
        delta = trail[begin][1] + 1
        # No token to come begins at a place whose rest begins none, so what is known there is left out.
        prefixes = self.prefixes
        known = (e and (e[0], e[1] - delta) if grown[i:] in prefixes else None for i, e in enumerate(trail[drop:], drop))
        to = self.add((grown[drop:], (*known, (token, 0))))
        self.to[state, column], self.delta[state, column] = to, delta

    def counts(self, symbols: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of tokens of each span of symbols; spans are words, which begin in the first state."""
        out = np.zeros(len(at), np.int64)
        upto = np.cumsum(ends - at)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + self.BATCH, "right")))
            out[lo:hi] = self._batch(symbols, at[lo:hi], ends[lo:hi])
            if len(self.states) > self.MOST:
                self.reset()
            lo = hi
        return out

    def _batch(self, symbols: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - at
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # words longer than so many symbols
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        step = 0
        self.learn(symbols[int(at.min()) : int((at + size).max())])
        while step < len(live) and live[step] >= self.FEW:
            n = int(live[step])
            column = self.column[symbols[at[:n] + step]]
            to = self.to[state[:n], column]
            missing = np.flatnonzero(to < 0)
            if len(missing):
                for pair in np.unique(state[missing] << 10 | column[missing]).tolist():
                    self.compile(pair >> 10, pair & 1023)
                to = self.to[state[:n], column]
            total[:n] += self.delta[state[:n], column]
            state[:n] = to
            step += 1
        for i in range(int(live[step]) if step < len(live) else 0):  # the few longest
            total[i] += self._rest(symbols[at[i] + step : at[i] + size[i]], int(state[i]), keep=i + 1 < live[step])
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out

    def _rest(self, symbols: np.ndarray, state: int, keep: bool) -> int:
        """The change over one word's symbols. keep: other words still stand in states, which thus may not go."""
        total, columns = 0, self.column[symbols].tolist()
        for i, column in enumerate(columns):
            if self.to[state, column] < 0:
                self.compile(state, column)
            total += int(self.delta[state, column])
            state = int(self.to[state, column])
            if not keep and len(self.states) > 2 * self.MOST:
                here = self.states[state]
                self.reset()
                self.learn(symbols[i + 1 :])
                state = self.add(here)
                columns[i + 1 :] = self.column[symbols[i + 1 :]].tolist()
        return total


def flat(lists: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after another, and their offsets."""
    rows = list(lists)
    sizes = np.fromiter((len(x) for x in rows), np.int64, len(rows))
    return np.fromiter((i for x in rows for i in x), np.uint32, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])
