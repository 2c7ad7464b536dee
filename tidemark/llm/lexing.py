"""Pretokens of whole texts: a finite-state transducer run by chunk state maps and a parallel prefix scan.

Both public tokenizers split text into pretokens by a regular expression. The splits are compiled into
one deterministic transducer over symbol classes: each transition says whether the symbol starts a
pretoken. Text is cut into chunks of equal length; all chunks advance at once from every possible state,
which gives each chunk's map from its first state to its last; a prefix scan composes the maps of the
chunks before it, so each chunk learns the state it starts in; a second pass from that state emits.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import regex

LETTER, DIGIT, SPACE, BLANK, OTHER = range(5)
#: Symbols beside the classes: white space before a non-white symbol (the last of its run), an apostrophe with one or two letters of a contraction after it.
LAST_SPACE, LAST_BLANK, SHORT, LONG = 5, 6, 7, 8
#: States: at a text's start or after a finished pretoken; in a run of letters, digits, others; after a joining space; in white space; with one or two letters of a contraction left.
FRESH, IN_L, IN_N, IN_O, JOIN, IN_W, LEFT1, LEFT2 = range(8)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point; white space is the Unicode property."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "!" for i in range(sys.maxunicode + 1))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    table[32] = SPACE
    return table


def _machine(joins: bool, runs_of_digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a pretoken) by state * 9 + symbol. joins: a single space belongs to the pretoken after it, other white space is pretokens of its own; else white space is dropped."""
    to, starts = np.zeros((8, 9), np.uint8), np.zeros((8, 9), bool)
    run = {LETTER: IN_L, DIGIT: IN_N if runs_of_digits else FRESH, OTHER: IN_O}
    for state in range(8):
        for symbol in range(9):
            if state in (LEFT1, LEFT2):
                to[state, symbol] = FRESH if state == LEFT1 else LEFT1
            elif symbol in (LAST_SPACE, LAST_BLANK, SPACE, BLANK):
                last = symbol in (LAST_SPACE, LAST_BLANK)
                to[state, symbol] = (JOIN if symbol == LAST_SPACE else FRESH) if last else IN_W
                starts[state, symbol] = joins and (last or state != IN_W)
            elif symbol in (SHORT, LONG):
                contraction = state not in ((IN_O, JOIN) if joins else (IN_O,))
                to[state, symbol] = (LEFT1 if symbol == SHORT else LEFT2) if contraction else IN_O
                starts[state, symbol] = contraction
            else:
                to[state, symbol] = run[symbol]
                starts[state, symbol] = not (state == JOIN and joins) and (state != run[symbol] or run[symbol] == FRESH)
    return to.ravel(), starts.ravel()


class Lexer:
    """joins: the byte-level pattern with joined spaces; otherwise the word pattern that drops white space and takes digits one by one."""

    CHUNK = 128

    def __init__(self, joins: bool):
        self.joins = joins
        self.to, self.starts = _machine(joins, runs_of_digits=joins)

    def symbols(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """first: where each text begins (and the end); looks at most two symbols ahead within the text."""
        kind = classes()[points]
        n = len(points)
        white = (kind == SPACE) | (kind == BLANK)
        ends = np.zeros(n + 1, bool)
        ends[first] = True
        next_solid = np.zeros(n, bool)
        next_solid[:-1] = ~white[1:] & ~ends[1:n]
        last = white & next_solid
        kind = np.where(last, np.where(kind == SPACE, LAST_SPACE, LAST_BLANK), kind).astype(np.uint8)
        for at in np.flatnonzero(points == 39):
            if at + 1 < n and not ends[at + 1]:
                c = points[at + 1]
                if c in (115, 116, 109, 100):  # s t m d
                    kind[at] = SHORT
                elif at + 2 < n and not ends[at + 2] and (c, points[at + 2]) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
                    kind[at] = LONG
        return kind

    def run(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pretokens of texts that lie one after another; none crosses the start of a text."""
        n = len(points)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.symbols(points, first)
        begins = np.zeros(n + 1, bool)
        begins[first] = True
        # A symbol at the start of a text is read from FRESH, whatever came before: nine more symbols.
        to = np.concatenate([self.to.reshape(8, 9), np.tile(self.to.reshape(8, 9)[FRESH], (8, 1))], axis=1).ravel()
        starts = np.concatenate([self.starts.reshape(8, 9), np.tile(self.starts.reshape(8, 9)[FRESH], (8, 1))], axis=1).ravel()
        symbol = kind + np.uint8(9) * begins[:n]
        c = self.CHUNK
        rows = -(-n // c)
        padded = np.zeros(rows * c, np.uint8)
        padded[:n] = symbol
        columns = np.ascontiguousarray(padded.reshape(rows, c).T)
        maps = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)
        for column in columns:
            maps = to[maps * np.uint8(18) + column]
        state = self.scan(maps)
        out = np.empty((c, rows), bool)
        for i, column in enumerate(columns):
            at = state * np.uint8(18) + column
            out[i] = starts[at]
            state = to[at]
        at = np.flatnonzero(np.ascontiguousarray(out.T).ravel()[:n])
        ends = np.append(at[1:], n)
        if not self.joins and len(at):  # white space after a pretoken is not part of it
            solid = np.flatnonzero(~np.isin(kind, (SPACE, BLANK, LAST_SPACE, LAST_BLANK)))
            ends = solid[np.searchsorted(solid, ends, "left") - 1] + 1
        return at, ends

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """The state that each chunk starts in: maps of the chunks before it composed, in log2(chunks) steps."""
        rows = maps.shape[1]
        upto, step = maps.copy(), 1
        while step < rows:
            moved = upto.copy()
            moved[:, step:] = np.take_along_axis(upto[:, step:], upto[:, :-step].astype(np.intp), axis=0)
            upto, step = moved, step * 2
        state = np.empty(rows, np.uint8)
        state[0], state[1:] = FRESH, upto[FRESH, :-1]
        return state


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_POWERS = np.ones(1, np.uint64)


def hashes(points: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points: a polynomial over scrambled symbols, then mixed with the length."""
    global _POWERS
    if not len(at):
        return np.zeros(0, np.uint64)
    size = ends - at
    if len(_POWERS) < size.max():
        with np.errstate(over="ignore"):
            factors = np.full(int(size.max()) * 2 + 1, 0x9E3779B97F4A7C15, np.uint64)
            factors[0] = 1
            _POWERS = np.cumprod(factors, dtype=np.uint64)
    with np.errstate(over="ignore"):
        spans = np.arange(len(points), dtype=np.int64)
        begin = np.zeros(len(points), np.int64)
        begin[at] = at
        begin = np.maximum.accumulate(begin)
        inside = spans - begin
        inside[: at[0]] = 0
        np.minimum(inside, len(_POWERS) - 1, out=inside)
        x = points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= _POWERS[inside]
        cut = np.empty(2 * len(at), np.int64)
        cut[0::2], cut[1::2] = at, ends
        if cut[-1] == len(points):
            x = np.append(x, np.uint64(0))
        h = np.add.reduceat(x, cut)[0::2]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h += size.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h
