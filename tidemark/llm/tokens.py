"""Token counts, and encoding and decoding, of whole texts with public byte-pair tokenizers.

Token counts come from two deterministic transducers: one finds the pretokens (lexing.Lexer: chunk state
maps composed by a prefix scan), the other (bpe.CountingTransducer) annotates its transitions with the
change in the number of tokens. The second starts anew at each pretoken, so the map of a chunk that ends at
a pretoken's end sends every state to the first one and adds a number: the chunks (pretokens) advance side
by side, and their maps compose by a prefix sum, whose differences at the borders of texts are the counts.
Encoding uses the backtracking encoder over Aho-Corasick matches, whose results are kept by pretoken;
decoding copies bytes by an offset table.

Cases: null text counts as empty (0 tokens); rows repeated keep their own results; other columns don't
matter; an empty table gives an empty result; one very long text is a slice of its own, with memory in
proportion to it.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.bpe import BacktrackingEncoder, CountingTransducer, Vocabulary, flat
from tidemark.llm.common import map_text, spread
from tidemark.llm.lexing import Lexer, code_points, hashes

#: Pretokens whose results a worker keeps, and the longest that it keeps.
MEMORY, LONG = 400_000, 64


class Splitter:
    """Pretokens of a slice: normalisation, special strings, lexing."""

    def __init__(self, vocabulary: Vocabulary, lowers: bool):
        self.lowers = lowers
        self.special = vocabulary.special
        self.pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.lexer = Lexer(joins=not vocabulary.ends_words)

    def normal(self, text: str) -> str:
        """As the word tokenizer: composed, lower case by character (no final sigma). White space is dropped later."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower() if self.lowers else text

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
        """(normal text, start of each row and the end, starts of independent parts, special strings: start -> (end, id)), in code points."""
        raw = data.tobytes()
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = None
        if text is not None and not (self.lowers and (not unicodedata.is_normalized("NFC", text) or "İ" in text)) and not self.pattern.search(text):
            leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            first = leads[offsets].astype(np.int64)
            return self.normal(text), first, first, {}
        rows, first, parts, special, at = [], [0], [], {}, 0
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            row, done = raw[lo:hi].decode("utf-8", "replace"), 0
            parts.append(at)
            for m in [*self.pattern.finditer(row), None]:
                rows.append(self.normal(row[done : m.start() if m else len(row)]))
                at += len(rows[-1])
                parts.append(at)
                if m:
                    rows.append(m[0])
                    special[at] = at + len(m[0]), self.special[m[0]]
                    at += len(m[0])
                    parts.append(at)
                    done = m.end()
            first.append(at)
        return "".join(rows), np.array(first, np.int64), np.array(parts, np.int64), special

    def split(self, data: np.ndarray, offsets: np.ndarray):
        """(text, its code points, starts, ends, row of each pretoken, {index: special id})."""
        text, first, parts, special = self.pieces(data, offsets)
        points = code_points(text)
        at, ends = self.lexer.run(points, parts)
        marks: dict[int, int] = {}
        if special:
            keep = np.ones(len(at), bool)
            for begin, (end, token) in special.items():
                lo, hi = np.searchsorted(at, [begin, end])
                keep[lo + 1 : hi] = False
                ends[lo] = end
                marks[int(lo)] = token
            moved = np.cumsum(keep) - 1
            marks = {int(moved[i]): t for i, t in marks.items()}
            at, ends = at[keep], ends[keep]
        row = np.searchsorted(first, at, "right") - 1
        return text, points, at, ends, row, marks


@functools.lru_cache(2)
def _counting(path: str, lowers: bool) -> tuple[Vocabulary, Splitter, CountingTransducer]:
    """What a worker keeps from task to task."""
    vocabulary = Vocabulary(path)
    return vocabulary, Splitter(vocabulary, lowers), CountingTransducer(vocabulary)


def counter(path: str, limit: int, lowers: bool = False):
    vocabulary, splitter, transducer = _counting(path, lowers)

    def work(data: np.ndarray, offsets: np.ndarray) -> dict:
        text, _, at, ends, row, marks = splitter.split(data, offsets)
        symbols = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        place = np.append(np.flatnonzero((symbols & 0xC0) != 0x80), len(symbols))  # of code points in bytes
        at, ends = place[at], place[ends]
        if vocabulary.ends_words and len(at):
            symbols = symbols.astype(np.uint16)
            symbols[ends - 1] += 256
        each = transducer.counts(symbols, at, ends)
        each[list(marks)] = 1
        upto = np.concatenate([[0], np.cumsum(each)])  # the prefix sum
        first = np.searchsorted(row, np.arange(len(offsets)))
        total = np.diff(upto[first])
        return {"n_bytes": np.diff(offsets), "n_tokens": total, "over_limit": total > limit}

    return work


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; path: a byte-level tokenizer file."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return map_text(docs, [key], text, lambda: counter(path, limit), "n_bytes long, n_tokens long, over_limit boolean")


class Decoder:
    """Token texts one after another with an offset table. Without a decoder of its own, a vocabulary's tokens are joined by a space."""

    def __init__(self, vocabulary: Vocabulary):
        most = max(vocabulary.raw) + 1
        texts = [(vocabulary.raw.get(i, "") + " ").encode() for i in range(most)]
        self.size = np.fromiter(map(len, texts), np.int64, most)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, each with its space, and where each token ends."""
        size = self.size[ids]
        return self.bytes[spread(self.first[ids], size)], np.cumsum(size)


def different(points: np.ndarray, at: np.ndarray, ends: np.ndarray, alone: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Spans that differ from one another, and for every span which of these it equals. Spans of one hash are compared; those in `alone` equal no other."""
    _, where, inverse = np.unique(hashes(points, at, ends), return_index=True, return_inverse=True)
    first = where[inverse]
    odd = (ends - at) != (ends - at)[first]
    odd[alone] = True
    same = np.flatnonzero(~odd)
    size = (ends - at)[same]
    wrong = points[spread(at[same], size)] != points[spread(at[first[same]], size)]
    if wrong.any():
        odd[same[np.unique(np.repeat(np.arange(len(same)), size)[wrong])]] = True
    odd |= odd[first]  # what would stand for others has to equal them
    if not odd.any():
        return where, inverse
    more = np.flatnonzero(odd)
    number = np.empty(len(at), np.int64)
    number[:] = inverse
    number[more] = len(where) + np.arange(len(more))
    return np.concatenate([where, more]), number


@functools.lru_cache(2)
def _encoding(path: str, lowers: bool) -> tuple[Vocabulary, Splitter, BacktrackingEncoder, Decoder, dict[str, list[int]]]:
    """What a worker keeps from task to task; the last are ids by pretoken."""
    vocabulary = Vocabulary(path)
    return vocabulary, Splitter(vocabulary, lowers), BacktrackingEncoder(vocabulary), Decoder(vocabulary), {}


def encoder(path: str, lowers: bool, texts: bool, ids_too: bool = False):
    vocabulary, splitter, machine, decoder, known = _encoding(path, lowers)

    def work(data: np.ndarray, offsets: np.ndarray) -> dict:
        n = len(offsets) - 1
        text, points, at, ends, row, marks = splitter.split(data, offsets)
        where, inverse = different(points, at, ends, list(marks))
        if len(known) > MEMORY:
            known.clear()
        lists = []
        for k in where.tolist():
            if k in marks:
                lists.append([marks[k]])
                continue
            word = text[at[k] : ends[k]]
            ids = known.get(word)
            if ids is None:
                ids = machine.encode(vocabulary.word(word))
                if len(word) <= LONG:
                    known[word] = ids
            lists.append(ids)
        pool, first = flat(lists)
        size = np.diff(first)[inverse]
        ids = pool[spread(first[:-1][inverse], size)].astype("<u4")
        total = np.bincount(row, weights=size, minlength=n).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(total)])
        out = {"n_tokens": total}
        decoded, stops = decoder.decode(ids)
        stops = np.concatenate([[0], stops])
        sliced = [(memoryview(ids[a:b]).cast("B"), decoded[stops[a] : max(stops[a], stops[b] - 1)]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        if texts or ids_too:
            out["ids"] = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int32)))
        if texts:
            out["decoded"] = pa.array([d.tobytes().decode() for _, d in sliced], pa.string())
        out["ids_sha256"] = pa.array([hashlib.sha256(i).hexdigest() for i, _ in sliced], pa.string())
        out["decoded_sha256"] = pa.array([hashlib.sha256(d).hexdigest() for _, d in sliced], pa.string())
        return out

    return work


def encode_decode(docs: DataFrame, path: str | None = None, texts: bool = False, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ids: bool = False) -> DataFrame:
    """Ids and decoded text of each row with the word tokenizer: their digests, with ids=True the ids, and with texts=True ids and decoded themselves."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    whole = "ids array<int>, " * (texts or ids) + "decoded string, " * texts
    return map_text(docs, list(keep), text, lambda: encoder(path, True, texts, ids), f"n_tokens long, {whole}ids_sha256 string, decoded_sha256 string")
