import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import tokens

random.seed(5)
TEXTS = ["", None, "one", "a  b\n\n c\t", "<|endoftext|>", "x <|endoftext|> y<|startoftext|≯z <|endofte", "xt|> plain", "é İstanbul ΣΣ", "a\u0085b\x1cc　d",
         "don't I'LL 's ''s !'s \n's", " " * 40 + "q", "z" * 5000, "ab\n" * 3000, "\U0001f600 中文٠١ ½"]
TEXTS += ["".join(random.choice("ab's'tl er  \n\t1é中!?'<|>") for _ in range(random.randint(1, 60))) for _ in range(300)]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)


def test_counts_as_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in tokens.token_counts(rows(spark), limit=40).collect()}
    for i, t in enumerate(TEXTS):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 40), t


def test_encodes_and_decodes_as_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in tokens.encode_decode(rows(spark), texts=True).collect():
        ids = tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, text, len(ids)), TEXTS[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table_and_repeated_rows(spark):
    assert tokens.token_counts(rows(spark, [])).count() == 0
    twice = rows(spark, ["same"]).union(rows(spark, ["same"]))
    assert [r.n_tokens for r in tokens.token_counts(twice).collect()] == [1, 1]


@pytest.mark.parametrize("name,joins", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_every_code_point_lexes_as_the_library(name, joins):
    """White space, letters and numbers as the library's own tables have them, but for code points newer than either."""
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    chars = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    work = tokens.counter(public_tokenizers.path(name), 1, lowers=not joins)
    texts = [f"a{c}b 1{c}2 {c} {c}{c}" for c in chars]
    data = [t.encode() for t in texts]
    got = work(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))["n_tokens"]
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    bad = [hex(ord(c)) for c, g, w in zip(chars, got, want) if g != w]
    assert len(bad) < 40, bad


def test_transducer_counts_words_of_all_lengths(monkeypatch):
    vocabulary = tokens.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    machine, encoder = tokens.CountingTransducer(vocabulary), tokens.BacktrackingEncoder(vocabulary)
    r = random.Random(8)
    words = ["".join(r.choice("abcdeinrst \u00c3\u00a9") for _ in range(r.choice([1, 2, 5, 9, 40]))) for _ in range(500)] + ["a" * 3000, "".join(r.choice("abcdefgh") for _ in range(4000))]
    data = [w.encode("latin-1") for w in words]
    ends = np.cumsum([len(d) for d in data])
    want = [len(encoder.encode(d.decode("latin-1"))) for d in data]
    for most, batch, few in ((60_000, 100_000, 24), (50, 300, 3), (50, 300, 10_000)):
        monkeypatch.setattr(tokens.CountingTransducer, "MOST", most)
        monkeypatch.setattr(tokens.CountingTransducer, "BATCH", batch)
        monkeypatch.setattr(tokens.CountingTransducer, "FEW", few)
        assert machine.counts(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], ends[:-1]]), ends).tolist() == want
    assert machine.counts(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_equal_hashes_are_compared(monkeypatch):
    points = np.frombuffer("abcabxababc".encode("utf-32-le"), np.uint32)
    at, ends = np.array([0, 3, 6, 8]), np.array([3, 6, 8, 11])
    for fake in (None, lambda *a: np.zeros(4, np.uint64)):
        if fake:
            monkeypatch.setattr(tokens, "hashes", fake)
        where, number = tokens.different(points, at, ends, [])
        text = ["abc", "abx", "ab", "abc"]
        assert [text[where[k]] for k in number] == text
        where, number = tokens.different(points, at, ends, [0])
        assert [text[where[k]] for k in number] == text and where[number[0]] == 0 and where[number[3]] == 3
