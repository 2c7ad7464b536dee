"""The stages against brute force on a small fixture."""

import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import brute as similar
from tests.llm.test_langid import text
from tests.llm.test_substrings import brute as repeated


def documents(spark):
    r = random.Random(8)
    passage = text("en", r, 80)
    rows = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        words = text(lang, r, r.randint(30, 160))
        if i % 10 == 3:
            words += " " + passage + " " + text(lang, r, 20)
        if i % 10 == 7:
            w = rows[-1][1].split()
            w[len(w) // 2] = "changed"
            words = " ".join(w)
        rows.append((i, words, lang, f"s{i % 4}", len(words)))
    rows += [(200, None, "en", "s0", 0), (201, "12 34 !!", None, "s1", 8), (202, rows[4][1], "de", "s2", len(rows[4][1])), (1, rows[1][1], "de", "s1", len(rows[1][1]))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stages(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs.collect()
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["language"]
    assert sorted(r.doc_id for r in before if r not in after) == [200, 201] and len(before) - len(after) == 2
    before, after = seen["near_duplicates"]
    roots = {root for _, _, root in similar([(r.doc_id, r.text) for r in before], 5, 80)}
    assert sorted(r.doc_id for r in after) == sorted(roots)
    before, after = seen["repeated_passages"]
    rest = {d: digest for d, _, _, _, digest in repeated([(r.doc_id, r.text) for r in before], 200)}
    from hashlib import sha256

    assert {r.doc_id: sha256(r.text.encode()).hexdigest() for r in after} == rest
    assert all(r.n_chars == len(r.text) for r in after) and any(n.text != o.text for n, o in zip(sorted(after), sorted(before)))
    before, after = seen["mixing"]
    copies = Counter(r.doc_id for r in after)
    assert max(copies.values()) == 2 and set(copies) < {r.doc_id for r in before}
    assert all(r in before for r in after)
    before, after = seen["encoding"]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, tuple(tok.encode(r.text, add_special_tokens=False).ids)) for r in before)
    assert Counter((r.doc_id, tuple(r.ids)) for r in after) == want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(str, whole.collect())) == Counter(map(str, after))
