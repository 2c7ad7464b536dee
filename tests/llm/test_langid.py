import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid

SYL = {"en": ["the", "and", "ing", "wh", "th", "er"], "de": ["sch", "ung", "über", "ich", "ein", "tz"], "fr": ["eau", "que", "é", "oui", "ment", "aux"]}


def text(lang, r, n):
    return " ".join("".join(r.choice(SYL[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def table(spark, n=300):
    r = random.Random(3)
    langs = ["en", "de", "fr"]
    rows = [(i, text(langs[i % 3], r, r.randint(4, 60)), langs[i % 3], f"h{i % 3}", "z") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lid__ string")


def test_held_out_accuracy_and_rejects(spark):
    docs = table(spark)
    model = langid.train(docs.where("doc_id < 150"))
    odd = spark.createDataFrame([(900, None, None, None, "z"), (901, "", "en", "h0", "z"), (902, "12 34 :: 99", "en", "h0", "z"), (903, "ab", None, None, "z")], docs.schema)
    out = langid.identify(docs.union(odd), model, host=F.col("source"), declared=F.col("lang"))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns[:5] == docs.columns and len(got) == 304
    assert all(got[i].lid__lang == got[i].lang for i in range(150, 300))
    assert got[900].lid__lang == got[901].lid__lang == got[902].lid__lang == "und"
    assert langid.accepted(docs).count() == 300


def test_evidence_decides_when_text_is_short(spark):
    r = random.Random(4)
    base = table(spark, 600).withColumn("source", F.concat("lang", F.lit(".host.com")))
    model = langid.train(base)
    short = spark.createDataFrame([(1000, "ab", "de", "de.host.com", "z"), (1001, "ab", "en", "en.host.com", "z")], base.schema)
    got = {x.doc_id: x.lid__lang for x in langid.identify(base.union(short), model, host=F.col("source"), declared=F.col("lang")).where("doc_id >= 1000").collect()}
    assert got == {1000: "de", 1001: "en"} and r


def test_pages(spark):
    r = random.Random(5)
    rows = [(i, f"https://www.x{i % 3}.example.{('uk', 'de', 'fr')[i % 3]}/a?b", f"<html lang='{('en', 'de', 'fr')[i % 3]}'><script>the the</script><p>{text(('en', 'de', 'fr')[i % 3], r, 30)}</p>") for i in range(60)]
    rows += [(60, None, None), (61, "junk", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.lid__lang for x in langid.pages_identified(pages, langid.train(table(spark))).collect()}
    assert [got[i] for i in range(60)] == ["en", "de", "fr"] * 20 and got[60] == got[61] == "und"


def test_posterior_by_brute_force(spark):
    r = random.Random(6)
    rows = [(i, text(("en", "de", "fr")[i % 3], r, r.randint(1, 12)), r.choice(["en", "de", None]), r.choice(["a.x.com", "b.x.com", "c.org", None]), r.choice(["com", "org", None])) for i in range(120)]
    rows += [(500, None, "de", "a.x.com", "com"), (501, "", None, None, None), (502, rows[3][1], "en", "c.org", "org"), (502, rows[3][1], "en", "c.org", "org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, suffix string")
    model = langid.train(table(spark))
    k, weight = len(model.languages), 20.0
    data = [(t or "").encode() for _, t, _, _, _ in rows]
    score = model.score(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]), 150)
    best = score.argmax(1)

    def counts(of):
        out = {}
        for x, b in zip(of, best):
            if x is not None:
                out.setdefault(x, np.zeros(k))[b] += 1
        return out

    total = np.bincount(best, minlength=k).astype(float)
    overall = (total + 1) / (total.sum() + k)
    domain = [(h and ".".join(h.split(".")[-2:])) or "" for _, _, _, h, _ in rows]
    domains, hosts = counts(domain), counts([x[3] for x in rows])
    smooth = lambda c, p: (c + weight * p) / (c.sum() + weight)
    evidence = [(counts([x[j] for x in rows]), j) for j in (2, 4)]
    got = Counter((x.doc_id, x.lid__lang, round(x.lid__p, 6)) for x in langid.identify(docs, model, host=F.col("host"), suffix=F.col("suffix"), declared=F.col("lang")).collect())
    want = Counter()
    for i, row in enumerate(rows):
        z = score[i] + np.log(smooth(hosts[row[3]], smooth(domains[domain[i]], overall)) if row[3] else overall)
        for by, j in evidence:
            if row[j] is not None:
                z = z + np.log((by[row[j]] + 1) / (total + len(by) + 1))
        want[row[0], model.languages[int(z.argmax())], round(float(1 / np.exp(z - z.max()).sum()), 6)] += 1
    assert got == want


def test_rows_of_one_id_are_one_training_row(spark):
    docs = table(spark, 30).withColumn("doc_id", F.lit(1))
    model = langid.train(docs)
    assert len(model.languages) == 2  # one row, and und


def test_pages_query(spark):
    pages = spark.createDataFrame([(1, "http://a.de/x", "<html lang=de><p>" + text("de", random.Random(1), 30)), (2, None, None)], "page_id long, url string, html string")
    got = {x.page_id: (x.language, x.kept) for x in langid.pages_language(pages, table(spark)).collect()}
    assert got == {1: ("de", True), 2: ("und", False)}


def test_empty(spark):
    docs = table(spark).limit(0)
    assert langid.op4_language_id(docs).count() == 0
