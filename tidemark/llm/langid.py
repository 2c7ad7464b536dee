"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

log P(language | row) = text + declared + suffix + host prior, where
  text      is the log likelihood of the text's byte trigrams under each language's add-constant model,
            scaled down so that no text speaks with more than `most_trigrams` trigrams;
  declared  is log P(declared markup language | language);
  suffix    is log P(address suffix | language);
  host      is log P(language | host), smoothed towards its domain, that towards all rows.
The last three come from one grouped aggregation over all rows of (host, domain, suffix, declared,
language by text alone). A further class, `und`, has a uniform trigram model; rows that it wins are
rejected. The trigram models are fitted on at most `most` labelled rows, those with the least hash of their
key, of several with one key the least.

Cases: null or empty texts, and texts without three bytes, have no text evidence; without any letter or
trigram a row is rejected; null host, suffix or declared language gives no evidence of its kind; rows
repeated are judged alike; ties go to the first language in order of code; with no labelled rows all is
`und`, and an empty table gives an empty result. Working columns begin with `lid__`, other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, lean, text_slices

UND = "und"
BITS = 16
#: Rows of an evidence table up to which it is broadcast (a row is a key and a number a language); larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram at each byte, whether it lies within one row); A-Z lowered."""
    b = data.astype(np.uint32)
    b += ((b >= 65) & (b <= 90)).astype(np.uint32) * 32
    if len(b) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    whole = np.ones(len(b), bool)
    for back in (1, 2):  # the last two bytes of a row begin none
        at = offsets[1:] - back
        whole[at[at >= 0]] = False
    return code, whole[:-2]


class TrigramModel:
    def __init__(self, languages: list[str], scores: np.ndarray):
        self.languages, self.scores = languages, scores  # (trigrams, languages), float32

    @classmethod
    def fit(cls, rows: pa.Table, constant: float = 0.1) -> TrigramModel:
        names = sorted({x for x in rows.column("lang").to_pylist() if x})
        counts = np.full((len(names), 1 << BITS), constant)
        lang = np.array([names.index(x) for x in rows.column("lang").to_pylist()], np.int64)
        for lo, hi, data, offsets in text_slices(rows.column("text")):
            code, whole = trigrams(data, offsets)
            owner = np.repeat(lang[lo:hi], np.diff(offsets))[: len(code)]
            for k in range(len(names)):
                counts[k] += np.bincount(code[whole & (owner == k)], minlength=1 << BITS)
        scores = np.log(counts / counts.sum(1, keepdims=True)) if names else np.zeros((0, 1 << BITS))
        return cls([*names, UND], np.concatenate([scores, np.full((1, 1 << BITS), -BITS * np.log(2.0))]).T.astype(np.float32))

    def score(self, data: np.ndarray, offsets: np.ndarray, most: int) -> np.ndarray:
        """(rows, languages) of scaled log likelihoods; rows without a trigram or letter favour und."""
        n, k = len(offsets) - 1, len(self.languages)
        code, whole = trigrams(data, offsets)
        out = np.zeros((n, k))
        size = np.maximum(np.diff(offsets) - 2, 0)
        if len(code):
            begin = np.minimum(offsets[:-1], len(code) - 1)
            for j in range(k):
                each = np.where(whole, self.scores[code, j], np.float32(0))
                sums = np.add.reduceat(each, begin, dtype=np.float64) if n else np.zeros(0)
                out[:, j] = np.where(size > 0, sums, 0)
        out *= (np.minimum(size, most) / np.maximum(size, 1))[:, None]
        letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
        seen = np.concatenate([[0], np.cumsum(letter)])
        out[:, -1] += np.where(seen[offsets[1:]] - seen[offsets[:-1]] == 0, 1e6, 0)
        return out


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", most: int = 2000) -> TrigramModel:
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    sample = known.select(F.col(key).alias("lid__key")).orderBy(F.xxhash64(key), key).limit(most).distinct()  # `most` numbers
    # Rows of one key are reduced to one where they are read, so no more than `most` texts meet.
    rows = known.join(F.broadcast(sample), known[key] == F.col("lid__key")).groupBy("lid__key").agg(F.min(F.struct(F.col(lang).alias("lang"), F.col(text).alias("text"))).alias("r"))
    return TrigramModel.fit(rows.select("r.lang", "r.text").toArrow())


def host_of(url: str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def markup_language(html: str) -> Column:
    """The lang attribute of <html>, its primary part."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1)), F.lit(""))


def _scored(rows: DataFrame, model: TrigramModel, keep: list[str], text: str, most: int) -> DataFrame:
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text))):
                s = model.score(data, offsets, most)
                values = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)).slice(lo, hi - lo) for k in keep), values], [*keep, "lid__text"])

    return rows.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(run), f"{fields}, lid__text array<double>")


def _best(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)) - 1


def _attached(rows: DataFrame, evidence: DataFrame, key: str, name: str) -> DataFrame:
    side = evidence.withColumnRenamed(key, f"{name}__key")
    side = F.broadcast(side) if evidence.count() <= BROADCAST_ROWS else side
    return rows.join(side, F.col(key) == F.col(f"{name}__key"), "left").drop(f"{name}__key")


def identify(docs: DataFrame, model: TrigramModel, text: str = "text", host: Column | None = None, suffix: Column | None = None, declared: Column | None = None, most_trigrams: int = 150, weight: float = 20.0) -> DataFrame:
    """docs with lid__lang and lid__p, the likeliest language and its probability; und is to be rejected.

    weight: how many rows of the wider group (domain for a host, all for a domain) the prior counts for.
    """
    none = F.lit(None).cast("string")
    host = none if host is None else host.cast("string")
    rows = docs.withColumns({"lid__host": host, "lid__domain": F.regexp_extract(F.coalesce(host, F.lit("")), r"([^.]+\.[^.]+|[^.]*)$", 1), "lid__suffix": none if suffix is None else suffix, "lid__declared": none if declared is None else declared})
    k = len(model.languages)
    keys = ["lid__host", "lid__domain", "lid__suffix", "lid__declared"]
    scored = _scored(rows, model, keys, text, most_trigrams)
    seen = cut(scored.groupBy(*keys, _best(F.col("lid__text")).cast("int").alias("lid__best")).agg(F.count("*").alias("lid__n")))

    def counts(key: str) -> DataFrame:
        return seen.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*(F.sum(F.when(F.col("lid__best") == i, F.col("lid__n")).otherwise(0)).cast("double") for i in range(k))).alias("c"))

    totals = [float(r or 0) for r in seen.agg(*(F.sum(F.when(F.col("lid__best") == i, F.col("lid__n")).otherwise(0)).alias(str(i)) for i in range(k))).first()]
    overall = [(t + 1) / (sum(totals) + k) for t in totals]
    plain = F.array(*(F.lit(float(x)) for x in overall))

    def smoothed(counted: Column, towards: Column) -> Column:
        n = F.aggregate(counted, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counted, towards, lambda c, p: (c + F.lit(weight) * p) / (n + F.lit(weight)))

    domains = counts("lid__domain").select("lid__domain", smoothed(F.col("c"), plain).alias("up"))
    hosts = seen.where("lid__host is not null").groupBy("lid__host").agg(F.first("lid__domain").alias("lid__domain"))
    hosts = hosts.join(counts("lid__host"), "lid__host").join(domains, "lid__domain")
    hosts = cut(hosts.select("lid__host", F.transform(smoothed(F.col("c"), F.col("up")), lambda p: F.log(p)).alias("lid__prior")))

    def likelihood(key: str, name: str) -> DataFrame:
        """log P(key | language): add-one over the keys seen."""
        by = counts(key)
        n = by.count() + 1
        whole = F.array(*(F.lit(t + n) for t in totals))
        return cut(by.select(key, F.zip_with("c", whole, lambda c, t: F.log((c + 1) / t)).alias(name)))

    out = _scored(rows, model, rows.columns, text, most_trigrams)
    out = _attached(out, hosts, "lid__host", "lid__prior")
    total = F.zip_with("lid__text", F.coalesce("lid__prior", F.transform(plain, lambda p: F.log(p))), lambda a, b: a + b)
    for key in ("lid__suffix", "lid__declared"):
        side = likelihood(key, f"{key}_like")
        out = _attached(out, side, key, f"{key}_like")
        total = F.zip_with(total, F.coalesce(f"{key}_like", F.array_repeat(F.lit(0.0), k)), lambda a, b: a + b)
    out = out.withColumn("lid__total", total).withColumn("lid__top", F.array_max("lid__total"))
    names = F.array(*(F.lit(x) for x in model.languages))
    p = F.lit(1.0) / F.aggregate("lid__total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("lid__top")))
    return out.withColumns({"lid__lang": F.element_at(names, (_best(F.col("lid__total")) + 1).cast("int")), "lid__p": p}).select(*docs.columns, "lid__lang", "lid__p")


def documents_identified(docs: DataFrame) -> DataFrame:
    """The documents table: `lang` is the declared language, `source` the host; it has no addresses, so no suffix."""
    return identify(docs, train(docs), host=F.col("source"), declared=F.lower("lang"))


def pages_identified(pages: DataFrame, model: TrigramModel) -> DataFrame:
    """Raw pages: the lang attribute, the address's suffix and host, and the page's markup-free bytes."""
    rows = pages.withColumn("lid__plain", F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " "))
    host = host_of("url")
    return identify(rows, model, text="lid__plain", host=host, suffix=F.substring_index(host, ".", -1), declared=markup_language("html")).drop("lid__plain")


def pages_language(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The pages table, with the trigram models of documents."""
    rows = pages_identified(pages, train(docs))
    return rows.select("page_id", F.col("lid__lang").alias("language"), F.round("lid__p", 6).alias("probability"), (F.col("lid__lang") != UND).alias("kept"))


def op4_language_id(docs: DataFrame) -> DataFrame:
    rows = documents_identified(docs)
    return rows.select("doc_id", F.col("lid__lang").alias("language"), F.round("lid__p", 6).alias("probability"), (F.col("lid__lang") != UND).alias("kept"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that have a language; their own columns only."""
    return documents_identified(docs).where(F.col("lid__lang") != UND).select(*docs.columns)
