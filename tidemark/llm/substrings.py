"""Exact removal of repeated byte strings: column-wise suffix sorting of many segments at once.

Every byte that a string of `length` bytes covers which also starts elsewhere (same document or another) is
removed. Finding them:

1. Each window of `length` bytes has an anchor: the least hash of its 32-byte strings. Equal windows have
   equal anchors at equal places, so windows need comparing only among segments around one anchor value. A
   segment is all bytes that windows with that anchor can reach.
2. Segments are dealt by anchor and sorted by a hash of their content. Anchors that occur once are done.
   Segments that are equal throughout repeat as a whole; one of them stands for all in step 3.
3. The different segments of an anchor are aligned at it and sorted column by column from the last to the
   first: each round inserts one symbol of every segment and updates, for all anchors of a batch at once,
   the order of the suffixes (the positional Burrows-Wheeler transform: a stable partition of the previous
   order by the new symbol) and the common prefixes of neighbours (the least of those passed over, plus
   one). A window repeats if its suffix has a common prefix of `length` with a neighbour. The columns lie in
   a sequential external file, so a batch needs memory for the order, the prefixes and one column.

The sequential construction over whole documents takes as many rounds as the longest document has bytes
and reads the whole transform in each; anchors bound the rounds by 2 * length - 32 and make the batches
independent. An anchor with more than `hot` different segments is split by ranges of window starts and the
bytes that all windows of the range share, down to single windows, so no task holds an unbounded group.

Cases: null text counts as empty; texts shorter than `length` lose nothing; rows repeated (also with one
doc_id or none) are documents of their own, so all their windows repeat; an empty table gives an empty
result; other columns don't matter. Removed spans may cut characters: digests are of bytes, and texts are
decoded without the broken ones.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, lean, text_slices

GRAM = 32
#: Different segments of an anchor that one batch may hold.
HOT = 20_000
#: Segments of a batch of step 3.
BATCH = 30_000
TABLE = np.random.default_rng(20).integers(1 << 20, (1 << 63) - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on, by doubling."""
    x = TABLE[data]
    with np.errstate(over="ignore"):
        step = 1
        while step < GRAM:
            x = x[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + x[step:]
            x ^= x >> np.uint64(31)
            step *= 2
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Places whose 32 bytes are the least of some window within a text; ties are all taken."""
    width = length - GRAM + 1
    if len(data) < length:
        return np.zeros(0, np.int64)
    x = grams(data)
    inside = np.zeros(len(data) + 1, bool)  # windows that lie in one text, by their start
    delta = np.zeros(len(data) + 2, np.int64)
    size = np.diff(offsets)
    long = size >= length
    np.add.at(delta, offsets[:-1][long], 1)
    np.add.at(delta, offsets[1:][long] - length + 1, -1)
    inside = np.cumsum(delta)[: len(data) - length + 1] > 0
    least = np.where(inside, sliding(x, width, np.minimum), np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(sliding(padded, width, np.maximum) == x)


def _anchored(length: int):
    reach = length - GRAM

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                at = anchors(data, offsets, length)
                row = np.searchsorted(offsets, at, "right") - 1
                begin = np.maximum(at - reach, offsets[row])
                end = np.minimum(at + length, offsets[row + 1])
                view = memoryview(np.ascontiguousarray(data))
                digest, whole = xxhash.xxh3_64_intdigest, (1 << 64) - 1
                content = np.fromiter((digest(view[a:b], p - a) & whole for a, b, p in zip(begin.tolist(), end.tolist(), at.tolist(), strict=True)), np.uint64, len(at))
                anchor = np.fromiter((digest(view[p : p + GRAM]) for p in at.tolist()), np.uint64, len(at))
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array((at - offsets[row]).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    ["doc", "mark", "place", "anchor", "content"],
                )

    return run


def _grouped(batches):
    """Sorted by (anchor, content): rows whose segment repeats as a whole (`whole`), and the first row of each content where an anchor has several (`first`). Holds two rows beside the batch."""
    rest = None  # the last row, which waits for the next
    held = None  # the last first row, which waits for another of its anchor: (row, repeats, emitted neighbours before)
    schema = None

    def emit(table: pa.Table, final: bool):
        nonlocal rest, held
        anchor, content = table.column("anchor").to_numpy(), table.column("content").to_numpy()
        n = len(anchor) - (0 if final else 1)
        if n <= 0:
            rest = table
            return None
        with_prev = np.zeros(len(anchor), bool)
        with_prev[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
        start = 0 if emit.fresh else 1  # row 0 was given out before and only precedes
        with_next = np.append(with_prev[1:], False)
        rows = np.arange(start, n)
        whole = rows[with_prev[rows] | with_next[rows]]
        firsts = rows[~with_prev[rows]]
        out = []
        if len(whole):
            out.append(table.take(pa.array(whole)).append_column("kind", pa.array(np.zeros(len(whole), np.int8))))
        if len(firsts):
            own = table.take(pa.array(firsts)).append_column("kind", pa.array(np.where(with_next[firsts], 2, 1).astype(np.int8)))
            if held is not None:
                own = pa.concat_tables([held[0], own])
            a = own.column("anchor").to_numpy()
            before = np.zeros(len(a), bool)
            before[1:] = a[1:] == a[:-1]
            if held is not None:
                before[0] = held[1]
            after = np.append(a[:-1] == a[1:], False)
            ready = len(a) - (0 if final else 1)
            use = np.flatnonzero((before | after)[:ready])
            if len(use):
                out.append(own.take(pa.array(use)))
            held = None if final else (own.slice(len(a) - 1), bool(before[-1]))
        elif final and held is not None and held[1]:
            out.append(held[0])
        if not final:
            rest = table.slice(n - 1)
            emit.fresh = False
        return pa.concat_tables(out) if out else None

    emit.fresh = True
    for batch in batches:
        table = pa.Table.from_batches([batch])
        schema = schema or table.schema
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if len(table) < (2 if emit.fresh else 3):
            rest = table
            continue
        out = emit(table, False)
        if out is not None:
            yield from out.combine_chunks().to_batches()
    if rest is not None:
        out = emit(rest, True)
        if out is not None:
            yield from out.combine_chunks().to_batches()


def repeated_ranges(columns, n_columns: int, group: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start, by column, of each segment's repeated windows (-1: none).

    columns: called with a column's number, from the last to the first, gives its symbols. group: ascending;
    begin, end: the columns that a segment fills.
    """
    n = len(group)
    order = np.arange(n)
    prefix = np.zeros(n + 1, np.int32)  # of each with the one before it; the last is a stop
    first, last = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    base = group.astype(np.int64) * 257
    for c in range(n_columns - 1, -1, -1):
        symbol = columns(c)[order].astype(np.int64)
        out = (c < begin[order]) | (c >= end[order])
        key = base + np.where(out, 256, symbol)
        if (key[1:] >= key[:-1]).all():  # nothing moves
            same = np.zeros(n, bool)
            same[1:] = (key[1:] == key[:-1]) & ~out[1:]
            prefix[:n] = np.where(same, prefix[:n] + 1, 0)
        else:
            perm = np.argsort(key, kind="stable")
            key, out = key[perm], out[perm]
            same = np.zeros(n, bool)
            same[1:] = (key[1:] == key[:-1]) & ~out[1:]
            new = np.zeros(n + 1, np.int32)
            at = np.flatnonzero(same)
            if len(at):
                p, q = perm[at - 1], perm[at]
                value = prefix[q]
                apart = np.flatnonzero(q > p + 1)
                if len(apart):
                    cutting = np.empty(2 * len(apart), np.int64)
                    cutting[0::2], cutting[1::2] = p[apart] + 1, q[apart] + 1
                    value[apart] = np.minimum.reduceat(prefix, cutting)[0::2]
                new[at] = value + 1
            order, prefix = order[perm], new
        if c <= n_columns - length:
            hit = prefix[:n] >= length
            hit[:-1] |= prefix[1:n] >= length
            rows = order[hit]
            if len(rows):
                first[rows] = c
                last[rows] = np.where(last[rows] < 0, c, last[rows])
    return first, last


def _sorted_columns(length: int):
    reach = length - GRAM
    width = reach + length

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        key, seg = rows.column("key").to_numpy(), rows.column("seg").to_pylist()
        left = rows.column("left").to_numpy()
        n = len(key)
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        begin = reach - left
        end = begin + np.fromiter(map(len, seg), np.int64, n)
        with tempfile.TemporaryFile() as file:
            step = 4096
            spans = []
            for a in range(0, n, step):  # blocks of segments, each column by column
                block = np.zeros((min(step, n - a), width), np.uint8)
                for i in range(len(block)):
                    block[i, begin[a + i] : end[a + i]] = np.frombuffer(seg[a + i], np.uint8)
                spans.append((a, len(block), file.tell()))
                file.write(np.ascontiguousarray(block.T).data)
            seg = None
            file.flush()

            def columns(c: int) -> np.ndarray:
                out = np.empty(n, np.uint8)
                for a, size, at in spans:
                    file.seek(at + c * size)
                    out[a : a + size] = np.frombuffer(file.read(size), np.uint8)
                return out

            first, last = repeated_ranges(columns, width, group, begin, end, length)
        # The windows of a segment overlap, so the first and the last repeated one bound their union.
        use = np.flatnonzero((rows.column("kind").to_numpy() == 1) & (last >= 0))
        if not len(use):
            return None
        place = rows.column("place").to_numpy()[use].astype(np.int64) - reach
        take = pa.array(use)
        return pa.RecordBatch.from_arrays(
            [rows.column("doc").combine_chunks().take(take), rows.column("mark").combine_chunks().take(take), pa.array(place + first[use], pa.int64()), pa.array(place + last[use] + length, pa.int64())], ["doc", "mark", "begin", "end"]
        )

    def run(batches):
        wait: list[pa.Table] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            wait.append(pa.Table.from_batches([batch]))
            held += batch.num_rows
            if held >= BATCH:
                table = pa.concat_tables(wait)
                key = table.column("key").to_numpy()
                stop = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
                if stop:
                    if (out := solve(table.slice(0, stop))) is not None:
                        yield out
                    table = table.slice(stop)
                wait, held = [table], len(table)
        if held and (out := solve(pa.concat_tables(wait))) is not None:
            yield out

    return run


def repeated_spans(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """(doc, mark, begin, end): byte spans, several a document, overlapping. docs: (doc, mark, text); mark: a hash of the text."""
    spark = docs.sparkSession
    doc = docs.schema["doc"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reach = length - GRAM
    found = docs.where(F.octet_length("text") >= length).select("doc", "mark", "text").mapInArrow(lean(_anchored(length)), f"doc {doc}, mark long, place int, anchor long, content long")
    rows = found.repartition(parts, "anchor").sortWithinPartitions("anchor", "content").mapInArrow(lean(_grouped), f"doc {doc}, mark long, place int, anchor long, content long, kind tinyint")
    rows = cut(rows)
    whole = rows.where("kind = 0").select("doc", "mark", F.greatest(F.col("place") - reach, F.lit(0)).cast("long").alias("begin"), (F.col("place") + length).cast("long").alias("end"))
    different = rows.where("kind > 0").groupBy("doc", "mark").agg(F.collect_list(F.struct("place", "anchor", "kind")).alias("at"))
    texts = docs.select(F.col("doc").alias("d_"), F.col("mark").alias("m_"), "text").join(different, F.expr("d_ <=> doc and m_ = mark"))
    bytes_ = F.encode("text", "utf-8")

    seg = texts.select("doc", "mark", "at", bytes_.alias("raw")).select("doc", "mark", F.explode("at").alias("a"), "raw").select(
        "doc", "mark", F.col("a.place").alias("place"), F.col("a.kind").alias("kind"), F.col("a.anchor").alias("key"),
        F.least(F.col("a.place"), F.lit(reach)).alias("left"),
        F.expr(f"substring(raw, greatest(a.place - {reach}, 0) + 1, least(a.place, {reach}) + {length})").alias("seg"),
        F.lit(0).alias("lo"), F.lit(reach).alias("hi"),
    )
    seg = cut(seg)
    names = ["key", "seg", "left", "kind", "doc", "mark", "place"]

    def sort_columns(part: DataFrame) -> DataFrame:
        return part.select(*names).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lean(_sorted_columns(length)), f"doc {doc}, mark long, begin long, end long")

    spans = whole
    for width in (13, 1):
        many = cut(seg.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))
        if many.isEmpty():
            break
        spans = spans.unionByName(sort_columns(seg.join(many, "key", "left_anti")))
        seg = seg.join(many, "key", "left_semi")
        starts = F.sequence(F.col("lo"), F.col("hi"), F.lit(width))
        seg = seg.withColumn("lo", F.explode(starts)).withColumn("hi", F.least(F.col("hi"), F.col("lo") + width - 1))
        # The bytes that all windows of the range share, in columns hi .. lo + length; the segment begins in column reach - left.
        core = F.expr(f"substring(seg, hi - ({reach} - left) + 1, lo + {length} - hi)")
        seg = seg.where(f"hi >= {reach} - left and lo + {length} <= {reach} - left + octet_length(seg)")
        seg = cut(seg.withColumn("key", F.xxhash64("key", "lo", core)))
    else:  # single windows: the key is the window
        twice = cut(seg.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
        alone = seg.join(twice, "key", "left_semi").where("kind = 1").select("doc", "mark", (F.col("place") - reach + F.col("lo")).cast("long").alias("begin"), (F.col("place") - reach + F.col("lo") + length).cast("long").alias("end"))
        return spans.unionByName(alone)
    return spans.unionByName(sort_columns(seg))


def merged(begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans, cut to the text."""
    order = np.argsort(begin)
    begin, end = np.maximum(begin[order], 0), np.minimum(np.maximum.accumulate(end[order]), size)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:] - 1, len(begin) - 1)] if len(begin) else end


def _cut_out(keep: list[str], texts: bool):
    def run(batches):
        for batch in batches:
            spans = batch.column(len(keep) + 1)
            raw = batch.column(len(keep)).cast(pa.binary())
            sizes, removed, number, digests, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                text = raw[i].as_py() or b""
                rest = text
                a = b = ()
                if spans[i].is_valid:
                    both = spans[i].values
                    a, b = merged(both.field(0).to_numpy(), both.field(1).to_numpy(), len(text))
                    rest = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                number.append(len(a))
                digests.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    kept.append(rest.decode("utf-8", "ignore") if raw[i].is_valid else None)
            new = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(len(keep))), *new, *([pa.array(kept, pa.string())] if texts else [])], [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    return run


def without_repeats(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", texts: bool = False, hot: int = HOT, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the key), n_bytes, n_removed, n_spans, kept_sha256 and, with texts=True, `kept`: the text that is left."""
    keep = keep or [key]
    mark = F.xxhash64(text)
    spans = repeated_spans(docs.select(F.col(key).alias("doc"), mark.alias("mark"), F.col(text).alias("text")), length, hot)
    spans = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("begin", "end")).alias("s__spans")).withColumnsRenamed({"doc": "s__doc", "mark": "s__mark"})
    rows = docs.select(*keep, F.col(key).alias("s__key"), F.col(text).alias("s__text")).withColumn("s__hash", F.xxhash64("s__text"))
    rows = rows.join(spans, F.expr("s__key <=> s__doc and s__hash = s__mark"), "left")
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, "s__text", "s__spans").mapInArrow(lean(_cut_out(keep, texts)), f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if texts else ""))


def cleaned(docs: DataFrame, length: int = 200, text: str = "text", key: str = "doc_id", size: str | None = "n_chars") -> DataFrame:
    """docs without their repeated strings: the text and, if there is such a column, its number of characters are those of what is left; texts of which nothing but white space is left go."""
    cols = docs.columns
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(cols)))
    at = cols.index(text)
    out = without_repeats(plain, length, f"c{cols.index(key)}", f"c{at}", texts=True, keep=list(plain.columns))
    out = out.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {text: F.col("kept")} | ({size: F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(f"c{cols.index(size)}")).cast(docs.schema[size].dataType)} if size in cols else {})
    return out.select(*((new.get(c, F.col(f"c{i}"))).alias(c) for i, c in enumerate(cols)))


def op2_substrings(docs: DataFrame) -> DataFrame:
    return without_repeats(docs)
