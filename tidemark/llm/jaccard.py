"""Set-similarity join of texts on word shingles: universe-partition pigeonhole with exact checks.

The universe of shingles is dealt by hash into m segments; m depends on the size band of the larger set.
Sets of similarity t differ in at most H = (1-t)/(1+t) (r+s) elements, so for thresholds T_i with
sum (T_i + 1) > H some segment differs in at most T_i elements (T_i = -1: segment left out). Two ways to
spend this are priced for each band and the cheaper one is used:

  exact      T_i = 0: H + 1 + slack segments, each indexed by its subset; the `slack` costliest segments of
             a set (the smallest ones, ties by signature) are left out. The order of cost depends on the
             segment alone, so the cheapest of the slack + 1 segments that a similar pair shares is left
             out on neither side.
  deletion   T_i = 1: half as many segments, each indexed by its subset and its one-deletion neighbourhood.

A set is indexed in its own band and, where it can be the smaller one of a pair, in the next. Sets that
share a signature are candidates; equal sets are one to begin with. First each set is checked against one
centre of its signatures (a star, not all pairs), which joins most of what is similar. Then, for signatures
whose sets still lie in several components, blocks of sets are compared across components: parity bitmaps
bound the difference of two sets from below, and the sets that this leaves with a possible partner are
checked in the task on shingles made anew from the whole texts. Only links that join components leave it,
never the pairs. So every component is that of all links, although pairs inside a component need not all
be checked.

Cases: null or empty texts, and texts of white space, have no shingle and link with nothing; texts with
fewer words than a shingle have one, their whole sequence; rows repeated are one class; null doc_ids take
part, but never name a component; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, drop, forest, lean, map_text, text_slices, tidy, written
from tidemark.llm.lexing import hashes

LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Segments of at most so many shingles can be left out as costly.
SMALL = 4
#: Texts that one task of the check holds besides the one they are compared with.
GROUP = 64
#: Sets, and shingles of them, of one signature that are a block of the check across components.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: More than there are size bands; a power of two.
BANDS = 128
#: Set ids that a task remembers to write signatures once, and names that may need a second hash.
SEEN, RENAMED = 200_000, 100_000
K1, K2, K3, K4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one after another."""
    inside = ~WHITE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    begin, stop = inside.copy(), inside.copy()
    if len(b):
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        stop[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, by row and upper hash, and their number in each row."""
    n = len(offsets) - 1
    b = LOWER[data]
    at, ends = word_spans(b, offsets)
    row = np.searchsorted(offsets, at, "right") - 1
    with np.errstate(over="ignore"):
        h = hashes(b, at, ends)
        factor = K2 ** np.arange(1, words + 1, dtype=np.uint64)
        count = np.bincount(row, minlength=n)
        whole = np.flatnonzero(row[: len(row) - words + 1] == row[words - 1 :]) if len(row) >= words else np.zeros(0, np.int64)
        value = np.zeros(len(whole), np.uint64)
        for j in range(words):
            value += h[whole + j] * factor[j]
        first = np.cumsum(count) - count
        few = np.flatnonzero((count > 0) & (count < words))
        short = np.zeros(len(few), np.uint64)
        for j in range(words - 1):
            live = count[few] > j
            short[live] += h[first[few[live]] + j] * factor[j]
        short += count[few].astype(np.uint64) * K4
        value = mix(np.concatenate([value, short]))
    row = np.concatenate([row[whole], few])
    order = np.argsort(row.astype(np.uint64) << np.uint64(48) | value >> np.uint64(16))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return row, value, np.bincount(row, minlength=n)


def banded(sig: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Signatures whose lowest bits say their size band."""
    return sig & ~np.uint64(BANDS - 1) | band.astype(np.uint64)


class Allocation:
    """Size bands and, for each, the number of segments and how thresholds are spent. percent: the least similarity; words: of a shingle."""

    def __init__(self, percent: int, words: int = 3, largest: int = 1 << 31):
        self.percent, self.shared = percent, 0.5 ** (words / 3)
        lo, rows = 1, []
        while lo < largest:
            hi = max(lo, lo * 10000 // (percent * percent))
            most = 2 * hi * (100 - percent) // (100 + percent)  # symmetric difference
            slack = 1 + (most + 1) // 10
            exact, deletion = most + 1 + slack, (most + 2) // 2
            rows.append((lo, hi, most, *((deletion, 0, True) if self.price(hi, deletion, True) < self.price(hi, exact, False) else (exact, slack, False))))
            lo = hi + 1
        self.lo, self.hi, self.most, self.segments, self.slack, self.deletes = (np.array(c) for c in zip(*rows, strict=True))

    def price(self, size: int, segments: int, deletes: bool) -> float:
        """Signatures to store, and candidates to check if of 300 related sets in a band each pair shares a shingle by a chance that falls with its words (one half for three)."""
        each = size / segments
        return size + segments + 300 * size * self.shared ** max(each - 1, 0) if deletes else segments + 300 * segments * self.shared**each

    def bands(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, n, "right") - 1

    def signatures(self, row: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, signature) of sets given by ascending rows and their sizes n."""
        out_row, out_sig = [], []
        with np.errstate(over="ignore"):
            g = mix(h + K3)
            place = mix(h + K4) >> np.uint64(32)
            for step in (0, 1):
                band = self.bands(n) + step
                use = (n > 0) & (self.most[band] > 0)
                if step:
                    use &= n * 100 >= self.percent * self.lo[band]
                sets = np.flatnonzero(use)
                if not len(sets):
                    continue
                number = np.cumsum(use) - 1
                mine = use[row]
                r = number[row[mine]]
                m = self.segments[band[sets]]
                base = np.cumsum(m) - m
                at = base[r] + (place[mine] * m[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                total = int(m.sum())
                low = np.bincount(at, weights=(g[mine] & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total).astype(np.uint64)
                high = np.bincount(at, weights=(g[mine] >> np.uint64(32)).astype(np.float64), minlength=total).astype(np.uint64)
                count = np.bincount(at, minlength=total)
                owner = np.repeat(np.arange(len(sets)), m)
                tag = mix(band[sets][owner].astype(np.uint64) * K2 + (np.arange(total) - base[owner]).astype(np.uint64) * K4)
                value = low + (high << np.uint64(32)) + tag
                sig = mix(value + count.astype(np.uint64) * K1)
                small = np.flatnonzero((count <= SMALL) & ~self.deletes[band[sets]][owner])
                small = small[np.lexsort((sig[small], count[small], owner[small]))]
                begin = np.searchsorted(owner[small], owner[small], "left")
                keep = np.ones(total, bool)
                keep[small[np.arange(len(small)) - begin < self.slack[band[sets]][owner[small]]]] = False
                out_row.append(sets[owner[keep]])
                out_sig.append(banded(sig, band[sets][owner])[keep])
                gone = self.deletes[band[sets]][r]
                if gone.any():
                    a = at[gone]
                    out_row.append(sets[r[gone]])
                    out_sig.append(banded(mix(value[a] - g[mine][gone] + (count[a] - 1).astype(np.uint64) * K1), band[sets][r[gone]]))
        if not out_row:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(out_row), np.concatenate(out_sig)


def set_ids(row: np.ndarray, h: np.ndarray, n: np.ndarray, bits: int = 64, renamed: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
    """The id of each whole set, a hash, and a second, independent one. renamed: ids that different sets had, by round; those sets take ids of the second hash."""
    with np.errstate(over="ignore"):
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])

        def whole(x: np.ndarray, factor: np.uint64) -> np.ndarray:
            sums = np.add.reduceat(np.append(x, np.uint64(0)), np.minimum(begin, len(x))) if len(n) else np.zeros(0, np.uint64)
            return mix(sums + n.astype(np.uint64) * factor)

        ids, second = whole(mix(h + K1), K2) >> np.uint64(64 - bits), whole(mix(mix(h + K4) + K2), K3)
        for i, odd in enumerate(renamed):
            ids = np.where(np.isin(ids.astype(np.int64), odd), mix(second + np.uint64(i + 1) * K1), ids)
        return np.where(n > 0, ids, 0).astype(np.int64), second.astype(np.int64)


def parities(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A bitmap of each set: the parity of the elements at each of twice as many places as elements, a power of two from 512 to 32768.

    Each element in which two sets differ flips one place, so bitmaps never differ in more places than the
    sets in elements. Larger bitmaps fold to smaller ones.
    """
    out, end = [], np.cumsum(n)
    place = mix(h + K2)
    for hi, size in zip(end.tolist(), n.tolist(), strict=True):
        bits = min(32768, max(512, 1 << (2 * size - 1).bit_length())) if size else 512
        odd = np.bincount((place[hi - size : hi] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the size of the least."""
    least = min(map(len, bitmaps)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, least), axis=0) for b in bitmaps])


def _identify(words: int, **naming):
    def work(data, offsets):
        row, h, n = shingles(data, offsets, words)
        ids, second = set_ids(row, h, n, **naming)
        with np.errstate(over="ignore"):
            bitmaps = parities(h, n)
        return {"n_shingles": n.astype(np.int64), "set_id": ids, "second": second, "bitmap": pa.array(bitmaps, pa.binary())}

    return lambda: work


def _indexed(words: int, percent: int, text: str, **naming):
    def run(batches):
        allocation = Allocation(percent, words)
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text))):
                row, h, n = shingles(data, offsets, words)
                ids, _ = set_ids(row, h, n, **naming)
                # Copies of a set would only repeat its rows.
                new = np.zeros(len(n), bool)
                new[np.unique(ids, return_index=True)[1]] = True
                new &= np.fromiter((i not in seen for i in ids.tolist()), bool, len(ids))
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(ids.tolist())
                use = new[row]
                number = np.cumsum(new) - 1
                of, sig = allocation.signatures(number[row[use]], h[use], n[new])
                yield pa.RecordBatch.from_arrays([pa.array(sig.astype(np.int64)), pa.array(ids[new][of])], ["sig", "set_id"])

    return run


def _shared(batches):
    """Sorted (sig, set_id) in; out the same rows, each once, of signatures with several sets. Holds one batch and one row."""
    last = None  # the row before, and whether it was given out
    for batch in batches:
        sig, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        if last is not None:
            sig, ids = np.append(last[0], sig), np.append(last[1], ids)
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        given = bool(last and last[2])
        at = np.flatnonzero(new)  # different rows; the first is the one before
        with_before = np.zeros(len(at), bool)
        with_before[1:] = sig[at[1:]] == sig[at[:-1]]
        use = with_before.copy()
        use[:-1] |= with_before[1:]
        out = use.copy()
        if last is not None and given:
            out[0] = False
        last = sig[-1], ids[-1], bool(use[-1]) or (len(at) == 1 and given)
        yield pa.RecordBatch.from_arrays([pa.array(sig[at[out]]), pa.array(ids[at[out]])], ["sig", "set_id"])


def _checked(words: int, percent: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """The row with b = a is compared with all others."""
        a, b = key[0].as_py(), rows.column("b").to_numpy()
        home = np.flatnonzero(b == a)[0]
        rows = rows.take(pa.array(np.concatenate([[home], np.flatnonzero(b != a)])))
        b, linked, mine = rows.column("b").to_numpy(), [], None
        for lo, hi, data, offsets in text_slices(rows.column("text")):
            row, h, n = shingles(data, offsets, words)
            stop = np.cumsum(n)
            for i in range(hi - lo):
                own = h[stop[i] - n[i] : stop[i]]
                if mine is None:
                    mine = own
                    continue
                common = len(np.intersect1d(mine, own, assume_unique=True))
                if 100 * common >= percent * (len(mine) + len(own) - common):
                    linked.append(b[lo + i])
        return pa.table({"a": pa.array([a] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return run


def _candidates(bits: np.ndarray, size: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """(left, right, gap) arrays of the pairs of rows with different labels whose bitmaps don't differ in more places than similar sets can."""
    step = max(1, 4_000_000 // max(1, bits.shape[1] * len(right)))
    for i in range(0, len(left), step):
        mine = left[i : i + step]
        gap = np.bitwise_count(bits[mine][:, None, :] ^ bits[right][None, :, :]).sum(axis=2, dtype=np.int64)
        small, large = np.minimum(size[mine][:, None], size[right]), np.maximum(size[mine][:, None], size[right])
        a, b = np.nonzero((gap * (100 + percent) <= (small + large) * (100 - percent)) & (100 * small >= percent * large) & (label[mine][:, None] != label[right]))
        yield mine[a], right[b], gap[a, b]


def _sides(bi: int, bj: int, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(part == bi), np.flatnonzero(part == bj)


def _concerned(percent: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """The rows of two blocks under one signature that may be similar to one of another component; each leaves once."""
        left, right = _sides(key[1].as_py(), key[2].as_py(), rows.column("part").to_numpy())
        label, size = rows.column("label").to_numpy(), rows.column("n_shingles").to_numpy()
        use = np.zeros(len(rows), bool)
        for a, b, _ in _candidates(folded(rows.column("bitmap").to_pylist()), size, label, left, right, percent):
            use[a] = use[b] = True
        return rows.select(["sig", "bi", "bj", "part", "label", "set_id"]).filter(pa.array(use))

    return run


def _joined(words: int, percent: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Links between components among the rows of two blocks, those that a spanning forest needs. Likelier pairs are checked first; a pair that links joined meanwhile needs no check."""
        left, right = _sides(key[1].as_py(), key[2].as_py(), rows.column("part").to_numpy())
        own, bitmaps = [], []
        for lo, hi, data, offsets in text_slices(rows.column("text")):
            _, h, n = shingles(data, offsets, words)
            with np.errstate(over="ignore"):
                bitmaps += parities(h, n)
            own += np.split(h, np.cumsum(n)[:-1])
        size = np.fromiter(map(len, own), np.int64, len(own))
        _, label = np.unique(rows.column("label").to_numpy(), return_inverse=True)
        found = [np.stack(x) for x in _candidates(folded(bitmaps), size, label, left, right, percent)]
        a, b, gap = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
        order = np.lexsort((b, a, gap))
        a, b = a[order], b[order]
        linked: list[tuple[int, int]] = []
        low, most = np.arange(label.max() + 1), 16
        while len(a):
            fresh: list[tuple[int, int]] = []
            for i, j in zip(a[:most].tolist(), b[:most].tolist(), strict=True):
                common = len(np.intersect1d(own[i], own[j], assume_unique=True))
                if 100 * common >= percent * (size[i] + size[j] - common):
                    fresh.append((i, j))
            a, b, most = a[most:], b[most:], most * 2
            if fresh:
                linked += fresh
                ends = label[np.array(linked)]
                low = forest(ends[:, 0], ends[:, 1], len(low))
                apart = low[label[a]] != low[label[b]]
                a, b = a[apart], b[apart]
        ids = rows.column("set_id").to_numpy()[np.array(linked, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(ids.min(1), pa.int64()), "b": pa.array(ids.max(1), pa.int64())})

    return run


def _across(members: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components among the sets of each signature. members: (sig, set_id, label).

    Sets of the component that has most under a signature are compared with the others only, not with one
    another. Signatures are cut into blocks by number of sets and of shingles and each pair of blocks is a
    task, first on bitmaps, then, for sets that may have a partner, on texts. Neither emits pairs.
    """
    labels = members.groupBy("sig", "label").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(7))).alias("y"))
    groups = labels.groupBy("sig").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("labels > 1")
    band = F.col("sig").bitwiseAND(F.lit(BANDS - 1)).cast("int")
    largest = F.element_at(F.array(*(F.lit(int(x)) for x in Allocation(percent, words).hi)), band + 1)

    def blocks(n: Column) -> Column:
        return F.least(n, F.greatest(F.ceil(n / BLOCK), F.ceil(n * largest / BLOCK_SHINGLES))).cast("int")

    groups = groups.select("sig", "n", "x", "y", band.alias("band"), F.col("top.label").alias("top"), blocks(F.col("top.n")).alias("inside"), blocks(F.col("n") - F.col("top.n")).alias("outside"))
    # Signatures over the same sets ask for the same checks: one of them stands for all.
    groups = groups.groupBy("n", "x", "y", "band").agg(F.min(F.struct("sig", "top", "inside", "outside")).alias("g")).select("g.*")
    at = members.join(groups, "sig").join(sets.select("set_id", "n_shingles", "bitmap"), "set_id").withColumn("ours", F.col("label") == F.col("top"))
    place = F.when(F.col("ours"), F.col("outside") + F.pmod(F.xxhash64("set_id", "sig"), F.col("inside"))).otherwise(F.pmod(F.xxhash64("set_id", "sig"), F.col("outside")))
    at = at.withColumn("part", place.cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("ours"), F.col("outside")).otherwise(F.col("outside") + F.col("inside")) - 1)
    pairs = F.transform(others, lambda o: F.struct(F.least("part", o).alias("bi"), F.greatest("part", o).alias("bj")))
    at = at.withColumn("pair", F.explode(pairs)).select("sig", "pair.bi", "pair.bj", "part", "label", "set_id", "n_shingles", "bitmap")
    some = cut(at.groupBy("sig", "bi", "bj").applyInArrow(_concerned(percent), "sig long, bi int, bj int, part int, label long, set_id long"))
    texts = _texts(some.select("set_id").distinct(), sets, docs)
    return cut(some.join(texts, "set_id").groupBy("sig", "bi", "bj").applyInArrow(_joined(words, percent), "a long, b long").distinct())


def _texts(wanted: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_id, text) of the sets wanted, each once: rows repeated are joined before they move."""
    needed = wanted.join(sets, "set_id").select("set_id", F.col("rep.doc_id").alias("d_"), F.col("rep.row_id").alias("r_"))
    return docs.join(needed, F.expr("row_id = r_ and doc_id <=> d_")).groupBy("set_id").agg(F.first("text").alias("text"))


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set_ids that link. sets: (set_id, rep: (doc_id, row_id), n_shingles, bitmap), docs: (doc_id, row_id, text)."""
    sizes = sets.select("set_id", "n_shingles")
    sized = pairs
    for c in ("a", "b"):
        sized = sized.join(sizes.select(F.col("set_id").alias(c), F.col("n_shingles").alias(f"n{c}")), c)
    sized = cut(sized.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b"))
    parts = sized.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    salted = sized.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    homes = parts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = salted.union(homes)
    texts = _texts(wanted.select(F.col("b").alias("set_id")).distinct(), sets, docs).withColumnRenamed("set_id", "b")
    return cut(wanted.join(texts, "b").groupBy("a", "part").applyInArrow(_checked(words, percent), "a long, b long"))


def classes(docs: DataFrame, words: int, percent: int, text: str = "text", key: str = "doc_id", id_bits: int = 64) -> DataFrame:
    """(doc_id, row_id, n_shingles, set_id, root, component) of every row; root: a set_id that names the class; component: the least doc_id reachable by links.

    A set's text is looked up by one of its rows: by its doc_id and, as doc_ids may repeat or be null, the
    text's own hash. id_bits: length of a set's first id; sets that share one take other ids, so 128 bits
    tell sets apart (tests use few).
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    texts = rows.withColumn("row_id", F.xxhash64("text"))
    renamed: list[np.ndarray] = []
    while True:
        naming = {"bits": id_bits, "renamed": renamed}
        known = cut(map_text(texts, ["doc_id", "row_id"], "text", _identify(words, **naming), "n_shingles long, set_id long, second long, bitmap binary"))
        sets = cut(known.where("n_shingles > 0").groupBy("set_id", "second", "n_shingles").agg(F.min(F.struct("doc_id", "row_id")).alias("rep"), F.first("bitmap").alias("bitmap"), F.min("doc_id").alias("least")))
        odd = sets.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1").select("set_id").limit(RENAMED + 1).toArrow()
        if not len(odd):
            break
        if len(odd) > RENAMED or len(renamed) > 8:
            raise RuntimeError("too many sets share an id")
        renamed = [*renamed, odd.column(0).to_numpy()]
    signed = rows.select("text").mapInArrow(lean(_indexed(words, percent, "text", **naming)), "sig long, set_id long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members, path = written(signed.repartition(parts, "sig").sortWithinPartitions("sig", "set_id").mapInArrow(lean(_shared), "sig long, set_id long"))
    del signed
    tidy(docs.sparkSession)  # the signatures are the largest exchange here
    # The centre of a signature is its set with most signatures that others have too; a set is checked against the centre it meets most often.
    degrees = members.groupBy("set_id").agg(F.count("*").alias("degree"))
    centres = members.join(degrees, "set_id").groupBy("sig").agg(F.max(F.struct("degree", "set_id")).alias("c")).select("sig", F.col("c.set_id").alias("a"))
    pairs = members.join(centres, "sig").where("a <> set_id").groupBy(F.col("set_id").alias("b"), "a").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    linked = _links(pairs, sets, texts, words, percent)
    roots = components(linked)
    tidy(docs.sparkSession)
    # Signatures whose sets are not all together: links across components.
    labelled = members.join(roots, F.col("set_id") == F.col("node"), "left").select("sig", "set_id", F.coalesce("component", "set_id").alias("label"))
    more = _across(labelled, sets, texts, words, percent)
    drop(docs.sparkSession, path)
    if not more.isEmpty():
        roots = components(linked.unionByName(more))
    tidy(docs.sparkSession)
    named = sets.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("component", "set_id").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(names, "root").select("set_id", "root", "component")
    grouped = known.join(named.withColumnRenamed("set_id", "s_"), F.expr("n_shingles > 0 and set_id = s_"), "left")
    return grouped.select("doc_id", "row_id", "n_shingles", "set_id", "root", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: of each class the one with the least doc_id (null ids last), and all rows without a shingle. Columns as in docs."""
    found = classes(docs, words, percent, text, key).where("n_shingles > 0")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("r_"))
    kept = kept.select(F.col("r_.doc_id").alias("keep__id"), F.col("r_.row_id").alias("keep__row"))
    rows = docs.withColumns({"own__id": F.col(key), "own__row": F.xxhash64(text)})
    wordless = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    staying = rows.where(~wordless).join(kept, F.expr("own__id <=> keep__id and own__row = keep__row"))
    once = staying.dropDuplicates(["own__id", "own__row"])
    return once.select(*docs.columns).unionByName(rows.where(wordless).select(*docs.columns))


def op3_jaccard(docs: DataFrame) -> DataFrame:
    return classes(docs, words=3, percent=90).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
