"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, in DataFrame functions only.

A text is cut without loss into sections (each ends with its blank lines), a section into paragraphs (each
ends with its line feed). A paragraph's digest is the SHA-256 of its text, a section's that of its
paragraphs' digests, the root's that of the length and the sections' digests: equal roots mean equal
texts, and where roots differ, the first differing section and paragraph locate an edit. The leaves under a
paragraph are pieces of a line: up to four words, of which a piece ends early at a word with one of the
characters ENDS at its end (so a word more or less changes pieces nearby only), and pieces of more than 32
characters are cut. The likeness of two trees is the Jaccard similarity of their sets of leaves; 1 for
equal roots.

The next document is found without gathering all in one task. Rows are sorted by a string, the id as 16 hex
digits and the digest of the text, in blocks of equal first 13 digits (4096 ids). A block of many rows, as
of one repeated id, is replaced by blocks of its ids' rows with equal first digits of the digest. The block
after each is found by shorter and shorter prefixes: the next one of the same prefix, or, for the last of
it, the first one of the next prefix.

Cases: null text counts as empty; equal texts have likeness 1, empty ones too, and a text without a leaf (of
white space) has likeness 0 to all others; equal doc_ids
follow one another by the digest of their text, null doc_ids come first; a single document is its own
next; rows repeated in full share a block; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Digits of a block; of a block that replaces one of more than HOT rows; of the prefixes by which blocks are put in order.
BLOCK, NARROW, PREFIXES = 13, 20, (8, 3, 0)
HOT = 20_000
#: Blocks of more than HOT rows up to which their names are broadcast.
BROADCAST_HOT = 100_000
MARK = "\x1e"
BLANK = r"(\n[ \t\r]*\n)"
PARAGRAPH = r"[^\n]*\n|[^\n]+"
ENDS = "acegikmoqsuwy02468.,;:!?"
PIECE = rf"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D{ENDS}][\x20\x09]+){{0,3}}[^\x20\x09-\x0D]+"
LEAF = r"(?s).{1,32}"


def sections(text: Column) -> Column:
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(MARK * 2)), BLANK, "$1" + MARK)
    return F.split(marked, MARK, -1)


def paragraphs(section: Column) -> Column:
    return F.regexp_extract_all(section, F.lit(PARAGRAPH), F.lit(0))


def leaves(section: Column) -> Column:
    def cut_up(piece: Column) -> Column:
        return F.when(F.length(piece) <= 32, F.array(piece)).otherwise(F.regexp_extract_all(piece, F.lit(LEAF), F.lit(0)))

    return F.flatten(F.transform(F.regexp_extract_all(section, F.lit(PIECE), F.lit(0)), cut_up))


def tree(text: Column) -> Column:
    """array<struct<digest, paragraphs: array<string>, leaves: array<string>>>: of each section its digest, those of its paragraphs, and the leaves under them."""
    grown = F.transform(sections(text), lambda s: F.struct(F.transform(paragraphs(s), lambda p: F.sha2(p, 256)).alias("paragraphs"), leaves(s).alias("leaves")))
    return F.transform(grown, lambda s: F.struct(F.sha2(F.array_join(s["paragraphs"], ""), 256).alias("digest"), s["paragraphs"].alias("paragraphs"), s["leaves"].alias("leaves")))


def root(text: Column, grown: Column | None = None) -> Column:
    """grown: the tree of the text, if it is at hand."""
    digests = F.transform(tree(text) if grown is None else grown, lambda s: s["digest"])
    return F.sha2(F.concat(F.length(text).cast("string"), F.lit(":"), F.array_join(digests, "")), 256)


def leaf_set(grown: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(grown, lambda s: s["leaves"])))


def likeness(a: Column, b: Column) -> Column:
    """Of the leaf sets of two trees whose roots differ."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(a) + F.size(b) - common
    return F.when(either > 0, common / either).otherwise(F.lit(0.0))


def first_difference(a: Column, b: Column) -> Column:
    """struct<section, paragraph>: places, from 0, of the first differing branch of two trees; null if they are equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x["digest"].eqNullSafe(y["digest"])), F.lit(False)).cast("int") - 1
    x, y = F.get(a, at)["paragraphs"], F.get(b, at)["paragraphs"]
    inside = F.array_position(F.zip_with(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>")), lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int") - 1
    return F.when(at >= 0, F.struct(at.alias("section"), F.greatest(inside, F.lit(0)).alias("paragraph")))


def _block_order(blocks: DataFrame) -> DataFrame:
    """(block, after): each block with the one after it, the first after the last. blocks: (block), all different."""
    levels = [blocks.select("block", F.col("block").alias("name"), F.col("block").alias("head"))]
    for digits in PREFIXES:  # head: the first block of a name
        below = levels[-1].withColumn("up", F.substring("name", 1, digits))
        beside = Window.partitionBy("up").orderBy("name")
        levels[-1] = below.withColumn("after", F.lead("head").over(beside))
        levels.append(below.groupBy(F.col("up").alias("name")).agg(F.min("head").alias("head")))
    above = levels[-1].select(F.col("name").alias("of"), F.col("head").alias("beyond"))
    for level in reversed(levels[:-1]):
        found = level.join(above, F.col("up") == F.col("of")).withColumn("after", F.coalesce("after", "beyond"))
        above = found.select(F.col("name").alias("of"), F.col("after").alias("beyond"))
    return above.select(F.col("of").alias("block"), F.col("beyond").alias("after"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the document after each, by ascending doc_id, and the first's after the last."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Flipping the sign bit makes negative ids sort before others; nulls sort before all digits.
    id_digits = F.lpad(F.lower(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")
    digits = F.coalesce(id_digits, F.lit("-" * 16))
    own = F.substring(digits, 1, BLOCK)
    hot = cut(docs.groupBy(own.alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hot"))
    many = hot.count()
    rows = rows.withColumn("block", own)
    if many:
        rows = rows.join(F.broadcast(hot) if many <= BROADCAST_HOT else hot, F.col("block") == F.col("hot"), "left")
        narrow = F.concat(digits, F.substring(F.sha2("text", 256), 1, NARROW - 16))
        rows = rows.withColumn("block", F.when(F.col("hot").isNull(), F.col("block")).otherwise(narrow)).drop("hot")
    order = Window.partitionBy("block").orderBy(F.asc_nulls_first("doc_id"), F.sha2("text", 256))
    placed = rows.withColumns({"next_text": F.lead("text").over(order), "before": F.lag(F.lit(1)).over(order)})
    inner = placed.where("next_text is not null").select("doc_id", "text", "next_text")
    lasts = placed.where("next_text is null").select("doc_id", "text", "block")
    heads = placed.where("before is null").select(F.col("block").alias("head"), F.col("text").alias("next_text"))
    blocks = _block_order(rows.select("block").distinct()).withColumnRenamed("block", "own")
    outer = lasts.join(blocks, F.col("block") == F.col("own")).join(heads, F.col("after") == F.col("head")).select("doc_id", "text", "next_text")
    return inner.unionByName(outer)


def op7_fingerprints(docs: DataFrame) -> DataFrame:
    rows = with_next(docs)
    n = F.length("text")
    kept = n - F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), kept), F.substring(F.col("next_text"), F.lit(1), n - kept))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumns({f"{x}_tree": tree(F.col(x)) for x in ("text", "edited", "next_text")})
    rows = rows.withColumns({f"{x}_leaves": leaf_set(F.col(f"{x}_tree")) for x in ("text", "edited", "next_text")})

    def near(other: str) -> Column:
        return F.when(F.col("text") == F.col(other), F.lit(1.0)).otherwise(likeness(F.col("text_leaves"), F.col(f"{other}_leaves")))

    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("text"), F.col("text_tree")).alias("fingerprint"),
        root(F.col("edited"), F.col("edited_tree")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"),
        near("next_text").alias("near_next"),
    )


def _sql_sections(x: str) -> str:
    return f"string_split(regexp_replace(replace({x}, chr(30), chr(30) || chr(30)), '{BLANK}', '\\1' || chr(30), 'g'), chr(30))"


def _sql_leaves(x: str) -> str:
    return f"list_distinct(flatten(flatten(list_transform({x}_sections, lambda s: list_transform(regexp_extract_all(s, '{PIECE}'), lambda p: regexp_extract_all(p, '{LEAF}'))))))"


def _sql_root(x: str) -> str:
    digests = f"list_transform({x}_sections, lambda s: sha256(array_to_string(list_transform(regexp_extract_all(s, '{PARAGRAPH}'), lambda p: sha256(p)), '')))"
    return f"sha256(length({x})::VARCHAR || ':' || array_to_string({digests}, ''))"


def _sql_like(x: str) -> str:
    common = f"len(list_intersect(text_leaves, {x}_leaves))"
    either = f"(len(text_leaves) + len({x}_leaves) - {common})"
    return f"CASE WHEN text = {x} THEN 1.0::DOUBLE WHEN {either} = 0 THEN 0.0::DOUBLE ELSE {common}::DOUBLE / {either}::DOUBLE END"


OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id ASC NULLS FIRST, sha256(text)) AS k, count(*) OVER () AS n FROM d),
x AS (SELECT a.doc_id, a.text, b.text AS next_text FROM o a JOIN o b ON b.k = a.k % a.n + 1),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 4) || substr(next_text, 1, length(text) // 4) AS edited FROM x),
t AS (SELECT *, {_sql_sections('text')} AS text_sections, {_sql_sections('edited')} AS edited_sections, {_sql_sections('next_text')} AS next_text_sections FROM e),
p AS (SELECT *, {_sql_leaves('text')} AS text_leaves, {_sql_leaves('edited')} AS edited_leaves, {_sql_leaves('next_text')} AS next_text_leaves FROM t)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_sql_root('text')} AS fingerprint, {_sql_root('edited')} AS edited_fingerprint,
       {_sql_like('edited')} AS near_edited, {_sql_like('next_text')} AS near_next
FROM p
"""
