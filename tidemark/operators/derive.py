"""Derived knowledge: extraction rules, the graph with provenance, and provenance-aware deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are stripped from both ends of an extracted word.
PUNCTUATION = ".,;:!?()[]\"'"
#: A word's first character must be an upper-case letter of any script.
CAPITAL = r"^\p{Lu}"


def words(text: Column) -> Column:
    """Non-empty words between white space of any script."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def capitalized(text: Column, most: int | None = 12) -> Column:
    """Distinct words of more than three characters that begin with a capital, stripped of punctuation, sorted; the first `most`."""
    found = F.filter(words(text), lambda w: w.rlike(CAPITAL) & (F.length(w) > 3))
    names = F.array_sort(F.array_distinct(F.transform(found, lambda w: F.btrim(w, F.lit(PUNCTUATION)))))
    return names if most is None else F.slice(names, 1, most)


def marker(text: Column, ignore: str = "Document", default: str = "BenchNode") -> Column:
    """The first capitalized word other than `ignore`, without trailing dots and commas."""
    found = F.filter(F.transform(F.filter(words(text), lambda w: w.rlike(CAPITAL)), lambda w: F.regexp_replace(w, "[.,]+$", "")), lambda w: w != ignore)
    return F.coalesce(F.get(found, 0), F.lit(default))


def summary(text: Column, most: int = 80) -> Column:
    """The first line, cut; `empty document` if there is none."""
    first = F.substring(F.get(F.split(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""), "\n", 2), 0), 1, most)
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("empty document"))


def vocabulary(text: Column, names: list[str]) -> Column:
    """Those of a fixed vocabulary that the text contains."""
    return F.filter(F.array(*(F.lit(n) for n in names)), lambda n: F.contains(text, n))


def node_key(name: Column) -> Column:
    return F.lower(name)


def chunks(text: Column, size: int) -> Column:
    """The text in pieces of `size` characters."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size)), lambda i: F.substring(text, i + 1, F.lit(size))), lambda c: c != "")


def provenance(docs: DataFrame, names: Column, data_id: str = "data_id") -> DataFrame:
    """The bridge (artifact_id, data_id): which document each artifact came from."""
    return docs.select(data_id, F.explode(names).alias("name")).select(node_key(F.col("name")).alias("artifact_id"), data_id).distinct()


def without_documents(bridge: DataFrame, gone: DataFrame) -> DataFrame:
    """The bridge after deleting documents."""
    return bridge.join(gone.select("data_id").distinct(), "data_id", "left_anti")


def survivors(artifacts: DataFrame, bridge: DataFrame) -> DataFrame:
    """Artifacts that some document still refers to."""
    return artifacts.join(bridge.select("artifact_id").distinct(), "artifact_id", "left_semi")


def reference_counts(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("artifact_id").agg(F.countDistinct("data_id").alias("n_refs"))


def edge_lookup(edges: DataFrame, nodes: DataFrame, source: Column, relationship: str) -> DataFrame:
    """Targets of a relationship by the source's name, both compared without case."""
    a = nodes.select(F.col("id").alias("source"), F.col("name").alias("source_name"))
    b = nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    return edges.where(F.lower("relationship_name") == relationship.lower()).join(a, "source").where(F.lower("source_name") == F.lower(source)).join(b, "target")


def pairs_within(rows: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """Left items with right items of the same document."""
    a = rows.where(left).select(key, F.col("item").alias("left"))
    b = rows.where(right).select(key, F.col("item").alias("right"))
    return a.join(b, key)
