"""A previous state for the documents table that reaches every operation, and the same in SQL.

doc_id % 10 decides how the tracked state differs from the declared one: 0 not tracked, 1 content, 2 label,
3 weight unknown, 4 annotations, 5 old processing, 6 perhaps missing, 7 old identity, 8 two possible labels,
9 nothing. Every 20th document also leaves a key behind that is no longer declared.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fingerprints as fp
from tidemark.functions.identity import NAMESPACE, document_id
from tidemark.operators import reconcile as rc

IDENTITY = ("rt-primary", "user-a", "tenant-a", "docs")
PROFILE, OLD_PROFILE = "profile-v2", "profile-v1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return d.select(
        "doc_id",
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("external_key"),
        F.col("text").alias("content"),
        F.lit(None).cast("binary").alias("content_bytes"),
        F.col("lang").alias("label"),
        F.lit(None).cast("string").alias("external_metadata"),
        F.array("source", "lang").alias("node_set"),
        F.col("quality").cast("double").alias("importance_weight"),
    )


def desired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.declared(docs(spark, sf_dir), *IDENTITY, PROFILE)


def _id(key: Column, version: int = 2) -> Column:
    return document_id(*IDENTITY, key, version)


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("m", F.col("doc_id") % 10)
    m, key = F.col("m"), F.col("external_key")
    own = rc.record(_id(key), PROFILE)
    old = own.withField("metadata_fp", fp.optional_fp(F.lit("zz")))
    possible = (
        F.when(m == 1, F.array(own.withField("content_fp", fp.content_fp(F.concat("content", F.lit("#old"))))))
        .when(m == 2, F.array(old))
        .when(m == 3, F.array(own.withField("weight_fp", F.lit(""))))
        .when(m == 4, F.array(own.withField("annotations_fp", fp.annotations_fp(F.lit(None).cast("string"), F.array(F.lit("old"))))))
        .when(m == 5, F.array(own.withField("processing_fp", F.lit(OLD_PROFILE))))
        .when(m == 7, F.array(own.withField("data_id", _id(key, 1))))
        .when(m == 8, F.array(old, own))
        .otherwise(F.array(own))
    )
    rows = d.where("m <> 0").select("external_key", possible.alias("possible"), F.lit(False).alias("has_delete_marker"), (m == 6).alias("may_be_missing"))
    gone_key = F.concat(F.lit("gone/"), F.col("doc_id").cast("string"))
    gone = d.where("doc_id % 20 = 0").select(gone_key.alias("external_key"), F.array(own.withField("data_id", _id(gone_key))).alias("possible"), F.lit(False).alias("has_delete_marker"), F.lit(False).alias("may_be_missing"))
    return rows.unionByName(gone)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.reconcile(desired(spark, sf_dir), tracking(spark, sf_dir), IDENTITY)


def kept(frame: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder, for plans that read a frame several times."""
    sc = frame.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return frame.checkpoint()


# The same in SQL: one row for each possible record.

def sql_netstring(*parts: str) -> str:
    return " || ".join(f"length({p})::VARCHAR || ':' || {p}" for p in parts)


def sql_uuid5(name: str) -> str:
    d = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode({name}))"
    nibble = f"substr('89ab', (('0x' || substr({d}, 17, 1))::INT & 3) + 1, 1)"
    return f"(substr({d},1,8) || '-' || substr({d},9,4) || '-5' || substr({d},14,3) || '-' || {nibble} || substr({d},18,3) || '-' || substr({d},21,12))"


def sql_id(key: str, version: int = 2) -> str:
    return sql_uuid5(sql_netstring(f"'{version}'", *(f"'{x}'" for x in IDENTITY), key))


def sql_content(x: str) -> str:
    return f"sha256('s\\x00'::BLOB || encode({x}))"


def sql_annotations(nodes: str) -> str:
    inner = f"'s' || array_to_string(list_transform(list_sort({nodes}), lambda n: length(n)::VARCHAR || ':' || n), '')"
    return f"sha256('1:n' || length({inner})::VARCHAR || ':' || {inner})"


def sql_optional(x: str) -> str:
    return f"sha256(coalesce('v' || ({x})::VARCHAR, 'n'))"


DOCS = f"""
docs AS (
  SELECT d.doc_id, d.source || '/' || d.doc_id::VARCHAR AS external_key, d.text AS content, d.lang AS label, [d.source, d.lang] AS node_set, l.quality::DOUBLE AS importance_weight, d.doc_id % 10 AS m
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
own AS (
  SELECT *, {sql_id('external_key')} AS data_id, {sql_content('content')} AS content_fp, {sql_annotations('node_set')} AS annotations_fp, {sql_optional('label')} AS metadata_fp,
         '{PROFILE}' AS processing_fp, {sql_optional('importance_weight')} AS weight_fp FROM docs)"""
_REC = "content_fp, annotations_fp, metadata_fp, processing_fp, weight_fp"
STATE = f"""{DOCS},
prev AS (
  SELECT external_key, CASE WHEN m = 7 THEN {sql_id('external_key', 1)} ELSE data_id END AS data_id,
         CASE WHEN m = 1 THEN {sql_content("(content || '#old')")} ELSE content_fp END AS content_fp,
         CASE WHEN m = 4 THEN {sql_annotations("['old']")} ELSE annotations_fp END AS annotations_fp,
         CASE WHEN m IN (2, 8) THEN {sql_optional("'zz'")} ELSE metadata_fp END AS metadata_fp,
         CASE WHEN m = 5 THEN '{OLD_PROFILE}' ELSE processing_fp END AS processing_fp,
         CASE WHEN m = 3 THEN '' ELSE weight_fp END AS weight_fp, m = 6 AS missing FROM own WHERE m <> 0
  UNION ALL SELECT external_key, data_id, {_REC}, false FROM own WHERE m = 8
  UNION ALL SELECT 'gone/' || doc_id::VARCHAR, {sql_id("('gone/' || doc_id::VARCHAR)")}, {_REC}, false FROM own WHERE doc_id % 20 = 0),
joined AS (
  SELECT coalesce(o.external_key, p.external_key) AS external_key, coalesce(o.data_id, p.data_id) AS data_id, o.external_key IS NOT NULL AS is_desired, p.external_key IS NOT NULL AS is_tracked,
         coalesce(p.missing, true) AS missing, p.data_id AS p_id, p.weight_fp <> o.weight_fp AS other_weight,
         p.data_id = o.data_id AND p.content_fp = o.content_fp AND p.annotations_fp = o.annotations_fp AND p.processing_fp = o.processing_fp AS safe,
         p.metadata_fp = o.metadata_fp AS same_label
  FROM own o FULL OUTER JOIN prev p ON o.external_key = p.external_key),
keyed AS (
  SELECT external_key, CASE WHEN bool_or(is_desired) THEN max(data_id) ELSE max(p_id) END AS data_id, bool_or(is_desired) AS is_desired, bool_or(is_tracked) AS is_tracked, bool_or(missing) AS missing,
         bool_or(coalesce(other_weight, false)) AS other_weight, bool_and(coalesce(safe, false)) AS safe, bool_and(coalesce(safe AND same_label AND NOT other_weight, false)) AS equal,
         coalesce(array_to_string(list_sort(list(DISTINCT p_id) FILTER (WHERE is_desired AND p_id <> data_id)), ','), '') AS stale_ids
  FROM joined GROUP BY external_key),
actions AS (
  SELECT external_key, data_id, missing, is_desired, is_tracked, stale_ids,
         CASE WHEN NOT is_desired THEN CASE WHEN is_tracked THEN 'delete' END WHEN NOT is_tracked THEN CASE WHEN missing THEN 'insert' END WHEN NOT equal THEN 'replace' WHEN missing THEN 'upsert' END AS diff,
         CASE WHEN NOT is_desired THEN 'delete' WHEN NOT is_tracked THEN CASE WHEN missing THEN 'upsert' END WHEN equal AND NOT missing THEN NULL WHEN other_weight THEN 'recreate'
              WHEN equal THEN 'replace' WHEN safe AND NOT missing THEN 'update_metadata' ELSE 'replace' END AS op
  FROM keyed)"""
