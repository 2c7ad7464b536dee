"""Every operator as a query over the driver's tables, with the SQL that checks it.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import fingerprints as fp
from tidemark.functions import identity as ident
from tidemark.functions import modelargs
from tidemark.operators import derive as dv
from tidemark.operators import paths, state, stats, verify
from tidemark.operators import reconcile as rc
from tidemark.plans import fixture as fx
from tidemark.plans.fixture import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Sources and catalog


@query("s1_declare", f"WITH {fx.DOCS} SELECT external_key, label, array_to_string(node_set, '|') AS nodes, importance_weight AS weight, length(content)::BIGINT AS n FROM docs")
def s1(s, d):
    rows = fx.docs(s, d)
    return rows.select(ident.normalize_key(F.col("external_key")).alias("external_key"), "label", F.array_join("node_set", "|").alias("nodes"), F.col("importance_weight").alias("weight"), F.length("content").cast("long").alias("n"))


def datasets(s, d) -> DataFrame:
    n = table(s, d, "nation")
    return n.select(F.concat(F.lit("ds-"), F.col("n_nationkey").cast("string")).alias("dataset_id"), F.lower("n_name").alias("name"), F.concat(F.lit("user-"), (F.col("n_nationkey") % 2).cast("string")).alias("owner"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("t"), F.col("n_regionkey").cast("string"))).alias("tenant"))


DATASETS = "datasets AS (SELECT 'ds-' || n_nationkey::VARCHAR AS dataset_id, lower(n_name) AS name, 'user-' || (n_nationkey % 2)::VARCHAR AS owner, CASE WHEN n_regionkey > 0 THEN 't' || n_regionkey::VARCHAR END AS tenant FROM nation)"


@query("s7_resolve_dataset", f"WITH {DATASETS}, asked AS (SELECT name, owner, tenant FROM datasets WHERE owner = 'user-0') SELECT a.name, a.tenant, max(x.dataset_id) AS dataset_id, count(x.dataset_id) AS n FROM asked a LEFT JOIN datasets x ON x.name = a.name AND x.owner = 'user-0' AND x.tenant IS NOT DISTINCT FROM a.tenant GROUP BY a.name, a.tenant")
def s7(s, d):
    x = datasets(s, d)
    return state.resolved(x, x.where("owner = 'user-0'")).select("name", "tenant", "dataset_id", "n")


@query("f1_owned_datasets", f"WITH {DATASETS} SELECT dataset_id, name FROM datasets WHERE owner = 'user-0' AND tenant IS NOT DISTINCT FROM NULL")
def f1(s, d):
    return datasets(s, d).where((F.col("owner") == "user-0") & F.col("tenant").eqNullSafe(F.lit(None).cast("string"))).select("dataset_id", "name")


# The stored state of the fixture: odd rows complete; m = 1 has old content, m = 2 an old label, m = 3 another weight, m = 0 is not stored.


def raw(s, d) -> DataFrame:
    r = fx.docs(s, d).where("doc_id % 10 <> 0").withColumn("m", F.col("doc_id") % 10)
    return r.select(
        F.lit("ds").alias("dataset_id"),
        ident.document_id(*fx.IDENTITY, F.col("external_key")).alias("data_id"),
        F.when(F.col("m") == 1, F.concat("content", F.lit("#old"))).otherwise(F.col("content")).alias("content"),
        "content_bytes",
        F.when(F.col("m") == 2, "zz").otherwise(F.col("label")).alias("label"),
        "external_metadata",
        "node_set",
        F.when(F.col("m") == 3, 9.0).otherwise(F.col("importance_weight")).alias("importance_weight"),
        (F.col("m") % 4 != 3).alias("complete"),
    )


def payload(s, d) -> DataFrame:
    return fx.docs(s, d).where("doc_id % 10 < 6").select(F.lit("ds").alias("dataset_id"), ident.document_id(*fx.IDENTITY, F.col("external_key")).alias("data_id"), *state.PAYLOAD)


def derivatives(s, d) -> DataFrame:
    return raw(s, d).where("complete").select("data_id", fp.content_fp(F.col("content")).alias("content_fp"), F.when(F.crc32(F.encode("data_id", "UTF-8")) % 5 == 0, fx.OLD_PROFILE).otherwise(fx.PROFILE).alias("profile_fp"))


def ids(s, d, where: str) -> DataFrame:
    return fx.docs(s, d).where(where).select(ident.document_id(*fx.IDENTITY, F.col("external_key")).alias("data_id"))


RAW = f"""{fx.DOCS},
raw AS (SELECT data_id, m, doc_id, CASE WHEN m = 1 THEN content || '#old' ELSE content END AS content, CASE WHEN m = 2 THEN 'zz' ELSE label END AS label, CASE WHEN m = 3 THEN 9.0 ELSE importance_weight END AS importance_weight, m % 4 <> 3 AS complete FROM own WHERE m <> 0)"""


@query("s8_list_documents", f"WITH {RAW} SELECT data_id, label, complete FROM raw ORDER BY data_id")
def s8(s, d):
    return state.list_documents(raw(s, d)).select("data_id", "label", "complete")


@query("s9_graph_scan", "SELECT r_name AS source, n_name AS target, 'contains' AS relationship_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1")
def s9(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    return n.join(r.where("r_regionkey = 1"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"), F.lit("contains").alias("relationship_name"))


# Store mutations


@query(
    "k1_upsert_state",
    f"""WITH {RAW}, pay AS (SELECT data_id, content, label, importance_weight FROM own WHERE m < 6)
SELECT coalesce(r.data_id, p.data_id) AS data_id, {fx.sql_content('coalesce(p.content, r.content)')} AS content_fp, CASE WHEN p.data_id IS NOT NULL THEN p.label ELSE r.label END AS label,
       CASE WHEN r.data_id IS NOT NULL THEN r.importance_weight ELSE p.importance_weight END AS weight,
       r.data_id IS NOT NULL AND r.complete AND (p.data_id IS NULL OR p.content = r.content) AS complete
FROM raw r FULL OUTER JOIN pay p ON r.data_id = p.data_id""",
)
def k1(s, d):
    out = state.upsert(raw(s, d), payload(s, d))
    return out.select("data_id", fp.content_fp(F.col("content")).alias("content_fp"), "label", F.col("importance_weight").alias("weight"), "complete")


@query("k2_payload_groups", f"WITH {fx.DOCS} SELECT array_to_string(node_set, '|') AS nodes, importance_weight AS weight, count(*) AS n FROM docs GROUP BY ALL")
def k2(s, d):
    return state.payload_groups(fx.docs(s, d)).select(F.array_join("node_set", "|").alias("nodes"), F.col("importance_weight").alias("weight"), "n")


@query("k4_delete", f"WITH {RAW} SELECT data_id, label FROM raw WHERE doc_id % 7 <> 0")
def k4(s, d):
    return state.delete(raw(s, d), ids(s, d, "doc_id % 7 = 0")).select("data_id", "label")


@query("k5_purge", f"WITH {RAW} SELECT data_id, complete AND doc_id % 7 <> 0 AS complete, CASE WHEN complete AND doc_id % 7 <> 0 THEN 1 ELSE 0 END AS n_derived FROM raw")
def k5(s, d):
    gone = ids(s, d, "doc_id % 7 = 0")
    left = state.delete(derivatives(s, d), gone).groupBy("data_id").agg(F.count("*").cast("int").alias("n"))
    return state.purge_raw(raw(s, d), gone).join(left, "data_id", "left").select("data_id", "complete", F.coalesce("n", F.lit(0)).alias("n_derived"))


@query("k6_teardown", f"WITH {DATASETS} SELECT dataset_id, name FROM datasets WHERE NOT (tenant IS NOT DISTINCT FROM 't1')")
def k6(s, d):
    return datasets(s, d).where(~F.col("tenant").eqNullSafe("t1")).select("dataset_id", "name")


# Scalar functions


@query("p1_canonical_join", f"SELECT doc_id, {fx.sql_netstring('source', 'lang', 'doc_id::VARCHAR', 'text')} AS joined FROM documents")
def p1(s, d):
    return table(s, d, "documents").select("doc_id", ident.netstring(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.col("text")).alias("joined"))


@query("p2_normalize_key", "SELECT doc_id, nfc_normalize(text || 'e' || chr(769)) AS key FROM documents")
def p2(s, d):
    return table(s, d, "documents").select("doc_id", ident.normalize_key(F.concat("text", F.lit("e\u0301"))).alias("key"))


@query("p3_document_data_id", f"WITH {fx.DOCS} SELECT external_key, data_id FROM own")
def p3(s, d):
    return fx.docs(s, d).select("external_key", ident.document_id(*fx.IDENTITY, F.col("external_key")).alias("data_id"))


@query("p4_content_fp_classes", "SELECT count(*) AS n, count(DISTINCT text) AS n_contents, count(DISTINCT text) AS n_exact FROM documents")
def p4(s, d):
    t = table(s, d, "documents")
    return t.agg(F.count("*").alias("n"), F.countDistinct(fp.content_fp(F.col("text"))).alias("n_contents"), F.countDistinct(fp.exact_content_fp("text")).alias("n_exact"))


@query("p5_json_fp_classes", "SELECT event_type, count(DISTINCT props) AS n_props, count(props) AS n FROM events GROUP BY event_type")
def p5(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.countDistinct(fp.exact_json_fp("props")).alias("n_props"), F.count("props").alias("n"))


@query("p6_json_keys", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events WHERE props IS NOT NULL")
def p6(s, d):
    return table(s, d, "events").where("props is not null").select("event_id", F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys"))


@query("p7_fp_sensitivity", f"WITH {fx.DOCS} SELECT external_key, content_fp, annotations_fp, metadata_fp, weight_fp FROM own")
def p7(s, d):
    shuffled = fx.docs(s, d).withColumn("node_set", F.reverse("node_set"))
    r = shuffled.withColumn("r", rc.record(F.lit("x"), "p"))
    return r.select("external_key", "r.content_fp", "r.annotations_fp", "r.metadata_fp", "r.weight_fp")


@query("p8_node_set_valid", "SELECT doc_id, len(list_distinct(n)) = len(n) AND NOT list_contains(n, '') AS valid FROM (SELECT doc_id, [source, lang, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 5 = 0 THEN '' ELSE 'x' END] AS n FROM documents)")
def p8(s, d):
    third = F.expr("case when doc_id % 3 = 0 then lang when doc_id % 5 = 0 then '' else 'x' end")
    return table(s, d, "documents").select("doc_id", fp.valid_node_set(F.array("source", "lang", third)).alias("valid"))


@query("p9_weight", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id::DOUBLE / 2 END AS weight FROM events")
def p9(s, d):
    w = F.expr("case when event_id % 7 = 0 then double('NaN') else event_id / 2 end")
    return table(s, d, "events").select("event_id", fp.normal_weight(w).alias("weight"))


@query("p11_record", f"WITH {fx.DOCS} SELECT external_key, data_id, processing_fp, 2 AS schema_version FROM own")
def p11(s, d):
    return fx.desired(s, d).select("external_key", "desired.data_id", "desired.processing_fp", "desired.schema_version")


ARGS = ["accessToken", "topP", "temperature", "api-key", "extraBody", "customKnob", "weirdKey", "HTTPProxy", "maxTokens", "log_level_x", "sessionURL", "n"]
_ARG = "['" + "', '".join(ARGS) + f"'][(o_orderkey % {len(ARGS)} + 1)::INT]"
_NORMAL = f"trim(regexp_replace(lower(regexp_replace(regexp_replace({_ARG}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_')"


def _in(names: list[str]) -> str:
    return "('" + "', '".join(names) + "')"


@query(
    "p17_model_arg_kind",
    f"""SELECT o_orderkey, CASE WHEN n IN {_in(modelargs.GENERATION)} THEN 'generation' WHEN n IN {_in(modelargs.NESTED)} THEN 'nested' WHEN n IN {_in(modelargs.EXCLUDED)} THEN 'excluded'
WHEN list_has_any(string_split(n, '_'), {modelargs.EXCLUDED_WORDS!r}) OR len(list_filter({modelargs.EXCLUDED_PHRASES!r}, lambda p: contains('_' || n || '_', '_' || p || '_'))) > 0 THEN 'excluded'
WHEN string_split(n, '_')[-1] IN ('key', 'token') THEN 'refused' ELSE 'nested' END AS kind FROM (SELECT o_orderkey, {_NORMAL} AS n FROM orders)""",
)
def p17(s, d):
    arg = F.element_at(F.array(*(F.lit(a) for a in ARGS)), (F.col("o_orderkey") % len(ARGS) + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", modelargs.kind_column(arg).alias("kind"))


@query("p18_token_ceiling", "SELECT p_partkey, least(p_size, CASE WHEN p_partkey % 3 <> 0 THEN 20 END) AS ceiling FROM part")
def p18(s, d):
    return table(s, d, "part").select("p_partkey", fp.token_ceiling(F.col("p_size"), F.expr("case when p_partkey % 3 <> 0 then 20 end")).alias("ceiling"))


@query("p19_embedding_width", "SELECT len(embedding)::INT AS width, count(*) AS n FROM embeddings GROUP BY 1")
def p19(s, d):
    return table(s, d, "embeddings").groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))


@query("p22_identity_scope", f"WITH {DATASETS} SELECT dataset_id, {fx.sql_netstring(repr(ident.USER_SCOPE), 'owner', chr(40) + 'coalesce(tenant, ' + repr('none') + ')' + chr(41))} AS scope FROM datasets")
def p22(s, d):
    return datasets(s, d).select("dataset_id", ident.identity_scope(F.col("owner"), F.col("tenant")).alias("scope"))


@query("p23_lock_scope", f"WITH {DATASETS} SELECT dataset_id, {fx.sql_netstring(repr(ident.LOCK_SCOPE), 'owner', chr(40) + 'coalesce(tenant, ' + repr('default') + ')' + chr(41), 'name')} AS scope FROM datasets")
def p23(s, d):
    return datasets(s, d).select("dataset_id", ident.lock_scope(F.col("owner"), F.coalesce("tenant", F.lit("default")), F.col("name")).alias("scope"))


@query("p24_runtime_key", "SELECT page_id, regexp_full_match(k, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') AS valid FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g') END AS k FROM pages)")
def p24(s, d):
    k = F.expr("case when page_id % 3 = 0 then url else regexp_replace(url, '[^A-Za-z0-9._-]', '-') end")
    return table(s, d, "pages").select("page_id", ident.valid_runtime_key(k).alias("valid"))


FILES = [".github/ci.html", "src/app/main.py", "docs/guide.md", "tests/test_a.py", "web/ui/index.tsx", "ops/run.sh", "uv.lock", "pkg/vendor/x.rs", "data/a/b/values.yaml", "img/logo.svg", "LICENSE", "a/b/setup.py", "deploy/k8s/app.yml"]
_PATH = "['" + "', '".join(FILES) + f"'][(page_id % {len(FILES)} + 1)::INT]"


def files(s, d) -> DataFrame:
    path = F.element_at(F.array(*(F.lit(f) for f in FILES)), (F.col("page_id") % len(FILES) + 1).cast("int"))
    return table(s, d, "pages").select(path.alias("path"), F.length("html").cast("long").alias("size"))


_SQL_FILES = f"""files AS (SELECT path, size, lower(path) AS p, string_split(lower(path), '/') AS parts, string_split(lower(path), '/')[-1] AS b FROM (SELECT {_PATH} AS path, length(html)::BIGINT AS size FROM pages)),
named AS (SELECT *, CASE WHEN contains(b, '.') THEN '.' || string_split(b, '.')[-1] ELSE '' END AS x FROM files),
classed AS (SELECT *, CASE WHEN b IN {_in(paths.LOCKS)} OR x IN {_in(paths.BINARY)} OR list_has_any(parts, {paths.VENDORED + paths.GENERATED!r}) THEN 'generated/vendor/binary'
 WHEN parts[1] = '.github' OR b IN {_in(paths.BUILD)} OR parts[1] IN {_in(paths.OPS)} OR (x IN ('.yml','.yaml') AND regexp_matches(p, 'docker-compose|compose\\.|ci|workflow|helm|k8s|kubernetes')) THEN 'build/CI'
 WHEN list_has_any(parts, {paths.TESTS!r}) OR starts_with(b, 'test_') OR ends_with(b, '_test.py') THEN 'test'
 WHEN parts[1] IN {_in(paths.EXAMPLES)} OR x IN {_in(paths.DOCUMENTS)} THEN 'docs/example' WHEN x IN {_in(paths.SOURCE + paths.FRONTEND)} THEN 'first-party source' ELSE 'irrelevant' END AS category,
 CASE WHEN len(parts) > 2 THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END AS module FROM named)"""


@query("p27_classify_paths", f"WITH {_SQL_FILES} SELECT path, category, module, count(*) AS n FROM classed GROUP BY ALL")
def p27(s, d):
    return files(s, d).select("path", paths.category(F.col("path")).alias("category"), paths.module(F.col("path")).alias("module")).groupBy("path", "category", "module").agg(F.count("*").alias("n"))


@query("p28_render", f"WITH {_SQL_FILES} SELECT category, category || ': ' || count(*)::VARCHAR || ' files' AS line FROM classed GROUP BY category")
def p28(s, d):
    by = files(s, d).groupBy(paths.category(F.col("path")).alias("category")).agg(F.count("*").alias("n"))
    return by.select("category", F.format_string("%s: %d files", "category", "n").alias("line"))


# Predicates


@query("f2_incremental_gate", f"WITH {RAW} SELECT data_id FROM raw WHERE NOT complete")
def f2(s, d):
    return state.incomplete(raw(s, d)).select("data_id")


@query("f3_unchanged", f"WITH {fx.STATE} SELECT external_key FROM actions WHERE op IS NULL")
def f3(s, d):
    a = fx.actions(s, d).where("desired is not null")
    return a.where(rc.unchanged(F.col("desired"), F.col("possible"), F.col("may_be_missing"))).select("external_key")


@query("f4_derivatives_safe", f"WITH {fx.STATE} SELECT external_key, NOT missing AND (safe OR NOT is_tracked) AS safe FROM keyed WHERE is_desired")
def f4(s, d):
    a = fx.actions(s, d).where("desired is not null")
    return a.select("external_key", rc.derivatives_safe(F.col("desired"), F.col("possible"), F.col("may_be_missing")).alias("safe"))


@query("f5_weight_differs", f"WITH {fx.STATE} SELECT external_key, other_weight FROM keyed WHERE is_desired")
def f5(s, d):
    a = fx.actions(s, d).where("desired is not null")
    return a.select("external_key", rc.weight_differs(F.col("desired"), F.col("possible")).alias("other_weight"))


@query("f6_stale_ids", f"WITH {fx.STATE} SELECT external_key, stale_ids FROM actions WHERE stale_ids <> ''")
def f6(s, d):
    return fx.actions(s, d).where("size(stale_ids) > 0").select("external_key", F.array_join("stale_ids", ",").alias("stale_ids"))


@query("f7_unconverged", f"WITH {RAW} SELECT data_id FROM raw WHERE NOT complete OR m = 4")
def f7(s, d):
    extra = raw(s, d).join(ids(s, d, "doc_id % 10 = 4"), "data_id", "left_semi").select("data_id", F.lit("stale").alias("content_fp"), F.lit(fx.PROFILE).alias("profile_fp"))
    return state.unconverged(raw(s, d), derivatives(s, d).unionByName(extra))


@query("f8_stale_derivatives", f"WITH {RAW} SELECT data_id FROM raw WHERE m = 4")
def f8(s, d):
    extra = raw(s, d).join(ids(s, d, "doc_id % 10 = 4"), "data_id", "left_semi").select("data_id", F.lit("stale").alias("content_fp"), F.lit(fx.PROFILE).alias("profile_fp"))
    return state.has_stale_derivatives(raw(s, d), derivatives(s, d).unionByName(extra))


@query("f10_written_equals_requested", f"WITH {RAW}, pay AS (SELECT data_id FROM own WHERE m < 6) SELECT count(*) AS requested, count(r.data_id) + count(CASE WHEN r.data_id IS NULL THEN 1 END) AS written FROM pay p LEFT JOIN raw r USING (data_id)")
def f10(s, d):
    p = payload(s, d)
    written = state.upsert(raw(s, d), p).join(p.select("data_id"), "data_id", "left_semi")
    return p.agg(F.count("*").alias("requested")).crossJoin(written.agg(F.count("*").alias("written")))


@query("f11_report_failed", "SELECT event_type, bool_or(value IS NULL OR value < 0) AS failed FROM events GROUP BY event_type")
def f11(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.bool_or(F.col("value").isNull() | (F.col("value") < 0)).alias("failed"))


# Joins


@query("j1_desired_by_tracking", f"WITH {fx.STATE} SELECT external_key, is_desired, is_tracked, missing FROM keyed")
def j1(s, d):
    return fx.actions(s, d).select("external_key", F.col("desired").isNotNull().alias("is_desired"), (F.size("possible") > 0).alias("is_tracked"), F.col("may_be_missing").alias("missing"))


_PLAN = f"""WITH {fx.STATE},
added AS (SELECT data_id FROM actions WHERE op IN ('upsert','replace','recreate','update_metadata')),
gone AS (SELECT data_id FROM actions WHERE op = 'delete' UNION ALL SELECT unnest(string_split(stale_ids, ',')) FROM actions WHERE stale_ids <> '' AND op IS NOT NULL),
planned AS (SELECT DISTINCT 'delete' AS phase, data_id FROM gone WHERE data_id NOT IN (SELECT data_id FROM added) UNION SELECT 'delete', data_id FROM actions WHERE op = 'recreate'
 UNION SELECT 'purge', data_id FROM actions WHERE op = 'replace' UNION SELECT 'add', data_id FROM added)"""


def planned(s, d) -> DataFrame:
    return state.batch_plan(fx.kept(fx.actions(s, d).where("op is not null").select("data_id", "op", "stale_ids")))


@query("j3_batch_plan", f"{_PLAN} SELECT phase, data_id FROM planned")
def j3(s, d):
    return planned(s, d)


@query("j4_semi_anti", f"WITH {RAW} SELECT data_id, doc_id % 7 = 0 AS hit FROM raw")
def j4(s, d):
    r, gone = raw(s, d).select("data_id"), ids(s, d, "doc_id % 7 = 0")
    return r.join(gone, "data_id", "left_semi").withColumn("hit", F.lit(True)).unionByName(r.join(gone, "data_id", "left_anti").withColumn("hit", F.lit(False)))


@query("j5_edge_lookup", "SELECT r_name AS source_name, n_name AS target_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = lower('EuRoPe')")
def j5(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    nodes = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name")).union(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), "r_name"))
    edges = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target"), F.lit("Contains").alias("relationship_name"))
    return dv.edge_lookup(edges, nodes, F.lit("EuRoPe"), "contains").select("source_name", "target_name")


_G3 = "list_sort(list_distinct(list_transform(list_filter(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: regexp_matches(w, '^\\p{Lu}') AND length(w) > 3), lambda w: trim(w, '.,;:!?()[]\"''')) ))"


@query("j6_pairs_within_documents", f"WITH e AS (SELECT doc_id, unnest({_G3}) AS item FROM documents) SELECT a.doc_id, a.item AS \"left\", b.item AS \"right\" FROM e a JOIN e b USING (doc_id) WHERE a.item < 'M' AND b.item >= 'M'")
def j6(s, d):
    e = table(s, d, "documents").select("doc_id", F.explode(dv.capitalized(F.col("text"), None)).alias("item"))
    return dv.pairs_within(e, "doc_id", F.col("item") < "M", F.col("item") >= "M")


@query("j7_prefix_gaps", f"WITH {_SQL_FILES} SELECT path, count(*) AS n FROM classed WHERE NOT (starts_with(path, 'src/') OR starts_with(path, 'docs/') OR starts_with(path, 'a/b')) GROUP BY path")
def j7(s, d):
    prefixes = s.createDataFrame([("src/",), ("docs/",), ("a/b",)], "prefix string")
    return paths.uncovered(files(s, d), prefixes).groupBy("path").agg(F.count("*").alias("n"))


@query("j8_stale_reviews", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def j8(s, d):
    used = table(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return table(s, d, "supplier").select("s_suppkey").join(used, "s_suppkey", "left_anti")


@query("j9_phantoms", f"WITH {RAW} SELECT data_id FROM raw WHERE doc_id % 13 = 0")
def j9(s, d):
    return raw(s, d).select("data_id").join(ids(s, d, "doc_id % 13 <> 0"), "data_id", "left_anti")


@query("j10_processing_fan_out", f"WITH {fx.DOCS} SELECT external_key, '{fx.OLD_PROFILE}' AS processing_fp FROM docs")
def j10(s, d):
    return fx.docs(s, d).select("external_key", F.lit(fx.OLD_PROFILE).alias("processing_fp"))


# Aggregations


@query("a1_possible_records", f"WITH {fx.STATE} SELECT external_key, count(DISTINCT (data_id, content_fp, annotations_fp, metadata_fp, processing_fp, weight_fp)) AS n FROM prev GROUP BY external_key")
def a1(s, d):
    log = fx.tracking(s, d).select("external_key", F.explode(F.concat("possible", "possible")).alias("record"), "may_be_missing")
    return rc.possible_records(log).select("external_key", F.size("possible").cast("long").alias("n"))


@query("a2_batch_counters", f"WITH {fx.STATE} SELECT count(*) FILTER (op = 'delete') AS n_delete, count(*) FILTER (op = 'recreate') AS n_recreate, count(*) FILTER (op = 'replace') AS n_replace, count(*) FILTER (op = 'update_metadata') AS n_update_metadata, count(*) FILTER (op = 'upsert') AS n_upsert, coalesce(bool_or(op IN ('upsert','replace','recreate')), false) AS derives FROM actions")
def a2(s, d):
    return state.batch_counters(fx.actions(s, d))


@query("a4_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type")
def a4(s, d):
    return table(s, d, "events").groupBy("event_type").agg(*stats.percentiles(F.col("value")))


@query("a5_summary", "SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, median(value) AS median FROM events GROUP BY event_type")
def a5(s, d):
    return table(s, d, "events").groupBy("event_type").agg(*stats.summary(F.col("value"))).withColumn("mean", F.round("mean", 6))


@query("a6_duplicates", "SELECT text_sha, count(*) AS n FROM (SELECT sha256(text) AS text_sha FROM documents) GROUP BY 1 HAVING count(*) > 1")
def a6(s, d):
    return table(s, d, "documents").groupBy(F.sha2("text", 256).alias("text_sha")).agg(F.count("*").alias("n")).where("n > 1")


_BRIDGE = f"bridge AS (SELECT DISTINCT lower(name) AS artifact_id, doc_id FROM (SELECT doc_id, unnest({_G3}[1:12]) AS name FROM documents))"


def bridge(s, d) -> DataFrame:
    return dv.provenance(table(s, d, "documents").withColumnRenamed("doc_id", "data_id"), dv.capitalized(F.col("text")))


@query("a7_reference_counts", f"WITH {_BRIDGE} SELECT artifact_id, count(DISTINCT doc_id) AS n_refs FROM bridge GROUP BY artifact_id")
def a7(s, d):
    return dv.reference_counts(bridge(s, d))


_V1 = f"""WITH {fx.DOCS},
e AS (SELECT data_id, external_key, label FROM own WHERE doc_id % 13 <> 0), t AS (SELECT data_id, CASE WHEN doc_id % 7 <> 0 THEN label END AS label, doc_id % 11 <> 0 AS complete FROM own WHERE doc_id % 17 <> 0),
issues AS (SELECT 'missing' AS kind, e.data_id, e.external_key FROM e ANTI JOIN t USING (data_id) UNION ALL SELECT 'unexpected', t.data_id, NULL FROM t ANTI JOIN e USING (data_id)
 UNION ALL SELECT 'incomplete', e.data_id, e.external_key FROM e JOIN t USING (data_id) WHERE NOT t.complete UNION ALL SELECT 'label_mismatch', e.data_id, e.external_key FROM e JOIN t USING (data_id) WHERE e.label IS DISTINCT FROM t.label)"""


def _drift(s, d) -> DataFrame:
    rows = fx.docs(s, d).withColumn("data_id", ident.document_id(*fx.IDENTITY, F.col("external_key")))
    expected = rows.where("doc_id % 13 <> 0").select("data_id", "external_key", "label")
    stored = rows.where("doc_id % 17 <> 0").select("data_id", F.when(F.col("doc_id") % 7 != 0, F.col("label")).alias("label"), (F.col("doc_id") % 11 != 0).alias("complete"))
    return verify.issues(expected, stored)


@query("a8_issue_counts", f"{_V1} SELECT kind, count(*) AS n FROM issues GROUP BY kind")
def a8(s, d):
    return _drift(s, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("a9_errored_runs", "SELECT user_id, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY user_id")
def a9(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_errors"))


@query("a10_all_same", "SELECT source, count(DISTINCT lang) <= 1 AS same FROM documents GROUP BY source")
def a10(s, d):
    return table(s, d, "documents").groupBy("source").agg(stats.all_same(F.col("lang")).alias("same"))


@query("a11_call_counts", f"{_PLAN} SELECT phase, count(*) AS n_ids FROM planned GROUP BY phase")
def a11(s, d):
    return planned(s, d).groupBy("phase").agg(F.count("*").alias("n_ids"))


@query("a12_rollup", f"WITH {_SQL_FILES} SELECT category, count(*) AS n_files, sum(size)::BIGINT AS total_size FROM classed GROUP BY category ORDER BY n_files DESC")
def a12(s, d):
    return paths.rollup(files(s, d).withColumn("category", paths.category(F.col("path"))), "category").orderBy(F.desc("n_files"))


@query("a13_coverage", f"WITH {_SQL_FILES} SELECT module, count(*) AS total, count(*) FILTER (starts_with(path, 'src/') OR starts_with(path, 'docs/')) AS covered FROM classed GROUP BY module")
def a13(s, d):
    covered = F.col("path").startswith("src/") | F.col("path").startswith("docs/")
    return files(s, d).groupBy(paths.module(F.col("path")).alias("module")).agg(F.count("*").alias("total"), F.count_if(covered).alias("covered"))


@query("a14_full_vs_incremental", f"WITH {fx.STATE} SELECT count(*) FILTER (is_desired) AS full_rebuild, count(*) FILTER (is_desired AND op IN ('upsert','replace','recreate')) AS incremental, count(*) FILTER (is_desired AND (op IS NULL OR op = 'update_metadata')) AS unnecessary FROM actions")
def a14(s, d):
    a, wanted = fx.actions(s, d), F.col("desired").isNotNull()
    work = F.coalesce(F.col("op").isin(*state.DERIVING_OPS), F.lit(False))
    return a.agg(F.count_if(wanted).alias("full_rebuild"), F.count_if(wanted & work).alias("incremental"), F.count_if(wanted & ~work).alias("unnecessary"))


# Windows, order, sets


@query("w1_last_action_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def w1(s, d):
    return state.last_action(table(s, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("w2_partial_batch", f"WITH {fx.DOCS} SELECT label, data_id FROM (SELECT label, data_id, row_number() OVER (PARTITION BY label ORDER BY data_id) AS n FROM own) WHERE n <= 5")
def w2(s, d):
    rows = fx.docs(s, d).select("label", ident.document_id(*fx.IDENTITY, F.col("external_key")).alias("data_id"))
    return stats.first_by_order(rows, "label", ["data_id"], 5).select("label", "data_id")


@query("w3_log_segments", "SELECT event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM events")
def w3(s, d):
    return stats.segments(table(s, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click").select("event_id", "segment")


@query("o1_ordered_ids", f"WITH {fx.STATE} SELECT data_id, op FROM actions WHERE op IS NOT NULL ORDER BY data_id")
def o1(s, d):
    return fx.actions(s, d).where("op is not null").select("data_id", "op").orderBy("data_id")


@query("o4_top12", f"SELECT doc_id, array_to_string({_G3}[1:12], '|') AS top FROM documents")
def o4(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(dv.capitalized(F.col("text")), "|").alias("top"))


@query("o5_first_gaps", "SELECT url FROM pages ORDER BY url LIMIT 40")
def o5(s, d):
    return table(s, d, "pages").select("url").orderBy("url").limit(40)


@query("o6_first_marker", "SELECT doc_id, coalesce(list_filter(list_transform(list_filter(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: regexp_matches(w, '^\\p{Lu}')), lambda w: rtrim(w, '.,')), lambda w: w <> 'Document')[1], 'BenchNode') AS marker FROM documents")
def o6(s, d):
    return table(s, d, "documents").select("doc_id", dv.marker(F.col("text")).alias("marker"))


@query("u1_union", "SELECT source FROM documents UNION SELECT lang FROM documents")
def u1(s, d):
    t = table(s, d, "documents")
    return t.select("source").union(t.select("lang")).distinct()


@query("u2_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def u2(s, d):
    return table(s, d, "customer").select("c_custkey").exceptAll(table(s, d, "orders").select("o_custkey").distinct())


@query("u3_intersection", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def u3(s, d):
    return table(s, d, "customer").select("c_custkey").intersect(table(s, d, "orders").select("o_custkey"))


@query("u4_set_equality", "SELECT (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) = 0 AND (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) = 0 AS equal")
def u4(s, d):
    a, b = table(s, d, "nation").select(F.col("n_regionkey").alias("k")).distinct(), table(s, d, "region").select(F.col("r_regionkey").alias("k")).distinct()
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "k", "full_outer")
    return both.agg((F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0).alias("equal"))


@query("u5_subset", "SELECT count(*) = 0 AS subset FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def u5(s, d):
    left = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).join(table(s, d, "customer"), "c_custkey", "left_anti")
    return left.agg((F.count("*") == 0).alias("subset"))


# The core


@query("r1_diff", f"WITH {fx.STATE} SELECT external_key, diff FROM actions")
def r1(s, d):
    return fx.actions(s, d).select("external_key", "diff")


@query("r2_op_counts", f"WITH {fx.STATE} SELECT coalesce(op, 'none') AS op, count(*) AS n FROM actions GROUP BY 1")
def r2(s, d):
    return fx.actions(s, d).groupBy(F.coalesce("op", F.lit("none")).alias("op")).agg(F.count("*").alias("n"))


@query("r3_reconcile", f"WITH {fx.STATE} SELECT external_key, data_id, op, stale_ids FROM actions")
def r3(s, d):
    return fx.actions(s, d).select("external_key", "data_id", "op", F.array_join("stale_ids", ",").alias("stale_ids"))


@query("r5_applied_state", f"WITH {fx.DOCS} SELECT data_id, content_fp, label, true AS complete FROM own")
def r5(s, d):
    """End state of applying the plan to what is stored: all that is declared, as declared, derived."""
    plan = fx.kept(planned(s, d))
    stored, made = raw(s, d), derivatives(s, d)
    for phase in ("delete", "purge"):
        gone = plan.where(F.col("phase") == phase)
        made = state.delete(made, gone)
        stored = state.delete(stored, gone) if phase == "delete" else state.purge_raw(stored, gone)
    every = fx.docs(s, d).select(F.lit("ds").alias("dataset_id"), ident.document_id(*fx.IDENTITY, F.col("external_key")).alias("data_id"), *state.PAYLOAD)
    stored = state.upsert(stored, every.join(plan.where("phase = 'add'"), "data_id", "left_semi"))
    stored, made = state.derive(stored, made, fx.PROFILE)
    return stored.select("data_id", fp.content_fp(F.col("content")).alias("content_fp"), "label", "complete")


@query("r6_dataset_transitions", f"WITH {DATASETS} SELECT dataset_id, CASE WHEN tenant IS NULL THEN NULL WHEN owner = 'user-0' THEN 'replace' ELSE NULL END AS action, tenant IS NOT NULL AND owner = 'user-0' AS lossy FROM datasets")
def r6(s, d):
    rows = datasets(s, d).select("dataset_id", "owner", "tenant").collect()  # one row a dataset: configuration, kept on the driver
    out = []
    for r in rows:
        t = rc.dataset_transition(fx.PROFILE, "user" if r.tenant is None else "system", [(fx.OLD_PROFILE if r.owner == "user-0" else fx.PROFILE, "system")], False)
        out.append((r.dataset_id, t["action"], t["lossy"]))
    return s.createDataFrame(out, "dataset_id string, action string, lossy boolean")


@query(
    "r7_precommit",
    f"""WITH {fx.STATE}, recs AS (SELECT external_key, data_id, content_fp, annotations_fp, metadata_fp, processing_fp, weight_fp FROM prev
 UNION SELECT o.external_key, o.data_id, o.content_fp, o.annotations_fp, o.metadata_fp, o.processing_fp, o.weight_fp FROM own o JOIN actions a USING (external_key) WHERE a.op IS NOT NULL)
SELECT a.external_key, count(r.external_key) AS n_possible, coalesce(a.op = 'delete', false) AS has_delete_marker FROM actions a LEFT JOIN recs r ON r.external_key = a.external_key GROUP BY a.external_key, a.op""",
)
def r7(s, d):
    t = rc.precommit(fx.tracking(s, d), fx.actions(s, d))
    return t.select("external_key", F.size("possible").cast("long").alias("n_possible"), "has_delete_marker")


@query("r8_commit", f"WITH {fx.STATE} SELECT external_key, 1::BIGINT AS n_possible, false AS may_be_missing FROM actions WHERE op IS DISTINCT FROM 'delete'")
def r8(s, d):
    a = fx.actions(s, d)
    t = rc.commit(rc.precommit(fx.tracking(s, d), a), a)
    return t.select("external_key", F.size("possible").cast("long").alias("n_possible"), "may_be_missing")


@query("r9_lossy", f"WITH {fx.STATE} SELECT CASE WHEN NOT is_desired THEN 'delete' WHEN NOT is_tracked THEN 'upsert' WHEN other_weight THEN 'recreate' ELSE 'replace' END AS op, count(*) AS n FROM keyed GROUP BY 1")
def r9(s, d):
    t = rc.invalidate_lossy(fx.tracking(s, d))
    return rc.reconcile(fx.desired(s, d), t, fx.IDENTITY).groupBy("op").agg(F.count("*").alias("n"))


@query("r11_fixed_point", "SELECT 0::BIGINT AS n_actions")
def r11(s, d):
    a = fx.actions(s, d)
    t = rc.commit(rc.precommit(fx.tracking(s, d), a), a)
    return rc.reconcile(fx.desired(s, d), t, fx.IDENTITY).agg(F.count_if(F.col("op").isNotNull()).alias("n_actions"))


@query(
    "r12_crash_before_commit",
    f"""WITH {fx.STATE},
recs AS (SELECT external_key, data_id, content_fp, annotations_fp, metadata_fp, processing_fp, weight_fp, missing FROM prev
 UNION SELECT o.external_key, o.data_id, o.content_fp, o.annotations_fp, o.metadata_fp, o.processing_fp, o.weight_fp, a.missing FROM own o JOIN actions a USING (external_key) WHERE a.op IS NOT NULL),
again AS (SELECT a.external_key, a.op AS first_op, o.external_key IS NOT NULL AS wanted, count(r.external_key) AS n, a.missing OR coalesce(a.op = 'delete', false) AS missing,
  bool_or(coalesce(r.weight_fp <> o.weight_fp, false)) AS other_weight,
  bool_and(coalesce(r.data_id = o.data_id AND r.content_fp = o.content_fp AND r.annotations_fp = o.annotations_fp AND r.processing_fp = o.processing_fp, false)) AS safe,
  bool_and(coalesce(r.data_id = o.data_id AND r.content_fp = o.content_fp AND r.annotations_fp = o.annotations_fp AND r.processing_fp = o.processing_fp AND r.weight_fp = o.weight_fp AND r.metadata_fp = o.metadata_fp, false)) AS equal
 FROM actions a LEFT JOIN own o USING (external_key) LEFT JOIN recs r USING (external_key) GROUP BY ALL),
planned AS (SELECT coalesce(first_op, 'none') AS first_op, CASE WHEN NOT wanted THEN 'delete' WHEN n = 0 THEN CASE WHEN missing THEN 'upsert' END WHEN equal AND NOT missing THEN NULL WHEN other_weight THEN 'recreate'
  WHEN equal THEN 'replace' WHEN safe AND NOT missing THEN 'update_metadata' ELSE 'replace' END AS op FROM again)
SELECT first_op, coalesce(op, 'none') AS op, count(*) AS n FROM planned GROUP BY ALL""",
)
def r12(s, d):
    """A run that crashed after its intents were logged: what was planned, and what the next run plans."""
    t = rc.precommit(fx.tracking(s, d), fx.actions(s, d))
    first = fx.actions(s, d).select("external_key", F.coalesce("op", F.lit("none")).alias("first_op"))
    again = rc.reconcile(fx.desired(s, d), t, fx.IDENTITY).select("external_key", "op").join(first, "external_key")
    return again.groupBy("first_op", F.coalesce("op", F.lit("none")).alias("op")).agg(F.count("*").alias("n"))


@query("r14_uncertainty", f"WITH {fx.STATE} SELECT external_key, missing OR (m_key % 3 = 0) AS missing FROM (SELECT *, length(external_key) AS m_key FROM keyed WHERE is_tracked)")
def r14(s, d):
    t = fx.tracking(s, d).withColumn("has_delete_marker", F.length("external_key") % 3 == 0)
    return rc.reconcile(fx.desired(s, d), t, fx.IDENTITY).where("size(possible) > 0").select("external_key", F.col("may_be_missing").alias("missing"))


# Derivation


@query("g1_derive", f"WITH {RAW} SELECT data_id, content_fp FROM (SELECT data_id, {fx.sql_content('content')} AS content_fp FROM raw)")
def g1(s, d):
    _, made = state.derive(raw(s, d), derivatives(s, d), fx.PROFILE)
    return made.select("data_id", "content_fp")


VOCABULARY = ["the", "und", "que", "Ouwhea", "est"]


@query("g2_vocabulary", f"SELECT doc_id, array_to_string(list_filter({VOCABULARY!r}, lambda v: contains(text, v)), '|') AS found FROM documents")
def g2(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(dv.vocabulary(F.col("text"), VOCABULARY), "|").alias("found"))


@query("g3_entities", f"SELECT doc_id, name FROM (SELECT doc_id, unnest({_G3}) AS name FROM documents)")
def g3(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(dv.capitalized(F.col("text"), None)).alias("name"))


@query("g5_summary", "SELECT doc_id, coalesce(nullif(substr(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1], 1, 80), ''), 'empty document') AS summary FROM documents")
def g5(s, d):
    return table(s, d, "documents").select("doc_id", dv.summary(F.col("text")).alias("summary"))


@query("g6_provenance_survivors", f"WITH {_BRIDGE} SELECT artifact_id, count(*) AS n_before, count(*) FILTER (doc_id % 20 <> 0) AS n_after FROM bridge GROUP BY artifact_id HAVING count(*) FILTER (doc_id % 20 <> 0) > 0")
def g6(s, d):
    b = bridge(s, d)
    gone = table(s, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("data_id"))
    left = dv.without_documents(b, gone)
    before = b.groupBy("artifact_id").agg(F.count("*").alias("n_before"))
    after = left.groupBy("artifact_id").agg(F.count("*").alias("n_after"))
    return dv.survivors(before, left).join(after, "artifact_id")


@query("g7_node_keys", f"WITH {_BRIDGE} SELECT count(*) AS n, count(DISTINCT artifact_id) AS n_nodes FROM bridge")
def g7(s, d):
    return bridge(s, d).agg(F.count("*").alias("n"), F.countDistinct("artifact_id").alias("n_nodes"))


@query("g9_chunks", "SELECT doc_id, i + 1 AS part, substr(text, (i * 500 + 1)::BIGINT, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest((length(text) + 499) // 500, 0))) AS i FROM documents)")
def g9(s, d):
    parts = table(s, d, "documents").select("doc_id", F.posexplode(dv.chunks(F.col("text"), 500)).alias("i", "chunk"))
    return parts.select("doc_id", (F.col("i") + 1).cast("long").alias("part"), "chunk")


@query("v1_verify_issues", f"{_V1} SELECT kind, data_id, external_key FROM issues")
def v1(s, d):
    return _drift(s, d).select("kind", "data_id", "external_key")


@query("x2_call_log", f"{_PLAN} SELECT phase, data_id, row_number() OVER (PARTITION BY phase, substr(data_id, 1, 2) ORDER BY data_id) AS place FROM planned")
def x2(s, d):
    """What a run would call, phase by phase: each id with its place among those of equal first digits, in which order calls are made."""
    order = Window.partitionBy("phase", F.substring("data_id", 1, 2)).orderBy("data_id")
    return planned(s, d).select("phase", "data_id", F.row_number().over(order).cast("long").alias("place"))
