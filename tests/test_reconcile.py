import pytest
from pyspark.sql import functions as F

from tidemark.operators import reconcile as rc
from tidemark.operators import state

D = dict(data_id="id", content_fp="c", annotations_fp="a", metadata_fp="m", processing_fp="p", weight_fp="w", schema_version=2)


def other(**change):
    return D | change


# desired, possible, missing -> diff, operation, stale ids
MATRIX = [
    (None, [], False, None, None, []),
    (None, [], True, None, "delete", []),
    (None, [D], False, "delete", "delete", []),
    (None, [D], True, "delete", "delete", []),
    (D, [], False, None, None, []),
    (D, [], True, "insert", "upsert", []),
    (D, [D], False, None, None, []),
    (D, [D, D], False, None, None, []),
    (D, [D], True, "upsert", "replace", []),
    (D, [other(content_fp="x")], False, "replace", "replace", []),
    (D, [other(annotations_fp="x")], False, "replace", "replace", []),
    (D, [other(processing_fp="x")], False, "replace", "replace", []),
    (D, [other(schema_version=1)], False, "replace", "replace", []),
    (D, [other(metadata_fp="x")], False, "replace", "update_metadata", []),
    (D, [other(metadata_fp="x"), D], False, "replace", "update_metadata", []),
    (D, [other(metadata_fp="x")], True, "replace", "replace", []),
    (D, [other(weight_fp="")], False, "replace", "recreate", []),
    (D, [other(weight_fp="x")], True, "replace", "recreate", []),
    (D, [D, other(weight_fp="x")], False, "replace", "recreate", []),
    (D, [other(data_id="z"), other(data_id="b")], False, "replace", "replace", ["b", "z"]),
]


def test_decision_matrix(spark):
    schema = f"i int, desired {rc.RECORD}, possible array<{rc.RECORD}>, missing boolean"
    rows = spark.createDataFrame([(i, d, p, m) for i, (d, p, m, *_) in enumerate(MATRIX)], schema)
    d, p, m = F.col("desired"), F.col("possible"), F.col("missing")
    got = rows.select("i", rc.differs(d, p, m).alias("diff"), rc.operation(d, p, m).alias("op"), rc.stale_ids(F.lit("id"), p).alias("stale"), rc.unchanged(d, p, m).alias("same")).collect()
    for r in got:
        desired, possible, missing, diff, op, stale = MATRIX[r.i]
        assert (r.diff, r.op, r.stale) == (diff, op, stale), MATRIX[r.i]
        if desired is not None and possible:
            assert r.same == (op is None)


@pytest.mark.parametrize(
    "desired,manager,previous,missing,action,lossy",
    [
        (None, None, [("f", "system")], False, "delete", False),
        (None, None, [("f", "system"), ("g", "user")], False, None, False),
        (None, None, [], True, None, False),
        ("f", "user", [("g", "system")], False, None, False),
        ("f", "system", [("g", "system")], False, "replace", True),
        ("f", "system", [("f", "user")], False, "replace", True),
        ("f", "system", [("f", "system")], False, None, False),
        ("f", "system", [], True, "insert", False),
    ],
)
def test_ownership(desired, manager, previous, missing, action, lossy):
    assert rc.dataset_transition(desired, manager, previous, missing) == {"action": action, "lossy": lossy}


def test_batch_plan(spark):
    rows = [("u", "upsert", []), ("r", "replace", ["old", "u"]), ("m", "update_metadata", []), ("d", "delete", []), ("x", "recreate", [])]
    actions = spark.createDataFrame(rows, "data_id string, op string, stale_ids array<string>")
    assert {(r.phase, r.data_id) for r in state.batch_plan(actions).collect()} == {
        ("delete", "d"), ("delete", "old"), ("delete", "x"), ("purge", "r"), ("add", "u"), ("add", "r"), ("add", "m"), ("add", "x"),
    }
    n = state.batch_counters(actions).first()
    assert (n.n_delete, n.n_replace, n.n_upsert, n.derives) == (1, 1, 1, True)


def test_log_of_intents(spark):
    log = spark.createDataFrame([("a", D, False), ("a", D, False), ("a", other(content_fp="x"), True), ("b", None, False)], f"external_key string, record {rc.RECORD}, may_be_missing boolean")
    got = {r.external_key: r for r in rc.possible_records(log).collect()}
    assert len(got["a"].possible) == 2 and got["a"].may_be_missing and not got["a"].has_delete_marker
    assert got["b"].possible == [] and got["b"].has_delete_marker
