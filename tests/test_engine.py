import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark import doctor
from tidemark.engine import OF_DOCUMENTS, PHASES, DriftError, Engine, Fault
from tidemark.locks import FileLocks, LockTimeout, ProcessLocks
from tidemark.operators import state
from tidemark.plans.config import Dataset, Processing, Profile, processing_of
from tidemark.sources.store import VersionedStore

DATA = Dataset("rt", "docs")


def frame(spark, docs):
    return spark.createDataFrame([(k, *v) for k, v in docs.items()], "external_key string, content string, label string, node_set array<string>, importance_weight double")


def stored(engine):
    store = engine.store(DATA)
    from tidemark.engine import BRIDGE, DERIVATIVES, RAW

    return store.read("raw", RAW), store.read("derivatives", DERIVATIVES), store.read("bridge", BRIDGE)


def assert_converged(engine, docs, processing=None):
    raw, made, bridge = stored(engine)
    rows = raw.collect()
    assert sorted((r.content, r.label, tuple(r.node_set or ()), r.importance_weight) for r in rows) == sorted((c, l, tuple(n or ()), w) for c, l, n, w in docs.values())
    assert all(r.complete for r in rows)
    assert state.unconverged(raw, made, (processing or processing_of(Profile())).fingerprint).isEmpty()
    ids = {r.data_id for r in rows}
    assert {r.data_id for r in made.collect()} == ids and {r.data_id for r in bridge.collect()} <= ids


def test_lifecycle(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    docs = {"ferry.md": ("Ferries leave Lundhaven and Oakmere daily.", "L", None, None), "bus.md": ("Buses serve Lundhaven.", None, ["n"], 0.5)}
    assert engine.sync(DATA, frame(spark, docs)) == {"upsert": 2}
    assert {r.name: r.n_refs for r in engine.graph(DATA).collect()} == {"Ferries": 1, "Lundhaven": 2, "Oakmere": 1, "Buses": 1}
    assert engine.sync(DATA, frame(spark, docs)) == {}
    docs["ferry.md"] = ("Ferries leave Stromby now.", "L", None, None)
    assert engine.sync(DATA, frame(spark, docs)) == {"replace": 1}
    assert {r.name for r in engine.graph(DATA).collect()} == {"Ferries", "Stromby", "Lundhaven", "Buses"}
    docs["bus.md"] = ("Buses serve Lundhaven.", "new", ["n"], 0.75)
    assert engine.sync(DATA, frame(spark, docs)) == {"recreate": 1}
    docs["ferry.md"] = ("Ferries leave Stromby now.", "other", None, None)
    assert engine.sync(DATA, frame(spark, docs)) == {"update_metadata": 1}
    newer = Processing(extras=(("code", "2"),))
    assert engine.sync(DATA, frame(spark, docs), processing=newer) == {"replace": 2}
    assert_converged(engine, docs, newer)
    del docs["bus.md"]
    assert engine.sync(DATA, frame(spark, docs), processing=newer) == {"delete": 1}
    assert {r.name for r in engine.graph(DATA).collect()} == {"Ferries", "Stromby"}
    expected = spark.createDataFrame([("ferry.md", "L"), ("gone.md", None)], "external_key string, label string")
    report = engine.verify(DATA, expected)
    assert (report["checked"], sorted(i["kind"] for i in report["first"]), report["ok"]) == (2, ["label_mismatch", "missing"], False)
    assert all(engine.store(DATA).vacuum(name) == 0 for name in engine.store(DATA).names()) and engine.documents(DATA).count() == 1
    mine = Dataset("rt", "docs", managed_by="user")
    assert engine.sync(mine, frame(spark, docs), processing=newer) == {}  # handed over to its user
    assert not engine.teardown(DATA) and engine.documents(DATA).count() == 1
    assert engine.sync(DATA, frame(spark, docs), processing=newer) == {"replace": 1}  # taken back: nothing of it is sure
    assert_converged(engine, docs, newer)
    assert engine.teardown(DATA) and not engine.teardown(DATA)
    assert engine.documents(DATA).count() == 0


@pytest.mark.parametrize("phase", PHASES + OF_DOCUMENTS)
def test_fault_windows(spark, tmp_path, phase):
    def fail():
        raise OSError("injected")

    first = {"a": ("Alpha text", None, None, None), "b": ("Bravo text", "x", None, 0.5), "c": ("Charlie text", None, None, None)}
    then = {"a": ("Alpha changed", None, None, None), "b": ("Bravo text", "y", None, 0.9), "d": ("Delta text", None, ["n"], None)}
    Engine(spark, str(tmp_path)).sync(DATA, frame(spark, first))
    broken = Engine(spark, str(tmp_path), hooks={phase: fail})
    with pytest.raises(OSError, match="injected"):
        broken.sync(DATA, frame(spark, then))
    engine = Engine(spark, str(tmp_path))
    engine.sync(DATA, frame(spark, then))
    assert_converged(engine, then)
    assert engine.sync(DATA, frame(spark, then)) == {}


def test_random_histories_converge(spark, tmp_path):
    r = random.Random(7)
    keys, contents = ["a.md", "b.md", "dir/c.md", "café.md"], ["Alpha", "Beta", "", "Gamma Delta"]
    docs: dict = {}
    for step in range(6):
        for k in r.sample(keys, 2):
            if r.random() < 0.3:
                docs.pop(k, None)
            else:
                docs[k] = (r.choice(contents), r.choice([None, "L1", "L2"]), r.choice([None, ["n1"], ["n1", "n2"]]), r.choice([None, 0.5]))
        hooks = {}
        if step % 2:
            def fail():
                raise OSError("injected")

            hooks = {r.choice(PHASES): fail}
        try:
            Engine(spark, str(tmp_path), hooks=hooks).sync(DATA, frame(spark, docs))
        except OSError:
            pass
    engine = Engine(spark, str(tmp_path))
    engine.sync(DATA, frame(spark, docs))
    assert_converged(engine, docs)


def test_refusals(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    with pytest.raises(ValueError, match="1 documents"):
        engine.sync(DATA, frame(spark, {"": ("x", None, None, None)}))
    twice = frame(spark, {"k": ("secret text", None, None, None)})
    with pytest.raises(RuntimeError) as e:
        engine.sync(DATA, twice.union(twice))
    assert "secret" not in str(e.value)
    engine.sync(DATA, twice)
    engine.store(DATA).drop("tracking")
    with pytest.raises(RuntimeError, match="tracked"):
        engine.sync(DATA, twice)


def test_documents_are_checked_when_declared(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    for bad in (("x", None, ["n", "n"], None), ("x", None, [" "], None), ("x", None, None, float("nan")), ("x", None, None, float("inf"))):
        with pytest.raises(ValueError):
            engine.sync(DATA, frame(spark, {"k": bad}))
    rows = "external_key string, content string, external_metadata string"
    for bad in ("[1]", "{'a'", '{"a": NaN}'):
        with pytest.raises(Exception, match="JSON|Expecting|compliant"):
            engine.sync(DATA, spark.createDataFrame([("k", "x", bad)], rows))
    assert engine.sync(DATA, spark.createDataFrame([("k", "x", '{"a": 1, "b": [2.0]}')], rows)) == {"upsert": 1}
    assert engine.sync(DATA, spark.createDataFrame([("k", "x", '{"b":[2.0],  "a":1}')], rows)) == {}
    assert engine.sync(DATA, spark.createDataFrame([("k", "x", '{"b":[2.0],  "a":2}')], rows)) == {"replace": 1}


def test_bytes_are_not_text(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    text, data = spark.createDataFrame([("k", "Alpha")], "external_key string, content string"), spark.createDataFrame([("k", bytearray(b"Alpha"))], "external_key string, content binary")
    assert [engine.sync(DATA, x) for x in (text, text, data, data)] == [{"upsert": 1}, {}, {"replace": 1}, {}]
    odd = spark.createDataFrame([("k", bytearray(b"Alpha \xff\xfe Bravo"))], "external_key string, content binary")
    assert engine.sync(DATA, odd) == {"replace": 1}
    assert {r.name for r in engine.graph(DATA).collect()} == {"Alpha", "Bravo"}


def test_chunks_and_edges(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    docs = frame(spark, {"a": ("Alpha Bravo Delta", None, None, None), "b": ("Alpha Bravo", None, None, None)})
    profile = Profile(relations=neighbours, chunk_size=12)
    engine.sync(DATA, docs, profile)
    assert {r.name for r in engine.graph(DATA).collect()} == {"Alpha", "Bravo", "Delta"}
    assert {(r.source, r.target, r.n_refs) for r in engine.edges(DATA).collect()} == {("Alpha", "Bravo", 2)}  # Delta is in a chunk of its own
    engine.sync(DATA, docs.where("external_key = 'b'"), profile)
    assert {(r.source, r.target, r.n_refs) for r in engine.edges(DATA).collect()} == {("Alpha", "Bravo", 1)}


def neighbours(text):
    words = F.filter(F.split(text, " "), lambda w: w != "")
    pairs = F.arrays_zip(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)))
    return F.when(F.size(words) > 1, F.transform(pairs, lambda p: F.struct(p["0"].alias("source"), p["1"].alias("target"), F.lit("next").alias("relationship_name"))))


def test_a_folder_belongs_to_one_dataset(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    docs = frame(spark, {"a": ("Alpha", None, None, None)})
    engine.sync(DATA, docs)
    engine.store(DATA).note("manifest", '{"identity": 1}')
    with pytest.raises(DriftError, match="identity"):
        engine.sync(DATA, docs)


def test_little_is_written_for_little_changes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    docs = {f"k{i}": (f"Content{i} " * 50, None, None, None) for i in range(200)}
    engine.sync(DATA, frame(spark, docs))
    base = engine.store(DATA).state("raw")["base"]
    docs["k7"] = ("Other", None, None, None)
    del docs["k8"]
    assert engine.sync(DATA, frame(spark, docs)) == {"replace": 1, "delete": 1}
    now = engine.store(DATA).state("raw")
    assert now["base"] == base and spark.read.parquet(f"{engine.store(DATA).root}/raw/{now['layer']}").count() == 3
    assert_converged(engine, docs)


def test_faults_count_calls():
    fault = Fault(OSError("x"), times=2, after=1)
    fault()
    for _ in range(2):
        with pytest.raises(OSError):
            fault()
    fault()


def test_config():
    assert Processing(extras=(("b", "1"), ("a", "2"))).fingerprint == Processing(extras=(("a", "2"), ("b", "1"))).fingerprint
    prints = {Processing(**{k: v}).fingerprint for k, v in (("chunk_size", 5), ("prompt", "x"), ("model", "m"), ("temporal", True), ("schema", "s"), ("extractor", "e"), ("extras", (("a", "b"),)))}
    assert len(prints | {Processing().fingerprint}) == 8
    assert processing_of(Profile(prompt="")).fingerprint == processing_of(Profile()).fingerprint
    for bad in (dict(chunk_size=0), dict(temporal=True, prompt="x")):
        with pytest.raises(ValueError):
            Profile(**bad)
    with pytest.raises(TypeError):
        Profile(chunk_size=True)
    for bad in ((("a", "1"), ("a", "2")), ((" ", "1"),)):
        with pytest.raises(ValueError):
            Processing(extras=bad)
    with pytest.raises(ValueError):
        Dataset("rt", "docs", managed_by="nobody")


@pytest.mark.parametrize("kind", ["process", "file"])
def test_locks(tmp_path, kind):
    def make():
        return FileLocks(str(tmp_path), timeout=0.2) if kind == "file" else locks

    locks = ProcessLocks(timeout=0.2)
    with make().lock("s"), make().lock("other"):
        failed = []

        def take():
            try:
                with make().lock("s"):
                    pass
            except LockTimeout:
                failed.append(1)

        t = threading.Thread(target=take)
        t.start()
        t.join()
        assert failed
    with make().lock("s"):
        pass
    assert not locks._held and Engine(None, "a").locks is Engine(None, "b").locks
    with pytest.raises(ValueError), make().lock(""):
        pass


def test_store(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    assert store.version("t") is None and store.read("t", "a long").count() == 0
    store.write("t", spark.range(3).withColumnRenamed("id", "a"))
    store.write("t", store.read("t", "a long").where("a > 0"))
    assert store.read("t", "a long").count() == 2 and store.vacuum("t") == 1
    store.change("t", "a long", "a", spark.createDataFrame([(2,), (9,)], "a long"), spark.createDataFrame([(9,), (9,)], "a long"), share=100)
    assert sorted(r.a for r in store.read("t", "a long").collect()) == [1, 9, 9] and store.state("t")["layer"]
    store.change("t", "a long", "a", spark.createDataFrame([(9,), (1,)], "a long"), spark.createDataFrame([(1,)], "a long"), share=100)
    assert [r.a for r in store.read("t", "a long").collect()] == [1]
    store.change("t", "a long", "a", spark.createDataFrame([(5,)], "a long"), spark.createDataFrame([(5,)], "a long"), share=0)
    assert sorted(r.a for r in store.read("t", "a long").collect()) == [1, 5] and store.state("t")["layer"] is None
    assert store.vacuum("t") > 0 and store.names() == ["t"] and store.note("x") is None and store.note("x", "y") == store.note("x") == "y"


def test_doctor(spark, tmp_path):
    found = doctor.check(spark, str(tmp_path), 2, spark.createDataFrame([([1.0],)], "embedding array<double>"))
    assert not doctor.healthy(found) and doctor.healthy(doctor.check(spark, str(tmp_path)))
