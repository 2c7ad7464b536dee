from tidemark.engine import RAW, Engine
from tidemark.plans.config import Dataset
from tidemark.sources import files
from tidemark.streaming.live import CHANGES, follow, watch


def test_folder(spark, tmp_path):
    for name, text in {"one.md": "Harbours were dredged in spring.\n", "deep/er/two.md": "Nobody dredged the canal.\n", "three.txt": "Tide tables, second edition.\n", "skip.bin": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.external_key: r.content for r in files.folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"one.md", "deep/er/two.md", "three.txt"} and got["one.md"].startswith("Harbours")


def test_ledger(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1, "b": "x"}\n\n   \n{"a": 2}\n')
    assert sorted((r.a, r.b) for r in files.ledger(spark, str(tmp_path / "l.jsonl"), "a int, b string").collect()) == [(1, "x"), (2, None)]
    assert files.ledger(spark, str(tmp_path / "l.jsonl")).count() == 2


def test_live(spark, tmp_path):
    engine, data = Engine(spark, str(tmp_path / "state")), Dataset("rt", "live")

    def feed(n, rows):
        spark.createDataFrame([(*r, None, None, None, None) for r in rows], CHANGES).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in/*"))
        follow(engine, data, stream, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(r.content for r in engine.store(data).read("raw", RAW).collect())

    assert feed(1, [(1, "a", False, "Alpha"), (2, "b", False, "Beta"), (3, "a", False, "Alpha two")]) == ["Alpha two", "Beta"]
    assert feed(2, [(4, "b", True, None), (5, "c", None, "Gamma")]) == ["Alpha two", "Gamma"]
    assert feed(3, [(2, "c", False, "too late")]) == ["Alpha two", "Gamma"]
    assert feed(4, [(6, "caf\u00e9", False, "One"), (7, "cafe\u0301", False, "Two"), (8, "", False, "no key"), (9, "d", False, "Tie 1"), (9, "d", False, "Tie 2")])[:2] == ["Alpha two", "Gamma"]
    got = feed(5, [])
    assert "Two" in got and "One" not in got and len([t for t in got if t.startswith("Tie")]) == 1


def test_watched_folder(spark, tmp_path):
    engine, data, folder = Engine(spark, str(tmp_path / "state")), Dataset("rt", "watched"), tmp_path / "real"
    folder.mkdir()
    (tmp_path / "link").symlink_to(folder)
    root = str(tmp_path / "x" / ".." / "link")

    def look(seq):
        done = watch(engine, data, root, seq)
        return done, sorted((r.content) for r in engine.store(data).read("raw", RAW).collect())

    (folder / "a.md").write_text("Alpha")
    (folder / "b.md").write_text("Bravo")
    assert look(1) == ({"upsert": 2}, ["Alpha", "Bravo"])
    assert look(2) == ({}, ["Alpha", "Bravo"])
    (folder / "a.md").write_text("Alpha edited")
    (folder / "b.md").unlink()
    (folder / "c.md").write_text("Charlie")
    assert look(3) == ({"replace": 1, "delete": 1, "upsert": 1}, ["Alpha edited", "Charlie"])
