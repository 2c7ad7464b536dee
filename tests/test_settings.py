import json

import pytest

from tidemark.plans.config import Profile, processing_of
from tidemark.plans.settings import Settings, configured_inputs, ontology_digest, prompt_digest
from tidemark.sources import reports


def test_readers():
    s = Settings({"t": "x", "b": " ", "n": 2, "f": 0.5, "yes": True, "inf": float("inf"), "none": None, "neg": -1})
    assert (s.text("t"), s.number("n"), s.number("f"), s.count("n"), s.flag("yes"), s.text("none"), s.count("absent")) == ("x", 2.0, 0.5, 2, True, None, None)
    for call, error in ((lambda: s.text("n"), TypeError), (lambda: s.text("b", True), ValueError), (lambda: s.text("none", True), KeyError), (lambda: s.number("yes"), TypeError), (lambda: s.number("inf"), ValueError), (lambda: s.count("yes"), TypeError), (lambda: s.count("f"), TypeError), (lambda: s.count("neg"), ValueError), (lambda: s.flag("n"), TypeError)):
        with pytest.raises(error):
            call()


def test_inputs_by_content(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("one")
    b.write_text("two")
    assert prompt_digest(str(a)) != prompt_digest(str(b)) and ontology_digest(f"{a}, {b}") != ontology_digest(f"{b},{a}")
    for bad in ("", f"{a},,{b}", f"{a},"):
        with pytest.raises(ValueError):
            ontology_digest(bad)
    before = configured_inputs({"model": "m", "prompt_file": str(a), "model_args": {"temperature": 0.5, "timeout": 3}, "keep_case": None})
    assert [k for k, _ in before] == ["model", "model_args", "prompt_file"]
    assert before == configured_inputs({"prompt_file": str(a), "model": "m", "model_args": {"timeout": 9, "temperature": 0.5}})
    a.write_text("edited")
    assert before != configured_inputs({"model": "m", "prompt_file": str(a), "model_args": {"temperature": 0.5}})
    with pytest.raises(ValueError, match="colour"):
        configured_inputs({"colour": "x"})


def extract(text):
    return text


def test_processing_from_settings_and_schema():
    plain = processing_of(Profile(), settings={"model": "m"})
    assert plain.extras == (("model", "m"),) and processing_of(Profile(), settings={"model": "m"}, include_models=False).extras == ()
    before = processing_of(Profile(extractor=extract)).fingerprint
    extract.output_schema = lambda: {"type": "array"}
    assert processing_of(Profile(extractor=extract)).fingerprint != before
    extract.output_schema = lambda: 1 / 0
    with pytest.raises(ValueError, match="schema"):
        processing_of(Profile(extractor=extract))
    del extract.output_schema


def test_reports(spark, tmp_path):
    files = spark.createDataFrame([("src/a.py", 3), ("src/b.py", 4), ("docs/x.md", 5)], "path string, size long")
    text = reports.write_inventory(files, str(tmp_path / "out"))
    assert "| first-party source | 2 | 7 |" in text and (tmp_path / "out/summary.md").read_text() == text
    assert spark.read.json(str(tmp_path / "out/inventory")).count() == 3
    assert "| full | 1.5 |" in reports.write_measurements({"full": 1.5}, {"done": 1}, str(tmp_path / "m"))
    assert json.loads((tmp_path / "m.json").read_text())["environment"]["spark"]
    one, two = reports.corpus(spark, 5).collect(), reports.corpus(spark, 5, 2, 2).collect()
    assert [a == b for a, b in zip(one, two)] == [False, False, True, True, True]
