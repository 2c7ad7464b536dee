"""Settings outside profiles that shape derivatives, read strictly and turned into pairs for `Processing.extras`.

A setting that isn't known is refused: whether derivatives depend on it can't be guessed. Prompts and
ontologies count by their content, model arguments by their canonical form.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from pathlib import Path

from tidemark.functions.fingerprints import blake2b, exact_json
from tidemark.functions.modelargs import canonical

#: Settings and how they are read.
KNOWN = {
    "model_provider": "text",
    "model": "text",
    "model_args": "arguments",
    "temperature": "number",
    "embedding_model": "text",
    "embedding_width": "count",
    "chunk_overlap": "number",
    "prompt_file": "prompt",
    "ontology_files": "ontology",
    "keep_case": "flag",
}


def digest_text(text: str) -> str:
    return blake2b(b"t\0" + text.encode())


def digest_bytes(data: bytes) -> str:
    return blake2b(b"d\0" + data)


def prompt_digest(path: str) -> str:
    """Of the file's text."""
    return digest_text(Path(path).read_text(encoding="utf-8"))


def ontology_digest(paths: str) -> str:
    """Of the contents of files whose paths are separated by commas, in their order."""
    names = [p.strip() for p in paths.split(",")]
    if not all(names):
        raise ValueError("an ontology path is empty")
    return exact_json([digest_bytes(Path(p).read_bytes()) for p in names])


class Settings:
    """Strict readers of a mapping; `required` ones raise KeyError where a value is absent or null, others give None."""

    def __init__(self, values: Mapping[str, object]):
        self.values = values

    def _get(self, name: str, required: bool) -> object:
        value = self.values.get(name)
        if value is None and required:
            raise KeyError(f"the setting {name} is required")
        return value

    def text(self, name: str, required: bool = False) -> str | None:
        value = self._get(name, required)
        if value is not None and not isinstance(value, str):
            raise TypeError(f"{name} must be text")
        if value is not None and required and not value.strip():
            raise ValueError(f"{name} must not be blank")
        return value

    def number(self, name: str, required: bool = False) -> float | None:
        value = self._get(name, required)
        if value is None:
            return None
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"{name} must be a number")
        if not math.isfinite(value):
            raise ValueError(f"{name} must be finite")
        return float(value)

    def count(self, name: str, required: bool = False) -> int | None:
        value = self._get(name, required)
        if value is None:
            return None
        if isinstance(value, bool) or not isinstance(value, int):
            raise TypeError(f"{name} must be an integer")
        if value <= 0:
            raise ValueError(f"{name} must be positive")
        return value

    def flag(self, name: str, required: bool = False) -> bool | None:
        value = self._get(name, required)
        if value is not None and not isinstance(value, bool):
            raise TypeError(f"{name} must be a boolean")
        return value

    def read(self, name: str) -> str | None:
        """A known setting as the text that stands for it in fingerprints."""
        kind = KNOWN[name]
        if kind in ("prompt", "ontology"):
            path = self.text(name)
            return path and (prompt_digest if kind == "prompt" else ontology_digest)(path)
        if kind == "arguments":
            value = canonical(self._get(name, False))
            return exact_json(value) if value else None
        value = getattr(self, kind)(name)
        return None if value is None else str(value)


def configured_inputs(values: Mapping[str, object]) -> tuple[tuple[str, str], ...]:
    """Pairs of all settings that have a value, by name."""
    unknown = sorted(set(values) - set(KNOWN))
    if unknown:
        raise ValueError(f"settings that may shape derivatives are unknown: {', '.join(unknown)}")
    read = Settings(values)
    return tuple((name, got) for name in sorted(values) if (got := read.read(name)) is not None)
