"""What a dataset is processed with, and the fingerprint of all that shapes its derivatives."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from tidemark.functions.fingerprints import exact_json
from tidemark.functions.identity import require_coordinate, require_runtime_key
from tidemark.plans.settings import configured_inputs


@dataclass(frozen=True)
class Profile:
    """How documents are derived. An extractor takes a text Column and gives an array<string> Column of names."""

    extractor: Callable | None = None
    chunk_size: int | None = None
    prompt: str | None = None
    temporal: bool = False
    #: Edges of a text: a function of a text Column that gives an array of struct<source, target, relationship_name>.
    relations: Callable | None = None

    def __post_init__(self) -> None:
        if self.chunk_size is not None and (isinstance(self.chunk_size, bool) or not isinstance(self.chunk_size, int)):
            raise TypeError("chunk_size must be an integer")
        if self.chunk_size is not None and self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        if not isinstance(self.temporal, bool):
            raise TypeError("temporal must be a boolean")
        if self.temporal and (self.extractor is not None or self.prompt):
            raise ValueError("temporal processing has its own extractor and prompt")


def qualified_name(thing: object) -> str:
    return f"{thing.__module__}.{thing.__qualname__}"


@dataclass(frozen=True)
class Processing:
    """Settings that derivatives depend on; `extras` is for versions of code that no setting shows."""

    extractor: str = "tidemark.operators.derive.capitalized"
    relations: str | None = None
    schema: str = "array<string>"
    chunk_size: int = 1000
    prompt: str | None = None
    model: str = "rules"
    temporal: bool = False
    extras: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self) -> None:
        pairs = []
        for pair in self.extras:
            if not isinstance(pair, (tuple, list)) or len(pair) != 2 or not all(isinstance(x, str) for x in pair):
                raise TypeError("extras are pairs of strings")
            if not pair[0].strip() or "\0" in pair[0]:
                raise ValueError("names of extras must not be blank or hold NUL")
            pairs.append(tuple(pair))
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("names of extras must be unique")
        object.__setattr__(self, "extras", tuple(sorted(pairs)))

    @property
    def fingerprint(self) -> str:
        return exact_json({k: (dict(v) if k == "extras" else v) for k, v in vars(self).items()})


def schema_fingerprint(thing: object) -> str | None:
    """Of what a function's `output_schema` gives (JSON, or a Spark type); None if it has none. One that fails is an error: left out, a change of it would go unseen."""
    schema = getattr(thing, "output_schema", None)
    if schema is None:
        return None
    try:
        found = schema()
        return exact_json(found.jsonValue() if hasattr(found, "jsonValue") else found)
    except Exception as e:
        raise ValueError(f"the output schema of {qualified_name(thing)} could not be had") from e


def processing_of(profile: Profile, model: str = "rules", extras: tuple = (), settings: Mapping | None = None, include_models: bool = True) -> Processing:
    """All settings of a profile with what is not given filled in; an empty prompt is none. settings: what is configured elsewhere (settings.py); include_models=False leaves it out, for callers that track it themselves."""
    base = Processing()
    return Processing(
        extractor=qualified_name(profile.extractor) if profile.extractor else base.extractor,
        schema=schema_fingerprint(profile.extractor) or base.schema,
        relations=qualified_name(profile.relations) if profile.relations else None,
        chunk_size=profile.chunk_size or base.chunk_size,
        prompt=profile.prompt or None,
        model=model,
        temporal=profile.temporal,
        extras=(*extras, *(configured_inputs(settings) if settings and include_models else ())),
    )


@dataclass(frozen=True)
class Dataset:
    """The coordinates of a dataset. Managed by `system`: it goes when it is no longer declared; by `user`: it stays."""

    runtime_key: str
    name: str
    tenant: str = "default"
    scope: str = "local"
    managed_by: str = "system"

    def __post_init__(self) -> None:
        require_runtime_key(self.runtime_key)
        for what in ("name", "tenant", "scope"):
            require_coordinate(getattr(self, what), what)
        if self.managed_by not in ("system", "user"):
            raise ValueError("managed_by is system or user")

    @property
    def identity(self) -> tuple[str, str, str, str]:
        return self.runtime_key, self.scope, self.tenant, self.name
