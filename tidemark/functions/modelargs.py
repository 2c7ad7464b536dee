"""Which arguments of a model call shape its output, and their canonical form for fingerprints.

An argument is `generation` (kept whole), `excluded` (transport, credentials, limits: dropped) or `nested`
(looked into). Names that look like secrets but are not known are refused, as are addresses under unknown
names: dropping or keeping them silently would be wrong.
"""

from __future__ import annotations

import enum
import math
import re
from collections.abc import Iterator, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names as model services use them.
GENERATION = [
    "additional_drop_params", "allowed_openai_params", "api_version", "audio", "candidate_count", "context_management",
    "custom_llm_provider", "do_sample", "drop_params", "frequency_penalty", "function_call", "functions", "guided_choice",
    "guided_decoding_backend", "guided_grammar", "guided_json", "guided_regex", "include_server_side_tool_invocations", "length_penalty",
    "logit_bias", "logprobs", "max_completion_tokens", "max_new_tokens", "max_output_tokens", "max_tokens", "min_p", "modalities",
    "mock_response", "mock_tool_calls", "n", "num_beams", "parallel_tool_calls", "prediction", "presence_penalty", "reasoning_effort",
    "repetition_penalty", "response_format", "safety_settings", "seed", "stop", "temperature", "thinking", "tool_choice", "tools", "top_k",
    "top_logprobs", "top_p", "typical_p", "verbosity", "web_search_options",
]
NESTED = [
    "context_window_fallback_dict", "context_window_fallbacks", "extra_body", "fallbacks", "model_alias_map", "provider_options",
]
EXCLUDED = [
    "acompletion", "api_base", "api_key", "apikey", "auth", "authentication", "authorization", "aws_access_key_id",
    "aws_bedrock_project_id", "aws_bedrock_runtime_endpoint", "aws_external_id", "aws_profile_name", "aws_region_name", "aws_role_name",
    "aws_secret_access_key", "aws_session_name", "aws_session_token", "aws_sts_endpoint", "aws_web_identity_token", "azure_ad_token",
    "azure_password", "azure_scope", "azure_username", "base_url", "batch_size", "bearer_token", "client", "client_id", "client_secret",
    "completion_call_id", "cookie", "cookies", "cooldown_time", "default_headers", "deployment_id", "enable_json_schema_validation",
    "endpoint", "extra_headers", "force_timeout", "gcs_bucket_name", "headers", "http_proxy", "https_proxy", "idempotency_key",
    "input_cost_per_second", "input_cost_per_token", "itpm", "litellm_call_id", "litellm_credential_name", "litellm_logging_obj",
    "litellm_session_id", "litellm_trace_id", "logger_fn", "max_budget", "max_parallel_requests", "max_retries", "metadata", "mock_delay",
    "mock_timeout", "model_info", "model_list", "no_log", "num_retries", "organization", "otpm", "output_cost_per_second",
    "output_cost_per_token", "parallel", "parallelism", "password", "port", "preset_cache_key", "prompt_cache_key",
    "prompt_cache_retention", "provider_specific_header", "proxy", "proxy_server_request", "request_timeout", "routing_key", "rpm",
    "safety_identifier", "service_tier", "shared_session", "ssl_verify", "store", "stream", "stream_options", "stream_timeout", "tenant_id",
    "timeout", "tpm", "traceparent", "user", "verbose", "vertex_ai_credentials", "vertex_ai_location", "vertex_ai_project",
    "vertex_credentials", "vertex_location", "vertex_project",
]
EXCLUDED_WORDS = [
    "apikey", "auth", "authentication", "authorization", "batch", "certificate", "concurrency", "cookie", "cookies", "credential",
    "credentials", "endpoint", "header", "headers", "host", "logger", "logging", "parallelism", "password", "port", "proxy", "retry",
    "retries", "secret", "stream", "streaming", "telemetry", "timeout", "trace", "tracing", "uri", "url", "worker", "workers",
]
EXCLUDED_PHRASES = [
    "access_key", "access_token", "api_base", "api_key", "auth_token", "base_url", "bearer_token", "cache_key", "csrf_token",
    "encryption_key", "id_token", "idempotency_key", "log_file", "log_format", "log_handler", "log_level", "log_path", "parallel_requests",
    "private_key", "public_key", "rate_limit", "refresh_token", "routing_key", "secret_key", "session_token", "web_identity_token",
]
SECRET_ENDINGS = ("key", "token")

#: One pattern for all excluded words and phrases, between the underscores of a normal name.
EXCLUDED_PATTERN = "(?:^|_)(?:" + "|".join([*EXCLUDED_WORDS, *EXCLUDED_PHRASES]) + ")(?:_|$)"
SECRET_PATTERN = "(?:^|_)(?:" + "|".join(SECRET_ENDINGS) + ")$"


def normal_name(name: str) -> str:
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    split = re.sub(r"([A-Z])(?=[A-Z][a-z])", r"\1_", split)
    return re.sub(r"[^a-z0-9]+", "_", split.lower()).strip("_")


def kind(name: str) -> str:
    """generation, nested or excluded; ValueError for names that look like unknown secrets."""
    n = normal_name(name)
    for known, names in (("generation", GENERATION), ("nested", NESTED), ("excluded", EXCLUDED)):
        if n in names:
            return known
    if re.search(EXCLUDED_PATTERN, n):
        return "excluded"
    if re.search(SECRET_PATTERN, n):
        raise ValueError(f"argument {name!r} looks like a secret and is unknown; classify it first")
    return "nested"


def kind_column(name: Column) -> Column:
    """kind() as an expression; `refused` where it raises."""
    n = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    n = F.regexp_replace(n, "([A-Z])(?=[A-Z][a-z])", "$1_")
    n = F.regexp_replace(F.regexp_replace(F.lower(n), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return (
        F.when(n.isin(GENERATION), "generation").when(n.isin(NESTED), "nested").when(n.isin(EXCLUDED), "excluded")
        .when(n.rlike(EXCLUDED_PATTERN), "excluded").when(n.rlike(SECRET_PATTERN), "refused").otherwise("nested")
    )


def canonical(args: Mapping | None) -> dict:
    """The arguments that shape output: leaves with their paths, those kept that no excluded name leads to, and a new whole of them; containers that only held dropped ones go too."""
    if args is None:
        return {}
    if not isinstance(args, Mapping):
        raise TypeError("model arguments must be a mapping")
    kept = [(path, _checked(leaf, fate)) for path, leaf in _leaves(args, ()) if (fate := _fate(path)) != "excluded"]
    return _whole([(path, leaf) for path, leaf in kept if path])


def _leaves(value: object, path: tuple) -> Iterator[tuple[tuple, object]]:
    """Scalars and empty containers, each with its path: ("name", key) and ("item", index) steps."""
    value = value.value if isinstance(value, enum.Enum) else value
    if isinstance(value, Mapping) and value:
        for name, item in value.items():
            yield from _leaves(item, (*path, ("name", name)))
    elif isinstance(value, (list, tuple)) and value:
        for i, item in enumerate(value):
            yield from _leaves(item, (*path, ("item", i)))
    else:
        yield path, value


def _fate(path: tuple) -> str:
    """The kind of the first name that decides: excluded, or generation, under which all is kept."""
    for step, name in path:
        if step == "name":
            if not isinstance(name, str):
                raise TypeError("names of model arguments must be strings")
            if (what := kind(name)) != "nested":
                return what
    return "nested"


def _checked(leaf: object, fate: str) -> object:
    if isinstance(leaf, str) and fate == "nested" and re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", leaf.strip()):
        raise ValueError("an address stands under an unknown argument; classify it first")
    if isinstance(leaf, float) and not math.isfinite(leaf):
        raise ValueError("model arguments must be finite")
    if isinstance(leaf, Mapping):
        return {}
    if isinstance(leaf, (list, tuple)):
        return []
    if leaf is None or isinstance(leaf, (bool, int, float, str)):
        return leaf
    raise TypeError(f"model arguments hold a {type(leaf).__name__}")


def _whole(leaves: list[tuple[tuple, object]]) -> dict:
    """Containers anew from leaves with their paths; items of lists close ranks."""
    made: dict[tuple, dict | list] = {(): {}}
    for path, leaf in leaves:
        for i, (step, name) in enumerate(path):
            here, above = path[: i + 1], made[path[:i]]
            if here in made:
                continue
            value = leaf if i == len(path) - 1 else {} if path[i + 1][0] == "name" else []
            if i < len(path) - 1:
                made[here] = value
            if step == "name":
                above[name] = value
            else:
                above.append(value)
    return made[()]
