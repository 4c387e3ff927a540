"""Types and constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The rulings and their reasons.
VERDICTS = ("approve", "reject")
REASONS = ("ok", "casing_error", "overcorrection", "meaning_change", "truncation_worse")
RETIRED_REASONS = ("truncation_worse",)
ACTIVE_REASONS = tuple(r for r in REASONS if r not in RETIRED_REASONS)
AXES = {"verdict": VERDICTS, "reason": REASONS}


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
COUNTS = T.MapType(S, L)

PAIR = _struct(("id", S), ("original", S), ("enriched", S), ("brand", S), ("mpn", S), ("ground_truth", S), ("reason", S))
USAGE = _struct(("prompt_tokens", L), ("completion_tokens", L), ("total_tokens", L), ("cached_tokens", L), ("reasoning_tokens", L))
VERDICT = _struct(
    ("pair_id", S), ("verdict", S), ("reason", S), ("model_id", S), ("prompt_version", S), ("temperature", D), ("run_index", L), ("reasoning_effort", S),
    ("usage", USAGE), ("base_url", S), ("config_digest", S), ("code_version", S),
)
VERDICT_KEYS = ("pair_id", "verdict", "reason", "model_id", "prompt_version", "temperature")  # those without a default
HEALTH = _struct(
    ("calls_ok", L), ("calls_failed", L), ("latency_min", D), ("latency_median", D), ("latency_p95", D), ("latency_max", D),
    ("failed_latency_median", D), ("failed_latency_max", D), ("error_kinds", COUNTS),
)
CUMULATIVE = _struct(("launches", L), ("calls_ok", L), ("calls_failed", L), ("error_kinds", COUNTS), ("discarded_prior_launches", L))
MANIFEST = _struct(
    ("backend", S), ("model_id", S), ("base_url", S), ("api", S), ("temperature", D), ("reasoning_effort", S), ("structured_output", S), ("votes", L),
    ("prompt_version", S), ("code_version", S), ("config_digest", S), ("prompt_variants", COUNTS), ("n_pairs", L), ("request_payload", S),
    ("observed_models", T.ArrayType(S)), ("health", HEALTH), ("usage", USAGE), ("launches", T.ArrayType(HEALTH)), ("cumulative", CUMULATIVE),
)
JOURNAL = _struct(("ts", S), ("session", S), ("pair_id", S), ("action", S), ("ground_truth", S), ("reason", S), ("notes", S), ("auto", B), ("elapsed_ms", L))

CONFIG_FIELDS = ("model_id", "prompt_version", "temperature", "reasoning_effort")
PROVENANCE_FIELDS = ("base_url", "config_digest", "code_version")
