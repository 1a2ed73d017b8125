"""The engine's entry points: one decision for each row, as a caller sees it.

A layer's decision reaches the caller only if it blocks or quarantines; what asks
or sanitizes stays within the layer and the caller gets ``allow``.  Layers run in
order, and the first that blocks decides.  Operators give layer decisions; these
functions turn them into the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.screens import Screen
from threatloom.operators import code, definitions, images, memory, outputs, prompts, reasoning, requests, sessions, tools, transactions
from threatloom.operators.detection import ALLOW, BLOCK, DETECTIONS, detection, is_blocked, where
from threatloom.operators.settings import DEFAULT, Settings
from threatloom.sources.catalog import Signature, catalog_detections, screen_test

def masked(decisions: DataFrame, layer: str) -> DataFrame:
    """Decisions as the caller sees them, with the ``layer`` that decided."""
    kept = is_blocked(F.col("verdict"))
    return (
        decisions.withColumn("layer", F.when(kept, F.lit(layer)).otherwise(F.lit("facade")))
        .withColumn("detections", F.when(kept, F.col("detections")).otherwise(F.array().cast(DETECTIONS)))
        .withColumn("verdict", F.when(kept, F.col("verdict")).otherwise(F.lit(ALLOW)))
        .withColumn("threat_count", F.size("detections"))
    )


def fail_closed(decisions: DataFrame, error: Column, settings: Settings = DEFAULT, always: bool = False) -> DataFrame:
    """Rows whose check failed (``error`` not null) are blocked, or allowed if
    failures may pass; ``always`` for layers that never let them."""
    failed = error.isNotNull()
    closed = settings.fail_closed or always
    one = F.array(detection("SYS-FAIL-CLOSED", "behavioral_anomaly", "critical", BLOCK, "A check failed; the request is blocked", error, "system", 1.0)).cast(DETECTIONS)
    call = F.lit(BLOCK if closed else ALLOW)
    return decisions.withColumn("detections", F.when(failed, one if closed else F.array().cast(DETECTIONS)).otherwise(F.col("detections"))).withColumn("verdict", F.when(failed, call).otherwise(F.col("verdict"))).withColumn("threat_count", F.size("detections"))


def check_prompts(df: DataFrame, signatures: list[Signature], settings: Settings = DEFAULT, text_col: str = "text", session_col: str | None = None, ts_col: str = "ts", id_col: str = "prompt_id") -> DataFrame:
    """With ``session_col``, conversations are folded too: rows of a session are
    brought together once for that, with their scores only, and joined by id."""
    text, categories = F.coalesce(F.col(text_col), F.lit("")), ["prompt_injection", "indirect_injection"]
    screen = Screen(**prompts.TESTS, catalog=screen_test(signatures, categories))
    found = where(screen.seen("catalog"), catalog_detections(text, signatures, categories))
    if session_col is None:
        return masked(prompts.check_prompts(screen.over(df, text), text_col, settings, found, screen=screen), prompts.LAYER).drop(screen.COLUMN)
    fold = sessions.escalation(df, session_col, ts_col, text_col, id_col).select(F.col(session_col).alias("_session"), F.col(id_col).alias("_prompt"), F.col("level").alias("_rise"), F.col("cumulative").alias("_sum"))
    both = df.join(fold, F.col(session_col).eqNullSafe(F.col("_session")) & (F.col(id_col) == F.col("_prompt")), "left")
    rises = sessions.crescendo_detections(F.col("_rise"), F.col("_sum"))
    out = prompts.check_prompts(screen.over(both, text), text_col, settings, F.concat(found, rises), screen=screen)
    return masked(out.drop("_session", "_prompt", "_rise", "_sum", screen.COLUMN), prompts.LAYER)


def check_requests(df: DataFrame, settings: Settings = DEFAULT, agent_col: str | None = None, instance_col: str | None = None) -> DataFrame:
    return requests.check_requests(df, settings, agent_col, instance_col).withColumn("layer", F.lit(requests.LAYER))


def check_tool_calls(df: DataFrame, policy: DataFrame, signatures: list[Signature], settings: Settings = DEFAULT, real_path_col: str | None = None) -> DataFrame:
    """Calls with ``params``; the catalog reads their values, joined by spaces.
    ``real_path_col`` names where a call's path leads, if the host resolved it."""
    found = catalog_detections(F.coalesce(F.array_join(F.map_values("params"), " "), F.lit("")), signatures, ["tool_exploitation"])
    return masked(tools.check_tool_calls(df, policy, settings, found, real_path_col), tools.LAYER)


def check_memory_writes(df: DataFrame, signatures: list[Signature], settings: Settings = DEFAULT, **columns: str) -> DataFrame:
    found = catalog_detections(F.coalesce(F.col(columns.get("content_col", "content")), F.lit("")), signatures, ["memory_poisoning"])
    return memory.check_writes(df, settings=settings, catalog=found, **columns).withColumn("layer", F.lit(memory.LAYER))


def check_memory_recalls(df: DataFrame, memories_col: str = "memories") -> DataFrame:
    return memory.check_recalls(df, memories_col).withColumn("layer", F.lit(memory.LAYER))


def python_float(x: Column) -> Column:
    """A number as Python writes it: Spark writes the same digits, but begins with
    exponents at 1e7 and below 1e-3, and without a sign or a second digit."""
    x = x.cast("double")
    text = x.cast("string")
    part = lambda k: F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E(-?\d+)$", k)
    power = part(4).try_cast("int")
    rest = F.when(part(3) == "0", "").otherwise(part(3))
    digits = F.rpad(rest, F.greatest(power, F.length(rest)), "0")
    after = F.substring(digits, power + 1, F.length(digits))
    large = F.concat(part(1), part(2), F.substring(digits, F.lit(1), power), F.lit("."), F.when(after == "", "0").otherwise(after))
    small = F.concat(part(1), F.lit("0."), F.repeat(F.lit("0"), -power - 1), part(2), rest)
    far = F.concat(part(1), part(2), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    return F.when(power.isNull(), text).when((power >= 16) | (power < -4), far).when(power >= 0, large).otherwise(small)


def transaction_text(df: DataFrame) -> Column:
    """What the catalog reads of a transaction."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(" ", word("tx_type"), word("to_address"), python_float(F.coalesce(F.col("amount_usd"), F.lit(0.0))), word("function_sig"), word("contract_data"))


def check_transactions(df: DataFrame, approvals: DataFrame, blocked: DataFrame, allowed: DataFrame, signatures: list[Signature], account_col: str, settings: Settings = DEFAULT) -> DataFrame:
    found = catalog_detections(transaction_text(df), signatures, ["wallet_attack"])
    return transactions.check_transactions(df, approvals, blocked, allowed, account_col, settings, found).withColumn("layer", F.lit(transactions.LAYER))


def check_images(df: DataFrame, signatures: list[Signature], settings: Settings = DEFAULT, alt_col: str = "alt_text") -> DataFrame:
    """As a caller sees it, an image is its alternative text, checked as a prompt."""
    return check_prompts(df, signatures, settings, alt_col)


def scan_images(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """All of an image's texts and its size."""
    return images.check_images(df, settings).withColumn("layer", F.lit(images.LAYER))


def scan_tool_definitions(df: DataFrame) -> DataFrame:
    """The clean definitions, in the order in which their servers register them."""
    return definitions.scanned(df).where("clean")


def session_risk(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return sessions.latest_risk(sessions.anomaly(events, settings=settings))


def check_outputs(df: DataFrame, signatures: list[Signature], settings: Settings = DEFAULT, text_col: str = "text", url_col: str | None = None, goal_col: str | None = None, canaries: DataFrame | None = None, id_col: str = "output_id", session_col: str = "session_id") -> DataFrame:
    """The output guard, then the reasoning auditor.  ``canaries`` are ``session_id,
    token``; outputs that hold one are joined by their id."""
    canary = None
    if canaries is not None:
        leaks = outputs.canary_leaks(df, canaries, id_col, session_col, text_col).select(F.col(id_col).alias("_leak_id"), F.col("signature_id").alias("_leak"), F.col("token").alias("_token"))
        df = df.join(leaks, F.col(id_col) == F.col("_leak_id"), "left")
        canary = outputs.canary_detections(F.col("_leak"), F.col("_token"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    screen = Screen(**outputs.TESTS, **reasoning.TESTS, catalog=screen_test(signatures, ["data_exfiltration"]))
    found = where(screen.seen("catalog"), catalog_detections(text, signatures, ["data_exfiltration"]))
    first = outputs.check_outputs(screen.over(df, text), text_col, url_col, settings, found, canary, screen)
    if canary is not None:
        first = first.drop("_leak_id", "_leak", "_token")
    goal = F.col(goal_col) if goal_col else None
    second = reasoning.reasoning_detections(text, goal, screen.seen)
    both = first.withColumn("_second", F.when(~is_blocked(F.col("verdict")), second).otherwise(F.array().cast(DETECTIONS)))
    call = reasoning.verdict(F.col("_second"), settings)
    blocked = is_blocked(F.col("verdict"))
    out = both.withColumn("detections", F.when(blocked, F.col("detections")).otherwise(F.col("_second"))).withColumn("layer", F.when(blocked, outputs.LAYER).otherwise(reasoning.LAYER))
    out = out.withColumn("verdict", F.when(blocked, F.col("verdict")).otherwise(call)).drop("_second", screen.COLUMN)
    seen = is_blocked(F.col("verdict"))
    return out.withColumn("layer", F.when(seen, F.col("layer")).otherwise("facade")).withColumn("detections", F.when(seen, F.col("detections")).otherwise(F.array().cast(DETECTIONS))).withColumn("verdict", F.when(seen, F.col("verdict")).otherwise(ALLOW)).withColumn("threat_count", F.size("detections"))


def check_documents(df: DataFrame, signatures: list[Signature], settings: Settings = DEFAULT, text_col: str = "text") -> DataFrame:
    found = catalog_detections(F.coalesce(F.col(text_col), F.lit("")), signatures, ["memory_poisoning"])
    return memory.check_documents(df, text_col, settings, found).withColumn("layer", F.lit(memory.LAYER))


def check_code(df: DataFrame, settings: Settings = DEFAULT, code_col: str = "code") -> DataFrame:
    return code.check_code(df, code_col, settings).withColumn("layer", F.lit(code.LAYER))


def check_reasoning(df: DataFrame, settings: Settings = DEFAULT, trace_col: str = "trace", goal_col: str | None = None) -> DataFrame:
    return reasoning.check_reasoning(df, trace_col, goal_col, settings).withColumn("layer", F.lit(reasoning.LAYER))


def as_json(decisions: DataFrame) -> DataFrame:
    """Decisions as JSON strings, for callers that want text."""
    kept = [c for c in ("verdict", "threat_count", "max_threat_level", "is_blocked", "detections", "sanitized", "layer") if c in decisions.columns]
    return decisions.withColumn("decision", F.to_json(F.struct(*kept)))


def strict_block(decisions: DataFrame, strict: bool) -> DataFrame:
    """Adds ``stop``: blocked, or in strict mode anything from medium up."""
    return decisions.withColumn("stop", is_blocked(F.col("verdict")) | (F.lit(strict) & F.col("max_threat_level").isin("medium", "high", "critical")))
