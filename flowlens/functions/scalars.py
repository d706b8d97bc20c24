"""Scalar functions as Column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A finite decimal number; casts alone also take Java literals such as 1d.
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
HEX = r"^[+-]?0[xX][0-9a-fA-F]+$"


def to_number(text: Column) -> Column:
    """Decimal or hexadecimal text to double; everything else, and what is not finite, is 0. Hex digits beyond 64 bits: 0."""
    t = F.trim(text)
    digits = F.regexp_replace(t, r"^[+-]?0[xX]", "")
    sign = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    hexed = F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 16, sign * F.conv(digits, 16, 10).cast("double"))
    number = F.when(t.rlike(HEX), hexed).when(t.rlike(DECIMAL), t.try_cast("double"))
    return finite_or_zero(number)


def finite_or_zero(x: Column) -> Column:
    """Null, NaN and infinities become 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def unix_to_iso(seconds: Column) -> Column:
    """Unix seconds as ISO-8601 text in UTC, whatever the session's zone."""
    shown = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.concat(F.date_format(shown, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def alert_window(timestamp: Column, seconds: int = 5) -> tuple[Column, Column]:
    """From `seconds` before an ISO time to it, as text; a time that cannot be read is both ends."""
    at = F.try_to_timestamp(timestamp)
    shown = F.regexp_replace(F.date_format(F.to_utc_timestamp(at, F.current_timezone()) - F.expr(f"INTERVAL {seconds} SECONDS"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), r"\.000Z$", "Z")
    return F.coalesce(shown, timestamp), timestamp


def event_id(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}%06d", number)


def category(text: Column, renamed: dict[str, str] | None = None) -> Column:
    """Trimmed category; known plurals in the singular; missing and the literal None are benign."""
    t = F.trim(text)
    out = F.when(t.isNull() | (t == "None"), F.lit("BENIGN"))
    for old, new in (renamed or {"Fuzzers": "Fuzzer", "Backdoors": "Backdoor"}).items():
        out = out.when(t == old, F.lit(new))
    return out.otherwise(t)


def alert_id(timestamp: Column, source: Column, prediction: Column, model: Column) -> Column:
    return F.concat_ws("-", timestamp, source, prediction, model)


def _normal(prediction: Column, *, word: str, whole: bool = False) -> Column:
    p = F.lower(F.trim(prediction))
    return p == word if whole else p.startswith(word)


def severity_scenario(prediction: Column, confidence: Column) -> Column:
    """critical from .9, warning from .7, else safe; what begins with normal is safe."""
    return F.when(_normal(prediction, word="normal"), "safe").when(confidence >= 0.9, "critical").when(confidence >= 0.7, "warning").otherwise("safe")


def severity_dashboard(prediction: Column, confidence: Column) -> Column:
    """As above with info from .4; what contains normal or benign is safe."""
    p = F.lower(prediction)
    calm = p.contains("normal") | p.contains("benign")
    return F.when(calm, "safe").when(confidence >= 0.9, "critical").when(confidence >= 0.7, "warning").when(confidence >= 0.4, "info").otherwise("safe")


def severity_mail(prediction: Column, confidence: Column) -> Column:
    """Only the word normal itself is exempt."""
    return F.when(_normal(prediction, word="normal", whole=True), "safe").when(confidence >= 0.9, "critical").when(confidence >= 0.7, "warning").otherwise("safe")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(3)


def decode(score: Column, threshold: float = 0.5) -> tuple[Column, Column]:
    """Predicted class and its confidence."""
    hit = score >= threshold
    return hit.cast("int"), F.when(hit, score).otherwise(1 - score)


def flood_signals() -> dict[str, Column]:
    """The five signals of the heuristic flood scorer, over the scenario's columns."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1.0))
    return {
        "syn_ack_ratio": ratio("syn_flag_count", "ack_flag_count") >= 4,
        "high_packet_rate": F.col("flow_packets_s") >= 140,
        "short_duration_burst": F.col("flow_duration_ms") <= 5000,
        "single_service_focus": F.col("same_srv_rate") >= 0.82,
        "forward_backward_imbalance": ratio("total_fwd_packets", "total_bwd_packets") >= 3,
    }


def flood_score() -> dict[str, Column]:
    """prediction, confidence and triggered (names of the signals that fired)."""
    fired = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flood_signals().items())), lambda x: x.isNotNull())
    k = F.size(fired)
    level = F.when(k >= 5, "SYN Flood - High Intensity").when(k == 4, "SYN Flood - Medium Intensity").when(k == 3, "SYN Flood - Low Intensity").otherwise("Normal Traffic")
    confidence = F.when(k >= 3, F.least(F.lit(0.99), 0.5 + 0.09 * k)).otherwise(F.greatest(F.lit(0.3), 0.62 - 0.08 * k))
    return {"prediction": level, "confidence": F.round(confidence.cast("double"), 2), "triggered": fired}
