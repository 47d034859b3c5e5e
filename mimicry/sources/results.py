"""Capture results written by an untrusted visitor: checked field by field on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mimicry.config import CAPTURE_STATUSES
from mimicry.functions.hostnames import candidate_urls
from mimicry.session import computed_once
from mimicry.sources.tables import SIGNALS

# The bounds a result must keep.
MAX_URL, MAX_TITLE, MAX_ERROR, MAX_HOST, MAX_PATH, MAX_NAME = 2100, 300, 2000, 253, 300, 300
MAX_FORM_TARGETS, MAX_COUNT, MAX_DURATION_MS = 50, 10_000, 86_400_000
HTTP_STATUS_MIN, HTTP_STATUS_MAX = 100, 599

_FIELDS = {
    "fqdn": "string", "url": "string", "status": "string", "captured_at": "string",
    "duration_ms": "bigint", "final_url": "string", "http_status": "int",
    "screenshot_path": "string", "html_path": "string", "signals": SIGNALS, "error": "string",
}
_REQUIRED = ("fqdn", "url", "status", "captured_at", "duration_ms")
_SIGNAL_FIELDS = (
    "title", "form_count", "has_password_input", "has_credential_field",
    "cross_domain_form_targets", "iframe_count", "password_input_count",
)
_SIGNAL_COUNTS = ("form_count", "iframe_count", "password_input_count")


def bound_results(results: DataFrame) -> DataFrame:
    """Cut a visitor's own record to the bounds, so an odd page keeps its result."""
    s = F.col("signals")
    status = F.col("http_status")
    odd = status.isNotNull() & ~status.between(HTTP_STATUS_MIN, HTTP_STATUS_MAX)
    note = F.concat_ws(
        "; ", F.when(odd, F.concat(F.lit("non-standard HTTP status "), status)), F.col("error")
    )
    signals = F.struct(
        F.substring(s["title"], 1, MAX_TITLE).alias("title"),
        F.least(s["form_count"], F.lit(MAX_COUNT)).alias("form_count"),
        s["has_password_input"].alias("has_password_input"),
        s["has_credential_field"].alias("has_credential_field"),
        F.transform(
            F.slice(s["cross_domain_form_targets"], 1, MAX_FORM_TARGETS),
            lambda h: F.substring(h, 1, MAX_HOST),
        ).alias("cross_domain_form_targets"),
        F.least(s["iframe_count"], F.lit(MAX_COUNT)).alias("iframe_count"),
        F.least(s["password_input_count"], F.lit(MAX_COUNT)).alias("password_input_count"),
    )
    return results.withColumns(
        {
            "error": F.substring(F.nullif(note, F.lit("")), 1, MAX_ERROR),
            "http_status": F.when(~odd, status),
            "final_url": F.substring("final_url", 1, MAX_URL),
            "screenshot_path": F.replace(F.col("screenshot_path"), F.lit("\\"), F.lit("/")),
            "html_path": F.replace(F.col("html_path"), F.lit("\\"), F.lit("/")),
            "signals": F.when(s.isNotNull(), signals),
        }
    )


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _given(name: str) -> Column:
    """The line has the field, and not as null."""
    return F.array_contains("given", name)


def _faults(r: Column) -> list[Column]:
    keys, given = F.col("keys"), F.col("given")
    known, needed = F.array(*map(F.lit, _FIELDS)), F.array(*map(F.lit, _REQUIRED))
    limits = {
        "fqdn": MAX_NAME, "url": MAX_URL, "final_url": MAX_URL, "error": MAX_ERROR,
        "screenshot_path": MAX_PATH, "html_path": MAX_PATH,
    }
    at = r["captured_at"]
    zoned = at.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(at).isNotNull()
    return [
        F.size(F.array_except(keys, known)),
        F.size(F.array_except(needed, given)),
        *[_flag(_given(n) & r[n].isNull()) for n in _FIELDS if n != "signals"],
        *[_flag(F.length(r[n]) > limit) for n, limit in limits.items()],
        _flag(~r["duration_ms"].between(0, MAX_DURATION_MS)),
        _flag(~r["http_status"].between(HTTP_STATUS_MIN, HTTP_STATUS_MAX)),
        _flag(~r["status"].isin(*CAPTURE_STATUSES)),
        _flag(at.isNotNull() & ~zoned),
        F.when(_given("signals"), _total(_signal_faults(r["signals"]))).otherwise(F.lit(0)),
    ]


def _signal_faults(s: Column) -> list[Column]:
    keys, given = F.col("signal_keys"), F.col("signals_given")
    known = F.array(*map(F.lit, _SIGNAL_FIELDS))
    needed = F.array(*[F.lit(f) for f in _SIGNAL_FIELDS if f != "title"])
    targets = s["cross_domain_form_targets"]
    return [
        _flag(keys.isNull()),
        F.coalesce(F.size(F.array_except(keys, known)), F.lit(0)),
        F.coalesce(F.size(F.array_except(needed, given)), F.lit(0)),
        *[_flag(F.array_contains(given, n) & s[n].isNull()) for n in _SIGNAL_FIELDS],
        *[_flag(~s[n].between(0, MAX_COUNT)) for n in _SIGNAL_COUNTS],
        _flag(F.length(s["title"]) > MAX_TITLE),
        _flag(F.size(targets) > MAX_FORM_TARGETS),
        _flag(F.exists(targets, lambda h: F.length(h) > MAX_HOST)),
    ]


def _total(faults: list[Column]) -> Column:
    return F.aggregate(F.array(*faults), F.lit(0), lambda acc, n: acc + n)


def _non_null(document: Column, keys: Column, names: tuple[str, ...]) -> Column:
    """Those of ``names`` the JSON object has with a value."""
    values = {n: F.try_variant_get(document, f"$.{n}", "variant") for n in names}
    present = [
        F.when(value.isNotNull() & ~F.is_variant_null(value), F.lit(n))
        for n, value in values.items()
    ]
    return F.when(keys.isNotNull(), F.array_compact(F.array(*present)))


def inside_folder(path: Column) -> Column:
    """A relative path that does not climb out of its folder."""
    return F.coalesce(
        (path != "") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)|^[A-Za-z]:|\\"),
        F.lit(False),
    )


_RESULT = (
    "url", "status", "captured_at", "duration_ms", "final_url", "http_status",
    "screenshot_path", "html_path", "signals", "error",
)


def judge_results(
    lines: DataFrame, targets: DataFrame, schemes: tuple[str, ...] = ("https", "http")
) -> DataFrame:
    """Each non-blank line (``value``, ``line_no``) as a result with its own ``reason``.

    A result is acceptable for a host of ``targets`` (column ``fqdn``), at a URL the host
    would be visited at, with every field typed and bounded and no others.
    """
    schema = ", ".join(f"{name} {kind}" for name, kind in _FIELDS.items())
    r, v = F.col("r"), F.col("v")
    read = computed_once(
        lines.where(F.trim("value") != ""),
        v=F.try_parse_json("value"),
        r=F.from_json("value", schema),
        keys=F.json_object_keys("value"),
        signal_keys=F.json_object_keys(F.get_json_object("value", "$.signals")),
    )
    signals = F.try_variant_get(v, "$.signals", "variant")
    read = computed_once(
        read,
        given=_non_null(v, F.col("keys"), tuple(_FIELDS)),
        signals_given=_non_null(signals, F.col("signal_keys"), _SIGNAL_FIELDS),
    )
    is_object = v.isNotNull() & F.col("keys").isNotNull()
    judged = computed_once(read, faults=F.when(is_object, _total(_faults(r))).otherwise(F.lit(1)))
    checked = judged.withColumn("fqdn", F.when(F.col("faults") == 0, r["fqdn"]))
    asked = targets.select(F.col("fqdn").alias("asked")).distinct()
    known = checked.join(asked, F.col("fqdn") == F.col("asked"), "left")
    at_home = F.array_contains(candidate_urls(F.col("fqdn"), schemes), r["url"])
    ok = r["status"] == "ok"
    shown = ~ok | inside_folder(r["screenshot_path"])
    faults = F.concat(F.col("faults").cast("string"), F.lit(" invalid field(s)"))
    return known.select(
        "line_no",
        "fqdn",
        F.col("asked").isNotNull().alias("asked"),
        F.when(F.col("faults") > 0, faults)
        .when(F.col("asked").isNull(), F.lit("hostname the job did not ask for"))
        .when(~at_home, F.lit("URL is not one this hostname would be visited at"))
        .when(~shown, F.lit("screenshot missing or outside the capture directory"))
        .alias("reason"),
        F.struct(
            r["url"].alias("url"),
            r["status"].alias("status"),
            F.try_to_timestamp(r["captured_at"]).alias("captured_at"),
            r["duration_ms"].alias("duration_ms"),
            r["final_url"].alias("final_url"),
            r["http_status"].alias("http_status"),
            F.when(ok, r["screenshot_path"]).alias("screenshot_path"),
            F.when(ok & inside_folder(r["html_path"]), r["html_path"]).alias("html_path"),
            r["signals"].alias("signals"),
            r["error"].alias("error"),
        ).alias("result"),
    )


def accepted_results(judged: DataFrame) -> DataFrame:
    """The first acceptable line of each host.

    An aggregate: a host returned millions of times costs each task one row.
    """
    fine = judged.where("reason IS NULL")
    first = fine.groupBy("fqdn").agg(F.min_by("result", "line_no").alias("__result"))
    return first.select("fqdn", *[F.col(f"__result.{name}").alias(name) for name in _RESULT])


def rejected_lines(judged: DataFrame) -> DataFrame:
    """(line_no, reject_reason): unacceptable lines, and any after a host's accepted one."""
    fine = judged.where("reason IS NULL").select("fqdn", "line_no")
    first = fine.groupBy(F.col("fqdn").alias("first_fqdn")).agg(
        F.min("line_no").alias("first_line")
    )
    lines = judged.select("line_no", "fqdn", "asked", "reason")
    later = F.col("asked") & (F.col("line_no") > F.col("first_line"))
    reason = F.when(later, F.lit("second result for the same hostname")).otherwise(F.col("reason"))
    return (
        lines.join(first, F.col("fqdn") == F.col("first_fqdn"), "left")
        .select("line_no", reason.alias("reject_reason"))
        .where("reject_reason IS NOT NULL")
    )
