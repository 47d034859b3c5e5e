"""Verdicts: rules over page signals, model replies, and visit attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mimicry.config import LABELS
from mimicry.functions.hostnames import candidate_urls, is_valid_hostname
from mimicry.functions.rounding import round_binary
from mimicry.operators.signals import has_login_form
from mimicry.session import computed_once

VERDICT = "struct<label:string,confidence:double,brand_impersonated:string,evidence:string>"

# Bounds of a reply and the words that mean "no brand".
MAX_BRAND, MAX_EVIDENCE = 200, 1000
NO_BRAND = ("", "none", "null", "n/a")

# Browser error texts by the status they stand for.
DNS_ERRORS = ("ERR_NAME_NOT_RESOLVED", "ERR_NAME_RESOLUTION_FAILED", "getaddrinfo")
CONNECTION_ERRORS = (
    "ERR_CONNECTION_REFUSED", "ERR_CONNECTION_RESET", "ERR_CONNECTION_CLOSED",
    "ERR_CONNECTION_FAILED", "ERR_CONNECTION_TIMED_OUT", "ERR_ADDRESS_UNREACHABLE",
    "ERR_EMPTY_RESPONSE", "ERR_SSL", "ERR_CERT", "ERR_SOCKET_NOT_CONNECTED", "ERR_HTTP2",
    "ERR_QUIC",
)

# Fixed value: the delimiter around page-controlled prompt lines.
FENCE = "-----PAGE CONTEXT (untrusted data)-----"


def _verdict(
    label: str, confidence: Column, evidence: Column, brand: Column | None = None
) -> Column:
    return F.struct(
        F.lit(label).alias("label"),
        confidence.cast("double").alias("confidence"),
        (F.lit(None).cast("string") if brand is None else brand).alias("brand_impersonated"),
        evidence.alias("evidence"),
    )


def rule_verdict(fqdn: Column, brand: Column, signals: Column) -> Column:
    """The verdict the page's signals alone support."""
    targets = signals["cross_domain_form_targets"]
    exfil = F.coalesce(F.size(targets) > 0, F.lit(False))
    posting = F.when(
        exfil, F.concat(F.lit(", posting to "), F.array_join(targets, ", "))
    ).otherwise(F.lit(""))
    bare = (F.coalesce(signals["form_count"], F.lit(0)) == 0) & (
        F.coalesce(signals["title"], F.lit("")) == ""
    )
    return (
        F.when(
            signals.isNull(),
            _verdict("unknown", F.lit(0.3), F.lit("No DOM signals available.")),
        )
        .when(
            has_login_form(signals),
            _verdict(
                "phishing",
                F.when(exfil, F.lit(0.8)).otherwise(F.lit(0.6)),
                F.concat(F.lit("Login form on "), fqdn, posting, F.lit(".")),
                brand,
            ),
        )
        .when(bare, _verdict("parked", F.lit(0.5), F.lit("No forms and no page title.")))
        .otherwise(
            _verdict(
                "unknown",
                F.lit(0.4),
                F.lit("No login form detected; a screenshot is needed to decide."),
            )
        )
    )


def offline_verdict(status: Column, has_screenshot: Column) -> Column:
    """The verdict that needs no page: unreachable, or nothing to look at. NULL otherwise."""
    return F.when(
        status != "ok",
        _verdict(
            "unreachable",
            F.lit(1.0),
            F.concat(F.lit("Capture failed with status "), status, F.lit(".")),
        ),
    ).when(
        ~has_screenshot,
        _verdict("unknown", F.lit(0.0), F.lit("Screenshot file is missing; cannot classify.")),
    )


def _unfenced(reply: Column) -> Column:
    """The reply without a surrounding code fence."""
    text = F.trim(F.btrim(reply, F.lit(" \t\r\n")))
    block = F.regexp_replace(F.get(F.split(text, "```"), F.lit(1)), r"^json", "")
    return F.when(text.startswith("```"), F.btrim(block, F.lit(" \t\r\n"))).otherwise(text)


def _braced(text: Column) -> Column:
    """The text from its first opening to its last closing brace, if it has these in this order."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    found = (first > 0) & (last > first) & (last <= F.length(text))
    return F.when(found, F.substr(text, first, last - first + 1))


def parse_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Add ``verdict`` and ``error`` (one of them NULL) to a table of model replies.

    A reply is JSON, or prose around one JSON object; anything that does not fit the
    verdict's schema is an error, never a verdict.
    """
    parsed = computed_once(replies, __text=_unfenced(F.col(column)))
    parsed = computed_once(parsed, __whole=F.try_parse_json("__text"))
    whole = F.col("__whole")
    parsed = computed_once(parsed, __braces=F.when(whole.isNull(), _braced(F.col("__text"))))
    inner = F.col("__braces")
    shown = F.substring(F.col(column), 1, 200)
    parsed = computed_once(parsed, __json=F.coalesce(whole, F.try_parse_json(inner)))
    json = F.col("__json")
    names = ("label", "confidence", "brand_impersonated", "evidence")
    # Each field is looked up once; what it is told as is computed once, too.
    parsed = computed_once(parsed, **{f"__{n}": F.try_variant_get(json, f"$.{n}", "variant") for n in names})
    told = {f"__{n}_text": F.try_variant_get(F.col(f"__{n}"), "$", "string") for n in names}
    typed = {f"__{n}_kind": F.schema_of_variant(F.col(f"__{n}")) for n in names if n != "confidence"}
    number = F.try_variant_get(F.col("__confidence"), "$", "string").try_cast("double")
    parsed = computed_once(parsed, **told, **typed, __number=number)
    r = {n: F.col(f"__{n}_text") for n in names}
    confidence = F.col("__number")
    kind = {n: F.col(f"__{n}_kind") for n in names if n != "confidence"}
    is_text = {n: F.coalesce(kind[n] == "STRING", F.lit(False)) for n in kind}
    has_brand = F.coalesce(kind["brand_impersonated"] != "VOID", F.lit(False))
    no_brand = F.lower(F.trim(r["brand_impersonated"])).isin(*NO_BRAND)
    faults = (
        F.when(~is_text["label"] | ~r["label"].isin(*LABELS), F.lit("label"))
        .when(
            confidence.isNull() | F.isnan(confidence) | ~confidence.between(0.0, 1.0),
            F.lit("confidence"),
        )
        .when(
            has_brand
            & (~is_text["brand_impersonated"] | (F.length(r["brand_impersonated"]) > MAX_BRAND)),
            F.lit("brand_impersonated"),
        )
        .when(~is_text["evidence"] | (F.length(r["evidence"]) > MAX_EVIDENCE), F.lit("evidence"))
    )
    error = (
        F.when(whole.isNull() & inner.isNull(), F.concat(F.lit("no JSON object in model output: "), shown))
        .when(
            json.isNull(),
            F.concat(F.lit("invalid JSON in model output: "), shown),
        )
        .when(
            faults.isNotNull(),
            F.concat(F.lit("model output does not match the verdict schema: "), faults),
        )
    )
    verdict = F.struct(
        r["label"].alias("label"),
        confidence.alias("confidence"),
        F.when(~no_brand, r["brand_impersonated"]).alias("brand_impersonated"),
        r["evidence"].alias("evidence"),
    )
    judged = computed_once(parsed, error=error)
    kept = [c for c in replies.columns if c not in ("error", "verdict")]
    return judged.select(
        *kept, "error", F.when(F.col("error").isNull(), verdict).alias("verdict")
    )


def _listed(items: Column) -> Column:
    quoted = F.transform(items, lambda item: F.concat(F.lit("'"), item, F.lit("'")))
    some = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, some).otherwise(F.lit("none"))


def prompt(fqdn: Column, brand: Column, final_url: Column, signals: Column) -> Column:
    """The fenced facts given to a model next to the screenshot."""

    def line(name: str, value: Column) -> Column:
        return F.replace(F.concat(F.lit(f"{name}: "), value), F.lit(FENCE), F.lit(""))

    def or_else(text: Column, default: str) -> Column:
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))

    page = [
        line("Page title", or_else(signals["title"], "(none)")),
        line("Forms", signals["form_count"].cast("string")),
        line("Password inputs", signals["password_input_count"].cast("string")),
        line("Credential-like field present", F.initcap(signals["has_credential_field"].cast("string"))),
        line("Forms posting to another domain", _listed(signals["cross_domain_form_targets"])),
        line("Iframes", signals["iframe_count"].cast("string")),
    ]
    facts = [
        line("Domain visited", fqdn),
        line("Brand the domain resembles", brand),
        line("Final URL after redirects", or_else(final_url, "unknown")),
        *[F.when(signals.isNotNull(), fact) for fact in page],
    ]
    return F.concat_ws("\n", F.lit(FENCE), *facts, F.lit(FENCE))


def token_cost(
    prompt_tokens: Column, completion_tokens: Column, prompt_price: float, completion_price: float
) -> Column:
    """USD of one classification, prices given per 1000 tokens."""
    prompt_usd = F.coalesce(prompt_tokens, F.lit(0)) / 1000 * prompt_price
    completion_usd = F.coalesce(completion_tokens, F.lit(0)) / 1000 * completion_price
    return round_binary(prompt_usd + completion_usd, 6)


def error_status(message: Column) -> Column:
    """Capture status a browser error text stands for."""

    def any_of(tokens: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | message.contains(token)
        return hit

    return (
        F.when(any_of(DNS_ERRORS), F.lit("dns_error"))
        .when(any_of(CONNECTION_ERRORS), F.lit("connection_error"))
        .otherwise(F.lit("error"))
    )


def fold_attempts(attempts: DataFrame) -> DataFrame:
    """One capture per visit from its attempts (fqdn, visit, attempt, url, status, error, ...).

    The first attempt that loaded wins. Otherwise the last one tried stands, with what
    every scheme answered; nothing is tried after a name that does not resolve.
    """
    key = ["fqdn", "visit"]
    others = [c for c in attempts.columns if c not in (*key, "attempt")]
    row = F.struct("attempt", *others)
    ok = F.col("status") == "ok"
    dead = F.min(F.when(F.col("status") == "dns_error", F.col("attempt")))
    tried = attempts.groupBy(*key).agg(
        F.min(F.when(ok, F.col("attempt"))).alias("ok_at"),
        dead.alias("dead_at"),
        F.array_sort(F.collect_list(row)).alias("rows"),
    )
    # A visit tries each scheme once: a handful of rows.
    kept = F.filter("rows", lambda r: F.col("dead_at").isNull() | (r["attempt"] <= F.col("dead_at")))
    won = F.get(F.filter("kept", lambda r: r["status"] == "ok"), F.lit(0))
    last = F.element_at("kept", -1)
    told = F.transform(
        "kept",
        lambda r: F.concat(r["url"], F.lit(": "), F.coalesce(F.nullif(r["error"], F.lit("")), r["status"])),
    )
    detail = F.substring(F.array_join(told, " | "), 1, 500)
    joined = F.when(F.col("won").isNull() & (F.size("kept") > 1), detail).otherwise(
        F.col("chosen.error")
    )
    chosen = (
        tried.withColumn("kept", kept)
        .withColumn("won", won)
        .withColumn("chosen", F.coalesce(F.col("won"), last))
    )
    return chosen.select(
        *key, *[joined.alias(c) if c == "error" else F.col(f"chosen.{c}").alias(c) for c in others]
    )


def blocked_hosts(targets: DataFrame, as_of: Column) -> DataFrame:
    """Captures to record for targets that are no plain hostname and are never visited."""
    shown = F.concat(F.lit("not a plain hostname: '"), F.substring("fqdn", 1, 100), F.lit("'"))
    return targets.where(~is_valid_hostname(F.col("fqdn"))).select(
        "fqdn",
        F.col("fqdn").alias("url"),
        F.lit("blocked").alias("status"),
        as_of.alias("captured_at"),
        F.lit(0).cast("bigint").alias("duration_ms"),
        shown.alias("error"),
    )


def visit_plan(targets: DataFrame, schemes: tuple[str, ...]) -> DataFrame:
    """(fqdn, attempt, url) to visit for each plain hostname, in the order of the schemes."""
    urls = F.posexplode(candidate_urls(F.col("fqdn"), schemes)).alias("attempt", "url")
    return targets.where(is_valid_hostname(F.col("fqdn"))).select("fqdn", urls)
