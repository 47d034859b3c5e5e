"""Files in: messages, labelled sets, feeds, untrusted results; tables out."""

from __future__ import annotations

import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from mimicry.config import DEFAULT_BRANDS
from mimicry.plans import labelling as lab
from mimicry.plans.triage import import_results
from mimicry.sources import ct, feeds, labelled, sinks
from mimicry.sources.lines import numbered_lines


def message(**changes):
    leaf = {
        "sha256": "AB:CD", "serial_number": "07", "issuer": {"O": "Let's Encrypt", "CN": "R3"},
        "not_before": 1700000000, "not_after": 1707776000, "all_domains": ["a.example.org"],
    }
    leaf |= changes.pop("leaf", {})
    for key in changes.pop("without", ()):
        del leaf[key]
    data = {"seen": 1700000001.5, "source": {"name": "log1"}, "leaf_cert": leaf, **changes}
    return json.dumps({"message_type": "certificate_update", "data": data})


def parsed(spark, tmp_path, lines):
    path = tmp_path / "messages.jsonl"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return ct.parse_messages(ct.read_ct_messages(spark, str(path)))


def test_messages(spark, tmp_path):
    rows = parsed(spark, tmp_path, [
        message(), "", "not json", '["list"]', json.dumps({"message_type": "heartbeat"}),
        message(leaf={"all_domains": None}), message(without=["not_after"]),
        message(leaf={"not_before": "soon"}), json.dumps({"message_type": "certificate_update"}),
        message(seen="1700000001"),
    ])
    good = ct.certificates(rows).orderBy("arrival").collect()
    assert [r.cert_sha256 for r in good] == ["abcd"] * 3
    assert good[0].seen_at == datetime(2023, 11, 14, 22, 13, 21, 500000)
    assert good[0].issuer_org == "Let's Encrypt" and good[0].ct_log == "log1"
    assert good[1].all_domains == []
    reasons = [r.reject_reason for r in ct.malformed(rows).orderBy("arrival").collect()]
    assert reasons == ["missing not_after", "not_before is not a number", "missing data"]


def test_derived_keys(spark, tmp_path):
    empty = ct.EMPTY_INPUT_SHA256.upper()
    rows = parsed(spark, tmp_path, [
        message(leaf={"sha256": ""}), message(leaf={"sha256": empty}),
        message(leaf={"sha256": None, "serial_number": "08"}),
        message(leaf={"sha256": "", "serial_number": "", "all_domains": ["b.x", "a.x"]}),
    ])
    keys = [r.cert_sha256 for r in ct.certificates(rows).orderBy("arrival").collect()]
    issuer = '{"CN": "R3", "O": "Let\'s Encrypt"}'
    want = [issuer + "|07", issuer + "|07", issuer + "|08", issuer + "|1700000000|1707776000|a.x,b.x"]
    assert keys == ["issuer-serial:" + hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_line_numbers(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(1, 500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = numbered_lines(spark, str(tmp_path / "*.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 998
    assert all(int(r.value[1:]) == r.line_no and r.file_path.endswith(f"{r.value[0]}.txt") for r in rows)


def site(fqdn, **more):
    return json.dumps({"fqdn": fqdn, "expected": "phishing", "source": "alerts", "labelled_at": "2026-01-02", **more})


def write_set(path, *lines):
    path.write_text("\n".join(("# header", "", *lines)) + "\n", encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    ("line", "problem"),
    [("{oops", "not valid JSON"), ("[1]", "expected a JSON object"),
     ('{"fqdn": "a.com"}', "missing field(s) expected, labelled_at, source"),
     (site("a.com", expected="bad"), "unknown label bad"), (site("a.com", expected=None), "no label yet"),
     (site("a.com", labelled_at="02/01/2026"), "ISO date"), (site("a.com", label_basis="guess"), "label_basis"),
     (site("b.com"), "b.com is also in")],
)
def test_unsound_sets(spark, tmp_path, line, problem):
    path = write_set(tmp_path / "set.jsonl", site("B.com "), line)
    with pytest.raises(labelled.DatasetError, match="set.jsonl:4: ") as caught:
        labelled.sound(labelled.read_labelled(spark, path))
    assert problem in str(caught.value)


def test_sound_sets(spark, tmp_path):
    main = write_set(tmp_path / "main.jsonl", site("A.com"), site("b.com", label_basis="feed", labelled_by="human"))
    feed = write_set(tmp_path / "feed.jsonl", site("c.com", brand="paypal"))
    rows = {r.fqdn: r for r in labelled.load_all(spark, main, [feed]).collect()}
    assert set(rows) == {"a.com", "b.com", "c.com"}
    assert rows["a.com"].labelled_at == date(2026, 1, 2) and rows["a.com"].label_basis == "screenshot"
    assert rows["b.com"].labelled_by == "human" and rows["c.com"].brand == "paypal"
    again = write_set(tmp_path / "again.jsonl", site("a.com"))
    with pytest.raises(labelled.DatasetError, match="also in"):
        labelled.load_all(spark, main, [again])
    with pytest.raises(labelled.DatasetError, match="empty"):
        labelled.sound(labelled.read_labelled(spark, write_set(tmp_path / "none.jsonl")))
    kept = labelled.read_labelled(spark, write_set(tmp_path / "new.jsonl", site("z.com", expected=None)), True)
    assert kept.first().expected == "unknown" and kept.first().reject_reason is None


FEED = """# feed
https://paypal-login.example/a
http://203.0.113.7/netflix/
https://quiet.example/
not a url
ftp://paypal.example/
https:///nohost
https://secure-verify.example/PayPal/signin
https://quiet.example/paypal
"""


def test_feed(spark, tmp_path):
    path = tmp_path / "feed.txt"
    path.write_text(FEED)
    entries = feeds.read_url_feed(spark, str(path), "daily")
    hosts = {"paypal-login.example", "203.0.113.7", "quiet.example", "secure-verify.example"}
    assert {r.fqdn for r in entries.collect()} == hosts
    found = {r.fqdn: r.brand for r in lab.candidates_from_feed(entries, DEFAULT_BRANDS).collect()}
    # The first URL of a host decides: quiet.example first came without a brand.
    assert found == {"paypal-login.example": "paypal", "203.0.113.7": "netflix", "secure-verify.example": "paypal"}


def result(fqdn, **changes):
    record = {
        "fqdn": fqdn, "url": f"https://{fqdn}/", "status": "ok", "captured_at": "2026-01-01T00:00:00+00:00",
        "duration_ms": 12, "final_url": None, "http_status": 200, "screenshot_path": "a/shot.png",
        "html_path": "a/page.html", "error": None,
        "signals": {"title": "T", "form_count": 1, "has_password_input": True, "has_credential_field": False,
                    "cross_domain_form_targets": ["x.org"], "iframe_count": 0, "password_input_count": 1},
    }
    return json.dumps(record | changes)


REFUSED = {
    "not json": "1 invalid field(s)",
    result("evil.com"): "hostname the job did not ask for",
    result("b.com", url="https://evil.com/"): "URL is not one this hostname would be visited at",
    result("b.com", duration_ms="soon"): "1 invalid field(s)",
    result("b.com", duration_ms=-1): "1 invalid field(s)",
    result("b.com", http_status=999, status="weird"): "2 invalid field(s)",
    result("b.com", extra=1): "1 invalid field(s)",
    result("b.com", captured_at="2026-01-01T00:00:00"): "1 invalid field(s)",
    result("b.com", final_url="x" * 2101): "1 invalid field(s)",
    result("b.com", signals={"title": "T"}): "6 invalid field(s)",
    result("b.com", screenshot_path="../../etc/passwd"): "screenshot missing or outside the capture directory",
    result("b.com", screenshot_path=None): "screenshot missing or outside the capture directory",
}


def test_import_refuses(spark):
    lines = spark.createDataFrame(list(enumerate([*REFUSED, ""])), "line_no bigint, value string")
    targets = spark.createDataFrame([("b.com",)], "fqdn string")
    got = import_results(lines, targets, F.current_timestamp())
    reasons = [r.reject_reason for r in got.rejected.orderBy("line_no").collect()]
    assert reasons == list(REFUSED.values())
    (silent,) = got.captures.collect()
    assert (silent.fqdn, silent.status) == ("b.com", "error")
    assert import_results(lines, targets, F.current_timestamp(), run_failed=True).captures.count() == 0


def test_import_accepts_once(spark):
    given = [result("a.com", url="http://bad.com/"), result("a.com"), result("a.com", url="http://a.com/"),
             result("c.com", status="timeout", screenshot_path=None)]
    lines = spark.createDataFrame(list(enumerate(given)), "line_no bigint, value string")
    targets = spark.createDataFrame([("a.com",), ("c.com",)], "fqdn string")
    got = import_results(lines, targets, F.current_timestamp(), "home")
    rows = {r.fqdn: r for r in got.captures.collect()}
    assert rows["a.com"].url == "https://a.com/" and rows["a.com"].vantage == "home"
    assert rows["a.com"].signals.cross_domain_form_targets == ["x.org"]
    assert rows["c.com"].status == "timeout" and rows["c.com"].screenshot_path is None
    assert [(r.line_no, r.reject_reason) for r in got.rejected.orderBy("line_no").collect()] == [
        (0, "URL is not one this hostname would be visited at"), (2, "second result for the same hostname")]


def test_insert_if_absent_treats_no_model_as_equal(spark, tmp_path):
    schema = "capture_id bigint, backend string, model string"
    path = str(tmp_path / "verdicts")
    rows = spark.createDataFrame([(1, "stub", None), (2, "vision", "m")], schema)
    assert sinks.insert_if_absent(rows, path, schema, ("capture_id", "backend", "model")) == 2
    more = spark.createDataFrame([(1, "stub", None), (2, "vision", None)], schema)
    assert sinks.insert_if_absent(more, path, schema, ("capture_id", "backend", "model")) == 1
    assert sinks.read_table(spark, path, schema).count() == 3


def test_batches_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "a bigint"
    assert sinks.read_batches(spark, path, schema).count() == 0
    for batch, size in ((0, 3), (1, 5), (1, 4)):
        sinks.write_batch(spark.range(size).toDF("a"), path, batch)
    assert sinks.read_batches(spark, path, schema).count() == 7
    assert sinks.read_batches(spark, path, schema, before=1).count() == 3
    assert sinks.read_batches(spark, path, schema, only=1).count() == 4
    sinks.export_snapshot({"x": spark.range(2), "y": spark.range(3)}, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap" / "y")).count() == 3


def test_ids_are_unique(spark):
    ids = [r.id2 for r in sinks.with_ids(spark.range(0, 1000, 1, 7), "id2", 41).collect()]
    assert len(set(ids)) == 1000 and min(ids) == 42


def test_suffix_rules_need_no_jar(spark, monkeypatch):
    """The rules come with the package, or from a list Spark reads."""
    import zipfile

    from mimicry.sources import suffixes

    def refuse(*_: object, **__: object) -> None:
        raise AssertionError("no archive is needed")

    monkeypatch.setattr(zipfile, "ZipFile", refuse)
    suffixes.parse_rules.cache_clear()
    rules = {rule for rule, *_ in suffixes.parse_rules(suffixes._list_lines(spark))}
    assert {"com", "co.uk", "github.io"} <= rules


def test_configured_suffix_list(spark, tmp_path):
    from mimicry.sources import suffixes

    path = tmp_path / "list.txt"
    path.write_text("// a comment\nexample\n*.wild.example\n!not.wild.example\n")
    spark.conf.set(suffixes.LIST_PATH_CONF, str(path))
    try:
        rows = suffixes.suffix_rules(spark).collect()
    finally:
        spark.conf.unset(suffixes.LIST_PATH_CONF)
    assert {(r.rule, r.kind) for r in rows} == {
        ("example", "exact"), ("wild.example", "wildcard"), ("not.wild.example", "exception"),
    }


def test_keys_of_unusual_issuers(spark):
    """Keys state the issuer as sorted ASCII JSON, values in their own types."""
    import hashlib
    import json

    issuers = [
        {"O": "Národní", "CN": 'a "b" \\ c'},
        {"O": "tab\there\n\x01", "CN": None},
        {"O": 7, "CN": True},
        {"O": "😀"},
        {},
    ]
    lines = [
        json.dumps(
            {
                "message_type": "certificate_update",
                "data": {
                    "seen": 1.5,
                    "leaf_cert": {"issuer": i, "serial_number": "5", "not_before": 1, "not_after": 2},
                },
            },
            ensure_ascii=n % 2 == 0,
        )
        for n, i in enumerate(issuers)
    ]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, value string")
    got = {r.n: r.cert_sha256 for r in ct.certificates(ct.parse_messages(rows)).collect()}
    for n, issuer in enumerate(issuers):
        identity = f"{json.dumps(issuer, sort_keys=True)}|5"
        assert got[n] == ct.DERIVED_KEY_PREFIX + hashlib.sha256(identity.encode()).hexdigest(), issuer


def test_times_out_of_range(spark):
    seen = {'"NaN"': "seen is out of range", '"1e18"': "seen is out of range", '"-Infinity"': "seen is out of range", "5": None}
    line = '\t{"message_type": "certificate_update", "data": {"seen": %s, "leaf_cert": {"not_before": 1, "not_after": 2}}}'
    rows = spark.createDataFrame([(k, line % k) for k in seen], "n string, value string")
    assert {r.n: r.reject_reason for r in ct.parse_messages(rows).collect()} == seen
