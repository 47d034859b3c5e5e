"""Metrics against hand-computed figures, statistics against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from math import comb

import pytest
from pyspark.sql import functions as F

from mimicry.operators import metrics as m
from mimicry.operators import statistics as s
from mimicry.operators.pairing import closest_pairs
from mimicry.plans import evaluation as e
from mimicry.plans import labelling as lab
from mimicry.plans.comparison import compare_sides, comparison_summary, detection_summary, feed_detection

PAIRS = [
    ("phishing", "phishing"), ("phishing", "phishing"), ("phishing", "phishing"), ("phishing", "legitimate"),
    ("legitimate", "legitimate"), ("legitimate", "legitimate"), ("legitimate", "phishing"), ("parked", "phishing"),
]


def predictions(spark, pairs=PAIRS):
    return spark.createDataFrame(pairs, "expected string, predicted string")


def test_golden_metrics(spark):
    counts = m.confusion_counts(predictions(spark))
    rows = {r.label: r for r in m.class_metrics(counts).collect()}
    p = rows["phishing"]
    assert (p.true_positives, p.false_positives, p.false_negatives, p.precision, p.recall, p.f1) == (3, 2, 1, 0.6, 0.75, 0.6667)
    assert rows["legitimate"].precision == rows["legitimate"].recall == 0.6667
    assert (rows["parked"].precision, rows["parked"].recall, rows["parked"].f1) == (0.0, 0.0, 0.0)
    total = m.macro_metrics(counts).first()
    assert (total.accuracy, total.macro_f1, total.correct) == (0.625, 0.4445, 5)
    cells = {(r.expected, r.predicted): r.n for r in m.confusion_matrix(counts).collect()}
    assert len(cells) == 9 and cells["parked", "phishing"] == 1 and cells["parked", "parked"] == 0


def test_empty_sweep_and_ties(spark):
    scored = spark.createDataFrame([("phishing", 0.7), ("parked", 0.65), ("phishing", 0.3)], "expected string, score double")
    points = {r.threshold: r for r in m.threshold_sweep(scored, (0.4, 0.65, 0.7, 1.0), 0.7).collect()}
    assert (points[0.7].alerts, points[0.7].precision, points[0.7].recall, points[0.7].is_configured) == (1, 1.0, 0.5, True)
    assert (points[1.0].alerts, points[1.0].f1) == (0, 0.0)
    assert points[0.4].f1 == points[0.65].f1
    assert m.best_threshold(m.threshold_sweep(scored, (0.4, 0.65), 0.7)).first().threshold == 0.4
    assert m.threshold_sweep(scored.where("false"), (0.4,), 0.7).first().alerts == 0


@pytest.mark.parametrize(("a", "b"), [(4, 2), (5, 0), (0, 0), (1, 1), (40, 13), (900, 1100)])
def test_mcnemar(spark, a, b):
    n = a + b
    want = min(1.0, 2 * sum(comb(n, k) for k in range(min(a, b) + 1)) / 2**n) if n else 1.0
    got = spark.range(1).select(s.mcnemar_exact(F.lit(a), F.lit(b)).alias("p")).first().p
    assert got == pytest.approx(want, rel=1e-9)


def test_discordant_counts(spark):
    rows = [("x", "a", True), ("x", "b", False), ("y", "a", False), ("y", "b", True), ("z", "a", True), ("z", "b", True), ("w", "a", True)]
    (pair,) = s.discordant_counts(spark.createDataFrame(rows, "fqdn string, model string, is_right boolean"), ["a", "b"]).collect()
    assert (pair.only_a, pair.only_b, pair.shared) == (1, 1, 3)


def brute_force_bootstrap(pairs, resamples):
    rng = random.Random(5)
    accuracies, scores = [], []
    for _ in range(resamples):
        drawn = [pairs[rng.randrange(len(pairs))] for _ in pairs]
        labels = {x for pair in drawn for x in pair}
        f1s = []
        for label in labels:
            tp = sum(e == p == label for e, p in drawn)
            said, real = sum(p == label for _, p in drawn), sum(e == label for e, _ in drawn)
            p, r = round(tp / said, 4) if said else 0.0, round(tp / real, 4) if real else 0.0
            f1s.append(round(2 * p * r / (p + r), 4) if p + r else 0.0)
        accuracies.append(round(sum(e == p for e, p in drawn) / len(drawn), 4))
        scores.append(round(sum(f1s) / len(f1s), 4))
    low, high = s.percentile_bounds(resamples)
    return {n: (sorted(x)[low], sorted(x)[high]) for n, x in (("accuracy", accuracies), ("macro_f1", scores))}


def test_bootstrap(spark):
    pairs = PAIRS * 6
    counts = m.confusion_counts(predictions(spark, pairs))
    got = {r.metric: (r.low, r.high) for r in s.bootstrap_intervals(counts, 3000).collect()}
    again = {r.metric: (r.low, r.high) for r in s.bootstrap_intervals(counts.repartition(5), 3000).collect()}
    assert got == again
    for metric, (low, high) in brute_force_bootstrap(pairs, 3000).items():
        assert got[metric][0] == pytest.approx(low, abs=0.03) and got[metric][1] == pytest.approx(high, abs=0.03)
    assert s.percentile_bounds(10_000) == (250, 9750)


def test_closest_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    start = datetime(2026, 1, 1)
    sides = {}
    for side in (0, 1):
        rows = []
        for i in range(400):
            host = "hot" if rng.random() < 0.4 else f"h{rng.randrange(25)}"
            rows.append((host, side * 1000 + i, start + timedelta(seconds=rng.randrange(40_000))))
        sides[side] = rows
    frames = [spark.createDataFrame(sides[x], "fqdn string, capture_id bigint, captured_at timestamp") for x in (0, 1)]
    got = {r.fqdn: (r.first_id, r.second_id) for r in closest_pairs(*frames).collect()}
    want = {}
    for host in {r[0] for r in sides[0]} & {r[0] for r in sides[1]}:
        options = [(abs(a[2] - b[2]), a[1], b[1]) for a in sides[0] for b in sides[1] if a[0] == b[0] == host]
        want[host] = min(options)[1:]
    assert got == want


SIDE = ("fqdn string, capture_id bigint, captured_at timestamp, status string, http_status int, final_host string, "
        "title string, has_login_form boolean, verdict string")  # fmt: skip


def test_comparison(spark):
    t = datetime(2026, 1, 1)
    first = [("same", 1, t, "ok", 200, "h", "A  b", False, "parked"), ("cloaked", 2, t, "ok", 200, "h", "x", True, "phishing"),
             ("down", 3, t, "timeout", None, None, None, False, None), ("far", 4, t, "ok", 200, "h", "", False, None),
             ("mine", 5, t, "ok", 200, "h", "", False, None)]
    second = [("same", 11, t + timedelta(hours=6), "ok", 200, "h", "a B", False, None), ("cloaked", 12, t, "ok", 404, "g", "y", False, "parked"),
              ("down", 13, t, "ok", 200, "h", "", False, None), ("far", 14, t + timedelta(hours=6, seconds=1), "ok", 200, "h", "", False, None),
              ("theirs", 15, t, "ok", 200, "h", "", False, None)]
    compared = compare_sides(spark.createDataFrame(first, SIDE), spark.createDataFrame(second, SIDE))
    rows = {r.fqdn: r for r in compared.collect()}
    assert not rows["same"].differs
    assert rows["cloaked"].content_differences == ["http status", "final site", "login form", "title"]
    assert rows["cloaked"].different_verdict and rows["down"].unreachable_on_one_side
    assert rows["down"].content_differences == []
    assert comparison_summary(compared).first().asDict() == {
        "pairs": 3, "too_far_apart": 1, "only_first": 1, "only_second": 1, "unreachable_on_one_side": 1,
        "different_content": 1, "different_verdict": 1, "differing": 2}


def test_detection(spark):
    t = datetime(2026, 1, 10, 12)
    matches = spark.createDataFrame(
        [("a.evil.com", "evil.com", True, t), ("evil.com", "evil.com", False, t - timedelta(days=3)),
         ("low.org", "low.org", False, t), ("me.github.io", "github.io", True, t)],
        "fqdn string, registered_domain string, is_alert boolean, first_seen_at timestamp")
    day = lambda d: datetime(2026, 1, d).date()
    entries = spark.createDataFrame(
        [("b.evil.com", day(11)), ("b.evil.com", day(12)), ("low.org", day(10)), ("you.github.io", day(10)), ("me.github.io", day(10)),
         ("new.net", day(20)), ("old.net", day(1))], "fqdn string, labelled_at date")
    rows = {r.fqdn: (r.outcome, r.timing) for r in feed_detection(entries, matches).collect()}
    assert rows == {"b.evil.com": ("alerted", "before the listing day"), "low.org": ("matched", "on the listing day"),
                    "you.github.io": ("out of reach", None), "me.github.io": ("alerted", "on the listing day"),
                    "new.net": ("not seen", None), "old.net": (None, None)}
    total = detection_summary(feed_detection(entries, matches)).first()
    assert (total.in_reach, total.out_of_reach, total.alerted, total.alerted_share, total.listed_before_monitoring) == (4, 1, 2, 0.5, 1)
    none = feed_detection(entries, matches.where("false")).collect()
    assert {r.outcome for r in none} == {None}


def test_full_arm_exclusions(spark):
    scored = spark.createDataFrame([("a", "phishing", 0.9), ("b", "phishing", 0.9), ("c", "parked", 0.2), ("d", "parked", 0.9), ("e", "parked", 0.9)],
                                   "fqdn string, expected string, score double")
    scored = scored.withColumns({c: F.lit(None).cast("string") for c in ("brand", "note", "source")})
    captures = spark.createDataFrame(
        [("a", "ok", "phishing"), ("b", "timeout", None), ("c", "ok", None), ("d", "ok", None)],
        "fqdn string, status string, verdict_label string").withColumns(
            {c: F.lit(None).cast("string") for c in ("screenshot_path", "verdict_brand")})
    rows = {r.fqdn: (r.predicted, r.excluded_reason) for r in e.full_arm(scored, 0.7, captures).collect()}
    assert rows == {"a": ("phishing", None), "b": (None, "unreachable"), "c": ("legitimate", None),
                    "d": (None, "not classified"), "e": (None, "not captured")}


def test_evaluate_and_export(spark, scorer, tmp_path):
    sites = spark.createDataFrame(
        [("paypa1.com", "phishing", "alerts", "human"), ("example.org", "legitimate", "feed", None), ("paypall.com", "parked", "", "agent"),
         ("odd.org", "unknown", "feed", None)], "fqdn string, expected string, source string, labelled_by string"
    ).withColumns({c: F.lit(None).cast("string") for c in ("brand", "note")})
    arms = e.evaluate(sites, scorer, resamples=50)
    tables = arms["scoring_only"]
    assert tables["metrics"].first().accuracy == 0.6667
    assert {r.split for r in tables["by_brand"].collect()} == {"paypal", "(none)"}
    assert {r.labelled_by for r in e.labeller_counts(sites).collect()} == {"human", "agent", "unrecorded"}
    e.export_report(arms, str(tmp_path / "report"), dataset="t.jsonl", alert_threshold=0.7)
    row = spark.read.json(str(tmp_path / "report/scoring_only/metrics")).first()
    assert (row.dataset, row.arm, row.total) == ("t.jsonl", "scoring_only", 3)


def test_labels(spark):
    current = spark.createDataFrame(
        [("a.com", "parked", "alerts", "agent", "seen"), ("b.com", "parked", "alerts", "human", None), ("c.com", "parked", "feed", None, None)],
        "fqdn string, expected string, source string, labelled_by string, note string"
    ).withColumns({"labelled_at": F.lit("2025-01-01").cast("date"), "label_basis": F.lit("feed"),
                   "brand": F.lit("x"), "suggestion": F.lit(None).cast("string")})
    labels = spark.createDataFrame([("a.com", "phishing"), ("b.com", "phishing"), ("new.com", "legitimate")], "fqdn string, label string").withColumns(
        {"brand": F.lit("paypal"), "suggestion": F.lit(None).cast("string"), "label_source": F.lit("alerts")})
    rows = {r.fqdn: r for r in lab.upsert_labels(current, labels, F.lit("2026-01-01").cast("date")).collect()}
    assert rows["a.com"].note == "seen; relabelled by a human; was parked (agent)"
    assert rows["b.com"].note is None and rows["b.com"].brand == "x"
    assert (rows["c.com"].expected, rows["c.com"].label_basis) == ("parked", "feed")
    assert (rows["new.com"].source, rows["new.com"].brand, rows["new.com"].labelled_by) == ("alerts", "paypal", "human")


def test_hard_negatives_become_candidates(spark):
    seeded = lab.hard_negatives(spark).withColumn("place", F.lit(1))
    present = spark.createDataFrame([("hicloud.net",)], "fqdn string")
    added = lab.new_candidates(seeded, present, F.lit("2026-01-01").cast("date"))
    assert added.count() == len(lab.HARD_NEGATIVES) - 1
    assert {(r.expected, r.suggestion, r.source) for r in added.collect()} == {(None, "legitimate", "calibration")}
    assert lab.candidate_counts(seeded, added).first().asDict() == {"added": 10, "skipped": 1}


def test_report_is_published_whole(spark, scorer, tmp_path):
    folder = str(tmp_path / "reports")
    rows = [("paypal-login.com", "phishing", "alerts", "human"), ("netflix.shop", "legitimate", "feed", None),
            ("shop.example.org", "legitimate", "", "agent"), ("x.example.org", "unknown", "feed", "agent")]
    sites = spark.createDataFrame(rows, "fqdn string, expected string, source string, labelled_by string").withColumns(
        {"brand": F.lit(None).cast("string"), "note": F.lit(None).cast("string")}
    )
    with pytest.raises(FileNotFoundError):
        e.Reports(spark, folder).read()
    first = e.run_evaluation(sites, scorer, folder, resamples=20, dataset="set.jsonl")
    second = e.run_evaluation(sites.where("fqdn <> 'netflix.shop'"), scorer, folder, resamples=20)
    assert (first, second) == (0, 1)
    reports = e.Reports(spark, folder)
    tables, conditions = reports.read(0)
    assert conditions["sites"] == 3 and conditions["excluded"] == 0 and conditions["dataset"] == "set.jsonl"
    arm = e.scoring_only_arm(e.score_sites(e.judgeable(sites), scorer), scorer.cfg.alert_threshold)
    want = e.arm_report(arm, None, scorer.cfg.alert_threshold, 20)
    for name in ("metrics", "classes", "confusion", "sweep", "intervals"):
        columns = want[name].columns
        assert sorted(map(str, tables[name].select(columns).collect())) == sorted(map(str, want[name].collect())), name
    for name, split in (("by_source", "source"), ("by_brand", "brand")):
        got = tables[name].withColumnRenamed(split, "split").select(want[name].columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want[name].collect())), name
    assert {r.labelled_by: r.sites for r in tables["labellers"].collect()} == {"human": 1, "agent": 2, "unrecorded": 1}
    assert reports.read()[1]["sites"] == 2
    # A run that breaks off before it is published is not seen.
    broken = {"metrics": tables["metrics"], "bad": spark.range(1).selectExpr("raise_error('no space') AS x")}
    with pytest.raises(Exception, match="no space"):
        reports.publish(broken)
    assert reports.read()[1]["sites"] == 2


def test_binomial_quantiles(spark):
    """Against cumulated exact chances."""
    from fractions import Fraction

    rows = [(u, n, p) for n in (0, 1, 7, 60) for p in (0.001, 0.3, 0.5, 0.97) for u in (1e-9, 0.02, 0.51, 0.77, 0.999999)]
    rows += [(0.4, 25, 1.0)]
    df = spark.createDataFrame(rows, "u double, n bigint, p double")
    got = df.select("u", "n", "p", s.binomial_quantile(F.col("u"), F.col("n"), F.col("p")).alias("x")).collect()
    for r in got:
        total, x = Fraction(0), -1
        while total < Fraction(r.u) and x < r.n:
            x += 1
            total += comb(r.n, x) * Fraction(r.p) ** x * (1 - Fraction(r.p)) ** (r.n - x)
        assert r.x == (r.n if r.p == 1 else x), r
    far = spark.createDataFrame([(0.5, 10**9, 0.25), (0.0013498980316301, 10**9, 0.25)], "u double, n bigint, p double")
    middle, low = [r.x for r in far.select(s.binomial_quantile(F.col("u"), F.col("n"), F.col("p")).alias("x")).collect()]
    assert abs(middle - 250_000_000) < 50 and abs(middle - low - 3 * (10**9 * 0.1875) ** 0.5) < 200
