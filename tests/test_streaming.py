"""Streams until their input is used up, compared with the batch jobs."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mimicry.plans import ingest as ing
from mimicry.sources import ct
from mimicry.sources.commits import CommitLog, Draft
from mimicry.streaming import monitors as mon
from mimicry.streaming.ingest import Stores, message_counters, new_names, start_ingest
from mimicry.streaming.triage import Triage, run_stages
from tests.test_sources import message, result


def test_stream_equals_batch(spark, scorer, tmp_path):
    names = [["paypal-login.com", "*.paypal-login.com"], ["netflix.shop"], ["shop.example.org"], ["paypal-login.com"], None]
    for i, domains in enumerate(names):
        lines = [message(leaf={"sha256": f"{i:02d}", "all_domains": domains}, seen=1700000000 + i), message(without=["not_after"])]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(lines) + "\n")
    folder = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        query = start_ingest(spark, str(tmp_path / "in"), scorer, folder, str(tmp_path / "cp"), None, 2)
        query.awaitTermination()
    parsed = ct.parse_messages(ct.read_ct_messages(spark, str(tmp_path / "in")))
    batch = ing.ingest(ct.certificates(parsed), scorer)
    key = lambda r: (r.fqdn, r.brand, r.score)
    stores = Stores.below(spark, folder)
    streamed = stores.matches.rows().collect()
    assert sorted(map(key, streamed)) == sorted(map(key, batch.matches.collect()))
    certs = stores.certificates.rows()
    assert certs.count() == certs.select("cert_sha256").distinct().count() == batch.certificates.count()
    assert stores.malformed.rows().count() == ct.malformed(parsed).count() == 5
    observed = message_counters(parsed)
    assert observed.count() == 10


def test_names_pass_once(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [("aa", at, None, ["a.com", "*.a.com"]), ("bb", at + timedelta(minutes=1), None, ["A.com", "b.com"])]
    schema = "cert_sha256 string, seen_at timestamp, issuer_org string, all_domains array<string>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "certs"))
    stream = new_names(spark.readStream.schema(schema).parquet(str(tmp_path / "certs")))
    query = stream.writeStream.format("memory").queryName("names").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.fqdn for r in spark.table("names").collect()) == ["a.com", "b.com"]


def triage_on(spark, folder, **settings):
    """A triage of two hosts, of which one has a match."""
    targets = spark.createDataFrame([("a.com",), ("b.com",)], "fqdn string")
    feature = "CAST(NULL AS struct<free_dv_issuer:boolean>)"
    matches = spark.createDataFrame([("a.com", "paypal", 0.9)], "fqdn string, brand string, score double").withColumns(
        {"registered_domain": F.lit("a.com"), "is_alert": F.lit(True), "cert_sha256": F.lit("x"),
         "first_seen_at": F.lit(datetime(2026, 1, 1)), "features": F.expr(feature)})
    store = Stores.below(spark, folder).matches
    if not store.runs():
        store.add(matches.drop("features"), 0)
    settings = {"vantage": "home", "clock": lambda: datetime(2026, 1, 2)} | settings
    return Triage(spark, folder, targets, **settings)


def sent(spark, folder):
    return sorted(json.loads(r.value)["fqdn"] for r in spark.read.text(f"{folder}/alerts/*").collect())


def test_triage_cycle(spark, tmp_path):
    folder = str(tmp_path / "t")
    triage = triage_on(spark, folder)
    lines = spark.createDataFrame([(result("a.com"),), (result("b.com"),), ("junk",)], "value string")
    for _ in range(2):  # a replayed batch adds nothing
        triage.run(lines, 1)
    cycles = triage.table("cycles").collect()
    assert [(r.stage, r.failed) for r in sorted(cycles, key=lambda r: r.stage)] == [("alert", False), ("capture", False), ("classify", False)]
    assert triage.table("captures").count() == 2 and triage.table("rejected").count() == 1
    assert {r.label for r in triage.table("verdicts").collect()} == {"phishing"}
    assert sent(spark, folder) == ["a.com"]  # b.com has no match: measured, not announced
    triage.clock = lambda: datetime(2026, 1, 3)
    triage.run(lines, 2)
    assert triage.table("announced").count() == 2  # the new capture is a new finding
    assert sent(spark, folder) == ["a.com", "a.com"]
    assert triage.table("verdicts").count() == 4


def test_nothing_of_a_broken_batch_is_seen(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    triage = triage_on(spark, folder)
    lines = spark.createDataFrame([(result("a.com"),)], "value string")
    whole = Draft.write

    def breaks(self, name, rows):
        whole(self, name, rows)
        if name == "rejected":
            raise OSError("no space")

    monkeypatch.setattr(Draft, "write", breaks)
    with pytest.raises(OSError, match="no space"):
        triage.run(lines, 0)
    assert triage.table("captures").count() == 0 and triage.log.state().number == -1
    monkeypatch.setattr(Draft, "write", whole)
    triage.run(lines, 0)
    assert triage.table("captures").count() == 2 and sent(spark, folder) == ["a.com"]


def test_a_stage_that_fails_is_recorded_and_made_up_for(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    triage = triage_on(spark, folder)
    lines = spark.createDataFrame([(result("a.com"),)], "value string")

    def boom(*_: object) -> None:
        raise RuntimeError("no model")

    with monkeypatch.context() as m:
        m.setattr(triage, "_classify", boom)
        triage.run(lines, 0)
    failed = {r.stage: r.error for r in triage.table("cycles").collect() if r.failed}
    assert failed == {"classify": "no model"} and triage.table("verdicts").count() == 0
    triage.run(lines.limit(0), 1)
    assert triage.table("verdicts").count() == 4 and sent(spark, folder) == ["a.com"]


def test_concurrent_cycles_announce_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    one, two = (triage_on(spark, folder, writer=w) for w in ("one", "two"))
    lines = spark.createDataFrame([(result("a.com"),)], "value string")
    with monkeypatch.context() as m:
        m.setattr(one, "_announce", lambda draft, cycle: None)
        one.run(lines, 0)
    ahead = two.log.draft()
    two._announce(ahead, 0)
    one.announce(1)  # gets the commit that the draft of the other is for
    assert two._publish(ahead, 0, []) is False
    two.announce(0)
    assert sent(spark, folder) == ["a.com"]
    assert two.table("announced").count() == 1 and two.table("outbox").count() == 1


def test_delivery_that_broke_off_is_made_up_for(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    triage = triage_on(spark, folder)
    lines = spark.createDataFrame([(result("a.com"),)], "value string")

    def down() -> None:
        raise OSError("sink is down")

    with monkeypatch.context() as m:
        m.setattr(triage, "deliver", down)
        with pytest.raises(OSError, match="sink is down"):
            triage.run(lines, 0)
    assert triage.table("outbox").count() == 1
    triage.run(lines, 0)
    triage.run(lines.limit(0), 1)
    assert sent(spark, folder) == ["a.com"]


def test_commits_merge_and_are_cleaned(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path), fan=2)
    for i in range(9):
        draft = log.draft()
        draft.write("t", spark.createDataFrame([(i,)], "n bigint"))
        draft.merge("t", "n bigint")
        assert draft.publish("w", i)
        log.clean(2)
    assert sorted(r.n for r in log.table("t", "n bigint").collect()) == list(range(9))
    assert len(log.state().tables["t"]) <= 4 and log.done("w", 8) and not log.done("w", 9) and not log.done("x", 0)
    assert len(list((tmp_path / "commits").glob("[0-9]*.json"))) == 2
    assert len(list((tmp_path / "t").iterdir())) <= 10


def test_a_failing_stage_is_isolated():
    done = []

    def boom():
        raise RuntimeError("no disk")

    outcomes = run_stages({"capture": boom, "classify": lambda: done.append(1)})
    assert outcomes == [("capture", True, "no disk"), ("classify", False, None)] and done == [1]


def test_monitors(spark):
    t = datetime(2026, 1, 1)
    minutes = [0, 1, 31, 32, 33, 95]
    events = spark.createDataFrame([(t + timedelta(minutes=x), x > 0, 50.0 + x) for x in minutes], "at timestamp, failed boolean, level double")
    counts = mon.event_counts(events)
    silent = mon.silent_windows(counts, F.lit(t), F.lit(t + timedelta(minutes=50)))
    assert sorted(r.window_start.minute for r in silent.collect()) == [10, 20, 40, 50]
    never = mon.event_counts(events.limit(0))
    silent = mon.silent_windows(never, F.lit(t), F.lit(t + timedelta(minutes=20)))
    assert sorted(r.window_start.minute for r in silent.collect()) == [0, 10, 20]
    assert mon.silent_windows(never, F.min("window_start"), F.max("window_start")).count() == 0
    assert [(r.window_start.minute, r.failures) for r in mon.failure_windows(events).collect()] == [(30, 3)]
    levels = spark.createDataFrame([(t + timedelta(minutes=5 * i), x) for i, x in enumerate([81.0, 90.0, 82.0, 99.0, 80.0, 85.0, 85.0])],
                                   "at timestamp, level double")
    high = mon.sustained_levels(mon.level_means(levels))
    assert sorted(r.window_start.minute for r in high.collect()) == [10, 15]


def arriving(spark, folder, schema, parts):
    """A stream with one micro-batch for each list of rows."""
    for number, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{number}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def run(folder, rows):
    query = rows.writeStream.format("parquet").option("path", f"{folder}/out").trigger(availableNow=True)
    query = query.option("checkpointLocation", f"{folder}/cp").start()
    query.awaitTermination()
    return query


def test_forgotten_hosts_pass_again_and_leave_the_state(spark, tmp_path):
    day = lambda n: datetime(2026, 1, 1) + timedelta(days=n)
    schema = "cert_sha256 string, seen_at timestamp, issuer_org string, all_domains array<string>"
    batches = [
        [("1", day(0), None, ["a.com"]), ("2", day(1), None, ["b.com"])],
        [("3", day(10), None, ["a.com"])],  # the watermark still stands at day -1: known
        [("4", day(20), None, ["c.com"])],  # by day 8 a.com and b.com have expired
        [("5", day(30), None, ["a.com", "*.A.com"]), ("6", day(2), None, ["late.com"])],
    ]
    stream = new_names(arriving(spark, tmp_path, schema, batches), "2 days")
    query = run(tmp_path, stream)
    got = sorted((r.fqdn, r.cert_sha256) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a.com", "1"), ("a.com", "5"), ("b.com", "2"), ("c.com", "4")]
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert [s["numRowsTotal"] for s in states][-1] <= 1  # all but the last host have left it
    assert max(s["numRowsTotal"] for s in states) <= 3
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1


def test_silence_over_a_stream(spark, tmp_path):
    at = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    schema = "source string, at timestamp, is_event boolean"
    batches = [
        [("ct", at(1), True), ("never", at(3), False), ("ends", at(2), True), ("ct", at(12), True)],
        [("ct", at(35), True), ("ends", at(15), True), ("ct", at(8), True)],
        [("ct", at(95), True), ("ct", at(61), True), ("new", at(88), True)],
        [("ct", at(5), True), ("never", at(4), True), ("ct", at(140), True)],  # the first two come too late
    ]
    with mon.rocksdb(spark):
        silent = mon.silence_alarms(arriving(spark, tmp_path, schema, batches), is_event=F.col("is_event"), watermark="30 minutes")
        run(tmp_path, silent)
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(r.source, []).append(int((r.window_start - at(0)).total_seconds()) // 60)
    assert {s: sorted(w) for s, w in got.items()} == {  # judged up to minute 110
        "ct": [20, 40, 50, 70, 80, 100],
        "never": list(range(0, 110, 10)),
        "ends": list(range(20, 110, 10)),
        "new": [90, 100],
    }


def test_silence_survives_a_restart(spark, tmp_path):
    at = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    schema = "source string, at timestamp, is_event boolean"
    with mon.rocksdb(spark):
        for number, rows in enumerate([[("a", at(0), True), ("b", at(30), True)], [("b", at(70), True)]]):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
            run(tmp_path, mon.silence_alarms(stream, watermark="0 minutes"))
    got = sorted((r.source, (r.window_start - at(0)).total_seconds() / 60) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 10), ("a", 20), ("a", 30), ("a", 40), ("a", 50), ("a", 60), ("b", 40), ("b", 50), ("b", 60)]


def test_sustained_levels_over_a_stream(spark, tmp_path):
    t = datetime(2026, 1, 1)
    levels = [81.0, 90.0, 82.0, 99.0, 80.0, 85.0, 85.0, 85.0]
    samples = [(t + timedelta(minutes=5 * i), x) for i, x in enumerate(levels)]
    schema = "at timestamp, level double"
    far = t + timedelta(minutes=400)
    batches = [samples[:3], samples[3:6], [*samples[6:], (far, 0.0)], [(far, 0.0)], [(t, 1e9), (t + timedelta(minutes=20), 1e9)]]
    stream = arriving(spark, tmp_path, schema, batches)
    run(tmp_path, mon.sustained_level_alarms(stream))
    streamed = sorted(r.window_start for r in spark.read.parquet(f"{tmp_path}/out").collect())
    table = spark.createDataFrame(samples, schema)
    batch = mon.sustained_levels(mon.level_means(table)).collect()
    assert streamed == sorted(r.window_start for r in batch) == sorted(r.window_start for r in mon.sustained_level_alarms(table).collect())
    assert [x.minute for x in streamed] == [10, 15, 35]
