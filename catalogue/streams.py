"""Structured Streaming runs over the given tables, each until its input is used up."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from uuid import uuid4

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogue.registry import check, moment, moment_sql, query, scorer
from catalogue.scoring import FIRST_MATCHES, FREE_DV, INGEST, LEAVES
from catalogue.queues import BEST
from catalogue.scoring_sql import scored_ctes
from catalogue.triage import DUE
from mimicry.config import AlertPolicy
from mimicry.session import computed_once, shared_folder
from mimicry.sources.commits import Draft
from mimicry.sources.files import remove
from mimicry.sources.sinks import read_batches, write_batch
from mimicry.staging import Tables, as_certificates
from mimicry.streaming import ingest as si
from mimicry.streaming import monitors as mon
from mimicry.streaming.triage import NOTIFICATION, Triage


def _stream(t: Tables, table: str) -> DataFrame:
    """One given table as a stream of its files."""
    schema = t.base(table).schema
    reader = t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    return reader.parquet(t.sf_dir)


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/run-{uuid4().hex}"


@query(check(("certificates",), f"""
    SELECT fqdn, brand, score, score >= 0.7 AS is_alert, cert_sha256, {moment_sql("seen_at")} AS first_seen_at
    FROM first_matches""", *INGEST))
def stream_ingest(t: Tables) -> DataFrame:
    """Certificates streamed through scoring into the match table, batch by batch."""
    folder = _folder(t)
    stores = si.Stores.below(t.spark, folder)
    judge = scorer(t.spark)

    def run(batch: DataFrame, batch_id: int) -> None:
        si.ingest_certificates(batch, judge, stores, batch_id)

    certificates = as_certificates(t.staged("certificates", orders=_stream(t, "orders")))
    stream = certificates.writeStream.foreachBatch(run).trigger(availableNow=True)
    stream.option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    return stores.matches.rows().select(
        "fqdn", "brand", "score", "is_alert", "cert_sha256", moment("first_seen_at").alias("first_seen_at")
    )


# Messages arrive in so many batches, by line number; a batch is several files.
BATCHES, FILES = 3, 4
# Files become more, by whole times, as they would hold more lines than so many.
FILE_ROWS = 250_000
# The run that shows the memory: merges of two, parts of few rows.
LONG_BATCHES, FAN, PART_ROWS = 6, 2, 200


def _messages_sql(batches: int) -> str:
    return check(("messages",), f"""
    SELECT 'match' AS kind, fqdn AS id, brand || ' ' || cert_sha256 || ' ' || {moment_sql("seen_at")} AS detail FROM first_matches
    UNION ALL
    SELECT 'certificate', cert_sha256, {moment_sql("min(seen_at)")} FROM names
    WHERE cert_sha256 IN (SELECT cert_sha256 FROM first_matches) GROUP BY cert_sha256
    UNION ALL
    SELECT 'malformed', CAST(line_no // width AS VARCHAR) || ' ' || reject_reason, CAST(count(*) AS VARCHAR)
    FROM checked, span WHERE reject_reason IS NOT NULL GROUP BY line_no // width, reject_reason""",
    *LEAVES,
    f"span AS (SELECT max(line_no) // {batches} + 1 AS width FROM messages)",
    """names AS (SELECT unnest(names) AS name, cert_sha256, to_timestamp(CAST(seen AS DOUBLE)) AS seen_at,
                        issuer_org, line_no AS arrival, line_no // width AS batch FROM keyed, span)""",
    f"""sightings AS (
        SELECT * FROM (SELECT *, {FREE_DV} AS free_dv, row_number() OVER (PARTITION BY name, batch ORDER BY arrival) AS rn
                       FROM names) r WHERE rn = 1)""",
    *scored_ctes("SELECT DISTINCT name AS host, free_dv FROM sightings"), FIRST_MATCHES)


def message_files(t: Tables, batches: int, folder: str) -> int:
    """The messages as files of lines, a folder to each batch; returns the files of a batch."""
    # Staged once: what follows reads it by line number.
    t.messages.select("line_no", "value").write.parquet(f"{folder}/staged")
    lines = t.spark.read.schema("line_no bigint, value string").parquet(f"{folder}/staged")
    width, count = lines.agg((F.max("line_no") / batches).cast("bigint") + 1, F.count("line_no")).first()
    files = FILES * max(1, count // (batches * FILES * FILE_ROWS))
    for batch in range(batches):
        part = lines.where((F.col("line_no") / width).cast("bigint") == batch)
        part.repartitionByRange(files, "line_no").sortWithinPartitions("line_no").select("value").write.text(
            f"{folder}/messages/{batch}"
        )
    remove(t.spark, f"{folder}/staged")
    return files


def ingest_messages(t: Tables, batches: int, fan: int = si.FAN, part_rows: int = si.PART_ROWS) -> si.Stores:
    """Message files ingested in so many micro-batches."""
    folder = _folder(t)
    files = message_files(t, batches, folder)
    si.start_ingest(
        t.spark, f"{folder}/messages/*", scorer(t.spark), folder, f"{folder}/checkpoint", None, files, fan, part_rows
    ).awaitTermination()
    return si.Stores.below(t.spark, folder, fan, part_rows)


def _kept(stores: si.Stores) -> DataFrame:
    detail = F.concat_ws(" ", "brand", "cert_sha256", moment("first_seen_at"))
    reasons = F.concat_ws(" ", F.col("batch_id").cast("string"), "reject_reason").alias("id")
    bad = stores.malformed.rows().groupBy(reasons).agg(F.count("*").cast("string").alias("detail"))
    return (
        stores.matches.rows().select(F.lit("match").alias("kind"), F.col("fqdn").alias("id"), detail.alias("detail"))
        .union(stores.certificates.rows().select(F.lit("certificate"), "cert_sha256", moment("seen_at")))
        .union(bad.select(F.lit("malformed"), "id", "detail"))
    )


@query(_messages_sql(BATCHES))
def stream_messages(t: Tables) -> DataFrame:
    """Message files ingested in three micro-batches: matches, certificates, malformed messages."""
    return _kept(ingest_messages(t, BATCHES))


@query(_messages_sql(LONG_BATCHES))
def stream_memory(t: Tables) -> DataFrame:
    """Six micro-batches through a memory whose runs are merged and looked up by part."""
    return _kept(ingest_messages(t, LONG_BATCHES, FAN, PART_ROWS))


def _written(t: Tables, rows: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream of rows into a folder and read the folder back."""
    folder = _folder(t)
    stream = rows.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
    stream = stream.option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows")
    stream.start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def _arriving(t: Tables, parts: list[DataFrame]) -> DataFrame:
    """A stream whose micro-batches are the given rows, part by part."""
    folder = _folder(t)
    for number, part in enumerate(parts):
        part.repartition(FILES).write.parquet(f"{folder}/{number}")
    reader = t.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", FILES)
    return reader.parquet(f"{folder}/*")


@query(check(("certificates",), """
    SELECT DISTINCT rtrim(lower(host), '.') AS fqdn FROM certificates
    UNION SELECT DISTINCT 'www.' || host FROM certificates WHERE with_www"""))
def stream_new_hosts(t: Tables) -> DataFrame:
    """Hosts passed on once by the deduplication within the watermark."""
    certificates = as_certificates(t.staged("certificates", orders=_stream(t, "orders")))
    names = si.new_names(certificates.drop("arrival"), "3000 days")
    return _written(t, names).select("fqdn")


@query("""
    SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start,
           count(*) FILTER (WHERE event_type = 'error') AS failures
    FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') >= 3""")
def stream_failure_windows(t: Tables) -> DataFrame:
    """The repeated-failure alarm over a stream of events, in update mode: a batch writes the
    windows it changed, whose counts only grow."""
    events = _stream(t, "events").withColumn("at", F.col("ts").cast("timestamp"))
    cycles = events.withColumn("failed", F.col("event_type") == "error")
    alarms = mon.failure_windows(cycles)
    folder = _folder(t)

    def keep(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{folder}/alarms", batch_id)

    stream = alarms.writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True)
    stream.option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    schema = "window_start timestamp, failures bigint"
    latest = read_batches(t.spark, f"{folder}/alarms", schema)
    return latest.groupBy("window_start").agg(F.max("failures").alias("failures")).select(
        moment("window_start").alias("window_start"), "failures"
    )


# Event time of the staged certificates runs over so many years, a batch each; a host is
# forgotten this long after it was passed on, as far as the watermark (as long behind) tells.
EXPIRY = "200 days"
_YEARLY = """yearly AS (
    SELECT rtrim(lower(host), '.') AS fqdn, year(seen_at) AS batch, min(seen_at) AS seen_at
    FROM certificates GROUP BY 1, 2)"""


@query(check(("certificates",), f"""
    SELECT fqdn, {moment_sql("seen_at")} AS seen_at FROM walk WHERE passed""",
    _YEARLY,
    "marks AS (SELECT batch, max(max(seen_at)) OVER (ORDER BY batch) - INTERVAL 200 DAY AS watermark FROM yearly GROUP BY batch)",
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY fqdn ORDER BY batch) AS rn FROM yearly)",
    # A host is forgotten in the batch before, by the watermark that the one before that left.
    """walk AS (
        SELECT fqdn, rn, batch, seen_at, seen_at AS since, true AS passed FROM numbered WHERE rn = 1
        UNION ALL
        SELECT n.fqdn, n.rn, n.batch, n.seen_at,
               CASE WHEN w.since + INTERVAL 200 DAY <= m.watermark THEN n.seen_at ELSE w.since END,
               coalesce(w.since + INTERVAL 200 DAY <= m.watermark, false)
        FROM walk w JOIN numbered n ON n.fqdn = w.fqdn AND n.rn = w.rn + 1
        LEFT JOIN marks m ON m.batch = n.batch - 2)""").replace("WITH ", "WITH RECURSIVE ", 1))
def stream_host_expiry(t: Tables) -> DataFrame:
    """Hosts passed on again after their state has expired, over yearly batches; a late row is dropped."""
    certificates = t.staged("certificates")
    yearly = certificates.groupBy(F.expr("rtrim('.', lower(host))").alias("fqdn"), F.year("seen_at").alias("batch")).agg(
        F.min("seen_at").alias("seen_at")
    )
    rows = yearly.select(
        "batch", F.md5("fqdn").alias("cert_sha256"), "seen_at", F.lit(None).cast("string").alias("issuer_org"),
        F.array("fqdn").alias("all_domains"),
    ).persist()
    batches = [r[0] for r in rows.select("batch").distinct().orderBy("batch").collect()]
    parts = [rows.where(F.col("batch") == b).drop("batch") for b in batches]
    late = parts[0].limit(1).withColumn("all_domains", F.array(F.lit("late.example.com")))
    parts[-1] = parts[-1].union(late)
    passed = _written(t, si.new_names(_arriving(t, parts), EXPIRY))
    rows.unpersist()
    return passed.select("fqdn", moment("seen_at").alias("seen_at"))


# Events arrive in so many batches by time; the watermark is an hour behind.
EVENT_BATCHES = 5
_QUIET_FROM = "2024-01-20 00:00:00"


def _event_parts(events: DataFrame, at: str) -> list[DataFrame]:
    """The events cut by time into parts of about equal spans."""
    first, last = events.agg(F.unix_seconds(F.min(at)), F.unix_seconds(F.max(at))).first()
    width = (last - first) // EVENT_BATCHES + 1
    number = ((F.unix_seconds(at) - first) / width).cast("int")
    return [events.where(number == i) for i in range(EVENT_BATCHES)]


@query(f"""
    WITH feed AS (SELECT event_type AS source, ts FROM events WHERE NOT (event_type = 'signup' AND ts >= TIMESTAMP '{_QUIET_FROM}')),
    span AS (SELECT time_bucket(INTERVAL 10 MINUTE, min(ts), TIMESTAMP '2000-01-01') AS first, max(ts) - INTERVAL 1 HOUR AS watermark FROM feed),
    calendar AS (SELECT unnest(generate_series(first, watermark - INTERVAL 10 MINUTE, INTERVAL 10 MINUTE)) AS w FROM span),
    sources AS (SELECT DISTINCT event_type AS source FROM events UNION SELECT 'never')
    SELECT source, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start FROM calendar, sources
    WHERE NOT EXISTS (SELECT 1 FROM feed f WHERE f.source = sources.source
                      AND time_bucket(INTERVAL 10 MINUTE, f.ts, TIMESTAMP '2000-01-01') = w)""")
def stream_silence(t: Tables) -> DataFrame:
    """The silence alarm of each source over a stream: one that never sends, one silent to the end,
    and an event that comes days late."""
    events = t.source("events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("at"), F.lit(True).alias("is_event"))
    feed = events.where(~((F.col("source") == "signup") & (F.col("at") >= F.lit(_QUIET_FROM).cast("timestamp"))))
    sources = events.select("source").distinct().union(t.spark.createDataFrame([("never",)], "source string"))
    duty = sources.crossJoin(F.broadcast(feed.agg(F.min("at").alias("at")))).withColumn("is_event", F.lit(False))
    parts = _event_parts(feed, "at")
    late = feed.agg(F.min("at").alias("at")).select(F.lit("never").alias("source"), "at", F.lit(True).alias("is_event"))
    parts[0], parts[-1] = parts[0].union(duty), parts[-1].union(late)
    with mon.rocksdb(t.spark):
        silent = _written(t, mon.silence_alarms(_arriving(t, parts), is_event=F.col("is_event")))
    return silent.select("source", moment("window_start").alias("window_start"))


@query(f"""
    WITH means AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') AS w, avg(value) AS mean FROM events GROUP BY 1)
    SELECT {moment_sql("w")} AS window_start FROM (
        SELECT w, mean, lag(w, 1) OVER o AS w1, lag(mean, 1) OVER o AS m1,
               lag(w, 2) OVER o AS w2, lag(mean, 2) OVER o AS m2 FROM means WINDOW o AS (ORDER BY w)) x
    WHERE mean > 40 AND m1 > 40 AND m2 > 40 AND w1 = w - INTERVAL 30 MINUTE AND w2 = w - INTERVAL 60 MINUTE""")
def stream_level_windows(t: Tables) -> DataFrame:
    """The sustained-level alarm over a stream, window over windows in append mode, with samples
    that come days late; a last sample moves the watermark past all windows."""
    events = t.source("events").select(F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("level"))
    parts = _event_parts(events, "at")
    late = parts[0].withColumn("level", F.lit(1e6))
    end = events.agg((F.max("at") + F.expr("INTERVAL 2 DAYS")).alias("at")).withColumn("level", F.lit(0.0))
    parts[-1] = parts[-1].union(late)
    alarms = mon.sustained_level_alarms(_arriving(t, [*parts, end]), limit=40.0, width="30 minutes")
    return _written(t, alarms).select(moment("window_start").alias("window_start"))


# Results of two batches, a line for each host and batch; some hosts were not asked for.
_RESULT_LINE = """
    SELECT id, id % 2 AS batch, fqdn, status, kind, CASE kind
        WHEN 0 THEN '{{"fqdn": "' || fqdn || '"'
        WHEN 1 THEN '{{"fqdn": "' || fqdn || '", "url": "https://elsewhere.example.org/", "status": "' || status || '", "captured_at": "2024-01-01T00:00:00Z", "duration_ms": 5}}'
        ELSE '{{"fqdn": "' || fqdn || '", "url": "https://' || fqdn || '/", "status": "' || status
             || '", "captured_at": "2024-01-01T10:00:00+02:00", "duration_ms": 7, "screenshot_path": "a/b.png", "signals": '
             || CASE kind WHEN 2 THEN 'null'
                          WHEN 3 THEN '{{"title": "T", "form_count": 1, "has_password_input": true, "has_credential_field": false, "cross_domain_form_targets": ["x.org"], "iframe_count": 0, "password_input_count": 1}}'
                          ELSE '{{"title": "T", "form_count": 2, "has_password_input": false, "has_credential_field": true, "cross_domain_form_targets": [], "iframe_count": 0, "password_input_count": 0}}' END
             || '}}' END AS value
    FROM (SELECT min(capture_id) AS id, fqdn, min_by(status, capture_id) AS status, min(capture_id) % 5 AS kind
          FROM {captures} GROUP BY fqdn, capture_id % 2) firsts"""


class _BreaksOnce(Triage):
    """Fails in its second batch, when captures and rejected lines are written."""

    broken = False

    def _store(self, draft: Draft, lines: DataFrame) -> None:
        super()._store(draft, lines)
        if draft.base.number == 0 and not _BreaksOnce.broken:
            _BreaksOnce.broken = True
            raise OSError("the disk went away")


@query(check(("captures", "labelled", "matches"), """
    SELECT 'capture' AS kind, fqdn AS id, status AS detail, count(*) AS rows FROM visits GROUP BY ALL
    UNION ALL SELECT 'rejected', NULL, reason, count(*) FROM judged WHERE reason IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'verdict', fqdn, label, count(*) FROM ruled GROUP BY ALL
    UNION ALL SELECT 'announced', '', '', count(*) FROM due
    UNION ALL SELECT 'delivered', fqdn, brand, count(*) FROM (SELECT DISTINCT fqdn, brand, confidence, batch FROM due) d GROUP BY ALL
    UNION ALL SELECT 'cycle', stage, 'false', 2 FROM (VALUES ('capture'), ('classify'), ('alert')) s(stage)""",
    "lines AS (" + _RESULT_LINE.format(captures="captures") + ")",
    "jobs AS (SELECT DISTINCT fqdn FROM labelled WHERE source <> 'feed')",
    """judged AS (
        SELECT l.*, CASE WHEN kind = 0 THEN '1 invalid field(s)'
                         WHEN fqdn NOT IN (SELECT fqdn FROM jobs) THEN 'hostname the job did not ask for'
                         WHEN kind = 1 THEN 'URL is not one this hostname would be visited at' END AS reason FROM lines l)""",
    """visits AS (
        SELECT j.fqdn, b.batch, coalesce(status, 'error') AS status, CASE WHEN status = 'ok' THEN kind END AS kind
        FROM jobs j CROSS JOIN (VALUES (0), (1)) b(batch)
        LEFT JOIN (SELECT * FROM judged WHERE reason IS NULL) a ON a.fqdn = j.fqdn AND a.batch = b.batch)""",
    """ruled AS (
        SELECT fqdn, batch, kind, CASE WHEN status <> 'ok' THEN 'unreachable' WHEN kind = 2 THEN 'unknown' ELSE 'phishing' END AS label FROM visits)""",
    BEST,
    """due AS (SELECT r.fqdn, b.brand, batch, CASE kind WHEN 3 THEN 0.8 ELSE 0.6 END AS confidence
               FROM ruled r JOIN best b ON b.fqdn = r.fqdn WHERE label = 'phishing')"""))
def triage_cycles(t: Tables) -> DataFrame:
    """Two triage cycles over result lines; the second fails after its second table and is replayed."""
    folder = _folder(t)
    lines = t.spark.sql(_RESULT_LINE, captures=t.captures)
    lines = computed_once(lines.select("id", "batch", "value"), value=F.col("value")).persist()
    for batch in (0, 1):
        lines.where(F.col("batch") == batch).select("value").repartition(FILES).write.text(f"{folder}/lines/{batch}")
    lines.unpersist()
    _BreaksOnce.broken = False
    hour = iter(range(10**6))
    triage = _BreaksOnce(
        t.spark, folder, t.labelled.where("source <> 'feed'").select("fqdn"), vantage="home",
        clock=lambda: datetime(2024, 2, 1) + timedelta(seconds=next(hour)), matches=lambda: t.matches,
    )
    for _ in range(2):  # started again after the failure
        source = t.spark.readStream.format("text").option("maxFilesPerTrigger", FILES).load(f"{folder}/lines/*")
        stream = source.writeStream.foreachBatch(triage.run).trigger(availableNow=True)
        running = stream.option("checkpointLocation", f"{folder}/checkpoint").start()
        try:
            running.awaitTermination()
        except StreamingQueryException:
            continue
    delivered = t.spark.read.schema(f"key string, {NOTIFICATION}").json(f"{folder}/alerts/*")

    def counted(kind: str, rows: DataFrame, id_: Column | str, detail: Column | str) -> DataFrame:
        named = rows.select(F.lit(kind).alias("kind"), *[
            (F.col(c) if isinstance(c, str) else c).cast("string").alias(n) for c, n in ((id_, "id"), (detail, "detail"))
        ])
        return named.groupBy("kind", "id", "detail").agg(F.count(F.lit(1)).alias("rows"))

    whole = [
        counted("capture", triage.table("captures"), "fqdn", "status"),
        counted("verdict", triage.table("verdicts"), "fqdn", "label"),
        counted("announced", triage.table("announced"), F.lit(""), F.lit("")),
        counted("delivered", delivered, "fqdn", "brand"),
        counted("cycle", triage.table("cycles"), "stage", "failed"),
    ]
    whole.append(counted("rejected", triage.table("rejected"), F.lit(None), "reject_reason"))
    return reduce(DataFrame.union, whole)


_NINE = "fqdn, brand, label, confidence, score, evidence, screenshot, final_url, detected_at"


@query(check(("matches", "captures", "verdicts"), f"""
    SELECT {_NINE}, 1 AS times, (SELECT count(*) FROM due) AS ledger FROM (SELECT DISTINCT {_NINE} FROM (
        SELECT fqdn, coalesce(brand, 'unknown') AS brand, label, confidence, score, coalesce(evidence, '') AS evidence,
               screenshot_path AS screenshot, final_url, strftime(classified_at, '%Y-%m-%dT%H:%M:%S.000000Z') AS detected_at
        FROM due) n) d""", BEST, DUE))
def announce_once(t: Tables) -> DataFrame:
    """What two concurrent cycles, one that fails before delivery, and replays of both put out."""
    folder = _folder(t)
    policy = AlertPolicy(("phishing", "parked"), 0.3, None)

    def cycle(writer: str) -> Triage:
        return Triage(t.spark, folder, t.labelled.select("fqdn"), policy, writer=writer,
                      clock=lambda: datetime(2024, 2, 1), matches=lambda: t.matches)

    first, second = cycle("first"), cycle("second")
    seed = first.log.draft()
    seed.write("captures", t.captures)
    seed.write("verdicts", t.verdicts)
    seed.publish("seed", 0)
    # Both draft from the same commit; the first one publishes and breaks off before delivery.
    drafts = [(x, x.log.draft()) for x in (first, second)]
    for x, draft in drafts:
        x._announce(draft, 0)
    published = [x._publish(draft, 0, []) for x, draft in drafts]
    if published != [True, False]:
        raise RuntimeError(f"two cycles got one commit: {published}")
    for x in (second, first, second, first):  # drafted anew, delivered late, replayed twice
        x.announce(0)
    first.announce(1)
    sent = t.spark.read.schema(f"key string, {NOTIFICATION}").json(f"{folder}/alerts/*")
    fields = [c.strip() for c in _NINE.split(",")]
    ledger = first.table("announced").agg(F.count(F.lit(1)).alias("ledger"))
    told = sent.groupBy(*fields).agg(F.count(F.lit(1)).cast("int").alias("times"))
    return told.crossJoin(F.broadcast(ledger))
