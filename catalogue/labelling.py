"""Feeds, candidates and labels."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogue.registry import check, query
from mimicry.config import DEFAULT_BRANDS
from mimicry.plans import labelling as lab
from mimicry.sources import feeds
from mimicry.session import computed_once, shared_folder
from mimicry.sources.labelled import parse_labelled, problems, read_all
from mimicry.staging import Tables


def _today() -> Column:
    return F.lit("2024-02-01").cast("date")

_ENTRIES = """entries AS (
    SELECT fqdn, arg_min(url, page_id) AS url FROM (
        SELECT page_id, trim(url) AS url, lower(regexp_extract(trim(url), '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS fqdn
        FROM feed) f
    WHERE regexp_matches(lower(url), '^https?://') AND fqdn <> '' AND NOT contains(fqdn, 'bad_host-')
      AND regexp_matches(fqdn, '^[a-z0-9._-]+$') GROUP BY fqdn)"""
_TOKENS = [
    (i, b.name, token) for i, b in enumerate(DEFAULT_BRANDS) for token in b.tokens
]
_MENTION = "CASE " + " ".join(
    f"WHEN contains(lower(url), '{token}') THEN '{name}'" for _, name, token in _TOKENS
) + " END"


def _entries(t: Tables) -> DataFrame:
    lines = t.feed.select("url", F.col("page_id").alias("arrival"))
    return feeds.feed_entries(lines, "daily.txt")


@query(check(("feed",), "SELECT fqdn, url, 'daily.txt' AS source FROM entries", _ENTRIES))
def url_feed(t: Tables) -> DataFrame:
    return _entries(t)


@query(check(("feed",), f"SELECT page_id, {_MENTION} AS brand FROM feed"))
def brand_for_url(t: Tables) -> DataFrame:
    brand = feeds.brand_for_url(F.col("url"), DEFAULT_BRANDS)
    return t.feed.select("page_id", brand.alias("brand"))


_FEED_CANDIDATES = f"""feed_candidates AS (
    SELECT fqdn, 'daily.txt' AS source, 'phishing' AS suggestion, {_MENTION} AS brand,
           'listed by daily.txt; confirm from the capture' AS note FROM entries WHERE {_MENTION} IS NOT NULL)"""


@query(check(("feed",), "SELECT * FROM feed_candidates", _ENTRIES, _FEED_CANDIDATES))
def candidates_from_feed(t: Tables) -> DataFrame:
    return lab.candidates_from_feed(_entries(t), DEFAULT_BRANDS)


_ALL = [
    _ENTRIES,
    _FEED_CANDIDATES,
    """alerting AS (SELECT DISTINCT fqdn, 'alerts' AS source, CAST(NULL AS VARCHAR) AS suggestion,
                    CAST(NULL AS VARCHAR) AS brand, 'alerted' AS note FROM matches WHERE is_alert)""",
    "present AS (SELECT fqdn FROM labelled WHERE labelled_by = 'human')",
    """fresh AS (
        SELECT fqdn, source, suggestion, brand, note FROM (
            SELECT *, row_number() OVER (PARTITION BY fqdn ORDER BY place) AS rn FROM (
                SELECT 1 AS place, * FROM feed_candidates UNION ALL SELECT 2, * FROM alerting) u) r
        WHERE rn = 1 AND fqdn NOT IN (SELECT fqdn FROM present))""",
]


def _candidates(t: Tables) -> DataFrame:
    feed = lab.candidates_from_feed(_entries(t), DEFAULT_BRANDS).withColumn("place", F.lit(1))
    none = F.lit(None).cast("string")
    alerting = t.matches.where("is_alert").select("fqdn").distinct().select(
        "fqdn", F.lit("alerts").alias("source"), none.alias("suggestion"), none.alias("brand"),
        F.lit("alerted").alias("note"), F.lit(2).alias("place"),
    )
    return feed.unionByName(alerting)


def _fresh(t: Tables) -> DataFrame:
    present = t.labelled.where("labelled_by = 'human'")
    return lab.new_candidates(_candidates(t), present, _today())


@query(check(("feed", "matches", "labelled"), """
    SELECT fqdn, suggestion, brand, source, '2024-02-01' AS labelled_at, note, 'screenshot' AS label_basis FROM fresh""", *_ALL))
def new_candidates(t: Tables) -> DataFrame:
    return _fresh(t).drop("expected")


@query(check(("feed", "matches", "labelled"), """
    SELECT (SELECT count(*) FROM fresh) AS added,
           (SELECT count(*) FROM feed_candidates) + (SELECT count(*) FROM alerting) - (SELECT count(*) FROM fresh) AS skipped""", *_ALL))
def candidate_counts(t: Tables) -> DataFrame:
    return lab.candidate_counts(_candidates(t), _fresh(t))


_LABELS = """given AS (
    SELECT fqdn, CASE c_custkey % 4 WHEN 0 THEN 'phishing' WHEN 1 THEN 'parked' WHEN 2 THEN 'unreachable' ELSE 'legitimate' END AS label,
           c_custkey FROM labelled WHERE expected <> 'legitimate')"""
_PLACED = [
    _LABELS,
    """sets AS (SELECT fqdn, expected, labelled_by, CASE WHEN source = 'alerts' THEN 'tracked' ELSE 'feed-a' END AS dest
                FROM labelled WHERE source <> '')""",
    """routed AS (
        SELECT g.fqdn, g.label, CASE WHEN s.dest IS NOT NULL THEN s.dest
                    WHEN g.fqdn IN (SELECT fqdn FROM matches) THEN 'tracked' ELSE 'feed' END AS dest
        FROM given g LEFT JOIN sets s USING (fqdn))""",
]


def _given(t: Tables) -> DataFrame:
    label = F.expr("element_at(array('phishing', 'parked', 'unreachable', 'legitimate'), CAST(c_custkey % 4 AS INT) + 1)")
    given = t.labelled.where("expected <> 'legitimate'")
    return given.select("fqdn", label.alias("label"))


def _sets(t: Tables) -> DataFrame:
    dest = F.expr("CASE WHEN source = 'alerts' THEN 'tracked' ELSE 'feed-a' END")
    day = F.lit("2024-01-01").cast("date").alias("labelled_at")
    kept = t.labelled.where("source <> ''")
    return kept.select("fqdn", "expected", "labelled_by", day, dest.alias("dest"))


@query(check(("labelled",), """
    SELECT fqdn, label, CASE WHEN label = 'unreachable' THEN 'unreachable describes a visit, not a site, and cannot be a label' END AS reject_reason
    FROM given""", _LABELS))
def label_checks(t: Tables) -> DataFrame:
    return lab.refused_labels(_given(t))


@query(check(("labelled", "matches"), """
    SELECT fqdn, label, dest, CASE WHEN dest = 'tracked' THEN 'alerts' ELSE 'openphish' END AS label_source FROM routed""", *_PLACED))
def label_routing(t: Tables) -> DataFrame:
    return lab.route_labels(_given(t), _sets(t), t.matches)


@query(check(("labelled",), """
    SELECT coalesce(l.fqdn, g.fqdn) AS fqdn, coalesce(g.label, l.expected) AS expected,
           CASE WHEN l.fqdn IS NULL THEN 'alerts' ELSE l.source END AS source,
           CASE WHEN g.label IS NOT NULL THEN '2024-02-01' ELSE '2024-01-01' END AS labelled_at,
           CASE WHEN l.fqdn IS NULL THEN 'given' ELSE l.brand END AS brand,
           CASE WHEN g.label IS NOT NULL AND l.fqdn IS NOT NULL AND l.expected <> g.label AND coalesce(l.labelled_by, '') <> 'human'
                THEN coalesce(l.note || '; ', '') || 'relabelled by a human; was ' || l.expected || ' (' || coalesce(l.labelled_by, '?') || ')'
                ELSE l.note END AS note,
           CASE WHEN g.label IS NOT NULL THEN 'human' ELSE l.labelled_by END AS labelled_by
    FROM (SELECT * FROM labelled WHERE source <> '') l
    FULL JOIN (SELECT * FROM given WHERE label <> 'unreachable') g USING (fqdn)""", _LABELS))
def label_upsert(t: Tables) -> DataFrame:
    current = t.labelled.where("source <> ''").select(
        "fqdn", "expected", "source", F.lit("2024-01-01").cast("date").alias("labelled_at"), "brand",
        "note", F.lit(None).cast("string").alias("suggestion"), F.lit("feed").alias("label_basis"),
        "labelled_by",
    )
    given = lab.refused_labels(_given(t)).where("reject_reason IS NULL").select(
        "fqdn", "label", F.lit("given").alias("brand"),
        F.lit(None).cast("string").alias("suggestion"), F.lit("alerts").alias("label_source"),
    )
    after = lab.upsert_labels(current, given, _today())
    return after.drop("suggestion", "label_basis").withColumn(
        "labelled_at", F.col("labelled_at").cast("string")
    )


@query(check(("labelled", "matches"), """
    SELECT fqdn, expected, labelled_by, dest FROM (
        SELECT *, row_number() OVER (PARTITION BY fqdn ORDER BY dest = 'tracked' DESC, dest DESC) AS rn FROM (
            SELECT * FROM sets UNION ALL SELECT fqdn, 'phishing', 'human', 'feed-b' FROM given) u) r WHERE rn = 1""", *_PLACED))
def current_labels(t: Tables) -> DataFrame:
    more = _given(t).select(
        "fqdn", F.lit("phishing").alias("expected"), F.lit("human").alias("labelled_by"),
        F.lit("2024-01-02").cast("date").alias("labelled_at"), F.lit("feed-b").alias("dest"),
    )
    return lab.current_labels(_sets(t).unionByName(more)).drop("labelled_at")


_SET_LINES = """
    SELECT c_custkey AS line_no, CASE c_custkey % 11
        WHEN 0 THEN '# a comment'
        WHEN 1 THEN '{{"fqdn": "' || fqdn || '", "expected": "'
        WHEN 2 THEN '{{"fqdn": "' || fqdn || '", "expected": "parked", "labelled_at": "2024-01-01"}}'
        WHEN 3 THEN '{{"fqdn": "' || fqdn || '", "expected": "malware", "source": "a", "labelled_at": "2024-01-01"}}'
        WHEN 4 THEN '{{"fqdn": "' || fqdn || '", "expected": "parked", "source": "a", "labelled_at": "January"}}'
        WHEN 5 THEN '{{"fqdn": "' || fqdn || '", "expected": null, "source": "a", "labelled_at": "2024-01-01"}}'
        WHEN 6 THEN '{{"fqdn": "' || fqdn || '", "expected": "parked", "source": "a", "labelled_at": "2024-01-01", "label_basis": "guess"}}'
        WHEN 7 THEN '["not", "an", "object"]'
        WHEN 8 THEN '{{"fqdn": " Same.example.ORG ", "expected": "parked", "source": "a", "labelled_at": "2024-01-01"}}'
        ELSE '{{"fqdn": "' || fqdn || '", "expected": "phishing", "source": "a", "labelled_at": "2024-01-01", "label_basis": "feed"}}' END AS value
    FROM {labelled}"""


def _set_lines(t: Tables) -> DataFrame:
    lines = t.spark.sql(_SET_LINES, labelled=t.labelled)
    return computed_once(lines, value=F.col("value"))


@query(check(("labelled",), """
    SELECT line_no, CASE c_custkey % 11 WHEN 1 THEN 'not valid JSON' WHEN 2 THEN 'missing field(s) source'
        WHEN 3 THEN 'unknown label malware' WHEN 4 THEN 'labelled_at must be an ISO date' WHEN 5 THEN fqdn || ' has no label yet'
        WHEN 6 THEN 'label_basis must be ''screenshot'' or ''feed''' WHEN 7 THEN 'expected a JSON object' END AS problem
    FROM (SELECT *, c_custkey AS line_no FROM labelled WHERE c_custkey % 11 BETWEEN 1 AND 7) l
    UNION ALL
    SELECT c_custkey, 'same.example.org is also in set.jsonl:' || first FROM (
        SELECT c_custkey, min(c_custkey) OVER () AS first FROM labelled WHERE c_custkey % 11 = 8) s WHERE c_custkey > first"""))
def labelled_problems(t: Tables) -> DataFrame:
    lines = _set_lines(t).withColumn("file_path", F.lit("set.jsonl"))
    return problems(parse_labelled(lines)).drop("file_path")


@query(check(("labelled",), """
    SELECT c_custkey AS line_no, CASE WHEN c_custkey % 11 = 8 THEN 'same.example.org' ELSE fqdn END AS fqdn,
           CASE c_custkey % 11 WHEN 5 THEN 'unknown' WHEN 8 THEN 'parked' ELSE 'phishing' END AS expected,
           CASE WHEN c_custkey % 11 IN (9, 10) THEN 'feed' ELSE 'screenshot' END AS label_basis,
           '2024-01-01' AS labelled_at FROM labelled WHERE c_custkey % 11 IN (5, 8, 9, 10)"""))
def labelled_scan(t: Tables) -> DataFrame:
    lines = _set_lines(t)
    kept = parse_labelled(lines, allow_unlabelled=True).where("reject_reason IS NULL")
    return kept.select(
        "line_no", "fqdn", "expected", "label_basis", F.col("labelled_at").cast("string").alias("labelled_at")
    )


# The tracked set and two feed sets as files of their own. Some feed lines repeat tracked ones.
_FILES = ("0-tracked", "1-feed", "2-feed")
_FILED = f"""
    SELECT place, place % 11 AS kind, fqdn, value, CASE place % 3 WHEN 0 THEN '{_FILES[0]}' WHEN 1 THEN '{_FILES[1]}' ELSE '{_FILES[2]}' END AS file
    FROM ({_SET_LINES.replace("c_custkey AS line_no", "c_custkey AS place, fqdn")}) l
    UNION ALL
    SELECT c_custkey + 1000000, 9, fqdn,
           '{{{{"fqdn": "' || upper(fqdn) || '", "expected": "parked", "source": "b", "labelled_at": "2024-01-01"}}}}', '{_FILES[2]}'
    FROM {{labelled}} WHERE c_custkey % 5 = 0"""


@query(check(("labelled",), """
    SELECT 'site' AS kind, file, line_no, fqdn AS detail FROM placed WHERE problem IS NULL AND place = first
    UNION ALL SELECT 'problem', file, line_no, coalesce(problem, fqdn || ' is also in ' || first.file || ':' || first.line_no)
    FROM placed WHERE problem IS NOT NULL OR place > first""",
    "filed AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY place) AS line_no FROM ("
    + _FILED.format(labelled="labelled") + ") x)",
    """judged AS (
        SELECT file, line_no, CASE WHEN kind = 8 THEN 'same.example.org' ELSE fqdn END AS fqdn, {'file': file, 'line_no': line_no} AS place,
               CASE kind WHEN 1 THEN 'not valid JSON' WHEN 2 THEN 'missing field(s) source' WHEN 3 THEN 'unknown label malware'
                    WHEN 4 THEN 'labelled_at must be an ISO date' WHEN 5 THEN fqdn || ' has no label yet'
                    WHEN 6 THEN 'label_basis must be ''screenshot'' or ''feed''' WHEN 7 THEN 'expected a JSON object' END AS problem
        FROM filed WHERE kind <> 0)""",
    "placed AS (SELECT *, min(place) FILTER (WHERE problem IS NULL) OVER (PARTITION BY fqdn) AS first FROM judged)"))
def labelled_sets(t: Tables) -> DataFrame:
    """Three files read together: usable sites, refused lines, and every repeated line of a site."""
    folder = f"{shared_folder(t.spark)}/run-{uuid4().hex}"
    lines = computed_once(t.spark.sql(_FILED, labelled=t.labelled), value=F.col("value")).persist()
    for name in _FILES:
        # A set is one file, kept in order by a person.
        one = lines.where(F.col("file") == name).repartition(1).sortWithinPartitions("place")
        one.select("value").write.text(f"{folder}/{name}")
    lines.unpersist()
    entries = read_all(t.spark, f"{folder}/{_FILES[0]}", [f"{folder}/{name}" for name in _FILES[1:]])
    named = f"[^ ]*/({'|'.join(_FILES)})/[^: ]*"
    entries = entries.withColumn("file_path", F.regexp_replace("file_path", named, "$1"))
    wrong = problems(entries).select(
        F.lit("problem").alias("kind"), F.col("file_path").alias("file"), "line_no", F.col("problem").alias("detail")
    )
    usable = entries.where("reject_reason IS NULL").groupBy("fqdn").agg(F.min(F.struct("file_path", "line_no")).alias("first"))
    return wrong.union(usable.select(F.lit("site"), "first.file_path", "first.line_no", "fqdn"))


_SEEDS = ", ".join("('{}', '{}')".format(name, why.replace("'", "''")) for name, why in lab.HARD_NEGATIVES)


@query(check(("feed", "matches", "labelled"), f"""
    SELECT fqdn, suggestion, source, note FROM (
        SELECT *, row_number() OVER (PARTITION BY fqdn ORDER BY place) AS rn FROM (
            SELECT 1 AS place, fqdn, source, suggestion, note FROM feed_candidates
            UNION ALL SELECT 2, fqdn, source, suggestion, note FROM alerting
            UNION ALL SELECT 3, fqdn, 'calibration', 'legitimate', note FROM (VALUES {_SEEDS}) v(fqdn, note)) u) r
    WHERE rn = 1 AND fqdn NOT IN (SELECT fqdn FROM present)""", *_ALL))
def candidates_with_negatives(t: Tables) -> DataFrame:
    """All three sources of candidates: the feed, alerts, and known harmless lookalikes."""
    seeded = lab.hard_negatives(t.spark).withColumn("place", F.lit(3))
    present = t.labelled.where("labelled_by = 'human'")
    fresh = lab.new_candidates(_candidates(t).unionByName(seeded), present, _today())
    return fresh.select("fqdn", "suggestion", "source", "note")
