"""Metrics, arms and statistics."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogue.registry import check, query, scorer
from catalogue.scoring_sql import ratio, rounded, scored_ctes
from mimicry.config import SWEEP_THRESHOLDS
from mimicry.functions.rounding import round_binary
from mimicry.operators import metrics as m
from mimicry.operators import statistics as s
from mimicry.operators.queues import captures_with_verdict
from mimicry.plans import evaluation as e
from mimicry.session import shared_folder
from mimicry.staging import Tables


def _f1(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN {rounded(f'2 * {p} * {r} / ({p} + {r})')} ELSE 0.0::DOUBLE END"


def class_ctes(source: str, group: str = "1") -> list[str]:
    """``classes`` and ``macros`` per ``grp`` of a table with expected and predicted."""
    return [
        f"pairs AS (SELECT {group} AS grp, expected, predicted FROM {source})",
        """names AS (SELECT DISTINCT grp, expected AS label FROM pairs
                     UNION SELECT DISTINCT grp, predicted FROM pairs)""",
        """tallies AS (
            SELECT n.grp, n.label, count(*) FILTER (WHERE expected = label) AS support,
                   count(*) FILTER (WHERE predicted = label) AS predicted,
                   count(*) FILTER (WHERE predicted = label AND expected = label) AS true_positives
            FROM names n JOIN pairs p ON p.grp = n.grp GROUP BY n.grp, n.label)""",
        f"""rates AS (SELECT *, {ratio("true_positives", "predicted")} AS precision,
                        {ratio("true_positives", "support")} AS recall FROM tallies)""",
        f"classes AS (SELECT *, {_f1('precision', 'recall')} AS f1 FROM rates)",
        f"""macros AS (
            SELECT grp, CAST(sum(support) AS BIGINT) AS total, CAST(sum(true_positives) AS BIGINT) AS correct,
                   {ratio("sum(true_positives)", "sum(support)")} AS accuracy,
                   {rounded("sum(precision ORDER BY label) / count(*)")} AS macro_precision,
                   {rounded("sum(recall ORDER BY label) / count(*)")} AS macro_recall,
                   {rounded("sum(f1 ORDER BY label) / count(*)")} AS macro_f1
            FROM classes GROUP BY grp)""",
    ]


_PAIRS = ("label_pairs",)
_MACRO = "total, correct, accuracy, macro_precision, macro_recall, macro_f1"


@query(check(_PAIRS, """
    SELECT e.label AS expected, p.label AS predicted,
           (SELECT count(*) FROM pairs x WHERE x.expected = e.label AND x.predicted = p.label) AS n
    FROM names e, names p""", *class_ctes("label_pairs")[:2]))
def confusion(t: Tables) -> DataFrame:
    return m.confusion_matrix(m.confusion_counts(t.label_pairs))


@query(check(_PAIRS, """
    SELECT label, support, predicted, true_positives, predicted - true_positives AS false_positives,
           support - true_positives AS false_negatives, precision, recall, f1 FROM classes""",
    *class_ctes("label_pairs")))
def class_metrics(t: Tables) -> DataFrame:
    return m.class_metrics(m.confusion_counts(t.label_pairs))


@query(check(_PAIRS, f"SELECT {_MACRO} FROM macros", *class_ctes("label_pairs")))
def macro_metrics(t: Tables) -> DataFrame:
    return m.macro_metrics(m.confusion_counts(t.label_pairs))


@query(check(_PAIRS, f"SELECT grp AS split, {_MACRO} FROM macros",
             *class_ctes("label_pairs", "coalesce(nullif(source, ''), '(unknown)')")))
def metrics_by_source(t: Tables) -> DataFrame:
    return m.split_metrics(t.label_pairs, "source", "(unknown)")


@query(check(_PAIRS, f"SELECT grp AS split, {_MACRO} FROM macros",
             *class_ctes("label_pairs", "coalesce(nullif(verdict_brand, ''), '(none)')")))
def metrics_by_brand(t: Tables) -> DataFrame:
    return m.split_metrics(t.label_pairs, "verdict_brand", "(none)")


_POINTS = ", ".join(f"({x}::DOUBLE)" for x in SWEEP_THRESHOLDS)
_SWEEP = [
    f"""points AS (
        SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS alerts,
               count(*) FILTER (WHERE score >= threshold AND expected = 'phishing') AS true_positives,
               count(*) FILTER (WHERE score >= threshold AND expected <> 'phishing') AS false_positives,
               count(*) FILTER (WHERE score < threshold AND expected = 'phishing') AS false_negatives
        FROM label_pairs, (VALUES {_POINTS}) v(threshold) GROUP BY threshold)""",
    f"""rated AS (SELECT *, {ratio("true_positives", "alerts")} AS precision,
                     {ratio("true_positives", "true_positives + false_negatives")} AS recall,
                     abs(threshold - 0.7) < 1e-9 AS is_configured FROM points)""",
    f"sweep AS (SELECT *, {_f1('precision', 'recall')} AS f1 FROM rated)",
]


@query(check(_PAIRS, "SELECT * FROM sweep", *_SWEEP))
def threshold_sweep(t: Tables) -> DataFrame:
    return m.threshold_sweep(t.label_pairs, SWEEP_THRESHOLDS, 0.7)


@query(check(_PAIRS, "SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1", *_SWEEP))
def best_threshold(t: Tables) -> DataFrame:
    return m.best_threshold(m.threshold_sweep(t.label_pairs, SWEEP_THRESHOLDS, 0.7))


@query(check(_PAIRS, """
    SELECT fqdn, expected, predicted, expected = 'phishing' AS is_costly FROM label_pairs
    WHERE expected <> predicted"""))
def mistakes(t: Tables) -> DataFrame:
    return m.mistakes(t.label_pairs).select("fqdn", "expected", "predicted", "is_costly")


@query(check(_PAIRS, """
    SELECT fqdn, verdict_brand, predicted FROM label_pairs
    WHERE verdict_brand <> '' AND predicted <> 'phishing'"""))
def contradictory_verdicts(t: Tables) -> DataFrame:
    return m.contradictory(t.label_pairs).select("fqdn", "verdict_brand", "predicted")


def _draw(i: int) -> str:
    """Step ``i`` of a resample: the quantile of the hits in cell i among the draws that are left."""
    before = f"SELECT r, left_n FROM draw{i - 1}" if i else f"SELECT r, (SELECT sum(n) FROM cells)::BIGINT AS left_n FROM range({s.RESAMPLES}) t(r)"
    return f"""draw{i} AS MATERIALIZED (
        SELECT r, any_value(left_n) - min(x) FILTER (WHERE cum >= u OR x = hi) AS left_n,
               min(x) FILTER (WHERE cum >= u OR x = hi) AS drawn
        FROM (SELECT r, left_n, u, hi, x, sum(chance) OVER (PARTITION BY r ORDER BY x) AS cum FROM (
            SELECT r, left_n, u, hi, x, CASE WHEN p = 1 THEN 1.0 ELSE exp(lgamma(left_n + 1) - lgamma(x + 1) - lgamma(left_n - x + 1)
                                             + x * ln(p) + (left_n - x) * ln(1 - p)) END AS chance
            FROM (SELECT *, unnest(range(lo, hi + 1)) AS x FROM (
                SELECT r, left_n, p, (('0x' || substr(md5('{s.SEED}:' || r || ':{i}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u,
                       CASE WHEN p = 1 THEN left_n ELSE greatest(0, floor(left_n * p - 9 * sqrt(left_n * p * (1 - p)) - 9))::BIGINT END AS lo,
                       CASE WHEN p = 1 THEN left_n ELSE least(left_n, ceil(left_n * p + 9 * sqrt(left_n * p * (1 - p)) + 9))::BIGINT END AS hi
                FROM (SELECT r, left_n, n::DOUBLE / sites AS p FROM ({before}) b, cells WHERE place = {i}) c) d) e) f) g
        GROUP BY r)"""


# The labels are three on either side: nine cells at most.
_DRAWS = [
    """cells AS MATERIALIZED (
        SELECT expected, predicted, n, row_number() OVER w - 1 AS place,
               sum(n) OVER (ORDER BY expected, predicted ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sites
        FROM (SELECT expected, predicted, count(*) AS n FROM label_pairs GROUP BY ALL) c WINDOW w AS (ORDER BY expected, predicted))""",
    *[_draw(i) for i in range(9)],
    "drawn AS (" + " UNION ALL ".join(f"SELECT r, {i} AS place, drawn FROM draw{i}" for i in range(9)) + ")",
    "picks AS (SELECT r, expected, predicted, drawn AS n FROM drawn JOIN cells USING (place) WHERE drawn > 0)",
    f"""scores AS (
        SELECT r, label, support, {ratio("hits", "guessed")} AS precision, {ratio("hits", "support")} AS recall, hits FROM (
            SELECT r, label, sum(n) FILTER (WHERE side = 0) AS s, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS support,
                   coalesce(sum(n) FILTER (WHERE side = 1), 0) AS guessed, coalesce(sum(n) FILTER (WHERE side = 0 AND expected = predicted), 0) AS hits
            FROM (SELECT *, 0 AS side, expected AS label FROM picks UNION ALL SELECT *, 1, predicted FROM picks) b GROUP BY r, label) t)""",
    f"""resampled AS (
        SELECT r, {ratio("sum(hits)", "sum(support)")} AS accuracy, {rounded("sum(f1 ORDER BY label) / count(*)")} AS macro_f1
        FROM (SELECT *, {_f1("precision", "recall")} AS f1 FROM scores) f GROUP BY r)""",
]
_LOW, _HIGH = s.percentile_bounds(s.RESAMPLES)


@query(check(_PAIRS, " UNION ALL ".join(f"""
    SELECT '{m}' AS metric, (array_agg({m} ORDER BY {m}))[{_LOW + 1}] AS low, (array_agg({m} ORDER BY {m}))[{_HIGH + 1}] AS high
    FROM resampled""" for m in ("accuracy", "macro_f1")), *_DRAWS))
def bootstrap(t: Tables) -> DataFrame:
    """Intervals from resamples whose every draw follows from the seed, its resample and its cell."""
    return s.bootstrap_intervals(m.confusion_counts(t.label_pairs))


@query(check(("labelled",), """
    SELECT coalesce(nullif(labelled_by, ''), 'unrecorded') AS labelled_by, count(*) AS sites
    FROM labelled GROUP BY 1"""))
def labeller_counts(t: Tables) -> DataFrame:
    return e.labeller_counts(t.labelled)


_SITES = ["sites AS (SELECT * FROM labelled WHERE expected <> 'unknown')"]
_SCORES = [
    *scored_ctes("SELECT DISTINCT fqdn AS host, false AS free_dv FROM sites"),
    """site_scores AS (
        SELECT s.fqdn, s.expected, s.note, s.source, coalesce(b.score, 0.0::DOUBLE) AS score,
               coalesce(b.brand, s.brand) AS brand
        FROM sites s LEFT JOIN (
            SELECT host, score, brand FROM (
                SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, pos) AS rn
                FROM scored WHERE score >= 0.4) r WHERE rn = 1) b ON b.host = s.fqdn)""",
]
_SHOTS = """shots AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fqdn ORDER BY capture_id DESC) AS rn
                   FROM captures) WHERE rn = 1)"""
_ARM = """arm AS (
    SELECT fqdn, expected, CASE WHEN score >= 0.7 THEN 'phishing' ELSE 'legitimate' END AS predicted,
           score, brand, note, source FROM site_scores)"""


def _scored_sites(t: Tables) -> DataFrame:
    return e.score_sites(e.judgeable(t.labelled), scorer(t.spark))


@query(check(("labelled",), "SELECT * FROM arm", *_SITES, *_SCORES, _ARM))
def scoring_only_arm(t: Tables) -> DataFrame:
    arm = e.scoring_only_arm(_scored_sites(t), 0.7)
    return arm.drop("screenshot", "verdict_brand")


@query(check(("labelled",), f"SELECT grp AS split, {_MACRO} FROM macros", *_SITES, *_SCORES, _ARM,
             *class_ctes("arm", "coalesce(nullif(source, ''), '(unknown)')")))
def evaluation_by_source(t: Tables) -> DataFrame:
    arm = e.scoring_only_arm(_scored_sites(t), 0.7)
    return m.split_metrics(arm, "source", "(unknown)")


_JUDGED = """last_verdicts AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY verdict_id DESC) AS rv
                   FROM verdicts WHERE label <> 'error' AND backend = 'vision') WHERE rv = 1)"""
_FULL = """full_arm AS (
    SELECT s.fqdn, s.expected, s.score, s.brand, s.note, s.source, c.screenshot_path AS screenshot,
           v.brand_impersonated AS verdict_brand, c.duration_ms, v.latency_ms,
           coalesce(v.prompt_tokens, 0) + coalesce(v.completion_tokens, 0) AS tokens, v.cost_usd,
           CASE WHEN c.status IS NULL THEN 'not captured' WHEN c.status <> 'ok' THEN 'unreachable'
                WHEN s.score >= 0.7 AND v.label IS NULL THEN 'not classified' END AS excluded_reason,
           CASE WHEN s.score < 0.7 THEN 'legitimate' ELSE v.label END AS judged
    FROM site_scores s LEFT JOIN shots c USING (fqdn) LEFT JOIN last_verdicts v ON v.capture_id = c.capture_id)"""
_EVIDENCE = ("labelled", "captures", "verdicts")


def _full(t: Tables) -> tuple[DataFrame, DataFrame]:
    captures = captures_with_verdict(
        e.judgeable(t.labelled), t.captures, t.verdicts, "vision"
    )
    return e.full_arm(_scored_sites(t), 0.7, captures), captures


@query(check(_EVIDENCE, """
    SELECT fqdn, expected, CASE WHEN excluded_reason IS NULL THEN judged END AS predicted, score, brand,
           note, source, screenshot, verdict_brand, excluded_reason FROM full_arm""",
    *_SITES, *_SCORES, _SHOTS, _JUDGED, _FULL))
def full_arm(t: Tables) -> DataFrame:
    return _full(t)[0]


@query(check(_EVIDENCE, f"""
    SELECT count(*) AS sites, CAST(sum(duration_ms) AS BIGINT) AS capture_ms,
           CAST(sum(coalesce(latency_ms, 0)) AS BIGINT) AS classify_ms, CAST(sum(tokens) AS BIGINT) AS tokens,
           {rounded("sum(coalesce(cost_usd, 0))", 3)} AS cost_usd,
           {ratio("sum(duration_ms) + sum(coalesce(latency_ms, 0))", "count(*)", 1)} AS ms_per_site
    FROM full_arm WHERE excluded_reason IS NULL""", *_SITES, *_SCORES, _SHOTS, _JUDGED, _FULL))
def arm_cost(t: Tables) -> DataFrame:
    arm, captures = _full(t)
    cost = m.cost_of(e.judged(arm).select("fqdn"), captures)
    return cost.drop("usd_per_1000_sites")


_MODELS = ["small", "medium", "large"]
_MODEL_CTES = [
    *_SITES, *_SCORES, _SHOTS,
    """answers AS (
        SELECT m.model, s.fqdn, s.expected, CASE WHEN s.score < 0.7 THEN 'legitimate' ELSE v.label END AS predicted,
               coalesce(v.latency_ms, 0) AS classify_ms, coalesce(v.cost_usd, 0.0) AS cost_usd,
               coalesce(v.prompt_tokens, 0) + coalesce(v.completion_tokens, 0) AS tokens
        FROM site_scores s JOIN shots c USING (fqdn) CROSS JOIN (VALUES ('small'), ('medium'), ('large')) m(model)
        LEFT JOIN verdicts v ON v.capture_id = c.capture_id AND v.model = m.model AND v.backend = 'vision' AND v.label <> 'error'
        WHERE c.status = 'ok' AND (s.score < 0.7 OR v.label IS NOT NULL))""",
]


def _model_predictions(t: Tables) -> DataFrame:
    return e.model_predictions(
        _scored_sites(t), 0.7, t.captures, t.verdicts, _MODELS, "vision"
    )


@query(check(_EVIDENCE, f"""
    SELECT a.model, count(*) AS judged, any_value(accuracy) AS accuracy, any_value(macro_f1) AS macro_f1,
           {ratio("sum(classify_ms)", "count(*)", 1)} AS ms_per_site, CAST(sum(tokens) AS BIGINT) AS tokens,
           {rounded("sum(cost_usd)", 3)} AS cost_usd
    FROM answers a JOIN macros ON grp = a.model GROUP BY a.model""",
    *_MODEL_CTES, *class_ctes("answers", "model")))
def model_comparison(t: Tables) -> DataFrame:
    return e.model_table(_model_predictions(t))


_SPLIT = """
    SELECT a.model AS model_a, b.model AS model_b,
           count(*) FILTER (WHERE a.expected = a.predicted AND b.expected <> b.predicted) AS only_a,
           count(*) FILTER (WHERE b.expected = b.predicted AND a.expected <> a.predicted) AS only_b,
           count(*) AS shared
    FROM answers a JOIN answers b USING (fqdn)
    WHERE (a.model, b.model) IN (('small', 'medium'), ('small', 'large'), ('medium', 'large'))
    GROUP BY a.model, b.model"""


@query(check(_EVIDENCE, f"""
    SELECT model_a, model_b, only_a, only_b, shared,
           CASE WHEN only_a + only_b = 0 THEN 1.0::DOUBLE ELSE {rounded('''least(1.0, 2 * (
               SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1)
                              - (only_a + only_b) * ln(2)))
               FROM (SELECT unnest(range(0, least(only_a, only_b) + 1)) AS k) ks))''', 6)} END AS p_value
    FROM ({_SPLIT}) d""", *_MODEL_CTES))
def mcnemar(t: Tables) -> DataFrame:
    tests = s.paired_tests(e.model_answers(_model_predictions(t)), _MODELS)
    return tests.withColumn("p_value", round_binary(F.col("p_value"), 6))


_REPORT = [
    *_SITES, *_SCORES, _SHOTS, _JUDGED, _FULL,
    """predictions AS (
        SELECT 'scoring_only' AS arm, fqdn, expected, CASE WHEN score >= 0.7 THEN 'phishing' ELSE 'legitimate' END AS predicted, score,
               brand, source, CAST(NULL AS VARCHAR) AS verdict_brand, CAST(NULL AS VARCHAR) AS excluded_reason FROM site_scores
        UNION ALL SELECT 'scoring_plus_verdicts', fqdn, expected, judged, score, brand, source, verdict_brand, excluded_reason FROM full_arm)""",
    "made AS (SELECT * FROM predictions WHERE excluded_reason IS NULL)",
    """groups AS (
        SELECT 'metrics|' || arm || '|' AS grp, expected, predicted FROM made
        UNION ALL SELECT 'by_source|' || arm || '|' || coalesce(nullif(source, ''), '(unknown)'), expected, predicted FROM made
        UNION ALL SELECT 'by_brand|' || arm || '|' || coalesce(nullif(brand, ''), '(none)'), expected, predicted FROM made)""",
    *class_ctes("groups", "grp"),
    f"""points AS (
        SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS alerts,
               count(*) FILTER (WHERE score >= threshold AND expected = 'phishing') AS hits,
               count(*) FILTER (WHERE expected = 'phishing') AS phishing
        FROM made, (VALUES {_POINTS}) v(threshold) WHERE arm = 'scoring_only' GROUP BY threshold)""",
    f"""sweep AS (SELECT *, {_f1("precision", "recall")} AS f1 FROM (
        SELECT *, {ratio("hits", "alerts")} AS precision, {ratio("hits", "phishing")} AS recall FROM points) p)""",
]
_REPORT_SQL = f"""
    SELECT split_part(grp, '|', 1) AS tbl, split_part(grp, '|', 2) AS arm, split_part(grp, '|', 3) AS item, m.name, m.value FROM (
        SELECT grp, unnest([{{'name': 'total', 'value': total::DOUBLE}}, {{'name': 'correct', 'value': correct::DOUBLE}}, {{'name': 'accuracy', 'value': accuracy}},
                            {{'name': 'macro_precision', 'value': macro_precision}}, {{'name': 'macro_recall', 'value': macro_recall}}, {{'name': 'macro_f1', 'value': macro_f1}}]) AS m FROM macros) x
    UNION ALL SELECT 'classes', split_part(grp, '|', 2), label, m.name, m.value FROM (
        SELECT grp, label, unnest([{{'name': 'support', 'value': support::DOUBLE}}, {{'name': 'predicted', 'value': predicted::DOUBLE}}, {{'name': 'true_positives', 'value': true_positives::DOUBLE}},
                                   {{'name': 'precision', 'value': precision}}, {{'name': 'recall', 'value': recall}}, {{'name': 'f1', 'value': f1}}]) AS m
        FROM classes WHERE starts_with(grp, 'metrics|')) x
    UNION ALL SELECT 'confusion', split_part(a.grp, '|', 2), a.label, b.label,
                     (SELECT count(*) FROM pairs x WHERE x.grp = a.grp AND x.expected = a.label AND x.predicted = b.label)::DOUBLE
              FROM names a JOIN names b ON a.grp = b.grp WHERE starts_with(a.grp, 'metrics|')
    UNION ALL SELECT 'sweep', 'scoring_only', CAST(threshold AS VARCHAR), m.name, m.value FROM (
        SELECT threshold, unnest([{{'name': 'alerts', 'value': alerts::DOUBLE}}, {{'name': 'true_positives', 'value': hits::DOUBLE}}, {{'name': 'f1', 'value': f1}}]) AS m FROM sweep) x
    UNION ALL SELECT 'mistakes', arm, fqdn, expected || '>' || predicted, CASE WHEN expected = 'phishing' THEN 1.0 ELSE 0.0 END FROM made WHERE expected <> predicted
    UNION ALL SELECT 'contradictory', arm, fqdn, verdict_brand || '>' || predicted, 1.0 FROM made WHERE verdict_brand <> '' AND predicted <> 'phishing'
    UNION ALL SELECT 'excluded', arm, fqdn, excluded_reason, 1.0 FROM predictions WHERE excluded_reason IS NOT NULL
    UNION ALL SELECT 'cost', 'scoring_plus_verdicts', '', m.name, m.value FROM (
        SELECT unnest([{{'name': 'sites', 'value': count(*)::DOUBLE}}, {{'name': 'capture_ms', 'value': sum(duration_ms)::DOUBLE}}, {{'name': 'classify_ms', 'value': sum(coalesce(latency_ms, 0))::DOUBLE}},
                       {{'name': 'tokens', 'value': sum(tokens)::DOUBLE}}, {{'name': 'cost_usd', 'value': {rounded("sum(coalesce(cost_usd, 0))", 3)}}}]) AS m FROM full_arm WHERE excluded_reason IS NULL) x
    UNION ALL SELECT 'labellers', '', coalesce(nullif(labelled_by, ''), 'unrecorded'), 'sites', count(*)::DOUBLE FROM labelled GROUP BY 3
    UNION ALL SELECT 'conditions', '', '', 'sites', count(*)::DOUBLE FROM sites
    UNION ALL SELECT 'conditions', '', '', 'excluded', count(*)::DOUBLE FROM predictions WHERE excluded_reason IS NOT NULL
    UNION ALL SELECT 'conditions', '', '', 'alert_threshold', 0.7::DOUBLE"""


@query(check(_EVIDENCE, _REPORT_SQL, *_REPORT))
def evaluation_report(t: Tables) -> DataFrame:
    """Both arms evaluated in one run, the report published and read back, table by table."""
    folder = f"{shared_folder(t.spark)}/run-{uuid4().hex}"
    number = e.run_evaluation(t.labelled, scorer(t.spark), folder, t.captures, t.verdicts, "vision", resamples=200)
    tables, conditions = e.Reports(t.spark, folder).read(number)

    def told(name: str, arm: Column | str, item: Column | str, **values: Column) -> DataFrame:
        pairs = [F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()]
        kept = tables[name].select(F.lit(name).alias("tbl"), F.col(arm).alias("arm") if isinstance(arm, str) else arm.alias("arm"),
                                   (F.col(item) if isinstance(item, str) else item).alias("item"), F.array(*pairs).alias("m"))
        return kept.select("tbl", "arm", "item", F.inline("m"))

    def figures(*names: str) -> dict[str, Column]:
        return {n: F.col(n) for n in names}

    def single(name: str, detail: Column, value: Column) -> DataFrame:
        return tables[name].select(F.lit(name), "arm", "fqdn", detail, value.cast("double"))

    none = F.lit("")
    macro = figures("total", "correct", "accuracy", "macro_precision", "macro_recall", "macro_f1")
    arrow = F.lit(">")
    parts = [
        told("metrics", "arm", none, **macro),
        told("by_source", "arm", "source", **macro),
        told("by_brand", "arm", "brand", **macro),
        told("classes", "arm", "label", **figures("support", "predicted", "true_positives", "precision", "recall", "f1")),
        told("sweep", "arm", F.col("threshold").cast("string"), **figures("alerts", "true_positives", "f1")),
        told("cost", "arm", none, **figures("sites", "capture_ms", "classify_ms", "tokens"), cost_usd=round_binary(F.col("cost_usd"), 3)),
        told("labellers", none, "labelled_by", **figures("sites")),
        tables["confusion"].select(F.lit("confusion"), "arm", "expected", "predicted", F.col("n").cast("double")),
        single("mistakes", F.concat("expected", arrow, "predicted"), F.col("is_costly").cast("int")),
        single("contradictory", F.concat("verdict_brand", arrow, "predicted"), F.lit(1)),
        single("excluded", F.col("excluded_reason"), F.lit(1)),
        t.spark.createDataFrame([("conditions", "", "", n, float(conditions[n])) for n in ("sites", "excluded", "alert_threshold")],
                                "tbl string, arm string, item string, name string, value double"),
    ]
    return reduce(DataFrame.union, parts)
