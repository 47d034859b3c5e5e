"""One triage cycle per micro-batch of capture results: store, classify, announce.

All tables of a cycle become visible by one commit. A batch that cannot be stored fails and
is replayed: its lines come only once, and nothing of the broken attempt is seen. The stages
after it start from the stored tables, so a failing one is recorded and skipped, and its work
is found again by the next cycle.

A notification is a row of the outbox, named by a hash of its content; with it in the same
commit goes the ledger entry of its finding. Cycles that run at the same time meet at the
commit: the second one drafts anew and finds nothing left to announce. Outbox rows are
delivered after the commit, a file for each cycle, and again by the next cycle if that broke off.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.config import AlertPolicy
from mimicry.operators.queues import classification_queue, pending_alerts
from mimicry.plans.ingest import MATCH_KEY
from mimicry.plans.triage import (
    classify_by_rules,
    import_results,
    mark_announced,
    new_verdicts,
)
from mimicry.sources.commits import CommitLog, Draft
from mimicry.sources.files import exists
from mimicry.sources.keyed import KeyedStore
from mimicry.sources.sinks import absent, notification_lines, with_ids
from mimicry.sources.tables import CAPTURES, MATCHES, VERDICTS

LEDGER = "verdict_id bigint, alerted_at timestamp"
REJECTED = "line_no bigint, reject_reason string"
CYCLES = "writer string, cycle bigint, stage string, failed boolean, error string, finished_at timestamp"
NOTIFICATION = (
    "fqdn string, brand string, label string, confidence double, score double, evidence string, "
    "screenshot string, final_url string, detected_at string"
)
OUTBOX = f"key string, {NOTIFICATION}, writer string, cycle bigint"
TABLES = {
    "captures": CAPTURES, "rejected": REJECTED, "verdicts": VERDICTS, "announced": LEDGER,
    "outbox": OUTBOX, "cycles": CYCLES,
}
ATTEMPTS = 10

Stage = Callable[[], None]


def _last_id(table: DataFrame, column: str) -> int:
    return table.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


def run_stages(stages: dict[str, Stage]) -> list[tuple[str, bool, str | None]]:
    """(stage, failed, error) of each stage, run in order."""
    outcomes: list[tuple[str, bool, str | None]] = []
    for name, stage in stages.items():
        try:
            stage()
        except Exception as error:  # a stage that fails must not stop the others
            outcomes.append((name, True, str(error)[:300]))
        else:
            outcomes.append((name, False, None))
    return outcomes


def outbox_rows(due: DataFrame, outbox: DataFrame, writer: str, cycle: int) -> DataFrame:
    """Notifications of the findings, each content once, that no cycle has put out yet."""
    lines = notification_lines(due)
    key = F.sha2(F.to_json(F.struct(*lines.columns), {"ignoreNullFields": "false"}), 256)
    once = lines.withColumn("key", key).dropDuplicates(["key"])
    return absent(once, outbox, ("key",)).select(
        "key", *lines.columns, F.lit(writer).alias("writer"), F.lit(cycle).cast("bigint").alias("cycle")
    )


class Triage:
    """The stages of a cycle over tables below one folder.

    ``writer`` names the stream that runs the cycles: several may work on one folder.
    ``matches`` gives the stored matches, by default the ingest's below the same folder.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        targets: DataFrame,
        policy: AlertPolicy | None = None,
        vantage: str | None = None,
        max_classified: int | None = None,
        clock: Callable[[], datetime] = datetime.now,
        writer: str = "triage",
        matches: Callable[[], DataFrame] | None = None,
    ) -> None:
        self.spark = spark
        self.folder = folder
        self.targets = targets
        self.policy = policy or AlertPolicy()
        self.vantage = vantage
        self.max_classified = max_classified
        self.clock = clock
        self.writer = writer
        self.log = CommitLog(spark, folder)
        self.matches = matches or KeyedStore(spark, f"{folder}/matches", MATCHES, MATCH_KEY).rows

    def table(self, name: str) -> DataFrame:
        """The visible rows of one of :data:`TABLES`."""
        return self.log.table(name, TABLES[name])

    def _store(self, draft: Draft, lines: DataFrame) -> None:
        earlier = draft.table("captures", CAPTURES)
        found = import_results(lines, self.targets, F.lit(self.clock()), self.vantage)
        draft.write("captures", with_ids(found.captures, "capture_id", _last_id(earlier, "capture_id")))
        draft.write("rejected", found.rejected)

    def _classify(self, draft: Draft) -> None:
        stored = draft.table("verdicts", VERDICTS)
        queue = classification_queue(
            draft.table("captures", CAPTURES), stored, self.matches(), "stub", self.max_classified
        )
        rows = new_verdicts(classify_by_rules(queue, F.lit(self.clock())), stored)
        draft.write("verdicts", with_ids(rows, "verdict_id", _last_id(stored, "verdict_id")))

    def _announce(self, draft: Draft, cycle: int) -> None:
        policy = self.policy
        due = pending_alerts(
            draft.table("verdicts", VERDICTS),
            draft.table("captures", CAPTURES),
            self.matches(),
            policy.labels,
            policy.min_confidence,
            policy.max_per_run,
            draft.table("announced", LEDGER),
        ).persist()
        draft.write("outbox", outbox_rows(due, draft.table("outbox", OUTBOX), self.writer, cycle))
        draft.write("announced", mark_announced(due, F.lit(self.clock())))
        due.unpersist()

    def _publish(self, draft: Draft, cycle: int, outcomes: list[tuple[str, bool, str | None]]) -> bool:
        at = self.clock()
        rows = [(self.writer, cycle, name, failed, error, at) for name, failed, error in outcomes]
        draft.write("cycles", self.spark.createDataFrame(rows, CYCLES))
        for name, schema in TABLES.items():
            draft.merge(name, schema)
        return draft.publish(self.writer, cycle)

    def _committed(self, cycle: int, drafted: Callable[[Draft], list[tuple[str, bool, str | None]]]) -> None:
        """Draft and publish a cycle, again on top of any other cycle that came first."""
        for _ in range(ATTEMPTS):
            if self.log.done(self.writer, cycle):
                break
            draft = self.log.draft()
            if self._publish(draft, cycle, drafted(draft)):
                break
        else:
            raise RuntimeError(f"{self.writer}: cycle {cycle} met another commit {ATTEMPTS} times")
        self.deliver()
        self.log.clean()

    def run(self, results: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` step over capture result lines (``value``)."""
        lines = results.select("value", F.monotonically_increasing_id().alias("line_no"))

        def drafted(draft: Draft) -> list[tuple[str, bool, str | None]]:
            self._store(draft, lines)
            return [("capture", False, None)] + run_stages(
                {"classify": lambda: self._classify(draft), "alert": lambda: self._announce(draft, batch_id)}
            )

        self._committed(batch_id, drafted)

    def announce(self, cycle: int) -> None:
        """A cycle of the last stage alone, over what is stored."""
        self._committed(cycle, lambda draft: run_stages({"alert": lambda: self._announce(draft, cycle)}))

    def deliver(self) -> None:
        """Write the outbox rows of each cycle that has not been delivered as a file of JSON lines."""
        rows = self.table("outbox")
        last = self.log.state().writers
        for writer, cycle in ((w, c) for w, newest in last.items() for c in range(max(0, newest - ATTEMPTS), newest + 1)):
            path = f"{self.folder}/alerts/{writer}-{cycle}"
            if not exists(self.spark, f"{path}/_SUCCESS"):
                mine = rows.where((F.col("writer") == writer) & (F.col("cycle") == cycle))
                mine.drop("writer", "cycle").write.mode("overwrite").json(path)
