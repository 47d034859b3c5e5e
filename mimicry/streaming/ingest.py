"""Certificates as they arrive: score them, keep each first sighting once.

Each micro-batch adds a run to the stores of matches, certificates and malformed messages,
compared with earlier batches only, so a batch replayed after a failure replaces what it
wrote. The memory of what is already stored is the table, not streaming state: it may grow
for ever, and a batch reads only the parts of it that its keys fall into.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mimicry.functions.hostnames import normalize_hostname
from mimicry.operators.scoring import Scorer
from mimicry.plans.ingest import MATCH_KEY, referenced_certificates, score_certificates
from mimicry.sources.ct import certificates, malformed, parse_messages, stream_ct_messages
from mimicry.sources.keyed import FAN, PART_ROWS, KeyedStore
from mimicry.sources.tables import CERTIFICATES, MATCHES

# How late a repeated name may come and still be recognised.
WATERMARK = "1 hour"

MALFORMED = "reject_reason string, rejected_message string, batch_id bigint"


@dataclass
class Stores:
    """What an ingest keeps below a folder."""

    matches: KeyedStore
    certificates: KeyedStore
    malformed: KeyedStore

    @staticmethod
    def below(spark: SparkSession, folder: str, fan: int = FAN, part_rows: int = PART_ROWS) -> Stores:
        return Stores(
            KeyedStore(spark, f"{folder}/matches", MATCHES, MATCH_KEY, fan, part_rows),
            KeyedStore(spark, f"{folder}/certificates", CERTIFICATES, ("cert_sha256",), fan, part_rows),
            KeyedStore(spark, f"{folder}/malformed", MALFORMED, (), fan, part_rows),
        )

    def merge(self, before: int) -> None:
        for store in (self.matches, self.certificates, self.malformed):
            store.merge(before)


def ingest_certificates(certs: DataFrame, scorer: Scorer, stores: Stores, batch_id: int) -> None:
    """Add a batch's new matches, then the certificates they refer to that are new."""
    scored = score_certificates(certs, scorer).persist()
    stores.matches.add(stores.matches.absent(scored, batch_id), batch_id)
    # What was written is what the certificates have to cover.
    used = referenced_certificates(certs, stores.matches.rows(only=batch_id)).persist()
    stores.certificates.add(stores.certificates.absent(used, batch_id), batch_id)
    scored.unpersist()
    used.unpersist()


def ingest_batch(
    scorer: Scorer, folder: str, fan: int = FAN, part_rows: int = PART_ROWS
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` step: matches, certificates and malformed messages of a batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        stores = Stores.below(batch.sparkSession, folder, fan, part_rows)
        stores.merge(batch_id)
        place = F.struct("arrival.*", F.monotonically_increasing_id().alias("position"))
        parsed = parse_messages(batch.withColumn("arrival", place)).persist()
        try:
            bad = malformed(parsed).drop("arrival").withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            stores.malformed.add(bad, batch_id)
            ingest_certificates(certificates(parsed), scorer, stores, batch_id)
        finally:
            parsed.unpersist()

    return run


def start_ingest(
    spark: SparkSession,
    directory: str,
    scorer: Scorer,
    folder: str,
    checkpoint: str,
    interval: str | None = "5 seconds",
    max_files: int | None = None,
    fan: int = FAN,
    part_rows: int = PART_ROWS,
) -> StreamingQuery:
    """Ingest a directory of message files; with ``interval`` None, what is there, once."""
    messages = stream_ct_messages(spark, directory, max_files)
    writer = messages.writeStream.foreachBatch(ingest_batch(scorer, folder, fan, part_rows)).option(
        "checkpointLocation", checkpoint
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def new_names(stream: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Each normalised host once within the watermark, from a stream of certificates.

    Bounded state: a host seen again later than ``delay`` is passed on again, and the
    anti-join with the stored matches keeps it from being stored twice.
    """
    hosts = stream.select(
        "cert_sha256", "seen_at", "issuer_org", F.explode("all_domains").alias("name")
    ).withColumn("fqdn", normalize_hostname(F.col("name")))
    return (
        hosts.where("fqdn IS NOT NULL")
        .withWatermark("seen_at", delay)
        .dropDuplicatesWithinWatermark(["fqdn"])
    )


def message_counters(parsed: DataFrame, name: str = "ingest") -> DataFrame:
    """Counts of a parsed batch or stream, observed without another pass."""
    bad = F.col("reject_reason").isNotNull()
    return parsed.observe(
        name,
        F.count(F.lit(1)).alias("certificate_messages"),
        F.count(F.when(~bad, 1)).alias("certificates"),
        F.count(F.when(bad, 1)).alias("malformed"),
        F.sum(F.when(~bad, F.size("all_domains")).otherwise(0)).alias("hostnames"),
    )
