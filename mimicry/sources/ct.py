"""Certificate Transparency messages: JSON lines to certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.session import computed_once
from mimicry.sources.lines import read_lines

# Numbers are read as text: the feed mixes integers, floats and numeric strings.
MESSAGE = (
    "message_type string, data struct<seen:string, source:struct<name:string>, "
    "leaf_cert:struct<sha256:string, serial_number:string, issuer:map<string,variant>, "
    "not_before:string, not_after:string, all_domains:array<string>>>"
)

# The SHA-256 of no bytes, which some feeds send for lack of a real one,
# and the prefix of the keys derived instead.
EMPTY_INPUT_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
DERIVED_KEY_PREFIX = "issuer-serial:"

# The years 1 to 9999 in seconds.
FIRST_SECOND, LAST_SECOND = -62_135_596_800.0, 253_402_300_799.999

CERTIFICATE_COLUMNS = (
    "cert_sha256", "seen_at", "issuer_org", "not_before", "not_after", "ct_log", "all_domains",
)


def read_ct_messages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Replay of recorded messages: ``value`` and ``arrival``."""
    return read_lines(spark, path)


def stream_ct_messages(
    spark: SparkSession, directory: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Messages from a directory being written to; the same ``value`` lines as a replay.

    Any stream with a text ``value`` column (a message bus topic, say) works as well.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(directory).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.lit(0).cast("bigint").alias("row_id"),
        ).alias("arrival"),
    )


# The short escapes of JSON.
_ESCAPES = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
_FIRST_BEYOND_16_BITS = 0x10000


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code.cast("bigint"))), 4, "0"))


def _escaped(char: Column) -> Column:
    """One character beyond printable ASCII as JSON states it in ASCII."""
    code = F.ascii(char)
    above = code - _FIRST_BEYOND_16_BITS
    pair = F.concat(_unit(F.shiftright(above, 10) + 0xD800), _unit(above.bitwiseAND(0x3FF) + 0xDC00))
    out = F.when(char.rlike("[ -~]"), char).when(code >= _FIRST_BEYOND_16_BITS, pair)
    for special, letter in _ESCAPES.items():
        out = out.when(code == special, F.lit("\\" + letter))
    return out.otherwise(_unit(code))


def _quoted(text: Column) -> Column:
    """A JSON string in ASCII."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    ascii_only = F.array_join(F.transform(F.split(plain, ""), _escaped), "")
    escaped = F.when(plain.rlike("[^ -~]"), ascii_only).otherwise(plain)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _json_value(value: Column) -> Column:
    """A value as JSON, in its own type."""
    text = F.try_variant_get(value, "$", "string")
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, _quoted(text)).otherwise(F.coalesce(F.to_json(value), F.lit("null")))


def _issuer_json(issuer: Column) -> Column:
    """The issuer's fields as one JSON object with sorted keys."""
    names = F.array_sort(F.map_keys(issuer))
    fields = F.transform(
        names,
        lambda k: F.concat(_quoted(k), F.lit(": "), F.coalesce(_json_value(issuer[k]), F.lit("null"))),
    )
    joined = F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}"))
    return F.coalesce(joined, F.lit("{}"))


def derived_key(leaf: Column) -> Column:
    """Key for a certificate without a usable fingerprint: issuer and serial number.

    Without a serial, the validity and the sorted names stand in for it.
    """
    none = F.lit("None")
    names = F.array_sort(F.coalesce(leaf["all_domains"], F.array().cast("array<string>")))
    without_serial = F.concat_ws(
        "|",
        F.coalesce(leaf["not_before"], none),
        F.coalesce(leaf["not_after"], none),
        F.array_join(names, ","),
    )
    serial = F.nullif(leaf["serial_number"], F.lit(""))
    identity = F.concat(_issuer_json(leaf["issuer"]), F.lit("|"), F.coalesce(serial, without_serial))
    return F.concat(F.lit(DERIVED_KEY_PREFIX), F.sha2(identity, 256))


def parse_messages(messages: DataFrame) -> DataFrame:
    """Certificate updates with their columns and a ``reject_reason``, NULL when usable.

    Blank lines, invalid JSON, anything but an object and other message types are not
    certificate updates and drop out. A time must be a finite number within the years 1 to
    9999. Other columns of the input are kept.
    """
    keep = [c for c in messages.columns if c != "value"]
    is_object = F.try_parse_json("value").isNotNull() & F.col("value").rlike("^[ \\t\\r\\n]*\\{")
    parsed = computed_once(messages.where(is_object), m=F.from_json("value", MESSAGE))
    parsed = parsed.where(F.col("m.message_type") == "certificate_update")
    data, leaf = F.col("m.data"), F.col("m.data.leaf_cert")
    numbers = {
        "seen": data["seen"], "not_before": leaf["not_before"], "not_after": leaf["not_after"]
    }
    reason = F.when(data.isNull(), F.lit("missing data")).when(
        leaf.isNull(), F.lit("missing leaf_cert")
    )
    for name, value in numbers.items():
        reason = reason.when(value.isNull(), F.lit(f"missing {name}")).when(
            value.try_cast("double").isNull(), F.lit(f"{name} is not a number")
        )
        # NaN compares as larger than any number.
        outside = ~value.try_cast("double").between(FIRST_SECOND, LAST_SECOND)
        reason = reason.when(outside, F.lit(f"{name} is out of range"))
    parsed = computed_once(parsed, __reason=reason)
    reason = F.col("__reason")
    sha = F.lower(F.replace(F.coalesce(leaf["sha256"], F.lit("")), F.lit(":"), F.lit("")))
    usable = (sha != "") & (sha != EMPTY_INPUT_SHA256)
    at = {
        n: F.when(reason.isNull(), F.timestamp_seconds(v.try_cast("double"))) for n, v in numbers.items()
    }
    return parsed.select(
        *keep,
        F.when(usable, sha).otherwise(derived_key(leaf)).alias("cert_sha256"),
        at["seen"].alias("seen_at"),
        F.try_variant_get(leaf["issuer"]["O"], "$", "string").alias("issuer_org"),
        at["not_before"].alias("not_before"),
        at["not_after"].alias("not_after"),
        data["source"]["name"].alias("ct_log"),
        F.coalesce(leaf["all_domains"], F.array().cast("array<string>")).alias("all_domains"),
        reason.alias("reject_reason"),
        F.when(reason.isNotNull(), F.to_json("m")).alias("rejected_message"),
    )


def certificates(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NULL").drop("reject_reason", "rejected_message")


def malformed(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NOT NULL").select(
        *[c for c in parsed.columns if c not in (*CERTIFICATE_COLUMNS, "reject_reason",
                                                 "rejected_message")],
        "reject_reason",
        "rejected_message",
    )
