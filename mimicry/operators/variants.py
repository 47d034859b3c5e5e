"""Lookalike permutations of the official domains.

Labels are expanded by position; each family of permutations is an array expression
there. The result depends on the configured brands only, never on the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from mimicry.config import SWAP_TLDS, Brand
from mimicry.functions.confusables import CONFUSABLES
from mimicry.operators.domains import split_hosts

# The rows of a QWERTY keyboard; neighbours are derived from them.
_KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_VOWELS = "aeiou"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"

# ASCII spellings that render like one letter, both ways.
_ASCII_GLYPHS = (
    ("o", "0"), ("0", "o"), ("l", "1"), ("1", "l"), ("l", "i"), ("i", "l"), ("i", "1"),
    ("e", "3"), ("s", "5"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("vv", "w"), ("d", "cl"),
)


def keyboard_neighbours() -> dict[str, str]:
    """Keys beside, above and below each key, as on a staggered keyboard."""
    near: dict[str, set[str]] = {}
    for r, row in enumerate(_KEY_ROWS):
        for c, key in enumerate(row):
            spots = [(r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1), (r + 1, c), (r + 1, c - 1)]
            for rr, cc in spots:
                if 0 <= rr < len(_KEY_ROWS) and 0 <= cc < len(_KEY_ROWS[rr]):
                    near.setdefault(key, set()).add(_KEY_ROWS[rr][cc])
    return {key: "".join(sorted(keys)) for key, keys in near.items()}


def glyph_pairs() -> list[tuple[str, str]]:
    """(spelling, lookalike): ASCII pairs and every non-ASCII character of the skeleton."""
    unicode_pairs = [(plain, odd) for odd, plain in CONFUSABLES.items() if not odd.isascii()]
    return sorted({*_ASCII_GLYPHS, *unicode_pairs})


def bit_flips() -> list[tuple[str, str]]:
    """Hostname characters one bit apart."""
    allowed = set(_ALPHABET + "-")
    return [
        (key, chr(ord(key) ^ (1 << bit)))
        for key in sorted(allowed)
        for bit in range(8)
        if chr(ord(key) ^ (1 << bit)) in allowed
    ]


@pandas_udf(StringType())
def _to_ascii(labels: pd.Series) -> pd.Series:
    return labels.map(
        lambda label: "xn--" + label.encode("punycode").decode("ascii"), na_action="ignore"
    )


def ascii_label(label: Column) -> Column:
    """Punycode form of a label; plain ASCII labels stay as they are."""
    plain = label.rlike(r"^[\x00-\x7f]*$")
    return F.coalesce(_to_ascii(F.when(~plain, label)), label)


def _pairs(pairs: Sequence[tuple[str, str]]) -> Column:
    """The pairs as one folded literal array of structs."""
    joined = F.split(F.lit(" ".join(f"{old}>{new}" for old, new in pairs)), " ")
    return F.transform(
        joined,
        lambda p: F.struct(
            F.substring_index(p, ">", 1).alias("old"), F.substring_index(p, ">", -1).alias("new")
        ),
    )


def _here(pairs: Sequence[tuple[str, str]]) -> Column:
    """The pairs whose old spelling stands at this position of the label."""
    label, at = F.col("label"), F.col("at")
    return F.filter(_pairs(pairs), lambda p: F.substr(label, at, F.length(p["old"])) == p["old"])


def _before(at: Column) -> Column:
    return F.substr(F.col("label"), F.lit(1), at - 1)


def _from(at: Column) -> Column:
    return F.substr(F.col("label"), at)


def _char(at: Column) -> Column:
    return F.substr(F.col("label"), at, F.lit(1))


def _replaced(pairs: Sequence[tuple[str, str]]) -> Column:
    at = F.col("at")
    return F.transform(
        _here(pairs), lambda p: F.concat(_before(at), p["new"], _from(at + F.length(p["old"])))
    )


def _inserted(pairs: Sequence[tuple[str, str]]) -> Column:
    """The new character right before and right after the one at this position."""
    at = F.col("at")
    return F.flatten(
        F.transform(
            _here(pairs),
            lambda p: F.array(
                F.concat(_before(at), p["new"], _from(at)),
                F.concat(_before(at + 1), p["new"], _from(at + 1)),
            ),
        )
    )


def _spellings() -> dict[str, Column]:
    """Per family, the spellings made at position ``at`` of ``label``."""
    at = F.col("at")
    near = [(key, new) for key, keys in keyboard_neighbours().items() for new in keys]
    vowels = [(a, b) for a in _VOWELS for b in _VOWELS if a != b]
    letters = F.split(F.lit(" ".join(_ALPHABET)), " ")
    appended = F.transform(letters, lambda c: F.concat("label", c))
    swapped = F.concat(_before(at - 1), _char(at), _char(at - 1), _from(at + 1))
    hyphenated = F.concat(_before(at), F.lit("-"), _from(at))
    return {
        "addition": F.when(at == 1, appended),
        "bitsquatting": _replaced(bit_flips()),
        "homoglyph": _replaced(glyph_pairs()),
        "hyphenation": F.when(at > 1, F.array(hyphenated)),
        "insertion": _inserted(near),
        "omission": F.array(F.concat(_before(at), _from(at + 1))),
        "repetition": F.array(F.concat(_before(at), _char(at), _from(at))),
        "replacement": _replaced(near),
        "transposition": F.when(at > 1, F.array(swapped)),
        "vowel-swap": _replaced(vowels),
    }


def official_domains(spark: SparkSession, brands: Sequence[Brand]) -> DataFrame:
    rows = [
        (brand.name, position, domain)
        for position, brand in enumerate(brands)
        for domain in brand.official_domains
    ]
    columns = ["brand", "brand_pos", "official"]
    frame = pd.DataFrame(rows, columns=columns)
    return spark.createDataFrame(frame, "brand string, brand_pos int, official string")


def generate_variants(
    spark: SparkSession, brands: Sequence[Brand], tlds: Sequence[str] = SWAP_TLDS
) -> DataFrame:
    """(domain, brand, fuzzer) for every permutation that is no official domain."""
    official = official_domains(spark, brands)
    # A few dozen rows: one partition per family is plenty.
    parts = split_hosts(official.coalesce(1), "official").select(
        "brand", "official", F.col("domain").alias("label"), "suffix"
    )
    spelt = [
        F.transform(F.coalesce(labels, F.array().cast("array<string>")), _tagged(fuzzer))
        for fuzzer, labels in _spellings().items()
    ]
    by_tld = F.array(*[_entry("tld-swap", F.col("label"), F.lit(t)) for t in tlds])
    if tlds:
        spelt.append(F.when(F.col("at") == 1, by_tld).otherwise(F.slice(by_tld, 1, 0)))
    spelling = F.col("entry.label")
    usable = (spelling != "") & ~spelling.rlike("^-|-$")
    own = official.select("brand", F.col("official").alias("domain"))
    return (
        parts.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("label"))))
        .select("brand", F.explode(F.flatten(F.array(*spelt))).alias("entry"))
        .where(usable)
        .select(
            F.concat(ascii_label(spelling), F.lit("."), F.col("entry.suffix")).alias("domain"),
            "brand",
            F.col("entry.fuzzer").alias("fuzzer"),
        )
        .join(F.broadcast(own), ["brand", "domain"], "left_anti")
        .select("domain", "brand", "fuzzer")
        .distinct()
    )


def _tagged(fuzzer: str) -> Callable[[Column], Column]:
    return lambda spelling: _entry(fuzzer, spelling, F.col("suffix"))


def _entry(fuzzer: str, label: Column, suffix: Column) -> Column:
    return F.struct(
        F.lit(fuzzer).alias("fuzzer"), label.alias("label"), suffix.alias("suffix")
    )


def variant_index(variants: DataFrame) -> DataFrame:
    """One row per domain: ``variant_fuzzers``, a map from brand to its sorted fuzzers."""
    per_brand = variants.groupBy("domain", "brand").agg(
        F.array_sort(F.collect_set("fuzzer")).alias("fuzzers")
    )
    return per_brand.groupBy(F.col("domain").alias("variant_domain")).agg(
        F.map_from_entries(F.collect_list(F.struct("brand", "fuzzers"))).alias("variant_fuzzers")
    )
