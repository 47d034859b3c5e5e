"""The public-suffix rules as a small table.

The package carries Mozilla's list (``public_suffix_list.txt``, fixed values, with its
licence header); a setting may name a newer copy anywhere Spark can read. The list is a
reference table of some ten thousand rules, independent of the data.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from mimicry.sources.lines import read_lines

LIST_PATH_CONF = "spark.mimicry.publicSuffixList"
_BUNDLED = "public_suffix_list.txt"
_PRIVATE_MARK = "===BEGIN PRIVATE DOMAINS==="

RULES = "rule string, depth int, kind string, is_private boolean"


def _list_lines(spark: SparkSession) -> tuple[str, ...]:
    """The rules in file order; a configured list is read where Spark's storage is."""
    path = spark.conf.get(LIST_PATH_CONF, None)
    if path:
        ordered = read_lines(spark, path).orderBy("arrival").select("value")
        return tuple(row["value"] for row in ordered.collect())
    text = resources.files(__package__).joinpath(_BUNDLED).read_text(encoding="utf-8")
    return tuple(text.splitlines())


def _ascii_form(rule: str) -> str:
    try:
        return ".".join(
            label if label.isascii() else "xn--" + label.encode("punycode").decode("ascii")
            for label in rule.split(".")
        )
    except UnicodeError:
        return rule


@lru_cache(maxsize=4)
def parse_rules(lines: tuple[str, ...]) -> tuple[tuple[str, int, str, bool], ...]:
    """(rule, depth, kind, is_private); the rule is stored without its ``*.`` or ``!``."""
    rules: set[tuple[str, int, str, bool]] = set()
    private = False
    for line in lines:
        private = private or _PRIVATE_MARK in line
        rule = line.split("//")[0].strip().lower()
        if not rule:
            continue
        kind = "exception" if rule[0] == "!" else "wildcard" if rule[:2] == "*." else "exact"
        bare = rule.removeprefix("!").removeprefix("*.")
        for form in {bare, _ascii_form(bare)}:
            rules.add((form, form.count(".") + 1, kind, private))
    return tuple(sorted(rules))


def suffix_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(parse_rules(_list_lines(spark))), RULES)


def rules_by_depth(
    spark: SparkSession, include_private: bool
) -> dict[int, list[tuple[str, int, int, bool]]]:
    """Rules keyed by their number of labels: (rule, suffix labels, rank, is_private).

    ``rank`` orders a host's matching rules: an exception beats everything, then the
    longest suffix wins.
    """
    extra = {"exact": 0, "wildcard": 1, "exception": -1}
    found: dict[int, dict[str, list[tuple[int, int, bool]]]] = {}
    for rule, depth, kind, private in parse_rules(_list_lines(spark)):
        if private and not include_private:
            continue
        labels = depth + extra[kind]
        rank = labels + (1_000 if kind == "exception" else 0)
        found.setdefault(depth, {}).setdefault(rule, []).append((labels, rank, private))
    return {
        depth: [(rule, *option) for rule, options in by_rule.items() for option in options]
        for depth, by_rule in sorted(found.items())
    }
