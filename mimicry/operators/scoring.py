"""Scoring hosts against brands.

A host is related to a brand by its strongest base signal (known variant, typo of a
token, token in the registered label, token in the subdomain); bonuses only add to
that. Brands are configuration, so their checks are expressions over literals: a host
row fans out to the brands it relates to and no others, without any join on brands.

Typo similarity needs an exact edit distance. It is pruned inside the JVM with length
bounds and ``levenshtein`` (never more than twice the distance wanted), so the exact
distance, by array functions, is left for rows that can become matches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.config import DEFAULT_BRANDS, SWAP_TLDS, Brand, Scoring
from mimicry.functions.confusables import (
    fold,
    fold_loose,
    Folds,
    folded_words,
    host_unicode_forms,
)
from mimicry.functions.hostnames import normalize_hostname
from mimicry.functions.rounding import round_binary
from mimicry.functions.similarity import typo_similarity
from mimicry.operators.domains import split_hosts
from mimicry.operators.variants import generate_variants, variant_index
from mimicry.session import computed_once
from mimicry.sources.tables import FEATURES

_WORD_BREAK = "[^a-z]+"
_FORMS = ("label_raw", "subdomain_raw", "label_sk", "subdomain_sk", "label_loose", "subdomain_loose")


def _strings(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def host_forms(df: DataFrame, host: str = "fqdn") -> DataFrame:
    """Split each host and add the raw, skeleton and loose forms of its two parts."""
    out = split_hosts(df, host).where(F.col("registered_domain").isNotNull())
    out = out.withColumn("__forms", host_unicode_forms(F.col("domain"), F.col("subdomain")))
    for part, name in (("label", "domain"), ("subdomain", "subdomain")):
        plain = F.lower(name)
        unmarked = F.coalesce(F.col(f"__forms.{part}_unmarked"), plain)
        out = (
            out.withColumn(f"{part}_raw", F.coalesce(F.col(f"__forms.{part}_decoded"), plain))
            .withColumn(f"{part}_sk", fold(unmarked))
            .withColumn(f"{part}_loose", fold_loose(unmarked))
        )
    return out.drop("__forms", "domain", "subdomain", "suffix",
                    "on_private_suffix")


def _without(text: Column, words: Sequence[str]) -> Column:
    for word in words:
        text = F.replace(text, F.lit(word), F.lit(" "))
    return text


def contains_token(
    text: Column, tokens: Sequence[str], negatives: Sequence[str], min_len: int
) -> Column:
    """Long tokens anywhere in the text, short ones only as a whole word."""
    text = _without(text, negatives)
    hit = F.lit(False)
    for token in tokens:
        if len(token) >= min_len:
            hit = hit | text.contains(token)
        else:
            hit = hit | F.array_contains(F.split(text, _WORD_BREAK), token)
    return hit


def has_loose_word(text: Column, tokens: Sequence[str], negatives: Sequence[str]) -> Column:
    """A whole word equals a token once both are folded loosely."""
    words = F.split(_without(text, negatives), _WORD_BREAK)
    # The substring test is implied by the word test; it spares most rows the split.
    text_hit = F.lit(False)
    for token in tokens:
        text_hit = text_hit | (text.contains(token) & F.array_contains(words, token))
    return text_hit


def _typo_tokens(brand: Brand, cfg: Scoring, folds: Folds) -> list[str]:
    return [folds.loose[t] for t in brand.tokens if len(t) >= cfg.min_typo_token_len]


def _may_be_typo(text: Column, tokens: Sequence[str], cfg: Scoring) -> Column:
    """False only where no word can reach the minimum similarity to any token."""
    slack = 1.0 - (cfg.min_typo_similarity - 0.0001)
    if slack >= 1.0:
        return F.lit(True)
    words = F.array_append(F.split(text, _WORD_BREAK), text)
    hit = F.lit(False)
    for token in tokens:
        longest = int(len(token) / (1.0 - slack))
        hit = hit | F.exists(words, _close_to(token, longest, 2 * int(slack * longest)))
    return hit


def _close_to(token: str, longest: int, edits: int) -> Callable[[Column], Column]:
    def check(word: Column) -> Column:
        fits = F.length(word).between(len(token), longest)
        return fits & (F.levenshtein(word, F.lit(token), edits) >= 0)

    return check


def _relation(brand: Brand, position: int, cfg: Scoring, folds: Folds, every: bool) -> Column:
    """Struct of one brand's signals on a host, NULL where the brand is unrelated."""
    folded = [folds.plain[t] for t in brand.tokens]
    loose = [folds.loose[t] for t in brand.tokens]
    negatives = [folds.plain[t] for t in brand.negative_tokens]
    for_typo = _typo_tokens(brand, cfg, folds)
    min_len = cfg.min_substring_token_len

    def found_in(part: str) -> Column:
        return contains_token(F.col(f"{part}_sk"), folded, negatives, min_len) | has_loose_word(
            F.col(f"{part}_loose"), loose, negatives
        )

    in_label, in_subdomain = found_in("label"), found_in("subdomain")
    spelt_out = contains_token(
        F.col("label_raw"), brand.tokens, negatives, min_len
    ) | contains_token(F.col("subdomain_raw"), brand.tokens, negatives, min_len)
    fuzzers = F.coalesce(
        F.element_at("variant_fuzzers", F.lit(brand.name)), F.array().cast("array<string>")
    )
    label = _without(F.col("label_loose"), negatives)
    related = (F.size(fuzzers) > 0) | in_label | in_subdomain
    if for_typo:
        related = related | _may_be_typo(label, for_typo, cfg)
    signals = F.struct(
        F.lit(brand.name).alias("brand"),
        F.lit(position).alias("brand_pos"),
        fuzzers.alias("fuzzers"),
        in_label.alias("in_label"),
        in_subdomain.alias("in_subdomain"),
        ((in_label | in_subdomain) & ~spelt_out).alias("homoglyph"),
        (label if for_typo else F.lit(None).cast("string")).alias("typo_label"),
        _strings(for_typo).alias("typo_tokens"),
        _strings(folded).alias("tokens"),
    )
    official = F.col("registered_domain").isin(*brand.official_domains)
    return F.when(~official if every else (~official & related), signals)


def _may_be_related(brands: Sequence[Brand], cfg: Scoring, folds: Folds) -> Column:
    """False only for hosts unrelated to every brand: no false negatives, cheap to tell.

    A token found once negatives are cut out is also found before, and a whole word is
    also a substring, so plain substring tests are enough here.
    """
    tokens = sorted({t for b in brands for t in b.tokens})
    related = F.col("variant_domain").isNotNull()
    for part in ("label", "subdomain"):
        for token in sorted({folds.plain[t] for t in tokens}):
            related = related | F.col(f"{part}_sk").contains(token)
        for token in sorted({folds.loose[t] for t in tokens}):
            related = related | F.col(f"{part}_loose").contains(token)
    by_negatives: dict[tuple[str, ...], set[str]] = {}
    for brand in brands:
        negatives = tuple(folds.plain[t] for t in brand.negative_tokens)
        by_negatives.setdefault(negatives, set()).update(_typo_tokens(brand, cfg, folds))
    for negatives, words in by_negatives.items():
        if words:
            label = _without(F.col("label_loose"), negatives)
            related = related | _may_be_typo(label, sorted(words), cfg)
    return related


def _keyword_hits(cfg: Scoring, folds: Folds) -> Column:
    """Configured keywords left in the host once the brand's own tokens are removed."""
    rest = F.aggregate(
        F.col("__rel.tokens"),
        F.concat(F.col("subdomain_sk"), F.lit("."), F.col("label_sk")),
        lambda text, token: F.replace(text, token, F.lit(" ")),
    )
    words = [
        F.when(rest.contains(folds.plain[word]), F.lit(word.lower()))
        for word in cfg.sensitive_keywords
    ]
    return F.array_compact(F.array(*words)) if words else F.array().cast("array<string>")


def combine(features: Column, cfg: Scoring) -> Column:
    """The score of one feature struct."""
    w = cfg.weights
    typo = features["typo_similarity"]
    zero = F.lit(0.0)
    base = F.greatest(
        F.when(F.size(features["known_variant_fuzzers"]) > 0, F.lit(w.known_variant)).otherwise(
            zero
        ),
        F.when(
            (typo >= cfg.min_typo_similarity) & (typo < 1.0), F.lit(w.typo_similarity) * typo
        ).otherwise(zero),
        F.when(features["token_in_registered_label"], F.lit(w.token_in_registered_label)).otherwise(
            zero
        ),
        F.when(features["token_in_subdomain"], F.lit(w.token_in_subdomain)).otherwise(zero),
    )
    bonus = (
        F.when(features["homoglyph"], F.lit(w.homoglyph_bonus)).otherwise(zero)
        + F.lit(w.keyword_bonus)
        * F.least(F.size(features["keyword_hits"]), F.lit(w.max_keyword_hits))
        + F.when(features["free_dv_issuer"], F.lit(w.free_dv_bonus)).otherwise(zero)
    )
    return F.when(
        base > 0, round_binary(F.least(F.lit(1.0), base + bonus), 4)
    ).otherwise(zero)


def is_free_dv(issuer: Column, cfg: Scoring) -> Column:
    """The issuer names one of the configured free authorities."""
    hit = F.lit(False)
    for name in cfg.free_dv_issuers:
        hit = hit | F.lower(issuer).contains(name.lower())
    return F.coalesce(hit, F.lit(False))


class Scorer:
    """Brands, settings and variant lookup, bound to a session."""

    def __init__(
        self,
        spark: SparkSession,
        brands: Sequence[Brand] = DEFAULT_BRANDS,
        cfg: Scoring | None = None,
        variants: DataFrame | None = None,
        tlds: Sequence[str] = SWAP_TLDS,
    ) -> None:
        self.brands = tuple(brands)
        self.cfg = cfg or Scoring()
        if variants is None:
            variants = generate_variants(spark, self.brands, tlds)
        # Small and used by every scoring job of the session: computed once and kept.
        self.variants = variants.persist()
        # Configuration: its size follows from the brands, not from the data.
        self._index = F.broadcast(variant_index(self.variants))
        # The brands' checks are the same for every input: built once, bound on use.
        own = [w for b in self.brands for w in (*b.tokens, *b.negative_tokens)]
        self.folds = folded_words(spark, [*own, *self.cfg.sensitive_keywords])
        self._prefilter = _may_be_related(self.brands, self.cfg, self.folds)
        self._relations = {
            every: [
                _relation(brand, p, self.cfg, self.folds, every) for p, brand in enumerate(self.brands)
            ]
            for every in (False, True)
        }

    def score(
        self,
        hosts: DataFrame,
        floor: float | None = None,
        only_brand: str | None = None,
    ) -> DataFrame:
        """Matches of each row's ``fqdn`` (normalised) with its ``free_dv`` flag.

        Adds ``registered_domain``, ``brand``, ``brand_pos``, ``score`` and ``features``
        and keeps the input columns; rows scoring below ``floor`` are dropped. With
        ``floor`` 0 every brand but the host's owner is reported. ``only_brand`` names
        an input column holding the one brand each row is to be scored against.
        """
        cfg = self.cfg
        floor = cfg.store_floor if floor is None else floor
        every = floor <= 0.0
        keep = hosts.columns
        forms = host_forms(hosts).join(
            self._index, F.col("registered_domain") == F.col("variant_domain"), "left"
        )
        if not every and self.brands:
            forms = forms.where(self._prefilter)
        relations = [
            F.when(
                F.lit(True) if only_brand is None else F.col(only_brand) == brand.name,
                relation,
            )
            for brand, relation in zip(self.brands, self._relations[every], strict=True)
        ]
        if not relations:
            return hosts.select(
                *keep, F.lit("").alias("registered_domain"), F.lit("").alias("brand"),
                F.lit(0).alias("brand_pos"), F.lit(0.0).alias("score"),
                F.lit(None).cast(FEATURES).alias("features"),
            ).where(F.lit(False))
        # The outer form keeps the optimiser from evaluating the relations once more in a
        # filter that asks whether there are any.
        related = forms.withColumn("__rel", F.explode_outer(F.array(*relations))).where(
            "__rel IS NOT NULL"
        )
        typo = F.coalesce(
            typo_similarity(F.col("__rel.typo_label"), F.col("__rel.typo_tokens")), F.lit(0.0)
        )
        features = F.struct(
            F.col("__rel.fuzzers").alias("known_variant_fuzzers"),
            F.col("__typo").alias("typo_similarity"),
            F.col("__rel.in_label").alias("token_in_registered_label"),
            F.col("__rel.in_subdomain").alias("token_in_subdomain"),
            F.col("__rel.homoglyph").alias("homoglyph"),
            _keyword_hits(cfg, self.folds).alias("keyword_hits"),
            F.col("free_dv").alias("free_dv_issuer"),
        )
        scored = (
            computed_once(related, __typo=typo)
            .withColumn("features", features)
            .withColumn("score", combine(F.col("features"), cfg))
        )
        return scored.where(F.col("score") >= floor).select(
            *keep,
            "registered_domain",
            F.col("__rel.brand").alias("brand"),
            F.col("__rel.brand_pos").alias("brand_pos"),
            "score",
            "features",
        )

    def score_names(
        self, df: DataFrame, name: str, issuer: Column | None = None, floor: float | None = None
    ) -> DataFrame:
        """Score raw hostnames of column ``name``; names that normalise to nothing drop out."""
        ready = df.withColumn("fqdn", normalize_hostname(F.col(name))).withColumn(
            "free_dv", F.lit(False) if issuer is None else is_free_dv(issuer, self.cfg)
        )
        return self.score(ready.where("fqdn IS NOT NULL"), floor)


def best_match(matches: DataFrame, key: str = "fqdn") -> DataFrame:
    """Highest score per host; ties go to the brand configured first.

    An aggregate rather than a ranking window: partial results are combined before the
    shuffle, so one frequent host cannot fill a task.
    """
    return matches.groupBy(key).agg(
        F.max("score").alias("score"),
        F.max_by("brand", F.struct(F.col("score"), -F.col("brand_pos"))).alias("brand"),
    )
