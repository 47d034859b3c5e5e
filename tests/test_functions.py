"""Hostnames, folding, text and URLs on small golden tables."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from mimicry.functions import hostnames as h
from mimicry.functions.confusables import folded_words, unicode_forms
from mimicry.functions.rounding import ratio, round_binary
from mimicry.functions.similarity import edit_distance, typo_similarity
from mimicry.functions.text import chat_safe, clean_text, defang, normalised_title
from mimicry.operators.domains import split_hosts
from mimicry.operators.scoring import host_forms


def evaluate(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_normalize_hostname(spark):
    got = evaluate(spark, ["*.PayPal-Login.com.", "  a.b.com", "*.", "*.*.x.y", " ", None], h.normalize_hostname)
    assert got == ["paypal-login.com", "a.b.com", None, "*.x.y", None, None]


@pytest.mark.parametrize(
    ("raw", "twin"),
    [("PayPal.com", "paypal.com"), ("paypa1.com", "paypal.com"), ("аррӏе.com", "apple.com"),
     ("amazön.fr", "amazon.fr"), ("netf1ix-l0gin.net", "netflix-login.net"),
     ("xn--pypal-4ve.com", "paypal.com")],
)
def test_words_that_fold_alike(spark, raw, twin):
    folds = folded_words(spark, [raw, twin])
    assert folds.plain[raw] == folds.plain[twin]


@pytest.mark.parametrize(("raw", "twin"), [("lcloud", "icloud"), ("rnicrosoft", "microsoft"), ("vvebmail", "webmail")])
def test_words_that_only_fold_alike_loosely(spark, raw, twin):
    folds = folded_words(spark, [raw, twin])
    assert folds.loose[raw] == folds.loose[twin]
    assert folds.plain[raw] != folds.plain[twin]


def test_punycode_that_does_not_decode_is_kept(spark):
    names = ["xn--99999999.com", "xn--pypal-4ve.com", "axn--b.com", "a.xn--pypal-4ve.com"]
    got = evaluate(spark, names, lambda c: unicode_forms(c)["decoded"])
    assert got == ["xn--99999999.com", "pаypal.com", "axn--b.com", "a.pаypal.com"]


def test_column_forms_equal_the_word_forms(spark):
    hosts = ["paypa1.com", "xn--pypal-4ve.com", "shop.amazön.fr", "vvebrnail.rn.co.uk", "ℌello.example.org"]
    labels = {x: x.split(".")[-3 if x.endswith("co.uk") else -2] for x in hosts}
    folds = folded_words(spark, labels.values())
    df = spark.createDataFrame([(x,) for x in hosts], "fqdn string")
    for r in host_forms(df).collect():
        assert r.label_sk == folds.plain[labels[r.fqdn]]
        assert r.label_loose == folds.loose[labels[r.fqdn]]


def test_split_hosts(spark):
    hosts = {
        "a.b.paypal.com": ("a.b", "paypal", "com", "paypal.com"),
        "paypal.co.uk": ("", "paypal", "co.uk", "paypal.co.uk"),
        "co.uk": (None, None, "co.uk", None),
        "com": (None, None, "com", None),
        "localhost": (None, None, None, None),
        "10.0.0.1": (None, None, None, None),
        "x.kobe.jp": (None, None, "x.kobe.jp", None),
        "a.x.kobe.jp": ("", "a", "x.kobe.jp", "a.x.kobe.jp"),
        "www.city.kobe.jp": ("www", "city", "kobe.jp", "city.kobe.jp"),
        "me.github.io": ("me", "github", "io", "github.io"),
        "a..com": (None, None, "com", None),
        "evil@paypal.com:80/x": ("", "paypal", "com", "paypal.com"),
    }
    rows = split_hosts(spark.createDataFrame([(x,) for x in hosts], "fqdn string")).collect()
    assert {r.fqdn: (r.subdomain, r.domain, r.suffix, r.registered_domain) for r in rows} == hosts


def test_private_suffixes(spark):
    df = spark.createDataFrame([("me.github.io",), ("a.b.me.github.io",), ("paypal.com",)], "fqdn string")
    rows = {r.fqdn: r for r in split_hosts(df, include_private=True).collect()}
    assert rows["me.github.io"].on_private_suffix
    assert rows["a.b.me.github.io"].registered_domain == "me.github.io"
    assert not rows["paypal.com"].on_private_suffix


HOSTS = {
    "paypal.com": True, "a_b.example.com": True, "example.com.": True, "example.com:8443": True,
    "203.0.113.9": True, "[2001:db8::1]": True, "[2001:db8::1]:443": True, "evil.com@router.local": False,
    "a.com/path": False, "a b.com": False, "": False, "-a.com": False, "a..com": False,
    "example.com:0": False, "example.com:999999": False, "[nonsense]": False, "[::1": False,
    "x" * 254: False, "a.com:80:90": False,
}


def test_valid_hostnames(spark):
    assert evaluate(spark, list(HOSTS), h.is_valid_hostname) == list(HOSTS.values())


PRIVATE = {
    "127.0.0.1": True, "10.1.2.3": True, "172.16.0.1": True, "172.32.0.1": False,
    "192.168.1.1": True, "169.254.169.254": True, "0.0.0.0": True, "224.0.0.1": True,
    "8.8.8.8": False, "192.0.0.9": False, "192.0.0.8": True, "[::1]": True, "fe80::1": True,
    "2606:4700:4700::1111": False, "paypal.com": False, "10.0.0.256": False, "": False,
}


def test_private_addresses(spark):
    assert evaluate(spark, list(PRIVATE), h.is_private_address) == list(PRIVATE.values())


URLS = {
    "https://paypal.com/": None, "ws://a.example/": None, "data:text/html,x": None,
    "javascript:alert(1)": None, "file:///etc/passwd": "scheme file not allowed",
    "paypal.com": "scheme (none) not allowed", "https:///x": "no host",
    "http://127.0.0.1/": "private address 127.0.0.1", "http://user@10.0.0.8:80/": "private address 10.0.0.8",
    "http://[::1]:8080/": "private address ::1", "HTTPS://A@B@Paypal.COM?x": None,
}


def test_url_policy(spark):
    assert evaluate(spark, list(URLS), h.url_refusal) == list(URLS.values())
    assert evaluate(spark, ["HTTPS://A@B@Paypal.COM?x", None, "x"], h.url_host) == ["paypal.com", None, None]


def test_candidate_urls(spark):
    assert evaluate(spark, ["a.com"], h.candidate_urls) == [["https://a.com/", "http://a.com/"]]
    with pytest.raises(ValueError, match="unsupported scheme"):
        h.candidate_urls(F.lit("a.com"), ("ftp",))


def test_text(spark):
    assert evaluate(spark, ["a\x1b[31m\x9fb"], clean_text) == ["a [31m b"]
    assert evaluate(spark, ["https://evil.com/a.b"], defang) == ["hxxps://evil[.]com/a[.]b"]
    got = evaluate(spark, ["<!channel> @everyone evil.com 0.93 http://x.y"], chat_safe)
    assert got == ["&lt;!channel&gt; @​everyone evil[.]com 0.93 hxxp://x[.]y"]
    assert evaluate(spark, ["  Sign \n in ", None], normalised_title) == ["sign in", ""]


def test_rounding_is_of_the_binary_value(spark):
    values = [0.9 * 0.8335, 0.12345, 0.00005, 1.0, 2 / 3, 1234.56785]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.x for r in df.select(round_binary(F.col("v"), 4).alias("x")).collect()]
    assert got == [round(v, 4) for v in values]
    assert df.select(ratio(F.lit(1), F.lit(0)).alias("x")).first().x == 0.0


def cheapest(left, right):
    """Distance by definition: match the ends, edit one, or swap what two matched letters enclose."""

    @lru_cache(None)
    def of(n, m):
        if not n or not m:
            return n + m
        options = [of(n - 1, m - 1) + (left[n - 1] != right[m - 1]), of(n - 1, m) + 1, of(n, m - 1) + 1]
        options += [
            of(i - 1, j - 1) + (n - i - 1) + 1 + (m - j - 1)
            for i in range(1, n) for j in range(1, m) if left[i - 1] == right[m - 1] and left[n - 1] == right[j - 1]
        ]
        return min(options)

    return of(len(left), len(right))


def test_edit_distance_is_unrestricted(spark):
    draw = random.Random(3)
    pairs = [("ca", "abc"), ("", "abc"), ("abc", ""), ("paypal", "papyal"), ("", ""), ("é😀ab", "😀éba")]
    pairs += [tuple("".join(draw.choices("abc", k=draw.randrange(9))) for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("d", edit_distance(F.col("a"), F.col("b")))
    assert all(r.d == cheapest(r.a, r.b) for r in df.collect())


def test_best_typo_is_that_of_all_pairs(spark):
    draw = random.Random(4)
    tokens = ["abcab", "bbca", "cabba", ""]
    labels = ["".join(draw.choices("abc-", k=draw.randrange(12))) for _ in range(200)]

    def best(label):
        pairs = [(w, t) for w in {*re.split("[^a-z]+", label), label} for t in tokens if len(w) >= len(t)]
        return max((round(1.0 - cheapest(w, t) / len(w), 4) if w else 1.0 for w, t in pairs), default=0.0)

    got = evaluate(spark, labels, lambda c: typo_similarity(c, F.array(*map(F.lit, tokens))))
    assert got == [best(label) for label in labels]


def test_typo_similarity_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("papyal",)], "v string").select(typo_similarity(F.col("v"), F.array(F.lit("paypal"))))
    assert "Python" not in df._jdf.queryExecution().toString()


def test_typo_similarity(spark):
    tokens = F.array(F.lit("mlcrosoft"), F.lit("paypal"))
    labels = ["mlcrosofft", "short", "login-papyal-now", None]
    got = evaluate(spark, labels, lambda c: typo_similarity(c, tokens))
    assert got == [0.9, 0.0, 0.8333, 0.0]
