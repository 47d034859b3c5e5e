"""The scorer once more, as SQL over small literal tables: the check of every scored query."""

from __future__ import annotations

from collections.abc import Iterable

from mimicry.config import DEFAULT_BRANDS, SWAP_TLDS, Scoring
from mimicry.staging import idn_labels

CFG = Scoring()
# Every public suffix a staged host or official domain can end in.
SUFFIXES = ("com", "net", "org", "xyz", "top", "info", "shop", "online", "fr", "uk", "co.uk",
            "io")
PRIVATE = ("github.io",)
# Characters that are folded, and what they become. Cyrillic, Greek, other
# Latin letters, digits; one more letter in the loose form.
FOLD_FROM = "авсԁеһіјкӏмпорԛгѕтцѵԝхуʐ" + "αβεικνορτυχ" + "ıłøđħɡ" + "0135"
FOLD_TO = "abcdehijklmnopqrstuvwxyz" + "abeikvoptux" + "ilodhg" + "oles"
LOOSE_FROM, LOOSE_TO = FOLD_FROM + "i", FOLD_TO + "l"
# The rows of a keyboard, each half a key to the right of the one above, and
# ASCII spellings drawn alike.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
ALIKE = "o0 0o l1 1l li il i1 e3 s5".split()
ALIKE_PAIRS = [("m", "rn"), ("rn", "m"), ("w", "vv"), ("vv", "w"), ("d", "cl")]


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: Iterable[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]::VARCHAR[]"


def table(name: str, columns: str, rows: Iterable[Iterable[object]]) -> str:
    body = ", ".join(
        "(" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in row) + ")"
        for row in rows
    )
    return f"{name}({columns}) AS (VALUES {body})"


def rounded(value: str, digits: int = 4) -> str:
    return f"CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE)"


def ratio(top: str, bottom: str, digits: int = 4) -> str:
    return (
        f"CASE WHEN ({bottom}) > 0 THEN {rounded(f'({top}) / ({bottom})', digits)} ELSE 0.0::DOUBLE END"
    )


FOLD = f"translate(lower(strip_accents(%s)), {text(FOLD_FROM)}, {text(FOLD_TO)})"
LOOSE = f"translate(lower(strip_accents(%s)), {text(LOOSE_FROM)}, {text(LOOSE_TO)})"
LOOSE = f"replace(replace({LOOSE}, 'rn', 'm'), 'vv', 'w')"


def _brands() -> str:
    rows = []
    for pos, b in enumerate(DEFAULT_BRANDS):
        lists = (
            b.tokens,
            b.negative_tokens,
            b.official_domains,
        )
        rows.append(f"({text(b.name)}, {pos}, " + ", ".join(array(v) for v in lists) + ")")
    long = f"list_filter(raw_tokens, lambda t: length(t) >= {CFG.min_typo_token_len})"
    folded = {
        "tokens": ("raw_tokens", FOLD), "loose_tokens": ("raw_tokens", LOOSE),
        "typo_tokens": (long, LOOSE), "negatives": ("raw_negatives", FOLD),
    }
    columns = ", ".join(f"list_transform({of}, lambda t: {how % 't'}) AS {name}" for name, (of, how) in folded.items())
    return f"""brands AS (
        SELECT brand, pos, raw_tokens, official, {columns}
        FROM (VALUES {', '.join(rows)}) b(brand, pos, raw_tokens, raw_negatives, official))"""


def variant_ctes() -> list[str]:
    """``variants(label, suffix, brand, fuzzer)``, with Unicode labels kept as they are."""
    keys = [(key, x + row / 2, row) for row, line in enumerate(KEY_ROWS) for x, key in enumerate(line)]
    near = [
        (a, b) for a, x, row in keys for b, other, line in keys if abs(x - other) + abs(row - line) / 2 == 1
    ]
    hostname = "abcdefghijklmnopqrstuvwxyz0123456789-"
    flips = [(a, b) for a in hostname for b in hostname if (ord(a) ^ ord(b)).bit_count() == 1]
    odd = [(plain, c) for c, plain in zip(FOLD_FROM, FOLD_TO, strict=True) if not c.isascii()]
    alike = [*map(tuple, ALIKE), *ALIKE_PAIRS, *odd]
    vowels = [(a, b) for a in "aeiou" for b in "aeiou" if a != b]
    pairs = [
        *[("bitsquatting", *p) for p in flips],
        *[("homoglyph", *p) for p in alike],
        *[("replacement", *p) for p in near],
        *[("vowel-swap", *p) for p in vowels],
    ]
    official = [
        (*d.split(".", 1), b.name) for b in DEFAULT_BRANDS for d in b.official_domains
    ]
    letters = [(c,) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    return [
        table("official_parts", "label, suffix, brand", official),
        table("swaps", "fuzzer, old, new", pairs),
        table("near_keys", "old, new", near),
        table("letters", "c", letters),
        table("tlds", "tld", [(t,) for t in SWAP_TLDS]),
        """at_pos AS (SELECT *, unnest(generate_series(1, length(label))) AS i FROM official_parts)""",
        """raw_variants AS (
            SELECT brand, suffix, label || c AS label, 'addition' AS fuzzer FROM official_parts, letters
            UNION SELECT brand, suffix, left(label, i - 1) || substr(label, i + 1), 'omission' FROM at_pos
            UNION SELECT brand, suffix, left(label, i) || substr(label, i), 'repetition' FROM at_pos
            UNION SELECT brand, suffix, left(label, i - 1) || '-' || substr(label, i), 'hyphenation' FROM at_pos WHERE i > 1
            UNION SELECT brand, suffix, left(label, i - 2) || substr(label, i, 1) || substr(label, i - 1, 1) || substr(label, i + 1), 'transposition' FROM at_pos WHERE i > 1
            UNION SELECT brand, suffix, left(label, i - 1) || new || substr(label, i + length(old)), fuzzer
                  FROM at_pos JOIN swaps ON substr(label, i, length(old)) = old
            UNION SELECT brand, suffix, left(label, i - 1) || new || substr(label, i), 'insertion' FROM at_pos JOIN near_keys ON substr(label, i, 1) = old
            UNION SELECT brand, suffix, left(label, i) || new || substr(label, i + 1), 'insertion' FROM at_pos JOIN near_keys ON substr(label, i, 1) = old
            UNION SELECT brand, tld, label, 'tld-swap' FROM official_parts, tlds)""",
        """variants AS MATERIALIZED (
            SELECT DISTINCT label, suffix, brand, fuzzer FROM raw_variants v
            WHERE label <> '' AND NOT regexp_matches(label, '^-|-$')
              AND NOT EXISTS (SELECT 1 FROM official_parts o WHERE o.brand = v.brand
                              AND o.label = v.label AND o.suffix = v.suffix))""",
    ]


def host_ctes(source: str) -> list[str]:
    """``forms``: the parts and folded forms of each distinct ``host`` of ``source``."""
    fold, loose = FOLD, LOOSE
    return [
        table("psl", "suffix", [(s,) for s in SUFFIXES]),
        table("idn", "ascii_label, decoded", idn_labels()),
        f"""named AS (
            SELECT DISTINCT host, nullif(rtrim(CASE WHEN starts_with(h, '*.') THEN substr(h, 3) ELSE h END, '.'), '') AS fqdn
            FROM (SELECT host, lower(trim(host)) AS h FROM ({source}) src) lowered)""",
        """suffixed AS (
            SELECT fqdn, arg_max(suffix, length(suffix)) AS suffix
            FROM (SELECT DISTINCT fqdn FROM named WHERE fqdn IS NOT NULL) f
            JOIN psl ON ends_with(fqdn, '.' || suffix) GROUP BY fqdn)""",
        """split AS MATERIALIZED (
            SELECT fqdn, suffix, domain, domain || '.' || suffix AS registered_domain,
                   CASE WHEN length(rest) > length(domain) THEN left(rest, length(rest) - length(domain) - 1) ELSE '' END AS subdomain
            FROM (SELECT fqdn, suffix, rest, regexp_extract(rest, '([^.]*)$', 1) AS domain
                  FROM (SELECT fqdn, suffix, left(fqdn, length(fqdn) - length(suffix) - 1) AS rest FROM suffixed) r) d
            WHERE domain <> '')""",
        f"""forms AS MATERIALIZED (
            SELECT s.*, coalesce(decoded, domain) AS label_raw, subdomain AS subdomain_raw,
                   {fold % "coalesce(decoded, domain)"} AS label_sk, {fold % "subdomain"} AS subdomain_sk,
                   {loose % "coalesce(decoded, domain)"} AS label_loose, {loose % "subdomain"} AS subdomain_loose
            FROM split s LEFT JOIN idn ON domain = ascii_label)""",
    ]


def _strip(form: str) -> str:
    return f"list_reduce(list_prepend({form}, negatives), lambda acc, neg: replace(acc, neg, ' '))"


def _token(form: str, tokens: str) -> str:
    stripped = _strip(form)
    return (
        f"len(list_filter({tokens}, lambda t: CASE WHEN length(t) >= {CFG.min_substring_token_len} "
        f"THEN contains({stripped}, t) "
        f"ELSE list_contains(string_split_regex({stripped}, '[^a-z]+'), t) END)) > 0"
    )


def _word(form: str) -> str:
    return f"list_has_any(string_split_regex({_strip(form)}, '[^a-z]+'), loose_tokens)"


def scored_ctes(source: str) -> list[str]:
    """``scored``: one row per (host, free_dv) of ``source`` and brand that does not own it."""
    w = CFG.weights
    keywords = list(enumerate(CFG.sensitive_keywords))
    return [
        _brands(),
        table("raw_keywords", "place, word", keywords),
        f"keywords AS (SELECT place, {FOLD % 'word'} AS folded, word FROM raw_keywords)",
        *variant_ctes(),
        *host_ctes(source),
        """known AS MATERIALIZED (
            SELECT label, suffix, brand, list_sort(list_distinct(list(fuzzer))) AS fuzzers
            FROM variants GROUP BY ALL)""",
        f"""flags AS MATERIALIZED (
            SELECT f.*, b.brand, b.pos, b.tokens, b.typo_tokens,
                   {_strip("label_loose")} AS typo_label,
                   {_token("label_sk", "tokens")} OR {_word("label_loose")} AS in_label,
                   {_token("subdomain_sk", "tokens")} OR {_word("subdomain_loose")} AS in_sub,
                   {_token("label_raw", "raw_tokens")} OR {_token("subdomain_raw", "raw_tokens")} AS spelt_out,
                   coalesce(k.fuzzers, []::VARCHAR[]) AS fuzzers
            FROM forms f JOIN brands b ON NOT list_contains(b.official, f.registered_domain)
            LEFT JOIN known k ON k.label = f.label_raw AND k.suffix = f.suffix AND k.brand = b.brand)""",
        """words AS (
            SELECT fqdn, brand, typo_tokens,
                   unnest(list_distinct(list_append(string_split_regex(typo_label, '[^a-z]+'), typo_label))) AS word
            FROM flags WHERE len(typo_tokens) > 0)""",
        """typos AS MATERIALIZED (
            SELECT fqdn, brand, max(1.0::DOUBLE - damerau_levenshtein(word, token)::DOUBLE / greatest(length(word), length(token))) AS sim
            FROM (SELECT fqdn, brand, word, unnest(typo_tokens) AS token FROM words) t
            WHERE length(word) >= length(token) GROUP BY fqdn, brand)""",
        """hits AS MATERIALIZED (
            SELECT fqdn, brand, list(word ORDER BY place) AS keywords
            FROM flags, keywords
            WHERE contains(list_reduce(list_prepend(subdomain_sk || '.' || label_sk, tokens), lambda acc, t: replace(acc, t, ' ')), folded)
            GROUP BY fqdn, brand)""",
        f"""features AS MATERIALIZED (
            SELECT f.fqdn, f.registered_domain, f.brand, f.pos, f.fuzzers, f.in_label, f.in_sub,
                   (f.in_label OR f.in_sub) AND NOT f.spelt_out AS homoglyph,
                   coalesce({rounded("sim")}, 0.0::DOUBLE) AS typo, coalesce(keywords, []::VARCHAR[]) AS keywords
            FROM flags f LEFT JOIN typos USING (fqdn, brand) LEFT JOIN hits USING (fqdn, brand))""",
        f"""based AS (
            SELECT *, greatest(CASE WHEN len(fuzzers) > 0 THEN {w.known_variant} ELSE 0 END::DOUBLE,
                               CASE WHEN typo >= {CFG.min_typo_similarity} AND typo < 1 THEN {w.typo_similarity}::DOUBLE * typo ELSE 0 END::DOUBLE,
                               CASE WHEN in_label THEN {w.token_in_registered_label} ELSE 0 END::DOUBLE,
                               CASE WHEN in_sub THEN {w.token_in_subdomain} ELSE 0 END::DOUBLE) AS base
            FROM features)""",
        f"""scored AS (
            SELECT c.host, c.free_dv, b.*,
                   CASE WHEN base > 0 THEN {rounded(f'''least(1.0::DOUBLE, base + (CASE WHEN homoglyph THEN {w.homoglyph_bonus} ELSE 0 END::DOUBLE
                        + {w.keyword_bonus}::DOUBLE * least(len(keywords), {w.max_keyword_hits})
                        + CASE WHEN c.free_dv THEN {w.free_dv_bonus} ELSE 0 END::DOUBLE))''')} ELSE 0.0::DOUBLE END AS score
            FROM (SELECT DISTINCT host, free_dv FROM ({source}) src) c
            JOIN named USING (host) JOIN based b USING (fqdn))""",
    ]


def with_ctes(ctes: Iterable[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
