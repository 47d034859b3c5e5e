"""Settings of the jobs: scoring weights, brands, word lists and limits.

Everything here is configuration, not data: its size does not depend on the volume
being processed, which is why the jobs may turn it into literals and broadcasts.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Brand:
    name: str
    tokens: tuple[str, ...]
    official_domains: tuple[str, ...]
    negative_tokens: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in ("tokens", "official_domains", "negative_tokens"):
            object.__setattr__(self, name, tuple(v.lower() for v in getattr(self, name)))


@dataclass(frozen=True)
class Weights:
    # The default scoring weights.
    known_variant: float = 1.0
    typo_similarity: float = 0.9
    token_in_registered_label: float = 0.6
    token_in_subdomain: float = 0.5
    homoglyph_bonus: float = 0.1
    keyword_bonus: float = 0.1
    max_keyword_hits: int = 2
    free_dv_bonus: float = 0.05


# Sensitive words, English first, then French.
SENSITIVE_KEYWORDS = (
    "login", "signin", "secure", "security", "support", "verify", "verification",
    "account", "update", "billing", "payment", "wallet", "auth", "recover", "unlock",
    "helpdesk", "service",
    "compte", "connexion", "remboursement", "securite", "carte", "vitale", "espace",
    "assure",
)

# Issuers that hand out domain-validated certificates for free.
FREE_DV_ISSUERS = ("Let's Encrypt", "ZeroSSL", "Google Trust Services", "cPanel")

# Suffixes tried by the tld-swap variants.
SWAP_TLDS = (
    "com", "net", "org", "info", "co", "io", "app", "online", "site", "xyz", "top",
    "shop", "support", "fr", "us",
)

# The six brands of the default configuration, in scoring order.
DEFAULT_BRANDS = (
    Brand("paypal", ("paypal",), ("paypal.com", "paypal.me", "paypalobjects.com")),
    Brand(
        "microsoft",
        ("microsoft", "office365", "outlook"),
        ("microsoft.com", "office.com", "office365.com", "outlook.com", "live.com",
         "microsoftonline.com"),
    ),
    Brand(
        "apple",
        ("apple", "icloud"),
        ("apple.com", "icloud.com"),
        ("pineapple", "applebee", "snapple", "grapple"),
    ),
    Brand("netflix", ("netflix",), ("netflix.com", "netflix.net", "nflxext.com")),
    Brand(
        "amazon",
        ("amazon",),
        ("amazon.com", "amazon.fr", "amazon.de", "amazon.co.uk", "amazonaws.com",
         "amazon.dev", "amazonwebservices.com.cn", "amazonaws.com.cn", "amazonaws.eu",
         "amazonwebservices.eu"),
    ),
    Brand("ameli", ("ameli",), ("ameli.fr",), ("amelia", "cameli", "pamela")),
)


@dataclass(frozen=True)
class Scoring:
    alert_threshold: float = 0.7
    store_floor: float = 0.4
    min_typo_similarity: float = 0.8
    min_typo_token_len: int = 7
    min_substring_token_len: int = 5
    weights: Weights = field(default_factory=Weights)
    sensitive_keywords: tuple[str, ...] = SENSITIVE_KEYWORDS
    free_dv_issuers: tuple[str, ...] = FREE_DV_ISSUERS


@dataclass(frozen=True)
class AlertPolicy:
    labels: tuple[str, ...] = ("phishing",)
    min_confidence: float = 0.6
    max_per_run: int | None = None  # findings announced at once


# Labels of a site, and the labels an analyst may assign.
LABELS = ("phishing", "parked", "legitimate", "unreachable", "unknown")
REVIEWABLE_LABELS = ("phishing", "parked", "legitimate", "unknown")
LABEL_BASES = ("screenshot", "feed")
CAPTURE_STATUSES = ("ok", "timeout", "dns_error", "connection_error", "blocked", "error")

# Alert thresholds at which the sweep reports.
SWEEP_THRESHOLDS = (0.4, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)
