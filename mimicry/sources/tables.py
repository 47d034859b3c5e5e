"""Schemas of the stored tables. Never inferred: the inputs are attacker-influenced."""

from __future__ import annotations

FEATURES = (
    "struct<known_variant_fuzzers:array<string>,typo_similarity:double,"
    "token_in_registered_label:boolean,token_in_subdomain:boolean,homoglyph:boolean,"
    "keyword_hits:array<string>,free_dv_issuer:boolean>"
)

SIGNALS = (
    "struct<title:string,form_count:int,has_password_input:boolean,"
    "has_credential_field:boolean,cross_domain_form_targets:array<string>,"
    "iframe_count:int,password_input_count:int>"
)

CERTIFICATES = (
    "cert_sha256 string, seen_at timestamp, issuer_org string, not_before timestamp, "
    "not_after timestamp, ct_log string, all_domains array<string>"
)

MATCHES = (
    "fqdn string, brand string, registered_domain string, score double, is_alert boolean, "
    f"features {FEATURES}, cert_sha256 string, first_seen_at timestamp"
)

CAPTURES = (
    "capture_id bigint, fqdn string, url string, status string, captured_at timestamp, "
    "duration_ms bigint, final_url string, http_status int, screenshot_path string, "
    f"html_path string, signals {SIGNALS}, error string, vantage string"
)

VERDICTS = (
    "verdict_id bigint, capture_id bigint, fqdn string, backend string, model string, "
    "label string, confidence double, brand_impersonated string, evidence string, "
    "classified_at timestamp, latency_ms bigint, prompt_tokens bigint, "
    "completion_tokens bigint, cost_usd double, error string, alerted_at timestamp"
)

LABELLED = (
    "fqdn string, expected string, source string, labelled_at date, brand string, "
    "note string, suggestion string, label_basis string, labelled_by string"
)
