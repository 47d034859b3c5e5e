"""Hostnames, IP literals and URLs."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

# What a plain DNS hostname (or dotted IPv4 literal) and a port look like.
_LABEL = "[a-z0-9_](?:[a-z0-9_-]{0,62}[a-z0-9_])?"
_PORT = "[1-9][0-9]{0,4}"
_HOSTNAME = rf"^(?=[^:]{{1,253}}(?::|$)){_LABEL}(?:\.{_LABEL})*\.?(?::{_PORT})?$"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_IPV6_SHAPE = r"^\[?[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\]]+)?\]?(?::[0-9]*)?$"

# IPv4 blocks that are private, loopback, link-local, reserved, multicast
# or unspecified (IANA special-purpose registry), without the global holes inside them.
_SPECIAL_V4 = (
    r"0\.", r"10\.", r"127\.", r"169\.254\.", r"172\.(?:1[6-9]|2[0-9]|3[01])\.",
    r"192\.0\.0\.", r"192\.0\.2\.", r"192\.168\.", r"198\.1[89]\.", r"198\.51\.100\.",
    r"203\.0\.113\.", r"22[4-9]\.", r"2[3-5][0-9]\.",
)
_GLOBAL_V4 = r"192\.0\.0\.(?:9|10)$"
_PRIVATE_V4 = rf"^(?={_IPV4[1:-1]}$)(?!{_GLOBAL_V4})(?:{'|'.join(_SPECIAL_V4)})"

_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"
_URL_HOST = rf"^(?:{_SCHEME}:)?//(?:[^/?#\\]*@)?(\[[^\]/?#]*\]|[^:/?#\\\[]*)"

# URL schemes that never reach the network, and those that may.
INERT_SCHEMES = ("data", "blob", "about", "javascript")
NETWORK_SCHEMES = ("http", "https", "ws", "wss")


def normalize_hostname(raw: Column) -> Column:
    """Trimmed, lower-cased, without one wildcard prefix and trailing dots; NULL if empty."""
    host = F.lower(F.btrim(raw, F.lit(" \t\n\r\f\x0b")))
    host = F.when(host.startswith("*."), F.substr(host, F.lit(3))).otherwise(host)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


@pandas_udf(BooleanType())
def _special_ipv6(literals: pd.Series) -> pd.Series:
    """NULL for text that is no address, else whether the address is not global."""
    return pd.Series([_address_flag(text) for text in literals], dtype=object)


def _address_flag(text: str | None) -> bool | None:
    if text is None:
        return None
    try:
        address = ipaddress.ip_address(text.strip("[]"))
    except ValueError:
        return None
    return (
        address.is_private
        or address.is_loopback
        or address.is_link_local
        or address.is_reserved
        or address.is_multicast
        or address.is_unspecified
    )


@pandas_udf(BooleanType())
def _valid_literal(hosts: pd.Series) -> pd.Series:
    """Whether hosts with a bracket or several colons are literals with an optional port."""
    return pd.Series([_is_literal(host) for host in hosts], dtype=object)


def _is_literal(host: str | None) -> bool | None:
    if host is None:
        return None
    if host.startswith("["):
        name, closed, port = host[1:].partition("]")
        port_fits = bool(closed) and (not port or bool(re.fullmatch(":" + _PORT, port)))
    else:
        name, _, port = host.rpartition(":")
        port_fits = bool(re.fullmatch(_PORT, port))
    return port_fits and _address_flag(name) is not None


def is_ipv4(text: Column) -> Column:
    return text.rlike(_IPV4)


def is_private_address(host: Column) -> Column:
    """True for an IP literal that is not on the public internet; names are false."""
    literal = F.btrim(host, F.lit("[]"))
    v6 = _special_ipv6(F.when(literal.rlike(_IPV6_SHAPE), literal))
    return F.coalesce(literal.rlike(_PRIVATE_V4) | F.coalesce(v6, F.lit(False)), F.lit(False))


def is_valid_hostname(host: Column) -> Column:
    """A DNS name or IP literal with an optional port and nothing else."""
    host = F.lower(host)
    odd = host.rlike(r"^\[|:.*:")
    return F.coalesce(
        host.rlike(_HOSTNAME) | F.coalesce(_valid_literal(F.when(odd, host)), F.lit(False)),
        F.lit(False),
    )


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, rf"^({_SCHEME}):", 1))


def url_host(url: Column) -> Column:
    """Lower-cased host of a URL without userinfo and port, or NULL."""
    found = F.regexp_extract(url, _URL_HOST, 1)
    return F.nullif(F.lower(F.btrim(found, F.lit("[]"))), F.lit(""))


def url_refusal(url: Column, block_private: bool = True) -> Column:
    """Why a URL must not be requested, or NULL when it may be."""
    scheme = url_scheme(url)
    host = url_host(url)
    shown = F.when(scheme == "", F.lit("(none)")).otherwise(scheme)
    reason = (
        F.when(scheme.isin(*INERT_SCHEMES), F.lit(None).cast("string"))
        .when(
            ~scheme.isin(*NETWORK_SCHEMES),
            F.concat(F.lit("scheme "), shown, F.lit(" not allowed")),
        )
        .when(host.isNull(), F.lit("no host"))
    )
    if block_private:
        reason = reason.when(
            is_private_address(host), F.concat(F.lit("private address "), host)
        )
    return reason


def candidate_urls(host: Column, schemes: tuple[str, ...] = ("https", "http")) -> Column:
    """The URLs a host is visited at, in order."""
    unknown = [s for s in schemes if s not in ("http", "https")]
    if unknown:
        raise ValueError(f"unsupported scheme(s): {unknown}")
    return F.array(*[F.concat(F.lit(f"{s}://"), host, F.lit("/")) for s in schemes])
