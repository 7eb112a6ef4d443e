"""Private and special network addresses in strings."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"(?<![0-9A-Za-z.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z]|\.[0-9])"
LOCALHOST = r"(?i)(?<![A-Za-z0-9_.-])localhost(?![A-Za-z0-9_-]|\.[A-Za-z0-9])"
#: First and last addresses, as numbers, of the private and special blocks.
BLOCKS = tuple(
    (int(n.network_address), int(n.broadcast_address))
    for n in map(ipaddress.ip_network, ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16"))
)


def private_ipv4_or_localhost(text: Column) -> Column:
    """Whether a text holds a private or special IPv4 address, or the name localhost; native."""

    def private(address: Column) -> Column:
        parts = F.transform(F.split(address, r"\."), lambda p: p.cast("long"))
        number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p)
        sound = F.forall(parts, lambda p: p <= 255)
        inside = F.lit(False)
        for lo, hi in BLOCKS:
            inside = inside | number.between(lo, hi)
        return sound & inside

    return F.coalesce(F.exists(F.regexp_extract_all(text, F.lit(IPV4), 1), private) | text.rlike(LOCALHOST), F.lit(False))


_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])\[?([0-9A-Fa-f:]*:[0-9A-Fa-f:.]*[0-9A-Fa-f:])\]?(?![0-9A-Za-z:])")


def has_private_ipv6(text: str | None) -> bool:
    for m in _IPV6.finditer(text or ""):
        try:
            a = ipaddress.IPv6Address(m[1])
        except ValueError:
            continue
        if a.is_loopback or a.is_unspecified or a.is_link_local or a in ipaddress.ip_network("fc00::/7"):
            return True
        if a.ipv4_mapped and any(lo <= int(a.ipv4_mapped) <= hi for lo, hi in BLOCKS):
            return True
    return False


def private_ipv6(text: Column) -> Column:
    """IPv6 needs a parser: a vectorised UDF, run only where a text holds two colons."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(has_private_ipv6).astype(bool)

    return F.when(text.rlike(":.*:"), run(text)).otherwise(False)
