"""Hardware and network addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mac_prefix(mac: Column) -> Column:
    """First six hex digits in upper case without separators; null if they aren't hex."""
    bare = F.upper(F.regexp_replace(mac, "[:.-]", ""))
    return F.when(bare.rlike("^[0-9A-F]{6}"), F.substring(bare, 1, 6))


def normalize_mac_prefix(mac: str) -> str | None:
    """The same on the driver."""
    bare = mac.replace(":", "").replace("-", "").replace(".", "").upper()[:6]
    return bare if len(bare) == 6 and set(bare) <= set("0123456789ABCDEF") else None


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat_ws(":", ip, port.cast("string"))


def session_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    """One name for both directions: addresses compare as text, ports as numbers."""
    a = F.struct(src_ip.alias("ip"), src_port.cast("int").alias("port"))
    b = F.struct(dst_ip.alias("ip"), dst_port.cast("int").alias("port"))
    low, high = F.least(a, b), F.greatest(a, b)
    return F.concat(endpoint(low["ip"], low["port"]), F.lit("<->"), endpoint(high["ip"], high["port"]))
