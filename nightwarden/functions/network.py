"""IPv4 and flow-key helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(\.{OCTET}){{3}}$"


def is_ipv4(text: Column) -> Column:
    return F.coalesce(text.rlike(IPV4), F.lit(False))


def ipv4_number(text: Column) -> Column:
    """32-bit value of a dotted IPv4 address, NULL when it is none."""
    octets = F.transform(F.split(text, r"\."), lambda o: o.try_cast("bigint"))
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    return F.when(is_ipv4(text), value)


def ipv4_text(number: Column) -> Column:
    parts = [(F.shiftright(number, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def directional_key(src_ip, dst_ip, src_port, dst_port, protocol) -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in (src_ip, dst_ip, src_port, dst_port, protocol)])


def _signed_octets(ip: Column) -> Column:
    return F.transform(
        F.split(ip, r"\."),
        lambda o: F.when(o.cast("int") > 127, o.cast("int") - 256).otherwise(o.cast("int")),
    )


def canonical_flow_id(src_ip="src_ip", dst_ip="dst_ip", src_port="src_port", dst_port="dst_port",
                      protocol="protocol") -> Column:
    """Flow id whose first endpoint has the lower address, octets read as signed bytes."""
    swapped = _signed_octets(F.col(src_ip)) > _signed_octets(F.col(dst_ip))
    return F.when(
        swapped, directional_key(dst_ip, src_ip, dst_port, src_port, protocol)
    ).otherwise(directional_key(src_ip, dst_ip, src_port, dst_port, protocol))


def conversation_key(src_ip="src_ip", dst_ip="dst_ip", src_port="src_port", dst_port="dst_port",
                     protocol="protocol") -> Column:
    """Same text for both directions of a 5-tuple; used to group packets."""
    one = F.struct(F.col(src_ip).alias("ip"), F.col(src_port).alias("port"))
    two = F.struct(F.col(dst_ip).alias("ip"), F.col(dst_port).alias("port"))
    low, high = F.least(one, two), F.greatest(one, two)
    return F.concat_ws(
        "-", low["ip"], low["port"].cast("string"), high["ip"], high["port"].cast("string"),
        F.col(protocol).cast("string"),
    )
