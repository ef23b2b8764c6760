"""Decode raw link-layer frames to packet rows with column expressions only.

Each layer is bound to a lambda variable, so that a header field is read once
and the optimizer cannot copy the whole chain into every predicate.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.vectors import bind

# Link types of capture files, ether types, header numbers.
ETHERNET, NULL_LOOPBACK, RAW, LINUX_SLL, IPV4_LINK, IPV6_LINK, LINUX_SLL2 = 1, 0, 101, 113, 228, 229, 276
VLAN_TYPES = ["8100", "88A8", "9100"]
IPV4_TYPE, IPV6_TYPE = "0800", "86DD"
EXTENSION_HEADERS = [0, 43, 44, 51, 60]
INET_FAMILY, INET6_FAMILIES = 2, [10, 24, 28, 30]


def _bytes(frame: Column, at, count: int) -> Column:
    """Hex text of `count` bytes from 0-based byte `at`."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.substring(frame["hex"], (at * 2 + 1).cast("int"), F.lit(2 * count))


def _number(frame: Column, at, count: int) -> Column:
    return F.conv(_bytes(frame, at, count), 16, 10).cast("int")


def _network(frame: Column) -> Column:
    """Network offset and ether type per link type; a null type when the frame is too short."""
    link, size = frame["link"], frame["size"]
    tags = F.regexp_extract(
        F.substring(frame["hex"], F.lit(25), size * 2), rf"^(?:(?:{'|'.join(VLAN_TYPES)}).{{4}})*", 0)
    ether = bind((14 + F.length(tags) / 2).cast("int"), lambda n: F.struct(
        n.alias("net"), F.when((size >= 14) & (size >= n), _bytes(frame, n - 2, 2)).alias("type")))
    first, turned = _bytes(frame, 0, 4), F.concat(*[_bytes(frame, i, 1) for i in (3, 2, 1, 0)])
    family = lambda values: first.isin([f"{v:08X}" for v in values]) | turned.isin([f"{v:08X}" for v in values])
    loopback = F.when(family([INET_FAMILY]), IPV4_TYPE).when(family(INET6_FAMILIES), IPV6_TYPE)
    version = F.substring(frame["hex"], F.lit(1), F.lit(1))
    at = lambda n, kind: F.struct(F.lit(n).alias("net"), kind.alias("type"))
    return (
        F.when(link == ETHERNET, ether)
        .when(link == LINUX_SLL, at(16, F.when(size >= 16, _bytes(frame, 14, 2))))
        .when(link == LINUX_SLL2, at(20, F.when(size >= 20, _bytes(frame, 0, 2))))
        .when(link == NULL_LOOPBACK, at(4, F.when(size >= 4, loopback)))
        .when(link == RAW, at(0, F.when(version == "4", IPV4_TYPE).when(version == "6", IPV6_TYPE)))
        .when(link == IPV4_LINK, at(0, F.lit(IPV4_TYPE))).when(link == IPV6_LINK, at(0, F.lit(IPV6_TYPE)))
    )


def _ipv6_text(frame: Column, at: Column) -> Column:
    """Address text with the longest zero run shortened."""
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.regexp_replace(F.lower(_bytes(frame, at + i * 2, 2)), "^0{1,3}", ""),
    )

    def shorten(full: Column) -> Column:
        short = full
        for run in range(2, 9):  # the longest run is tested last and wins
            pattern = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)(.*)$"
            short = F.when(full.rlike(pattern), F.regexp_replace(full, pattern, "$1::$2")).otherwise(short)
        return short

    return bind(F.array_join(groups, ":"), shorten)


def _dotted(frame: Column, at: Column) -> Column:
    return F.concat_ws(".", *[F.conv(_bytes(frame, at + i, 1), 16, 10) for i in range(4)])


def _state(proto: Column, at: Column, ok: Column) -> Column:
    return F.struct(proto.cast("int").alias("proto"), at.cast("int").alias("at"), ok.alias("ok"))


def _ipv4(frame: Column, net: Column) -> Column:
    def body(first: Column) -> Column:
        length = first.bitwiseAND(15) * 4
        whole = (F.shiftright(first, 4) == 4) & (length >= 20) & (frame["size"] >= net + length)
        initial = _number(frame, net + 6, 2).bitwiseAND(0x1FFF) == 0
        return _state(_number(frame, net + 9, 1), net + length, whole & initial)

    return F.when(frame["size"] >= net + 20, bind(_number(frame, net, 1), body))


def _ipv6(frame: Column, net: Column) -> Column:
    """Walk the extension headers; each has at least eight bytes, so the walk is finite."""
    size = frame["size"]
    begin = _state(_number(frame, net + 6, 1), net + 40, F.substring(_bytes(frame, net, 1), F.lit(1), F.lit(1)) == "6")

    def walk(s: Column, _: Column) -> Column:
        kind, at = s["proto"], s["at"]
        units = _number(frame, at + 1, 1)
        length = F.when(kind == 44, 8).when(kind == 51, (units + 2) * 4).otherwise((units + 1) * 8)
        later_fragment = (kind == 44) & (F.shiftright(_number(frame, at + 2, 2), 3) > 0)
        whole = (size >= at + F.when(kind == 44, 8).otherwise(2)) & (at + length <= size)
        ok = F.coalesce(whole & ~later_fragment, F.lit(False))
        moved = F.when(ok, _state(_number(frame, at, 1), at + length, F.lit(True))).otherwise(_state(kind, at, F.lit(False)))
        return F.when(s["ok"] & kind.isin(EXTENSION_HEADERS), moved).otherwise(s)

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((size - net - 40) / 8).cast("int")))
    walked = bind(begin, lambda s: F.when(~s["proto"].isin(EXTENSION_HEADERS), s).otherwise(F.aggregate(steps, s, walk)))
    return F.when(size >= net + 40, walked)


def _packet(frame: Column) -> Column:
    def transport(layer: Column, ip: Column) -> Column:
        four, net, at, size = layer["type"] == IPV4_TYPE, layer["net"], ip["at"], frame["size"]
        header = F.shiftright(_number(frame, at + 12, 1), 4) * 4
        tcp = (ip["proto"] == 6) & (size >= at + 20) & (header >= 20) & (size >= at + header)
        udp = (ip["proto"] == 17) & (size >= at + 8)
        return F.when(ip["ok"] & (tcp | udp), F.struct(
            F.when(four, _dotted(frame, net + 12)).otherwise(_ipv6_text(frame, net + 8)).alias("src_ip"),
            F.when(four, _dotted(frame, net + 16)).otherwise(_ipv6_text(frame, net + 24)).alias("dst_ip"),
            _number(frame, at, 2).alias("src_port"), _number(frame, at + 2, 2).alias("dst_port"),
            F.when(ip["proto"] == 6, "tcp").otherwise("udp").alias("protocol"),
            F.when(four, _number(frame, net + 2, 2)).alias("ip_length"),
        ))

    def network(layer: Column) -> Column:
        ip = F.when(layer["type"] == IPV4_TYPE, _ipv4(frame, layer["net"])).when(
            layer["type"] == IPV6_TYPE, _ipv6(frame, layer["net"]))
        return bind(ip, lambda s: transport(layer, s))

    return bind(_network(frame), network)


def decode_frames(frames: DataFrame) -> DataFrame:
    """frames[capture_id, frame_number, ts, linktype, bytes] -> packet rows.

    Frames that are not an initial TCP or UDP fragment over IP are left out.
    """
    frame = F.struct(F.hex("bytes").alias("hex"), F.length("bytes").alias("size"), F.col("linktype").alias("link"))
    found = F.filter(F.transform(F.array(frame), _packet), lambda p: p.isNotNull())
    return frames.select("capture_id", "frame_number", "ts", F.inline(found))


def wire_length(packets: DataFrame) -> DataFrame:
    """IPv4 total length clamped to 1..1500; other rows and impossible lengths are left out."""
    length = F.col("ip_length")
    return packets.where(length >= 20).withColumn("wire_length", F.greatest(F.lit(1), F.least(F.lit(1500), length)))
