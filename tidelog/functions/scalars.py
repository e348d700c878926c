"""Scalar functions: hashes, JSON, URLs, texts.  All are Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_SIZE = 1 << 32


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def h32(x: Column | str) -> Column:
    """The first 32 bits of md5, as an unsigned number: the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(_c(x).cast("binary")), 1, 8), 16, 10).cast("long")


def bucket_of(key: Column | str, n: int) -> Column:
    if n < 1:
        raise ValueError("at least one bucket")
    return F.pmod(h32(key), F.lit(n)).cast("int")


def fnv1a_32(x: Column | str) -> Column:
    """32-bit FNV-1a over UTF-8 bytes."""
    digits = F.hex(_c(x).cast("binary"))
    count = (F.length(digits) / 2).cast("int")
    octets = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long"),
    )
    return F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619), F.lit(RING_SIZE)))


def ring_angle(pos: Column | str) -> Column:
    """Angle of a ring position, zero at the top."""
    return _c(pos) / F.lit(float(RING_SIZE - 1)) * F.lit(2 * math.pi) - F.lit(math.pi / 2)


def on_circle(pos: Column | str, radius: float = 230.0) -> Column:
    return F.struct((F.cos(ring_angle(pos)) * radius).alias("x"), (F.sin(ring_angle(pos)) * radius).alias("y"))


def json_string(body: Column | str, field: str) -> Column:
    """A string field of a JSON object; empty where absent."""
    return F.coalesce(F.get_json_object(_c(body), f"$.{field}"), F.lit(""))


def json_int(body: Column | str, field: str, default: int) -> Column:
    """A non-negative whole number of a JSON object; the default where absent or otherwise."""
    raw = F.get_json_object(_c(body), f"$.{field}")
    return F.coalesce(F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int")), F.lit(default))


def url_decode(x: Column | str) -> Column:
    """Percent-decoding with + as space, escape by escape: a malformed one is kept as it stands.

    Bytes that aren't UTF-8 are replaced as Spark does.
    """
    plain = F.replace(_c(x), F.lit("+"), F.lit(" "))
    parts = F.regexp_extract_all(plain, F.lit("(%[0-9A-Fa-f]{2}|%|[^%]+)"), F.lit(1))
    coded = lambda p: (F.length(p) == 3) & p.rlike("^%[0-9A-Fa-f]{2}$")
    hexed = F.transform(parts, lambda p: F.when(coded(p), F.substring(p, 2, 2)).otherwise(F.hex(p.cast("binary"))))
    return F.when(F.instr(plain, "%") == 0, plain).otherwise(F.decode(F.unhex(F.array_join(hexed, "")), "UTF-8"))


def query_parameter(url: Column | str, name: str) -> Column:
    """The decoded text after the first `name=`, up to the next &; empty where there is none.  Any text will do as a URL."""
    return url_decode(F.regexp_extract(_c(url), f"(?s){name}=([^&]*)", 1))


def vnode_name(node: Column | str, i: Column) -> Column:
    return F.concat(_c(node), F.lit("#"), i.cast("string"))


def leaf_text(key: Column | str, value: Column | str) -> Column:
    return F.concat(_c(key), F.lit("="), _c(value), F.lit(";"))


def log_line(op: Column, key: Column, value: Column, handoff: Column | None = None) -> Column:
    put = F.concat(F.lit("PUT "), key, F.lit("="), value, F.when(handoff if handoff is not None else F.lit(False), " (Handoff)").otherwise(""))
    return F.when(op == "DELETE", F.concat(F.lit("DELETE "), key, F.lit(" (TOMBSTONE)"))).otherwise(put)


def percent(count: Column, full: int = 4) -> Column:
    return F.least(F.lit(100.0), count / F.lit(full) * 100)


def node_name(x: Column | str) -> Column:
    return F.lower(F.trim(_c(x)))


def verdict_text(code: Column) -> Column:
    """The name of a comparison's outcome: 0 equal, 1 before, 2 after, 3 concurrent."""
    return F.element_at(F.array(*map(F.lit, ("EQUAL", "BEFORE", "AFTER", "CONCURRENT"))), code + 1)


def monotonic_ms(as_of: Column, start: Column) -> Column:
    """Milliseconds since a start, never less than zero; time is an argument, so tests give their own."""
    return F.greatest(F.lit(0), F.unix_millis(as_of) - F.unix_millis(start))
