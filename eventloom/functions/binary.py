"""Reads from binary payloads as native column expressions.

Offsets are zero-based bytes. Out-of-range reads give null. Unsigned 32-bit
values live in a long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.stats import col

DECODES = ("u32", "i32", "f32", "u16lo", "u16hi", "i16lo", "i16hi", "u8_0", "u8_1", "u8_2", "u8_3")


def byte_length(payload) -> Column:
    return F.octet_length(col(payload)).cast("long")


def hex_number(payload, start: Column, width: int) -> Column:
    return F.conv(F.hex(F.substring(col(payload), start, F.lit(width))), 16, 10).cast("long")


def u8(payload, offset) -> Column:
    return read_uint(payload, offset, 1)


def read_uint(payload, offset, width: int, little: bool = True, stride: int = 1) -> Column:
    """Unsigned integer of ``width`` bytes taken every ``stride`` bytes."""
    payload = col(payload)
    offset = F.lit(offset) if isinstance(offset, int) else offset
    offset = offset.cast("int")
    fits = (offset >= 0) & (offset + (width - 1) * stride + 1 <= F.octet_length(payload))
    if width == 1 or (not little and stride == 1):
        return F.when(fits, hex_number(payload, offset + 1, width))
    parts = [F.hex(F.substring(payload, offset + 1 + i * stride, F.lit(1))) for i in range(width)]
    if little:
        parts = parts[::-1]
    return F.when(fits, F.conv(F.concat(*parts), 16, 10).cast("long"))


def as_signed(value, bits: int) -> Column:
    value = col(value)
    return F.when(value >= (1 << (bits - 1)), value - (1 << bits)).otherwise(value)


def read_int(payload, offset, width: int, little: bool = True, stride: int = 1) -> Column:
    return as_signed(read_uint(payload, offset, width, little, stride), 8 * width)


def float32_from_bits(raw) -> Column:
    """IEEE-754 single from its 32 bits, by arithmetic: no Python worker."""
    raw = col(raw).cast("long")
    sign = F.when(raw >= (1 << 31), -1.0).otherwise(1.0)
    exponent = F.shiftright(raw, 23).bitwiseAND(F.lit(255))
    mantissa = raw.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
    normal = sign * F.pow(F.lit(2.0), (exponent - 127).cast("double")) * (1 + mantissa / float(1 << 23))
    subnormal = sign * F.pow(F.lit(2.0), F.lit(-149.0)) * mantissa
    special = F.when(mantissa == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(exponent == 255, special).when(exponent == 0, subnormal).otherwise(normal)


def lane_decodes(raw) -> Column:
    """The eleven readings of a 32-bit lane, as an array of (decode, decoded)."""
    raw = col(raw).cast("long")
    low, high = raw.bitwiseAND(F.lit(0xFFFF)), F.shiftright(raw, 16)
    values = [raw, as_signed(raw, 32), float32_from_bits(raw), low, high, as_signed(low, 16), as_signed(high, 16)]
    values += [F.shiftright(raw, 8 * i).bitwiseAND(F.lit(255)) for i in range(4)]
    return F.array(
        *[F.struct(F.lit(d).alias("decode"), v.cast("double").alias("decoded")) for d, v in zip(DECODES, values)]
    )


def lane_decodes_sql(raw: str) -> str:
    """SQL lists of the names and values of ``lane_decodes``."""
    low, high, part, power = f"({raw} & 65535)", f"({raw} >> 16)", f"({raw} & 8388607)", f"(({raw} >> 23) & 255)"
    signed = [f"CASE WHEN {x} >= {1 << n - 1} THEN {x} - {1 << n} ELSE {x} END" for x, n in ((raw, 32), (low, 16), (high, 16))]
    size = f"CASE WHEN {power} = 255 THEN 'NaN'::DOUBLE WHEN {power} = 0 THEN {part} * pow(2.0, -149) ELSE (1 + {part} / 8388608.0) * pow(2.0, {power} - 127) END"
    real = f"(CASE WHEN {raw} >= 2147483648 THEN -1 ELSE 1 END) * ({size})"
    values = [raw, signed[0], real, low, high, signed[1], signed[2], *[f"({raw} >> {8 * i}) & 255" for i in range(4)]]
    return ", ".join(["unnest([" + ", ".join(f"'{d}'" for d in DECODES) + "]) AS decode", "unnest([" + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + "]) AS decoded"])


def bit_slice(value, start: int, width: int) -> Column:
    return F.shiftright(col(value).cast("long"), start).bitwiseAND(F.lit((1 << width) - 1))


def payload_bits(payload, start: int, width: int, little: bool = True) -> Column:
    """``width`` bits from bit ``start``: LSB-first little, MSB-first big."""
    first, last = start // 8, (start + width - 1) // 8
    span = last - first + 1
    word = read_uint(payload, first, span, little=little)
    shift = start - 8 * first if little else 8 * span - (start - 8 * first) - width
    return F.shiftright(word, shift).bitwiseAND(F.lit((1 << width) - 1))


def reverse_bits(value, width: int) -> Column:
    value = col(value).cast("long")
    out = F.lit(0).cast("long")
    for i in range(width):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(value, i).bitwiseAND(F.lit(1)), width - 1 - i))
    return out


def parity(value, mask: int) -> Column:
    return F.pmod(F.bit_count(col(value).cast("long").bitwiseAND(F.lit(mask))), F.lit(2)).cast("long")


def bytes_array(payload) -> Column:
    """Payload as an array of 0..255."""
    payload = col(payload)
    size = F.octet_length(payload)
    positions = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: F.conv(F.hex(F.substring(payload, i, F.lit(1))), 16, 10).cast("int"))


def words_array(payload, width: int, stride: int) -> Column:
    """Little-endian words at every ``stride`` bytes as array of (pos, word)."""
    payload = col(payload)
    size = F.octet_length(payload)
    last = size - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts, lambda i: F.struct(i.alias("pos"), read_uint(payload, i, width).alias("word"))
    )


def hamming(a, b) -> Column:
    """Positions that differ between two byte arrays of equal length."""
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)),
        F.lit(0),
        lambda acc, v: acc + v,
    ).cast("long")


def changed_bytes(a, b) -> Column:
    """Differing positions over the common length plus the length difference."""
    a, b = col(a), col(b)
    shared = F.least(F.size(a), F.size(b))
    return hamming(F.slice(a, 1, shared), F.slice(b, 1, shared)) + F.abs(F.size(a) - F.size(b))


def l1_distance(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))),
        F.lit(0).cast("long"),
        lambda acc, v: acc + v,
    )


def change_mask(a, b, lane: int, width: int = 4) -> Column:
    """Bit i set when byte ``lane*width+i`` differs."""
    out = F.lit(0).cast("long")
    for i in range(width):
        x = F.try_element_at(col(a), F.lit(lane * width + i + 1))
        y = F.try_element_at(col(b), F.lit(lane * width + i + 1))
        out = out + F.when(x.eqNullSafe(y), 0).otherwise(1 << i)
    return out


def token_windows(raw) -> Column:
    """Four bytes, two halves and six overlapping 12-bit windows of a 32-bit token."""
    shapes = [(8 * i, 8) for i in range(4)] + [(0, 16), (16, 16)] + [(4 * i, 12) for i in range(6)]
    return F.array(
        *[
            F.struct(
                F.lit(s).cast("long").alias("start"),
                F.lit(b).cast("long").alias("bits"),
                bit_slice(raw, s, b).alias("slice"),
            )
            for s, b in shapes
        ]
    )


def fixed_hex(value, width: int) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(col(value).cast("long"))), width, "0"))


def fingerprint(payload, digits: int = 16) -> Column:
    return F.substring(F.sha2(col(payload), 256), 1, digits)
