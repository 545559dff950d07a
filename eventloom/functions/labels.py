"""Label, bucket and projection expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.stats import col

# fixed values: spellings of a position and the display order of roles
POSITION_ALIASES = {
    "UTILITY": "UTILITY", "SUPPORT": "UTILITY", "BOTTOM": "BOTTOM", "BOT": "BOTTOM", "ADC": "BOTTOM",
    "MID": "MIDDLE", "MIDDLE": "MIDDLE", "JG": "JUNGLE", "JUNGLE": "JUNGLE", "TOP": "TOP",
}
ROLE_ORDER = ("TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY")


def lookup(values: Mapping, key, default=None) -> Column:
    """Map lookup with a default."""
    table = F.create_map(*[F.lit(v) for kv in values.items() for v in kv])
    found = table[col(key)]
    return found if default is None else F.coalesce(found, col(default) if isinstance(default, Column) else F.lit(default))


def version_group(version) -> Column:
    """First two dotted parts; the whole text when there are fewer; 'unknown' for null."""
    parts = F.split(col(version), "\\.")
    two = (F.size(parts) >= 2) & (F.try_element_at(parts, F.lit(1)) != "") & (F.try_element_at(parts, F.lit(2)) != "")
    return F.when(two, F.concat_ws(".", F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)))).otherwise(
        F.coalesce(col(version), F.lit("unknown"))
    )


def team_position(value) -> Column:
    clean = F.upper(F.trim(F.coalesce(col(value), F.lit(""))))
    return F.coalesce(lookup(POSITION_ALIASES, clean), F.nullif(clean, F.lit("")), F.lit("UNKNOWN"))


def role_rank(position) -> Column:
    at = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), col(position))
    return F.when(at > 0, at - 1).otherwise(len(ROLE_ORDER)).cast("long")


def trailing_id(text) -> Column:
    return F.expr(f"try_cast(regexp_extract({text}, '([0-9]+)$', 1) AS bigint)") if isinstance(text, str) else F.regexp_extract(text, "([0-9]+)$", 1).try_cast("long")


def clock(ms) -> Column:
    """m:ss of a millisecond time."""
    sec = F.floor(col(ms) / 1000).cast("long")
    return F.concat(F.floor(sec / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(sec, F.lit(60)).cast("string"), 2, "0"))


def level_from_thresholds(xp, thresholds: Sequence[int], cap) -> Column:
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: col(xp) >= t))
    return F.least(reached.cast("long"), col(cap) if isinstance(cap, (str, Column)) else F.lit(cap))


def projected(value, epsilon: float, integer_only: Column | None = None) -> Column:
    """floor(v+ε); an integer-only field passes integers and nulls the rest."""
    v = col(value)
    out = F.floor(v + F.lit(epsilon)).cast("long")
    if integer_only is None:
        return out
    return F.when(integer_only, F.when(v == F.floor(v), v.cast("long"))).otherwise(out)


def item_class(known, on_map, purchasable, cost) -> Column:
    """catalog-missing, map-invalid, non-purchasable, system or real."""
    return (
        F.when(~col(known), "catalog-missing").when(~col(on_map), "map-invalid").when(~col(purchasable), "non-purchasable")
        .when(col(cost) <= 0, "system").otherwise("real")
    )


def steps(value, edges: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first edge the value does not exceed."""
    out = None
    for limit, name in edges:
        cond = col(value) <= limit
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(otherwise)


def slot_band(slot) -> Column:
    low = (F.floor(col(slot) / 5) * 5).cast("long")
    return F.when(col(slot).isNull(), "unknown").otherwise(F.concat_ws("-", low.cast("string"), (low + 4).cast("string")))


def family_key(length, first_byte) -> Column:
    return F.concat(col(length).cast("string"), F.lit("-0x"), F.lpad(F.hex(col(first_byte)), 2, "0"))


def parse_family_key(key) -> Column:
    k = col(key)
    return F.struct(
        F.regexp_extract(k, "^([0-9]+)-0x", 1).cast("long").alias("length"),
        F.conv(F.regexp_extract(k, "-0x([0-9A-Fa-f]{2})", 1), 16, 10).cast("long").alias("first_byte"),
    )


def entity_key_parts(key) -> Column:
    """family|slot|x|y|mapping → named parts."""
    p = F.split(col(key), "\\|")
    names = ("family_key", "slot_index", "x_offset", "y_offset", "mapping")
    cells = [F.try_element_at(p, F.lit(i + 1)) for i in range(5)]
    typed = [c.cast("long") if n in ("slot_index", "x_offset", "y_offset") else c for n, c in zip(names, cells)]
    return F.struct(*[c.alias(n) for n, c in zip(names, typed)])


# fixed values: per metric the relative slack and the floor of the fit score
FIT_LIMITS = {
    "level": (0.0, 2), "totalGold": (0.35, 900), "xp": (0.35, 800), "minionsKilled": (0.3, 25), "jungleMinionsKilled": (0.4, 12),
    "healthMax": (0.3, 120), "powerMax": (0.3, 120), "health": (0.5, 150), "power": (0.5, 150), "currentGold": (0.5, 150),
}


def metric_fit(metric, expected, actual) -> Column:
    """max(0, 1 - |diff| / max(slack*expected, floor)); 0 when a side is missing."""
    rel = lookup({k: v[0] for k, v in FIT_LIMITS.items()}, metric, 0.35)
    low = lookup({k: float(v[1]) for k, v in FIT_LIMITS.items()}, metric, 100.0)
    e, a = col(expected), col(actual)
    fit = F.greatest(F.lit(0.0), 1 - F.abs(a - e) / F.greatest(rel * e, low))
    return F.coalesce(fit, F.lit(0.0))


def fnv1a64(text) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hex digits.

    The 64-bit state is two 32-bit halves in longs; the prime is 2^40 + 0x1b3, so the product
    is a small multiplication plus a shift and never overflows.
    """
    from eventloom.functions.binary import bytes_array

    low_mask = F.lit(0xFFFFFFFF)
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(acc, byte):
        lo = acc["lo"].bitwiseXOR(byte.cast("long"))
        small = lo * 0x1B3
        hi = acc["hi"] * 0x1B3 + F.shiftright(small, 32) + F.shiftleft(lo, 8)
        return F.struct(hi.bitwiseAND(low_mask).alias("hi"), small.bitwiseAND(low_mask).alias("lo"))

    out = F.aggregate(bytes_array(F.encode(col(text), "UTF-8")), start, step)
    return F.lower(F.concat(F.lpad(F.hex(out["hi"]), 8, "0"), F.lpad(F.hex(out["lo"]), 8, "0")))
