"""Search of whole payloads for needles of any width, numbers and text alike."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Widths of a number token in bytes, and needles that a task searches for at once.
WIDTHS, BLOCK = (1, 2, 4, 8), 4096


def swapped(digits: Column) -> Column:
    """Hex digits with the order of their bytes turned round."""
    return F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit(".."), F.lit(0))), "")


def little_endian(value: Column) -> Column:
    """The 16 hex digits of an unsigned number below 2^64, lowest byte first; null for other values."""
    whole = value.cast("decimal(20,0)")
    digits = F.lpad(F.conv(whole.cast("string"), 10, 16), 16, "0")
    return F.when((whole >= 0) & (whole < F.lit("18446744073709551616").cast("decimal(20,0)")), swapped(digits))


def number_needles(value: Column, widths: Sequence[int] = WIDTHS) -> Column:
    """Array of (width, needle): the number in every width that holds it, lowest byte first."""
    digits = little_endian(value)
    made = [F.when(F.substring(digits, 2 * w + 1, 16) == "0" * (16 - 2 * w), F.struct(F.lit(f"u{8 * w}").alias("width"), F.unhex(F.substring(digits, 1, 2 * w)).alias("needle"))) for w in widths]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def text_needles(value: Column, least: int = 3) -> Column:
    """Array of (width, needle): the UTF-8 bytes of a text of at least ``least`` characters."""
    made = F.array(F.struct(F.lit("ascii").alias("width"), F.encode(value, "UTF-8").alias("needle")))
    return F.when(F.char_length(value) >= least, made).otherwise(F.slice(made, 1, 0))


class Matcher:
    """Finds all places of a set of needles in a payload, overlapping ones too.

    Windows of up to eight bytes are compared as integers. A longer needle is met by its first eight bytes,
    then by the rest.
    """

    def __init__(self, needles: list[bytes]):
        self.needles = sorted({n for n in needles if n})
        by_width: dict[int, dict[int, list[int]]] = {}
        for k, needle in enumerate(self.needles):
            by_width.setdefault(min(8, len(needle)), {}).setdefault(int.from_bytes(needle[:8], "little"), []).append(k)
        self.heads = {w: (np.array(sorted(heads), np.uint64), heads) for w, heads in sorted(by_width.items())}

    def find(self, payload: bytes) -> tuple[list[int], list[int]]:
        """Numbers of needles and their offsets."""
        data = np.frombuffer(payload, np.uint8).astype(np.uint64)
        found, offsets, window, width = [], [], data, 1
        for w, (sorted_heads, heads) in self.heads.items():
            if len(data) < w:
                break
            while width < w:
                window = window[:-1] | (data[width:] << np.uint64(8 * width))
                width += 1
            at = np.minimum(np.searchsorted(sorted_heads, window), len(sorted_heads) - 1)
            for offset in np.flatnonzero(sorted_heads[at] == window).tolist():
                for k in heads[int(window[offset])]:
                    needle = self.needles[k]
                    if len(needle) <= 8 or payload.startswith(needle, offset):
                        found.append(k)
                        offsets.append(offset)
        return found, offsets


def find_needles(payloads: DataFrame, needles: DataFrame, keys: Sequence[str], payload: str = "payload", block: int = BLOCK) -> DataFrame:
    """Every place of every needle in the payloads of its key.

    ``payloads`` has the keys, the payload and other columns; ``needles`` has the keys, ``needle`` (bytes)
    and label columns, and a needle applies to the payloads of its own key only (no keys: to all). Gives the
    columns of both with ``offset`` in place of the payload; a repeated needle row gives repeated hits. Null
    payloads, null and empty needles and null keys match nothing.

    A payload travels whole, once for each block of ``block`` needles of its key, so the bytes are never
    turned into rows; only hits are.
    """
    keys = list(keys)
    labels = [c for c in needles.columns if c not in (*keys, "needle")]
    kept = [c for c in payloads.columns if c != payload]
    usable = needles.filter(F.octet_length("needle") > 0)
    distinct = usable.select(*keys, "needle").distinct()
    sizes = distinct.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    parted = (distinct.join(sizes, keys) if keys else distinct.crossJoin(F.broadcast(sizes))).withColumn("_block", F.pmod(F.xxhash64("needle"), "_blocks"))  # one-row side without keys
    sets = parted.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list("needle")).alias("_needles"))
    rows = payloads.select(*kept, F.col(payload).alias("_payload")).filter(F.octet_length("_payload") > 0)
    # without keys every payload meets every block, which is the search itself
    asked = rows.join(sets, keys) if keys else rows.crossJoin(sets)
    fields = [f for f in asked.schema.fields if f.name not in ("_payload", "_needles", "_block")]
    names = [f.name for f in fields]

    def run(batches):
        matchers: dict[tuple, Matcher] = {}
        for batch in batches:
            spots = list(zip(*[batch.column(k).to_pylist() for k in keys], batch.column("_block").to_pylist()))
            row, needle, offset = [], [], []
            for r, spot in enumerate(spots):
                if spot not in matchers:
                    if len(matchers) >= 8:
                        matchers.clear()
                    matchers[spot] = Matcher(batch.column("_needles")[r].as_py())
                matcher = matchers[spot]
                found, offsets = matcher.find(batch.column("_payload")[r].as_py())
                row += [r] * len(found)
                needle += [matcher.needles[k] for k in found]
                offset += offsets
            own = batch.select(names).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(needle, pa.binary()), pa.array(offset, pa.int64())], names=[*names, "needle", "offset"])

    schema = T.StructType([*fields, T.StructField("needle", T.BinaryType()), T.StructField("offset", T.LongType())])
    hits = asked.select(*names, "_payload", "_needles", "_block").mapInArrow(run, schema)
    return hits.join(usable, [*keys, "needle"]).select(*names, *labels, "needle", "offset")
