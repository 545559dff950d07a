"""Order-keeping one-to-one matching by a dynamic program that is cut into time slices.

The program runs over both streams in time order. Its state at a moment is the number of rows of one stream that
are still open: the last ``s`` decoded rows (s > 0), the last ``-s`` oracle rows (s < 0), or none. Rows further back
than the tolerance are never open, so a slice of time sees only the rows inside it and the tolerance before it.

What a slice does to the states is a table (state before, state after, value). Tables of neighbouring slices are
composed pair by pair, as joins, until one table is left for a component; on the way back every slice gets
the states it starts and ends with, and all slices are then solved side by side. A value is (matches, total
difference, largest difference): most matches first, then the least total, then the smallest largest one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import cut_lineage

NEVER = np.int64(1 << 62)


class Slice:
    """The dynamic program over one slice: ``before`` holds the rows of the tolerance before it, ``rows`` its own (side, t)."""

    def __init__(self, before: list[tuple[int, int]], rows: list[tuple[int, int]], tolerance: int, end: int):
        self.tolerance, self.rows, self.end = tolerance, rows, end
        self.times = [[t for side, t in before if side == k] for k in (0, 1)]
        self.start = [len(x) for x in self.times]
        every = [np.array(x + [t for side, t in rows if side == k], np.int64) for k, x in enumerate(self.times)]
        self.every = every
        # most rows of a stream that are open at once
        self.most = [int((np.arange(1, len(x) + 1) - np.searchsorted(x, x - tolerance)).max(initial=0)) for x in every]
        self.zero, self.size = self.most[1], self.most[0] + self.most[1] + 1
        # values are packed: (difference - matches * prize) * base + largest difference
        self.base = tolerance + 1
        self.prize = tolerance * (len(rows) + 1) + 1
        if self.prize * (len(rows) + 1) * self.base >= NEVER // 2:
            raise ValueError("a slice is too dense for its tolerance; take shorter slices")

    def open_at_start(self) -> range:
        return range(-self.start[1], self.start[0] + 1)

    def closed(self, v: np.ndarray, seen: list[int], t: int | None) -> np.ndarray:
        """Any open rows may be given up, the oldest first; rows out of the tolerance of ``t`` must be."""
        z = self.zero
        v[:, z:] = np.minimum.accumulate(v[:, z:][:, ::-1], axis=1)[:, ::-1]
        v[:, :z + 1] = np.minimum.accumulate(v[:, :z + 1], axis=1)
        v[:, z:z + 1] = v.min(axis=1, keepdims=True)
        if t is not None:
            alive = [seen[k] - int(np.searchsorted(self.every[k][:seen[k]], t - self.tolerance)) for k in (0, 1)]
            v[:, z + alive[0] + 1:] = NEVER
            v[:, :max(0, z - alive[1])] = NEVER
        return v

    def matched(self, v: np.ndarray, delta: np.ndarray) -> np.ndarray:
        worst = v % self.base
        out = v - worst + (delta - self.prize) * self.base + np.maximum(worst, delta)
        return np.where((v >= NEVER) | (delta > self.tolerance), NEVER, out)

    def step(self, v: np.ndarray, seen: list[int], side: int, t: int) -> np.ndarray:
        """Values after a row of ``side``, before giving up open rows."""
        z = self.zero
        out = np.full_like(v, NEVER)
        if side == 0:
            out[:, z + 1:] = v[:, z:-1]
            out[:, :z] = v[:, :z]
            n = min(z, seen[1])
            if n:  # state -k meets the k-th last oracle row
                delta = np.abs(t - self.every[1][seen[1] - n:seen[1]])
                out[:, z - n + 1:z + 1] = np.minimum(out[:, z - n + 1:z + 1], self.matched(v[:, z - n:z], delta))
        else:
            out[:, :z] = v[:, 1:z + 1]
            out[:, z + 1:] = v[:, z + 1:]
            n = min(self.most[0], seen[0])
            if n:
                delta = np.abs(t - self.every[0][seen[0] - n:seen[0]])[::-1]
                out[:, z:z + n] = np.minimum(out[:, z:z + n], self.matched(v[:, z + 1:z + n + 1], delta))
        return out

    def begin(self, states: Sequence[int]) -> np.ndarray:
        v = np.full((len(states), self.size), NEVER)
        v[np.arange(len(states)), self.zero + np.asarray(states)] = 0
        return self.closed(v, list(self.start), None)

    def table(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(state before, state after, matches, total, largest) of every way through the slice."""
        states = list(self.open_at_start())
        v, seen = self.begin(states), list(self.start)
        for side, t in self.rows:
            v = self.step(v, seen, side, t)
            seen[side] += 1
            v = self.closed(v, seen, t)
        v = self.closed(v, seen, self.end)
        for i, k in zip(*np.nonzero(v < NEVER)):
            yield states[i], int(k) - self.zero, *self.value(int(v[i, k]))

    def value(self, packed: int) -> tuple[int, int, int]:
        cost, worst = divmod(packed, self.base)
        matches = -(cost // self.prize)
        return matches, cost + matches * self.prize, worst

    def pairs(self, first: int, last: int) -> list[tuple[int, int]]:
        """Matches between states ``first`` and ``last``, as places in the decoded and in the oracle rows, those before the slice counted first."""
        v, seen, trail = self.begin([first]), list(self.start), []
        for side, t in self.rows:
            after = self.step(v, seen, side, t)
            trail.append((v, after, tuple(seen)))
            seen[side] += 1
            v = self.closed(after.copy(), seen, t)
        out, z, s = [], self.zero, self.zero + last
        goal = v[0, s]
        for (before, after, seen), (side, t) in zip(reversed(trail), reversed(self.rows)):
            if after[0, s] != goal:
                # rows were given up: go back to the nearest state of the same stream with this value
                same = np.flatnonzero(after[0] == goal)
                same = same[same >= s] if s > z else same[same <= s] if s < z else same
                s = int(same[np.argmin(np.abs(same - z))])
            prior = s - 1 if side == 0 else s + 1
            if (s - z) * (prior - s) < 0:
                s = prior  # the row stayed open
            elif s == z or before[0, s] != goal:
                s = prior  # the row met the oldest open row of the other stream
                early = seen[1 - side] - abs(s - z)
                out.append((seen[0], early) if side == 0 else (early, seen[1]))
                goal = before[0, s]
        return out


def _starts(rows: pa.Table, group: list[str]) -> np.ndarray:
    """Whether a row begins another group than the row before it; the first one does. Nulls are equal, NaNs too."""
    out = np.ones(rows.num_rows, bool)
    out[1:] = False
    for name in group:
        cells = rows.column(name).combine_chunks()
        if pa.types.is_nested(cells.type):
            values = cells.to_pylist()
            out[1:] |= np.fromiter((a != b for a, b in zip(values, values[1:])), bool, len(out) - 1)
            continue
        gone = cells.is_null().to_numpy(False)
        other = pc.fill_null(pc.not_equal(cells[1:], cells[:-1]), False).to_numpy(False)
        if pa.types.is_floating(cells.type):
            nan = pc.fill_null(pc.is_nan(cells), False).to_numpy(False)
            other &= ~(nan[1:] & nan[:-1])
        out[1:] |= other | (gone[1:] != gone[:-1])
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the bounds of the groups; the last group waits for the next batch."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        if held:
            begins = _starts(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), rows]), group)[1:]
        else:
            begins = _starts(rows, group)
            begins[0] = False
        cuts = np.flatnonzero(begins)
        if len(cuts):
            before = sum(t.num_rows for t in held)
            yield pa.concat_tables([*held, rows.slice(0, cuts[-1])]), np.concatenate([[0], before + cuts])
            held, rows = [], rows.slice(cuts[-1])
        held.append(rows)
    if held:
        yield pa.concat_tables(held), np.array([0, sum(t.num_rows for t in held)])


def _plain(rows: pa.Table, cuts: np.ndarray, keys: list[str], names: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The answers of groups without a choice, whole columns at a time, and which groups are left to the program.

    A component inside one slice has no choice if one stream has no row in it, or if each has one: neighbours of
    a component are within the tolerance.
    """
    side = rows.column("side").to_numpy()
    sizes, n_oracle = np.diff(cuts), np.add.reduceat(side, cuts[:-1])
    apart = rows.column("first").combine_chunks().is_null().to_numpy(False)[cuts[:-1]]
    lone, pair = apart & ((n_oracle == 0) | (n_oracle == sizes)), apart & (sizes == 2) & (n_oracle == 1)
    singles, twos = np.flatnonzero(np.repeat(lone, sizes)), cuts[:-1][pair]
    decoded = np.concatenate([singles, twos + (side[twos] != 0)])
    oracle = np.concatenate([singles, twos + (side[twos] == 0)])
    empty = np.zeros(len(decoded), bool)
    empty[:len(singles)] = side[singles] != 0
    at = [pa.array(decoded, mask=empty), pa.array(oracle, mask=np.where(np.arange(len(empty)) < len(singles), ~empty, False))]
    columns = [*[rows.column(k).take(pa.array(decoded)) for k in keys], *[rows.column(c).take(at[k]) for c in ("id", "t") for k in (0, 1)]]
    return pa.table(columns, names=names), ~(lone | pair)


def _streamed(rows: DataFrame, group: list[str], schema: str, columns: dict[str, str], solve, plain=None) -> DataFrame:
    """Run ``solve(head, rows)`` for every group of sorted rows (own, side, t, id, first, last) inside the tasks.

    ``columns`` names the output columns and, for each, the input column that has its type. ``plain`` answers
    simple groups of a table at once.
    """
    placed = rows.repartition(*group).sortWithinPartitions(*group, "t", "side", "id")
    cells = [*group, "own", "side", "t", "id", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole_groups(batches, group):
            left = np.ones(len(cuts) - 1, bool)
            if plain:
                done, left = plain(table, cuts)
                yield from done.combine_chunks().to_batches()
            out: list[tuple] = []
            for a, b in zip(cuts[:-1][left], cuts[1:][left]):
                held = list(zip(*[table.column(c).slice(a, b - a).to_pylist() for c in cells]))
                out.extend(solve(held[0][:len(group)], [row[len(group):] for row in held]))
            if out:
                kinds = [table.schema.field(c).type for c in columns.values()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=list(columns))

    return placed.mapInArrow(run, schema)


def _chosen(tables: DataFrame, component: list[str]) -> DataFrame:
    """(component, slice, first, last): the states every slice of a component starts and ends with.

    ``tables`` has node (the slice counted from the first of its component), last_node, before, after and the value
    as (less, cost, worst) with less = -matches. Level by level, an even node and the next one become one.
    """
    levels = [cut_lineage(tables)]
    while levels[-1].filter("last_node > 0").limit(1).count():
        now = levels[-1]
        left = now.filter("node % 2 = 0").alias("l")
        right = now.filter("node % 2 = 1").select(*component, (F.col("node") - 1).alias("node"), F.col("before").alias("after"), F.col("after").alias("end"), F.col("less").alias("r_less"), F.col("cost").alias("r_cost"), F.col("worst").alias("r_worst"))
        both = left.join(right, [*component, "node", "after"]).select(
            *component, "node", "last_node", "before", F.col("end").alias("after"), (F.col("less") + F.col("r_less")).alias("less"), (F.col("cost") + F.col("r_cost")).alias("cost"), F.greatest("worst", "r_worst").alias("worst")
        )
        alone = now.filter("node % 2 = 0 AND node = last_node").select(*both.columns)
        best = both.unionByName(alone).groupBy(*component, (F.col("node") / 2).cast("long").alias("node"), (F.col("last_node") / 2).cast("long").alias("last_node"), "before", "after")
        levels.append(cut_lineage(best.agg(F.min(F.struct("less", "cost", "worst")).alias("v")).select(*component, "node", "last_node", "before", "after", "v.less", "v.cost", "v.worst")))
    chosen = levels[-1].filter("before = 0 AND after = 0").select(*component, "node", F.lit(0).alias("first"), F.lit(0).alias("last"))
    for now in reversed(levels[:-1]):
        own = [*component, "node", "last_node", "before", "after", "less", "cost", "worst"]
        up = chosen.select(*component, (2 * F.col("node")).alias("node"), "first", "last")
        left = now.select(*own).join(up, [*component, "node"]).filter("before = first")
        right = now.select(*component, (F.col("node") - 1).alias("node"), F.col("before").alias("after"), F.col("after").alias("end"), F.col("less").alias("r_less"), F.col("cost").alias("r_cost"), F.col("worst").alias("r_worst"))
        value = F.struct((F.col("less") + F.col("r_less")).alias("a"), (F.col("cost") + F.col("r_cost")).alias("b"), F.greatest("worst", "r_worst").alias("c"), F.abs("after").alias("d"), F.col("after").alias("mid"))
        split = left.filter("node < last_node").join(right, [*component, "node", "after"]).filter("end = last").groupBy(*component, "node", "first", "last").agg(F.min(value)["mid"].alias("mid"))
        alone = left.filter("node = last_node AND after = last").select(*component, "node", "first", "last")
        halves = F.explode(F.array(
            F.struct(F.col("node").alias("node"), F.col("first").alias("first"), F.col("mid").alias("last")), F.struct((F.col("node") + 1).alias("node"), F.col("mid").alias("first"), F.col("last").alias("last"))
        )).alias("h")
        chosen = cut_lineage(split.select(*component, halves).select(*component, "h.*").unionByName(alone))
    return chosen


def optimal_pairs(parts: DataFrame, keys: Sequence[str], tolerance: int, slices: int = 64) -> DataFrame:
    """Matches of the components in ``parts`` (keys, component, side, id, t): keys, decoded_id, oracle_id, decoded_t, oracle_t.

    Side 0 is decoded. A row without a partner has nulls on the other side. A slice spans ``slices`` times
    the tolerance; a component inside one slice is solved at once, a longer one slice by slice. Of equally
    good matchings one is taken by a fixed rule. Times must not be null.
    """
    keys = list(keys)
    component = [*keys, "component"]
    width = max(1, tolerance) * slices
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    names = [*keys, "decoded_id", "oracle_id", "decoded_t", "oracle_t"]
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"decoded_id {kinds['id']}", f"oracle_id {kinds['id']}", "decoded_t long", "oracle_t long"])
    timed = parts.withColumn("slice", F.floor(F.col("t") / width).cast("long"))
    # components of several slices; their number ``cid`` makes joins safe for null keys. Two rows leave no choice, wherever they lie
    spans = cut_lineage(
        timed.groupBy(*component).agg(F.min("slice").alias("low"), F.max("slice").alias("high"), F.count("*").alias("n")).filter("high > low AND n > 2").drop("n")
        .withColumn("cid", F.monotonically_increasing_id())
    )
    many = spans.limit(1).count() > 0
    if many:
        other = spans.select(*[F.col(c).alias(f"_{c}") for c in component], "low", "high", "cid")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in component]
        placed = timed.join(other, same, "left").drop(*[f"_{c}" for c in component])
    else:
        placed = timed.withColumns({c: F.lit(None).cast("long") for c in ("low", "high", "cid")})
    placed = placed.withColumn("slice", F.when(F.col("cid").isNull(), F.lit(0).cast("long")).otherwise(F.col("slice")))
    late = (F.col("slice") < F.col("high")) & (F.col("t") >= (F.col("slice") + 1) * width - tolerance)
    copies = F.explode(F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    rows = placed.select(*component, "side", "id", "t", "slice", "cid", copies).withColumns({"slice": F.col("slice") + F.col("copy"), "own": F.col("copy") == 0})
    group = [*component, "slice"]

    def program(head, held) -> Slice:
        sides = [[(r[1], r[2]) for r in held if r[0] == own] for own in (False, True)]
        return Slice(*sides, tolerance, (head[-1] + 1) * width)

    def tables(head, held):
        for first, last, matches, cost, worst in program(head, held).table():
            yield (*head, first, last, -matches, cost, worst)

    def pairs(head, held):
        first, last = (v or 0 for v in held[0][4:6])
        streams = [[r for own in (False, True) for r in held if r[0] == own and r[1] == k] for k in (0, 1)]
        used: list[set] = [set(), set()]
        if streams[0] and streams[1]:
            for d, o in program(head, held).pairs(first, last):
                used[0].add(d)
                used[1].add(o)
                a, b = streams[0][d], streams[1][o]
                yield (*head[:-2], a[3], b[3], a[2], b[2])
        for k, stream in enumerate(streams):
            # rows open at the end are the next slice's, rows before the slice are its own if they were open
            at_start, at_end = max(0, first if k == 0 else -first), max(0, last if k == 0 else -last)
            n_before = sum(not r[0] for r in stream)
            for at, r in enumerate(stream):
                if at not in used[k] and at >= n_before - at_start and at < len(stream) - at_end:
                    yield (*head[:-2], *((r[3], None, r[2], None) if k == 0 else (None, r[3], None, r[2])))

    if many:
        columns = ["cid", "slice", "before", "after", "less", "cost", "worst"]
        long_rows = rows.filter("cid IS NOT NULL").withColumns({"first": F.lit(0), "last": F.lit(0)})
        found = _streamed(long_rows, ["cid", "slice"], ", ".join(f"{c} long" for c in columns), {c: "slice" for c in columns}, tables)
        spot = spans.select("cid", "low", "high")
        found = found.join(spot, "cid").withColumns({"node": F.col("slice") - F.col("low"), "last_node": F.col("high") - F.col("low")})
        chosen = _chosen(found.select("cid", "node", "last_node", *columns[2:]), ["cid"])
        states = chosen.join(spot, "cid").select("cid", (F.col("node") + F.col("low")).alias("slice"), "first", "last")
        rows = rows.join(states, ["cid", "slice"], "left")
    else:
        rows = rows.withColumns({"first": F.lit(None).cast("long"), "last": F.lit(None).cast("long")})
    columns = {**{k: k for k in keys}, **dict(zip(names[len(keys):], ("id", "id", "t", "t")))}
    return _streamed(rows, group, schema, columns, pairs, lambda table, cuts: _plain(table, cuts, keys, names))
