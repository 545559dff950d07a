"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import ROW, parallelism
from eventloom.llm.components import connected_components, forest
from eventloom.llm.exact import merge_runs
from eventloom.session import cut_lineage

#: Vectors in a block, and leading dimensions added between two looks at the bound.
BLOCK, STEP = 1024, 8
#: Closer to the threshold than this, a pair is decided on exact sums of products.
DOUBT = 1e-12


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """Second moments of the unit vectors of all rows (vector of ``dim`` numbers)."""
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            unit = units(batch.column(0), dim)
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "line"])

    sums = vectors.select("vector").mapInArrow(run, "i int, line array<double>").groupBy("i").agg(*[F.sum(F.col("line")[j]).alias(f"c{j}") for j in range(dim)])
    out = np.zeros((dim, dim))
    for row in sums.collect():  # one row for each dimension
        out[row[0]] = row[1:]
    return out


def units(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def axes(second: np.ndarray) -> np.ndarray:
    """Principal axes, the most telling first."""
    _, vectors = np.linalg.eigh(second)
    return np.ascontiguousarray(vectors[:, ::-1])


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of two blocks of PCA-ordered unit vectors with cosine >= threshold.

    The first ``STEP`` dimensions are multiplied for the whole tile. Cauchy-Schwarz bounds what the
    rest can add by the product of the suffix norms; pairs that cannot reach the threshold stop there,
    and the others go on, ``STEP`` dimensions at a time.
    """
    dim = a.shape[1]
    slack = threshold - DOUBT - 1e-9

    def rest(x: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (x[:, k:] ** 2).sum(axis=1)))

    k = min(STEP, dim)
    partial = a[:, :k] @ b[:, :k].T
    i, j = np.nonzero(partial + np.outer(rest(a, k), rest(b, k)) >= slack)
    if same:
        ahead = i < j
        i, j = i[ahead], j[ahead]
    so_far = partial[i, j]
    while k < dim and len(i):
        after = min(k + STEP, dim)
        for s in range(0, len(i), 1 << 18):
            part = slice(s, s + (1 << 18))
            so_far[part] += np.einsum("ij,ij->i", a[i[part], k:after], b[j[part], k:after])
        k = after
        keep = so_far + rest(a, k)[i] * rest(b, k)[j] >= slack
        i, j, so_far = i[keep], j[keep], so_far[keep]
    return i, j


def confirmed(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose cosine of the original vectors reaches the threshold in double precision."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 18):
        p, q = i[s:s + (1 << 18)], j[s:s + (1 << 18)]
        out[s:s + (1 << 18)] = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) >= threshold
    doubt = np.abs(np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j]) - threshold) < DOUBT if len(i) < 1 << 18 else np.zeros(len(i), bool)
    for k in np.flatnonzero(doubt):
        x, y = a[i[k]], b[j[k]]
        out[k] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= threshold
    return out


def blocks_of(reps: DataFrame, dim: int, frame: np.ndarray) -> DataFrame:
    """Rows packed, in order of (label, first principal coordinate), into blocks of up to ``BLOCK`` vectors of one label."""
    shared = reps.sparkSession.sparkContext.broadcast(frame)  # dim x dim

    def first(batches):
        for batch in batches:
            lead = units(batch.column("vector"), dim) @ shared.value[:, 0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead, pa.float64())], names=[*batch.schema.names, "lead"])

    fields = [("label", pa.int64()), ("block", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("nodes", pa.binary()), ("counts", pa.binary()), ("data", pa.binary())]

    def block(rows: pa.Table) -> pa.RecordBatch:
        lead, nodes = rows["lead"].to_numpy(), np.asarray(rows["node"], dtype=np.int64)
        data = np.asarray(rows["vector"].combine_chunks().flatten(), dtype=np.float64)
        packed = {"label": rows["label"][0].as_py(), "block": int(nodes[0]), "lo": float(lead.min()), "hi": float(lead.max()),
                  "nodes": nodes.tobytes(), "counts": np.asarray(rows["n"], dtype=np.int64).tobytes(), "data": data.tobytes()}
        return pa.RecordBatch.from_pylist([packed], schema=pa.schema(fields))

    def pack(batches):
        rows = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            rows = more if rows is None else pa.concat_tables([rows, more])
            while rows.num_rows > BLOCK:
                n = one_label(rows)
                yield block(rows.slice(0, n))
                rows = rows.slice(n)
        while rows is not None and rows.num_rows:
            n = one_label(rows)
            yield block(rows.slice(0, n))
            rows = rows.slice(n)

    def one_label(rows: pa.Table) -> int:
        """How many of the first ``BLOCK`` rows, which are in order of labels, have the first label."""
        labels = rows["label"].slice(0, BLOCK).to_numpy()
        return int(np.searchsorted(labels, labels[0], side="right"))

    named = reps.select("node", "label", "n", "vector").mapInArrow(first, "node bigint, label bigint, n bigint, vector array<float>, lead double")
    ordered = named.repartitionByRange(parallelism(reps.sparkSession), "label", "lead", "node").sortWithinPartitions("label", "lead", "node")
    return ordered.mapInArrow(pack, "label bigint, block bigint, lo double, hi double, nodes binary, counts binary, data binary")


def tile_links(blocks: DataFrame, dim: int, frame: np.ndarray, threshold: float) -> DataFrame:
    """Rows of (node, links) and (u, v): link counts of both sides of a tile, and a spanning forest of its links.

    Two blocks are compared when their label is the same and their first coordinates are near enough:
    |x - y|^2 = 2 - 2 cos. The table of tiles holds block numbers and ranges; each block's data goes to
    its tiles by a join, so a large label is many tiles on many machines.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    shared = blocks.sparkSession.sparkContext.broadcast(frame)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                get = lambda name: batch.column(name)[at].as_py()  # noqa: E731, B023
                a, b = (np.frombuffer(get(x)).reshape(-1, dim) for x in ("data_a", "data_b"))
                nodes = [np.frombuffer(get(x), dtype=np.int64) for x in ("nodes_a", "nodes_b")]
                counts = [np.frombuffer(get(x), dtype=np.int64) for x in ("counts_a", "counts_b")]
                same = get("block_a") == get("block_b")
                i, j = close_pairs(*(x / np.linalg.norm(x, axis=1, keepdims=True) @ shared.value for x in (a, b)), threshold, same)
                ok = confirmed(i, j, a, b, threshold)
                i, j = i[ok], j[ok]
                got = [np.bincount(i, weights=counts[1][j], minlength=len(a)).astype(np.int64), np.bincount(j, weights=counts[0][i], minlength=len(b)).astype(np.int64)]
                node = np.concatenate(nodes)
                links = np.concatenate(got)
                some = links > 0
                every = np.concatenate([nodes[0], nodes[1]])
                tree = forest(len(every), zip(i.tolist(), (j + (0 if same else len(a))).tolist()))
                u = every[[x for x, _ in tree]] if tree else np.zeros(0, np.int64)
                v = every[[y for _, y in tree]] if tree else np.zeros(0, np.int64)
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), *[pa.nulls(int(some.sum()), pa.int64())] * 2], names=["node", "links", "u", "v"])
                yield pa.RecordBatch.from_arrays([none, none, pa.array(u), pa.array(v)], names=["node", "links", "u", "v"])

    meta = blocks.select("label", "block", "lo", "hi")
    a, b = (meta.select([F.col(c).alias(f"{c}_{side}") for c in meta.columns]) for side in "ab")
    near = (F.col("label_a") == F.col("label_b")) & (F.col("block_a") <= F.col("block_b")) & (F.col("lo_a") - F.col("hi_b") <= reach) & (F.col("lo_b") - F.col("hi_a") <= reach)
    tiles = a.join(b, near).select("block_a", "block_b")
    for side in "ab":
        tiles = tiles.join(blocks.select(F.col("block").alias(f"block_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("nodes", "counts", "data")]), f"block_{side}")
    return tiles.repartition(2 * parallelism(blocks.sparkSession), "block_a", "block_b").mapInArrow(run, "node bigint, links bigint, u bigint, v bigint")


def embedding_links(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two rows link when their labels are equal and not null and the cosine of their vectors, in double
    precision, is ``threshold`` or more. Vectors of another length, null, zero or with null or
    non-finite components link with nothing, nor do rows without identifier. Equal vectors of a label
    are compared once, by their smallest identifier, and counted. n_links counts the other rows that a
    row links with; component_id is the smallest identifier reachable, the row's own included. Rows
    that share an identifier are one node. An empty table gives no rows.
    """
    own = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<float>").alias("vector"),
        F.monotonically_increasing_id().alias(ROW), F.spark_partition_id().cast("long").alias("run"),
    ).withColumn("good", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    own = cut_lineage(own.withColumn("dim", F.when(F.col("good"), F.size("vector"))))
    alone = own.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    shape = F.concat_ws(",", F.transform("vector", lambda x: F.hex((x + F.lit(0.0)).cast("double").cast("string"))))
    keyed = own.filter("good").select(
        F.struct((-F.col("vec_id")).alias("least"), ROW, F.col("vec_id")).alias("who"), F.unhex(F.sha2(F.concat_ws(":", "label", shape), 256)).alias("digest"),
        F.size("vector").alias("n_bytes"), F.xxhash64("label", "vector").alias("check"), "run",
    )
    members = cut_lineage(merge_runs(cut_lineage(keyed), 64).select(F.col("own.vec_id").alias("vec_id"), F.col(f"own.{ROW}").alias(ROW), F.col("who.vec_id").alias("node"), F.col(f"who.{ROW}").alias("first"), "n"))
    reps = own.filter("good").join(members.filter(F.col(ROW) == F.col("first")).select(ROW, "node", "n"), ROW).select("node", "label", "n", "vector", "dim")
    reps = cut_lineage(reps)
    links = None
    for (dim,) in sorted(tuple(r) for r in reps.select("dim").distinct().collect()):  # lengths of vectors, usually one
        some = reps.filter(F.col("dim") == dim)
        frame = axes(moments(some, dim))
        got = tile_links(cut_lineage(blocks_of(some, dim, frame)), dim, frame, threshold)
        links = got if links is None else links.union(got)
    if links is None:
        return alone.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    links = cut_lineage(links)
    degree = links.filter("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(links.filter("u IS NOT NULL").select("u", "v"))
    linked = (
        members.join(degree, "node", "left").join(parts, "node", "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
