"""MinHash near-duplicates: universal hash minima, banding, signature check, full check, components."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import ROW, kept, squeezed, texts
from eventloom.llm.components import connected_components
from eventloom.llm.exact import merge_runs
from eventloom.session import cut_lineage, free_shuffles

#: Words in a shingle; minima in a band and bands. At similarity 0.75 a pair shares no band with
#: probability (1 - 0.75^5)^36 = 6e-5, at 0.8 with 6e-7.
WORDS, ROWS, BANDS = 5, 5, 36
#: A signature estimate this far below the threshold rules a pair out: over four standard deviations.
MARGIN = 0.15
#: Rounds with a drawn member before all pairs are compared, and members in a block of a bucket.
DRAWS, BLOCK = 1, 1024
WIDTH = 6  # bytes of a shingle hash that the full check compares


class WordHash(dict):
    """64-bit hashes of words; forgets them when it holds ``keep``."""

    def __init__(self, keep: int = 500_000):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of the whole word sequence when it is shorter."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(kept("word hashes", WordHash).__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), np.uint64)
    for k in range(min(len(h), WORDS)):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(out)


def hash_family(seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) for _ in range(2))
    return a * np.uint64(2) + np.uint64(1), b


A, B = hash_family()


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minimum of every hash function a * x + b mod 2^64 over the set."""
    low = np.full(len(A), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(hashes), 2048):
        np.minimum(low, (np.multiply.outer(A, hashes[s:s + 2048]) + B[:, None]).min(axis=1), out=low)
    return low


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, row__, run, n_shingles, digest, sig) of every whole text; sig has 16 bits of every minimum."""
    names = ["doc_id", ROW, "run", "n_shingles", "digest", "sig"]

    def run(batches):
        for batch in batches:
            n, digest, sig = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py())
                n.append(len(s))
                digest.append(hashlib.sha256(s.tobytes()).digest()[:16])
                sig.append(((minima(s) >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() if len(s) else None)
            columns = [batch.column("doc_id"), batch.column(ROW), batch.column("run"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    numbered = docs.withColumn(ROW, F.monotonically_increasing_id()).withColumn("run", F.spark_partition_id().cast("long"))
    return numbered.mapInArrow(run, f"doc_id bigint, {ROW} bigint, run bigint, n_shingles bigint, digest binary, sig binary")


def band_keys(sig: str) -> Column:
    """One key for every band of a signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col(sig), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes): the shingle sets of some documents, ``WIDTH`` bytes a shingle."""
    def run(batches):
        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            packed = []
            for text in batch.column("packed"):
                s = shingles(grow.decompress(text.as_py()).decode()).view(np.uint8).reshape(-1, 8)
                packed.append(s[:, :WIDTH].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "hashes"])

    wanted = squeezed(docs.select(F.col("doc_id").alias("node"), "text")).join(nodes, "node", "left_semi")
    return wanted.select("node", "packed").mapInArrow(run, "node bigint, hashes binary").dropDuplicates(["node"])


def both_sides(pairs: DataFrame, by_node: DataFrame, column: str) -> DataFrame:
    """Pairs (u, v, ...) with ``column`` of either node as a and b."""
    own = pairs.columns
    for side, name in (("u", "a"), ("v", "b")):
        pairs = pairs.join(by_node.select(F.col("node").alias(side), F.col(column).alias(name)), side)
    return pairs.select(*own, "a", "b")


def unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return wide.view(np.uint64).ravel()


def linked(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs (u, v, must): 100 * intersection >= percent * union, first by signatures, then on full sets.

    Of the other pairs only the likeliest one of each v is looked at; what is left out meets in ``across``.
    """
    least = percent / 100 - MARGIN

    def likely(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, len(A)) for c in "ab")
            same = (a == b).sum(axis=1).astype(np.int32)
            near = pa.array(same >= least * len(A))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("u", "v", "must")], pa.array(same)], names=["u", "v", "must", "same"]).filter(near)

    def sure(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a"), batch.column("b")):
                a, b = unpack(x.as_py()), unpack(y.as_py())
                both = len(np.intersect1d(a, b))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    maybe = cut_lineage(both_sides(pairs, sigs, "sig").mapInArrow(likely, "u bigint, v bigint, must boolean, same int"))
    best = maybe.filter("NOT must").groupBy("v").agg(F.max_by("u", F.struct("same", "u")).alias("u")).select("u", "v")
    chosen = maybe.filter("must").select("u", "v").union(best)
    return both_sides(chosen, sets, "hashes").mapInArrow(sure, "u bigint, v bigint")


def nearby(links: DataFrame) -> DataFrame:
    """(node, part): a cheap label; nodes of one part are connected, but a component may have several.

    Every node takes its smallest neighbour, and then what that one took. This is enough to pass over
    most pairs that need no check; the full components come once, at the end.
    """
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    took = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    return took.join(took.select(F.col("node").alias("label"), F.col("label").alias("part")), "label").select("node", "part")


def families(open_: DataFrame) -> DataFrame:
    """(key, node, part) with the buckets of one family of near copies merged, where that takes less.

    The members of a large family share most of their buckets, 36 of which would each send all sets along. A
    bucket takes the smallest label of its members and they that of their buckets, twice; buckets of the same
    label are compared as one if that sends no more rows and makes at most a few times the comparisons.
    All pairs of every bucket still meet.
    """
    label = open_.select("key", "node", F.min("node").over(Window.partitionBy("key")).alias("label"))
    for by in ("node", "key") * 2:
        least = label.groupBy(by).agg(F.min("label").alias("least"))
        label = cut_lineage(label.join(least, by).select("key", "node", F.col("least").alias("label")))
    n, blocks = F.count(F.lit(1)), F.ceil(F.count(F.lit(1)) / BLOCK)
    alone = label.groupBy("key", "label").agg((n * blocks).alias("sent"), (n * n).alias("met")).groupBy("label").agg(F.sum("sent").alias("sent"), F.sum("met").alias("met"))
    whole = label.select("label", "node").distinct().groupBy("label").agg((n * blocks).alias("sent_whole"), (n * n).alias("met_whole"))
    merged = alone.join(whole, "label").filter("sent_whole <= sent AND met_whole <= 4 * met").select("label", F.lit(True).alias("merge"))
    family = label.join(merged, "label", "left").select("key", "node", F.when(F.col("merge"), F.struct(F.lit(1).alias("kind"), F.col("label").alias("of"))).otherwise(F.struct(F.lit(0).alias("kind"), F.col("key").alias("of"))).alias("family"))
    return open_.join(family, ["key", "node"]).select(F.col("family").alias("key"), "node", "part").distinct()


def across(open_: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between different components of a bucket, enough of them to join these components.

    Buckets, or families of them, are cut into blocks of about ``BLOCK`` members, and two blocks meet in one task, where pairs
    are compared by signature and then on full sets, as arrays. Components that a found link has joined
    are not compared again, so a task emits fewer links than it has members.
    """
    least = percent / 100 - MARGIN
    merged = cut_lineage(families(open_))
    sizes = merged.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    own = merged.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tiles = own.join(sigs, "node").join(sets, "node").select("key", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), "b", "node", "part", "sig", "hashes")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), -1)
        node, block = rows["node"].to_numpy(), rows["b"].to_numpy()
        part = np.unique(rows["part"].to_numpy(), return_inverse=True)[1]
        split = rows["i"].iloc[0] != rows["j"].iloc[0]
        held = [unpack(h) for h in rows["hashes"]]
        size = np.array([len(h) for h in held])
        start = np.cumsum(size) - size
        ids = np.unique(np.concatenate(held), return_inverse=True)[1]
        here = np.zeros(len(ids) + 1, bool)
        found = []
        for k in range(len(rows)):
            near = np.flatnonzero((part != part[k]) & ((block != block[k]) if split else (np.arange(len(rows)) > k)))
            near = near[(sig[near] == sig[k]).mean(axis=1) >= least]
            if not len(near):
                continue
            own_ids = ids[start[k]:start[k] + size[k]]
            here[own_ids] = True
            both = np.add.reduceat(here[ids], start, dtype=np.int64)[near]
            here[own_ids] = False
            for j in near[100 * both >= percent * (size[k] + size[near] - both)]:
                if part[j] != part[k]:
                    found.append((min(node[k], node[j]), max(node[k], node[j])))
                    part[part == part[j]] = part[k]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return tiles.groupBy("key", "i", "j").applyInPandas(compare, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut at white space; the set of a document is its distinct shingles
    of five words, or its whole word sequence when it has fewer. Documents without words, and rows
    without identifier, link with nothing. Two documents link at 100 * intersection >= percent * union.

    Equal sets are compared once, by their smallest identifier. The others meet in bands of their
    minima. A bucket of two is checked. In others each member is tried with the likeliest of the smallest
    and largest members of its buckets; then, in buckets that hold several components, of members drawn
    for the buckets, ``DRAWS`` times. Last, all pairs between the components of a bucket are compared in
    blocks. So a bucket of thousands of near copies costs a few full checks for each member, and no link
    between components is lost. Rows that share an identifier are one node. An empty table gives no rows.
    """
    own = texts(docs, id_col, text_col)
    rows = cut_lineage(features(own))
    lone = rows.filter("sig IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    keyed = rows.filter("sig IS NOT NULL AND doc_id IS NOT NULL").select(
        F.struct((-F.col("doc_id")).alias("least"), F.col(ROW), F.col("doc_id")).alias("who"), "digest", F.col("n_shingles").alias("n_bytes"), F.xxhash64("sig").alias("check"), "run",
    )
    members = cut_lineage(merge_runs(keyed, 64).select(F.col("own.doc_id").alias("doc_id"), F.col("n_bytes").alias("n_shingles"), F.col("who.doc_id").alias("node"), F.col(f"who.{ROW}").alias(ROW)))
    firsts = members.select(ROW, "node").distinct()
    sigs = cut_lineage(rows.select(ROW, "sig").join(firsts, ROW).select("node", "sig"))
    keys = sigs.select("node", F.explode(band_keys("sig")).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), (F.count(F.lit(1)) == 2).alias("must")).filter("lo < hi")
    buckets = cut_lineage(keys.join(shared, "key"))
    sets = cut_lineage(sets_of(own, buckets.select("node").distinct()))
    free_shuffles(docs.sparkSession)
    tried = cut_lineage(
        buckets.select(F.col("lo").alias("u"), F.col("node").alias("v"), "must").union(buckets.select(F.col("node").alias("u"), F.col("hi").alias("v"), "must"))
        .filter("u < v").groupBy("u", "v").agg(F.bool_or("must").alias("must"))
    )
    links = cut_lineage(linked(tried, sigs, sets, percent))
    for draw in range(DRAWS + 1):
        free_shuffles(docs.sparkSession)
        # before all pairs are compared the components must be whole
        parts = nearby(links) if draw < DRAWS else connected_components(links).withColumnRenamed("component", "part")
        placed = buckets.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("part", "node").alias("part"))
        # two members of a bucket of two have been tried
        several = placed.groupBy("key").agg(
            F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("node", "part"), F.xxhash64("key", "node", F.lit(draw))).alias("drawn")
        ).filter("p < q AND n > 2")
        open_ = cut_lineage(placed.join(several.select("key", "drawn"), "key"))
        if open_.isEmpty():
            break
        if draw < DRAWS:
            x, y = F.col("node"), F.col("drawn.node")
            more = open_.filter("part <> drawn.part").select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"), F.lit(False).alias("must")).distinct()
            links = links.union(cut_lineage(linked(more.join(tried, ["u", "v"], "left_anti"), sigs, sets, percent)))
        else:
            links = links.union(cut_lineage(across(open_.select("key", "node", "part"), sigs, sets, percent)))
    free_shuffles(docs.sparkSession)
    whole = connected_components(links)
    found = members.join(whole, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return found.union(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) whose identifier is the smallest of its component, columns unchanged."""
    safe = [f"c{i}__" for i in range(len(docs.columns))]
    gone = near_duplicates(docs, percent).filter("NOT kept").select(F.col("doc_id").alias("id__")).distinct()
    rows = docs.toDF(*safe).withColumn("id__", F.col(safe[docs.columns.index("doc_id")]).cast("long"))
    return rows.join(gone, "id__", "left_anti").select(*[F.col(s).alias(c) for s, c in zip(safe, docs.columns)])
