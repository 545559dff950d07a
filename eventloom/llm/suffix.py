"""Repeated substrings by a sparse suffix sort: front-coded runs merged with common-prefix-aware loser trees.

A string of ``length`` bytes that occurs twice holds the same anchor at the same place both times: the
smallest hash among its substrings of ``length / 2`` bytes. So only suffixes that start at anchors are
sorted. Anchors whose substring is unique drop out by counts; anchors whose whole surroundings occur
again are settled by counts, too. The others meet in the suffix sort: longest common prefixes with the
neighbours in the order of suffixes, and in the order of the reversed text before the anchor, bound
which windows around an anchor can be repeated; those windows are then compared one offset at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import ROW, parallelism, pieces, squeezed, texts
from eventloom.llm.minhash import mix
from eventloom.session import cut_lineage

LENGTH = 400
CHUNK = 1 << 21
RUN = 50_000  # contexts in a sorted run
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
FULL, NEED = 1, 2

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, CHUNK), base, np.uint64)
        held[0] = 1
        _POWERS[base] = held = np.cumprod(held)
    return held[:n]


class Rolling:
    """Hashes of all substrings of a byte array from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * powers(BASE, len(data)) + powers(BASE, len(data)), out=self.sums[1:])
        self.shift = powers(INVERSE, len(data) + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.shift[lo])

    def every(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.shift[:len(self.sums) - size])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values)
    wide = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    wide[:n] = values
    blocks = wide.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(rows: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and position of every anchor, the hash of its substring and that of its surroundings."""
    half = length // 2
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    none = np.zeros(0, np.int64)
    if not len(rows) or ends[-1] < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = Rolling(np.frombuffer(b"".join(rows), np.uint8))
    hashes = rolling.every(half)
    place = np.uint64((1 << 31) - 1)
    least = sliding_least((hashes & ~place) | np.arange(len(hashes), dtype=np.uint64), length - half + 1)
    whole = np.zeros(len(least) + 1, np.int64)  # windows inside one text
    long_ = sizes >= length
    np.add.at(whole, starts[long_], 1)
    np.add.at(whole, ends[long_] - length + 1, -1)
    at = (least[np.cumsum(whole)[:-1] > 0] & place).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    doc = np.searchsorted(ends, at, side="right")
    lo, hi = np.maximum(at - half, starts[doc]), np.minimum(at + length, ends[doc])
    around = mix(rolling.of(lo, hi) + (at - lo).astype(np.uint64) * np.uint64(length + 1) + (hi - at).astype(np.uint64))
    return doc, at - starts[doc], hashes[at], around


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree before ``at``."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 8
    while a[at:at + step] == b[at:at + step]:
        at += step
        step += step
    while step > 1:
        step >>= 1
        if a[at:at + step] == b[at:at + step]:
            at += step
    return at


def merge(runs: list[list[tuple[int, bytes]]]) -> list[tuple[int, int, int]]:
    """Merge sorted front-coded runs; returns (run, place in it, common prefix with the string before).

    A run holds (common prefix with the string before it, rest). Every loser in the tree keeps its
    common prefix with the winner that passed it, so two strings are compared from where their known
    prefixes end, and not at all when these differ: the one that agrees longer with the last output is
    the smaller.
    """
    k = 1
    while k < len(runs):
        k *= 2
    text: list[bytes | None] = [None] * k
    known, at = [0] * k, [-1] * k
    lengths = [len(r) for r in runs] + [0] * (k - len(runs))

    def advance(r: int) -> None:
        at[r] += 1
        if at[r] < lengths[r]:
            shared, rest = runs[r][at[r]]
            text[r] = (text[r] or b"")[:shared] + rest
            known[r] = shared
        else:
            text[r] = None

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        a, b = text[x], text[y]
        if a is None:
            return y, x
        if b is None:
            return x, y
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        p = common(a, b, known[x])
        if p == len(a) or (p < len(b) and a[p] < b[p]):
            known[y] = p
            return x, y
        known[x] = p
        return y, x

    for r in range(k):
        advance(r)
    tree, best = [0] * k, [0] * (2 * k)
    for node in range(2 * k - 1, 0, -1):
        if node >= k:
            best[node] = node - k
        else:
            best[node], tree[node] = play(best[2 * node], best[2 * node + 1])
    out, winner = [], best[1]
    while text[winner] is not None:
        out.append((winner, at[winner], known[winner]))
        advance(winner)
        node = (winner + k) >> 1
        while node:
            winner, tree[node] = play(tree[node], winner) if node else (winner, 0)
            node >>= 1
    return out


def front_coded(strings: list[bytes]) -> list[tuple[int, bytes]]:
    """A sorted list as (common prefix with the string before, rest)."""
    out, last = [], b""
    for s in strings:
        p = common(last, s, 0)
        out.append((p, s[p:]))
        last = s
    return out


def adjacent(strings: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Longest common prefix of every row (bytes, of ``sizes``) with either neighbour in sorted order."""
    n = len(strings)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{strings.shape[1]}").ravel(), kind="stable")
    for s in range(0, n - 1, 1 << 14):
        a, b = order[s:s + (1 << 14)], order[s + 1:s + 1 + (1 << 14)]
        a = a[:len(b)]
        differ = strings[a] != strings[b]
        p = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
        p = np.minimum(p, np.minimum(sizes[a], sizes[b]))
        best[a] = np.maximum(best[a], p)
        best[b] = np.maximum(best[b], p)  # a and b share rows
    return best


def repeated_windows(head: np.ndarray, left: np.ndarray, right: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest offset t in lo .. hi at which the window from t before the anchor is another row's, too.

    Rows are compared only with rows of the same ``head``. The largest is -1 where there is none.
    """
    n, half = len(head), left.shape[1]
    first, last = np.full(n, half + 1), np.full(n, -1)
    if not n:
        return first, last
    grow = powers(BASE, length)[::-1]
    window = np.zeros(n, np.uint64)
    for s in range(0, n, 1 << 13):
        window[s:s + (1 << 13)] = (right[s:s + (1 << 13)].astype(np.uint64) * grow).sum(axis=1)
    for t in range(half + 1):
        if t:
            window = (window - right[:, length - t].astype(np.uint64)) * np.uint64(INVERSE) + left[:, half - t].astype(np.uint64) * grow[0]
        some = np.flatnonzero((lo <= t) & (t <= hi))
        if len(some) < 2:
            continue
        key = mix(window[some] + mix(head[some]))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(some), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = some[twice]
        first[hit] = np.minimum(first[hit], t)
        last[hit] = t
    return first, last


def covered(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans cut to 0 .. n, as maximal disjoint runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, a), min(n, b)) for a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def kept_of(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def settled(docs: DataFrame, length: int) -> DataFrame:
    """(row, n_bytes, full, need): anchors of a text that are repeated in full, and those to be sorted.

    Chunks of texts send the distinct (substring, surroundings) hashes of their anchors, one entry each,
    and get two bits back: FULL, the surroundings occur again; NEED, other surroundings share the
    substring, and this entry stands for its own.
    """
    parts = parallelism(docs.sparkSession)

    def find(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK):
                yield chunk(piece, task << 32 | made)
                made += 1

    def chunk(piece, name: int) -> pa.RecordBatch:
        rows = [t.as_py().encode() for t in piece.column("text")]
        doc, pos, half, around = anchors(rows, length)
        pairs, index, counts = np.unique(np.stack([half, around], axis=1), axis=0, return_inverse=True, return_counts=True) if len(doc) else (np.zeros((0, 2), np.uint64), doc, doc)
        part = ((pairs[:, 0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        blob = {"name": name, "part": -1, "a": doc.astype(np.int32).tobytes(), "b": pos.astype(np.int32).tobytes(), "c": index.ravel().astype(np.int32).tobytes()}
        out = [blob | {"rows": piece.column(ROW).to_pylist(), "sizes": [len(r) for r in rows]}]
        for p in range(parts):
            own = slice(cuts[p], cuts[p + 1])
            if cuts[p + 1] > cuts[p]:
                out.append({"name": name, "part": p, "a": pairs[own, 0].tobytes(), "b": pairs[own, 1].tobytes(), "c": np.minimum(counts[own], 2).astype(np.uint8).tobytes(), "rows": None, "sizes": None})
        kinds = [("name", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("rows", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
        return pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        half, around = (np.concatenate([np.frombuffer(x, np.uint64) for x in rows[c]]) for c in "ab")
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["c"]]).astype(np.int64)
        order = np.lexsort((around, half))
        h, w = half[order], around[order]
        new_half = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_half | np.concatenate([[True], w[1:] != w[:-1]])
        kind, group = np.cumsum(new) - 1, np.cumsum(new_half) - 1
        often = np.bincount(kind, weights=counts[order]) >= 2
        several = np.bincount(group, weights=new) >= 2
        flags = np.zeros(len(half), np.uint8)
        flags[order] = FULL * often[kind] + NEED * (several[group] & new)
        cuts = np.cumsum([0, *(len(x) // 8 for x in rows["a"])])
        return pd.DataFrame({"name": rows["name"], "part": rows["part"], "flags": [flags[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})

    def give(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        flags = np.frombuffer(b"".join(right.sort_values("part")["flags"]), np.uint8)
        doc, pos, index = (np.frombuffer(row[c], np.int32) for c in "abc")
        own = flags[index] if len(index) else np.zeros(0, np.uint8)
        first = np.zeros(len(index), bool)
        first[np.unique(index, return_index=True)[1]] = True
        full, need = (own & FULL) > 0, ((own & NEED) > 0) & first
        out = []
        for d in np.unique(doc[full | need]).tolist():
            here = doc == d if len(doc) < 64 else slice(*np.searchsorted(doc, [d, d + 1]))
            p, f, n = pos[here], full[here], need[here]
            out.append((int(row["rows"][d]), int(row["sizes"][d]), p[f].astype(np.int32).tobytes(), p[n].astype(np.int32).tobytes()))
        return pd.DataFrame(out, columns=["row", "n_bytes", "full", "need"])

    chunks = cut_lineage(docs.select(ROW, "text").mapInArrow(find, "name bigint, part int, a binary, b binary, c binary, rows array<bigint>, sizes array<bigint>"))
    answers = chunks.filter("part >= 0").select("name", "part", "a", "b", "c").groupBy("part").applyInPandas(answer, "name bigint, part int, flags binary")
    return chunks.filter("part < 0").groupBy("name").cogroup(answers.groupBy("name")).applyInPandas(give, "row bigint, n_bytes bigint, full binary, need binary")


def runs_of(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Texts without open anchors as results; the others packed, and their contexts as sorted front-coded runs.

    Rows of (doc_id, n_bytes, spans, kept) for the first, of (row, doc_id, text, full) for the second,
    of (part, run) for the third.
    """
    parts, half = parallelism(docs.sparkSession), length // 2

    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
             ("row", pa.int64()), ("packed", pa.binary()), ("full", pa.binary()), ("part", pa.int32())]

    def record(**values) -> dict:
        return {name: values.get(name) for name, _ in kinds}

    def split(batches):
        open_, grow = [], zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = grow.decompress(r["packed"])
                if r["size"] is not None and r["size"] != len(text):
                    raise RuntimeError("the documents were read in another order the second time")
                full = np.frombuffer(r["full"] or b"", np.int32).tolist()
                need = np.frombuffer(r["need"] or b"", np.int32).tolist()
                if not need:
                    out.append(result(r["doc_id"], text, covered(len(text), [(p - half, p + length) for p in full])))
                    continue
                out.append(record(row=r["row"], doc_id=r["doc_id"], packed=r["packed"], full=r["full"]))
                settled_ = set(full)
                open_ += [(text[p:p + length], text[max(0, p - half):p], r["row"], p, p not in settled_) for p in need]
                if len(open_) >= RUN:
                    out += runs(open_)
                    open_ = []
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))
        yield pa.RecordBatch.from_pylist(runs(open_), schema=pa.schema(kinds))

    def result(doc_id, text: bytes, spans: list[tuple[int, int]]) -> dict:
        return record(doc_id=doc_id, n_bytes=len(text), spans=[{"start": a, "end": b} for a, b in spans], kept=hashlib.sha256(kept_of(text, spans)).digest())

    def runs(contexts: list[tuple]) -> list[dict]:
        by_part: dict[int, list] = {}
        for right, *rest in contexts:
            key = hashlib.blake2b(right[:half], digest_size=8).digest()
            by_part.setdefault(int.from_bytes(key, "big") % parts, []).append((key + right, *rest))
        squeeze = zstandard.ZstdCompressor(level=1)
        out = []
        for part, own in by_part.items():
            own.sort(key=lambda x: x[0])
            coded = front_coded([x[0] for x in own])
            fields = [
                np.array([p for p, _ in coded], np.uint16).tobytes(), np.array([len(s) for _, s in coded], np.uint16).tobytes(), b"".join(s for _, s in coded),
                np.array([len(x[1]) for x in own], np.uint16).tobytes(), b"".join(x[1] for x in own), np.array([x[2] for x in own], np.int64).tobytes(),
                np.array([x[3] for x in own], np.int32).tobytes(), np.array([x[4] for x in own], np.uint8).tobytes(),
            ]
            head = np.array([len(f) for f in fields], np.int64).tobytes()
            out.append(record(part=part, packed=squeeze.compress(head + b"".join(fields))))
        return out

    joined = squeezed(docs.select(F.col(ROW).alias("row"), "doc_id", "text")).join(found.withColumnRenamed("n_bytes", "size"), "row", "left")
    return joined.select("row", "doc_id", "packed", "size", "full", "need").mapInArrow(split, f"{RESULT}, row bigint, packed binary, full binary, part int")


def unpacked(run: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(run)
    sizes = np.frombuffer(raw[:64], np.int64)
    cuts = 64 + np.cumsum([0, *sizes])
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def pieces_of(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64)
    return [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def sorted_contexts(runs: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of repeated stretches around the open anchors of one part, from its runs."""
    half = length // 2
    fields = [unpacked(r) for r in runs]
    coded = [list(zip(np.frombuffer(f[0], np.uint16).tolist(), pieces_of(f[2], np.frombuffer(f[1], np.uint16)))) for f in fields]
    order = merge(coded)
    n = len(order)
    prefix = np.array([p for _, _, p in order] + [0], np.int64)
    prefix[:1] = 0
    first = np.cumsum([0, *(len(c) for c in coded)])
    rank = np.array([first[r] + i for r, i, _ in order], np.int64)
    ahead = np.maximum(np.maximum(prefix[:-1], prefix[1:]) - 8, 0)
    left_size = np.concatenate([np.frombuffer(f[3], np.uint16) for f in fields]).astype(np.int64)[rank]
    lefts = [x for f in fields for x in pieces_of(f[4], np.frombuffer(f[3], np.uint16))]
    row, pos, solo = (np.concatenate([np.frombuffer(f[k], kind) for f in fields])[rank] for k, kind in ((5, np.int64), (6, np.int32), (7, np.uint8)))
    texts_of = [decoded(c) for c in coded]
    right = np.zeros((n, length), np.uint8)
    head = np.zeros((n, 8), np.uint8)
    left = np.zeros((n, half), np.uint8)
    for k, (r, i, _) in enumerate(order):
        s = texts_of[r][i]
        head[k] = np.frombuffer(s, np.uint8, 8)
        right[k, :len(s) - 8] = np.frombuffer(s, np.uint8, len(s) - 8, 8)
        before = lefts[rank[k]]
        if before:
            left[k, half - len(before):] = np.frombuffer(before, np.uint8)
    back = adjacent(np.concatenate([head, left[:, ::-1]], axis=1), 8 + left_size) - 8
    lo, hi = length - ahead, np.minimum(np.maximum(back, 0), left_size)
    near, far = repeated_windows(head.view(np.uint64).ravel(), left, right, lo, hi, length)
    hit = np.flatnonzero((far >= 0) & (solo > 0))
    return [(int(row[k]), int(pos[k] - far[k]), int(pos[k] + length - near[k])) for k in hit]


def decoded(coded: list[tuple[int, bytes]]) -> list[bytes]:
    out, last = [], b""
    for p, rest in coded:
        last = last[:p] + rest
        out.append(last)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (start, end of the removed runs), kept (digest of the other bytes).

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else, in the
    same document or another; strings are judged on the input, overlaps count, and no string crosses
    documents. Null counts as empty; texts shorter than ``length`` keep all their bytes. Repeated rows
    are copies of each other and lose what they share. An empty table gives no rows. ``length`` is even.
    """
    own = texts(docs, id_col, text_col).withColumn(ROW, F.monotonically_increasing_id())
    found = cut_lineage(settled(own, length))
    parted = cut_lineage(runs_of(own, found, length))
    half = length // 2

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(sorted_contexts(list(rows["packed"]), length), columns=["row", "start", "end"])

    stretches = parted.filter("part IS NOT NULL").select("part", "packed").groupBy("part").applyInPandas(sort, "row bigint, start bigint, end bigint")
    by_row = stretches.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("more"))  # at most the open anchors of one text

    def finish(batches):
        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, sizes, spans, kept = [], [], [], []
            for r in batch.to_pylist():
                text = grow.decompress(r["packed"])
                full = [(p - half, p + length) for p in np.frombuffer(r["full"], np.int32).tolist()]
                runs = covered(len(text), full + [(m["start"], m["end"]) for m in r["more"] or []])
                ids.append(r["doc_id"])
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(hashlib.sha256(kept_of(text, runs)).digest())
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, sizes, spans, kept), kinds)], names=["doc_id", "n_bytes", "spans", "kept"])

    late = parted.filter("row IS NOT NULL").select("row", "doc_id", "packed", "full").join(by_row, "row", "left").mapInArrow(finish, RESULT)
    return parted.filter("row IS NULL AND part IS NULL").select("doc_id", "n_bytes", "spans", "kept").union(late)


def removal_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))
