"""Prediction by partial matching over bytes, and word unigram scores from corpus counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import fold, parallelism, pieces, texts
from eventloom.llm.minhash import WordHash, mix
from eventloom.session import cut_lineage, free_shuffles

#: Symbols: bytes, the end of a text, and the mark that fills contexts before its start.
END, START, SYMBOLS, BITS = 256, 257, 257, 9
ORDER = 5
CHUNK = 1 << 21
#: Text for each part of the trie, text that the bounds of the parts are drawn from, and one gram in so many of it.
PART, DRAWN, THIN = 1 << 22, 1 << 25, 64
#: Texts of so many bytes, or with so many distinct grams, send their grams together.
GATHER, MOST = 1 << 24, 3 << 20
END_TOKEN = b" end"  # no word holds a space


class Trie:
    """The plain form: a byte-context trie of counts, with escapes (method C) and symbol exclusion."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[tuple[int, ...], dict[int, int]] = {}

    @staticmethod
    def symbols(text: str) -> list[int]:
        return [*text.encode(), END]

    def context(self, done: list[int]) -> tuple[int, ...]:
        return tuple(([START] * self.order + done)[len(done):]) if self.order else ()

    def learn_symbol(self, context: tuple[int, ...], s: int) -> None:
        for k in range(self.order + 1):
            node = self.counts.setdefault(context[self.order - k:], {})
            node[s] = node.get(s, 0) + 1

    def learn(self, text: str) -> None:
        done: list[int] = []
        for s in self.symbols(text):
            self.learn_symbol(self.context(done[-self.order:]), s)
            done.append(s)

    def log10(self, context: tuple[int, ...], s: int) -> float:
        out, ruled = 0.0, set()
        for k in range(self.order, -1, -1):
            node = self.counts.get(context[self.order - k:])
            if not node:
                continue
            left = {x: c for x, c in node.items() if x not in ruled}
            weight = sum(left.values()) + len(left)
            if s in left:
                return out + math.log10(left[s] / weight)
            if left:
                out += math.log10(len(left) / weight)
            ruled |= node.keys()
        return out - math.log10(SYMBOLS - len(ruled))

    def score(self, text: str, adaptive: bool = False) -> float:
        """log10 probability of the text with its end; ``adaptive`` learns every symbol once it is coded."""
        out, done = 0.0, []
        for s in self.symbols(text):
            context = self.context(done[-self.order:])
            out += self.log10(context, s)
            if adaptive:
                self.learn_symbol(context, s)
            done.append(s)
        return out


def grams(rows: list[bytes], order: int = ORDER, nearest_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, symbol) of every position of every text, and the text that each belongs to.

    The symbol is in the lowest bits; above it is the nearest symbol of the context, or with ``nearest_first``
    the farthest, so that the grams of a context of any order follow each other.
    """
    lengths = np.fromiter(map(len, rows), np.int64, len(rows)) + order + 1
    ends = np.cumsum(lengths)
    flat = np.frombuffer(b"".join(b"\0" * order + r + b"\0" for r in rows), np.uint8).astype(np.uint64)
    real = np.ones(len(flat), bool)
    for k in range(order):
        flat[ends - lengths + k] = START
        real[ends - lengths + k] = False
    flat[ends - 1] = END
    key = flat.copy()
    for k in range(1, order + 1):
        key[k:] |= flat[:-k] << np.uint64(BITS * (order + 1 - k if nearest_first else k))
    return key[real], np.repeat(np.arange(len(rows)), lengths - order)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal keys, in order of the keys."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def low_bits(keys: np.ndarray, symbols: int) -> np.ndarray:
    return keys & np.uint64((1 << BITS * symbols) - 1)


def turned(keys: np.ndarray, order: int) -> np.ndarray:
    """Grams of ``order`` context symbols with these in the other order; see ``grams``."""
    out = low_bits(keys, 1)
    for k in range(1, order + 1):
        out |= low_bits(keys >> np.uint64(BITS * (order + 1 - k)), 1) << np.uint64(BITS * k)
    return out


def squeeze(values: np.ndarray) -> bytes:
    """Values of eight bytes, compressed by byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def expand(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, np.uint64), dtype=np.uint64)


def cut_contexts(bounds: np.ndarray, order: int, o: int) -> np.ndarray:
    """The contexts of order ``o``, nearest symbol first, that lie on the way to one of the bounds."""
    return np.unique(bounds >> np.uint64(BITS * (order + 1 - o))) if o else np.zeros(min(1, len(bounds)), np.uint64)


def cut_grams(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(order and gram, count) of the contexts that have grams on both sides of a bound, from learned grams."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for o in range(order if len(bounds) else 0):
        context = keys >> np.uint64(BITS * (order + 1 - o))
        own = np.isin(context, cut_contexts(bounds, order, o))
        out.append(merged([context[own] << np.uint64(BITS) | low_bits(keys[own], 1) | np.uint64(o << 60)], [counts[own]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def part_bounds(docs: DataFrame, order: int) -> np.ndarray:
    """Bounds that deal the grams of ``docs`` (text) evenly, each before all grams of a context of full order.

    They are quantiles of distinct grams from a drawn part of the texts; results do not depend on them.
    """
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(parallelism(docs.sparkSession), -(-total // PART))

    def draw(batches):
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK):
                k = np.unique(grams([t.as_py().encode() for t in piece.column("text")], order, True)[0])
                yield pa.RecordBatch.from_arrays([pa.array([k[mix(k) % np.uint64(THIN) == 0].tobytes()], pa.binary())], names=["keys"])

    some = docs.select("text").sample(min(1.0, DRAWN / total), 5) if total > DRAWN else docs.select("text")
    drawn = [np.frombuffer(r[0], np.uint64) for r in some.mapInArrow(draw, "keys binary").collect()]
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *drawn]))
    return np.unique(keys[np.arange(1, parts) * len(keys) // parts] >> np.uint64(BITS) << np.uint64(BITS)) if len(keys) else keys


class Table:
    """Positions of 64-bit keys: open addressing with linear probing, whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots, self.at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo, keys = np.arange(len(keys)), keys + np.uint64(1)
        place = self.start(keys)
        while len(todo):
            free = self.slots[place] == 0
            self.slots[place[free]] = keys[todo[free]]
            own = self.slots[place] == keys[todo]
            self.at[place[own]] = todo[own]
            todo, place = todo[~own], (place[~own] + 1) & self.mask

    def start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of every key, or -1."""
        keys = keys + np.uint64(1)
        place = self.start(keys)
        held = self.slots[place]
        out = np.where(held == keys, self.at[place], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held != 0))
        place = place[todo]
        while len(todo):
            place = (place + 1) & self.mask
            held = self.slots[place]
            hit = held == keys[todo]
            out[todo[hit]] = self.at[place[hit]]
            on = ~hit & (held != 0)
            todo, place = todo[on], place[on]
        return out


class Tables:
    """The trie as arrays. An order has its grams with counts, and its contexts with

    total and kinds (counts and number of symbols), and below_total and below_kinds: the same of the
    next shorter context once the symbols of this one are ruled out.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.grams, self.contexts, self.counts, self.node, self.kinds, self.total, self.below = [], [], [], [], [], [], []
        for o, (keys, counts) in enumerate(levels):
            context, node = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            kinds, total = np.bincount(node, minlength=len(context)), np.bincount(node, weights=counts, minlength=len(context))
            if o and len(keys):
                up = self.grams[o - 1].find(low_bits(keys, o))
                parent = self.contexts[o - 1].find(low_bits(context, o - 1))
                left_total = self.total[o - 1][parent] - np.bincount(node, weights=self.counts[o - 1][up], minlength=len(context))
                left_kinds = self.kinds[o - 1][parent] - kinds
            else:
                left_total, left_kinds = np.zeros(len(context)), np.zeros(len(context))
            self.grams.append(Table(keys))
            self.contexts.append(Table(context))
            self.counts.append(counts.astype(np.float64))
            self.node.append(node)
            self.kinds.append(kinds.astype(np.float64))
            self.total.append(total)
            self.below.append((left_total, left_kinds))
        n = self.node[-1]
        self.first = np.log10(self.counts[-1] / (self.total[-1][n] + self.kinds[-1][n]))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of every packed gram after its context."""
        at = self.grams[-1].find(keys)
        seen = at >= 0
        out = np.where(seen, self.first[at] if len(self.first) else 0.0, 0.0)
        todo = np.flatnonzero(~seen)
        # what the level above rules out of the present level: weight and kinds; -1 where nothing stands above
        total, kinds = np.full(len(todo), -1.0), np.zeros(len(todo))
        for o in range(self.order, -1, -1):
            if not len(todo):
                return out
            own = low_bits(keys[todo], o + 1)
            node = self.contexts[o].find(own >> np.uint64(BITS))
            known = node >= 0
            fresh = known & (total < 0)
            total[fresh], kinds[fresh] = self.total[o][node[fresh]], self.kinds[o][node[fresh]]
            at = self.grams[o].find(own)
            hit = at >= 0
            out[todo[hit]] += np.log10(self.counts[o][at[hit]] / (total[hit] + kinds[hit]))
            escape = known & ~hit & (kinds > 0)
            out[todo[escape]] += np.log10(kinds[escape] / (total[escape] + kinds[escape]))
            below_total, below_kinds = self.below[o]
            total[known], kinds[known] = below_total[node[known]], below_kinds[node[known]]
            todo, total, kinds = todo[~hit], total[~hit], kinds[~hit]
        out[todo] -= math.log10(max(1, SYMBOLS - (self.kinds[0][0] if len(self.kinds[0]) else 0)))
        return out

    def score(self, rows: list[bytes]) -> np.ndarray:
        keys, owner = grams(rows, self.order)
        return np.bincount(owner, weights=self.log10(keys), minlength=len(rows))


def part_levels(keys: np.ndarray, counts: np.ndarray, part: int, bounds: np.ndarray, cut: tuple[np.ndarray, np.ndarray], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(grams, counts) of every order from 0 as ``Tables`` takes them, for the contexts of one part.

    ``keys`` are its learned grams. Contexts that one of its two bounds cuts have their counts from ``cut``,
    where the whole corpus is summed; all others are whole in the part.
    """
    own = [merged([turned(keys, order)], [counts])]
    for o in range(order - 1, -1, -1):
        own.insert(0, merged([low_bits(own[0][0], o + 1)], [own[0][1]]))
    edges = bounds[max(0, part - 1):part + 1]
    for o in range(order if len(edges) else 0):
        contexts = cut_contexts(edges, order, o)
        a, b = np.searchsorted(cut[0], [np.uint64(o << 60), np.uint64(o + 1 << 60)])
        gram, count = low_bits(cut[0][a:b], o + 1), cut[1][a:b]
        held = np.isin(gram >> np.uint64(BITS), contexts)
        rest = ~np.isin(own[o][0] >> np.uint64(BITS), turned(contexts << np.uint64(BITS), o) >> np.uint64(BITS))
        own[o] = merged([own[o][0][rest], turned(gram[held], o)], [own[o][1][rest], count[held]])
    return own


def ppm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The other columns of ``docs`` (text, train, ...) with score, the log10 probability of every whole text and its end.

    The trie is learned from all texts marked ``train`` and is never in one place. Chunks of texts send
    their distinct grams, with training counts, to the parts of the gram space: ranges by the context,
    nearest symbol first. So a context is whole in one part, but for the few on the way to a bound,
    whose counts are summed over the corpus and go to all parts. A part sends the log10 probability of
    every gram back to the chunk, in the order of its grams.
    """
    bounds = part_bounds(docs, order)
    groups = len(bounds) // 8 + 1
    fields = [f for f in docs.schema.fields if f.name not in ("text", "train")]
    blobs = pa.schema([("name", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def count(batches):
        name, size, keys, counts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK):
                if not piece.num_rows:
                    continue
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(piece)
                yield pa.RecordBatch.from_pylist([{"name": name, "part": -1, "a": sink.getvalue().to_pybytes(), "b": None}], schema=blobs)
                key, owner = grams([t.as_py().encode() for t in piece.column("text")], order, True)
                train = np.asarray(piece.column("train").to_pylist(), bool)[owner]
                for own, learned in ((key[train], 1), (key[~train], 0)):
                    k, n = np.unique(own, return_counts=True)
                    keys.append(k)
                    counts.append(n * learned)
                keys, counts = ([x] for x in merged(keys, counts))
                size += len(key)
                if size > GATHER or len(keys[0]) > MOST:
                    yield sent(name, keys[0], counts[0])
                    name, size, keys, counts = name + 1, 0, [], []
        if keys:
            yield sent(name, keys[0], counts[0])

    def sent(name: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        cuts = [0, *np.searchsorted(keys, bounds), len(keys)]
        rows = [{"name": name, "part": p, "a": packed_keys(keys[a:b]), "b": squeeze(counts[a:b])} for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        keys, counts = cut_grams(keys[counts > 0], counts[counts > 0], bounds, order)
        group = mix(keys) % np.uint64(groups)
        for g in np.unique(group):
            own = group == g
            rows.append({"name": name, "part": -2 - int(g), "a": packed_keys(keys[own]), "b": squeeze(counts[own])})
        return pa.RecordBatch.from_pylist(rows, schema=blobs)

    def add_up(rows: pa.Table) -> pa.Table:
        k, n = merged([unpacked_keys(x) for x in rows["a"].to_pylist()], [expand(x, np.int64) for x in rows["b"].to_pylist()])
        return pa.table({"a": pa.array([k.tobytes()], pa.binary()), "b": pa.array([n.tobytes()], pa.binary())})

    chunks = cut_lineage(docs.select(*[f.name for f in fields], "text", "train").mapInArrow(count, "name bigint, part int, a binary, b binary"))
    got = chunks.filter("part < -1").groupBy("part").applyInArrow(add_up, "a binary, b binary").collect()
    none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    cut = merged(none[0] + [np.frombuffer(r["a"], np.uint64) for r in got], none[1] + [np.frombuffer(r["b"], np.int64) for r in got])
    shared = docs.sparkSession.sparkContext.broadcast(cut)  # at most 257 symbols of ``order`` contexts for each bound

    def answer(rows: pa.Table) -> pa.Table:
        keys = [unpacked_keys(x) for x in rows["a"].to_pylist()]
        ends = np.cumsum([0, *map(len, keys)])
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([expand(x, np.int64) for x in rows["b"].to_pylist()])).astype(np.int64)
        del keys
        seen = counts > 0
        levels = part_levels(every[seen], counts[seen], rows["part"][0].as_py(), bounds, shared.value, order)
        score = Tables(levels).log10(turned(every, order))
        values, kind = np.unique(score, return_inverse=True)
        sent_back = [np.unique(kind[at[a:b]], return_inverse=True) for a, b in zip(ends, ends[1:])]
        return pa.table({
            "name": rows["name"], "part": rows["part"], "c": pa.array([squeeze(values[own]) for own, _ in sent_back], pa.binary()),
            "d": pa.array([squeeze(place.astype(np.int64)) for _, place in sent_back], pa.binary()),
        })

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        each = np.concatenate([expand(c, np.float64)[expand(d, np.int64)] for c, d in zip(right["c"].to_pylist(), right["d"].to_pylist())])
        held = []
        for blob in left["a"].to_pylist():
            piece = pa.ipc.open_stream(blob).read_all()
            key, owner = grams([t.as_py().encode() for t in piece["text"]], order, True)
            own, at = np.unique(key, return_inverse=True)
            held.append((piece.select([f.name for f in fields]), own, at.astype(np.int32), np.bincount(owner, minlength=piece.num_rows)))
        every = np.unique(np.concatenate([own for _, own, _, _ in held]))
        out = []
        for piece, own, at, lengths in held:
            owner = np.repeat(np.arange(len(lengths)), lengths)
            score = np.bincount(owner, weights=each[np.searchsorted(every, own)][at], minlength=len(lengths))
            out.append(piece.append_column("score", pa.array(score)))
        return pa.concat_tables(out)

    answers = chunks.filter("part >= 0").groupBy("part").applyInArrow(answer, "name bigint, part int, c binary, d binary")
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "score double"])
    return chunks.filter("part = -1").select("name", "a").groupBy("name").cogroup(answers.groupBy("name")).applyInArrow(finish, schema)


def adaptive_scores(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): log10 probability of every text under a trie that starts empty and learns as it codes."""
    def run(batches):
        for batch in batches:
            score = [Trie(order).score(t.as_py(), adaptive=True) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")


def unigram_scores(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, mark, train, text) with n_tokens, n_known, train_tokens and base_score.

    Chunks of texts keep a sorted dictionary of their words, and for each word the texts that it stands
    in. Only dictionaries with training counts are exchanged, by ranges of the word hash: one entry for
    each word and chunk, so the commonest word is as cheap as any other. The summed counts come back to
    the chunk, in the order of its dictionary.
    """
    parts = parallelism(docs.sparkSession)

    def tokenise(batches):
        task, made, hashes = TaskContext.get().partitionId(), 0, WordHash()
        for batch in batches:
            for start in range(0, max(1, batch.num_rows), 60_000):
                for piece in pieces(batch.slice(start, 60_000), "text", 4 * CHUNK):
                    yield from chunk(piece, task << 32 | made, hashes)
                    made += 1

    def chunk(piece, name: int, hashes: WordHash):
        docs_words = [t.as_py().encode().lower().split() + [END_TOKEN] for t in piece.column("text")]
        lengths = np.fromiter(map(len, docs_words), np.int64, len(docs_words))
        h = np.fromiter((hashes[w] for ws in docs_words for w in ws), np.uint64, int(lengths.sum()))
        words, at = np.unique(h, return_inverse=True)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        train = np.asarray(piece.column("train").to_pylist(), bool)
        learned = np.bincount(at, weights=train[doc], minlength=len(words)).astype(np.int64)
        by_word = np.argsort(at, kind="stable")
        blob = {"name": name, "part": -1, "a": doc[by_word].astype(np.uint16).tobytes(), "b": np.bincount(at, minlength=len(words)).astype(np.uint32).tobytes()}
        blob |= {"ids": piece.column("doc_id").to_pylist(), "marks": piece.column("mark").to_pylist()}
        rows = [blob]
        part = ((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p in range(parts):
            own = slice(cuts[p], cuts[p + 1])
            if cuts[p + 1] > cuts[p]:
                rows.append({"name": name, "part": p, "a": words[own].tobytes(), "b": learned[own].astype(np.uint32).tobytes(), "ids": None, "marks": None})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("name", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))]))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(x, np.uint64) for x in rows["a"]]
        _, at = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([np.frombuffer(x, np.uint32) for x in rows["b"]])).astype(np.int64)
        cuts = np.cumsum([0, *map(len, words)])
        totals = [(int(counts.sum()), int((counts > 0).sum()))] + [(0, 0)] * (len(rows) - 1)
        return pd.DataFrame({
            "name": rows["name"], "part": rows["part"], "c": [counts[at[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])],
            "n": [t[0] for t in totals], "v": [t[1] for t in totals],
        })

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = np.concatenate([np.frombuffer(x, np.int64) for x in right.sort_values("part")["c"]])
        row = left.iloc[0]
        doc, runs = np.frombuffer(row["a"], np.uint16), np.frombuffer(row["b"], np.uint32)
        n = len(row["ids"])
        each = np.repeat(c, runs)
        return pd.DataFrame({
            "doc_id": pd.array(row["ids"], dtype="Int64"), "mark": row["marks"], "n_tokens": np.bincount(doc, minlength=n), "n_known": np.bincount(doc, weights=each > 0, minlength=n).astype(np.int64),
            "logs": np.bincount(doc, weights=np.log10(each + 1.0), minlength=n),
        })

    chunks = cut_lineage(docs.select("doc_id", "mark", "train", "text").mapInArrow(tokenise, "name bigint, part int, a binary, b binary, ids array<bigint>, marks array<bigint>"))
    answers = cut_lineage(chunks.filter("part >= 0").select("name", "part", "a", "b").groupBy("part").applyInPandas(answer, "name bigint, part int, c binary, n bigint, v bigint"))
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    own = chunks.filter("part < 0").groupBy("name").cogroup(answers.groupBy("name")).applyInPandas(finish, "doc_id bigint, mark bigint, n_tokens bigint, n_known bigint, logs double")
    return own.select("doc_id", "mark", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"))


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from the documents whose crc32 fold is not ``held``. Null and empty texts hold the
    end alone. Repeated rows score alike; a null identifier counts as the empty text in its fold. Without
    training documents the base is log10(1) and the trie gives every symbol the same chance. The base is
    finished, and its chunks are let go, before the trie makes its own: disk holds one model's exchange.
    """
    own = texts(docs, id_col, text_col).withColumns({"mark": F.xxhash64("text"), "held_out": fold(F.col("doc_id"), folds) == held})
    own = own.withColumn("train", ~F.col("held_out"))
    base = cut_lineage(unigram_scores(own).dropDuplicates(["doc_id", "mark"]))
    free_shuffles(docs.sparkSession, 2.5)
    scored = ppm_scores(own.select("doc_id", "mark", "held_out", "text", "train"))
    return (
        scored.alias("s").join(base.alias("b"), F.col("s.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("s.mark") == F.col("b.mark")))
        .select("s.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    )
