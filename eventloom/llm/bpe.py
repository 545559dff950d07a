"""Byte-level BPE with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from eventloom.llm.common import kept, pieces, sha, texts

#: Bytes of text encoded at once.
PIECE = 1 << 20
#: Bytes of new pre-tokens that are merged through one queue.
GATHER = 1 << 14


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file (a fixed table of a public tokenizer)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Positions waiting by merge rank; the lowest rank is found through two levels of bitmaps.

    A bit of ``low`` says that a rank has positions waiting, a bit of ``top`` that a 64-bit word of
    ``low`` is not zero. The lowest set bit of each level leads to the next rank, whose leftmost
    position comes first. An entry may be stale (its pair has been merged away); the caller checks
    and skips it. ``Codec.merge_all`` holds the two levels in local names, as calls would cost most of its time.
    """

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.top = 0
        self.waiting: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.waiting.get(rank)
        if bucket is None:
            self.waiting[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.top |= 1 << (rank >> 6)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        bucket = self.waiting[rank]
        position = heappop(bucket)
        if not bucket:
            del self.waiting[rank]
            self.low[b] = word & (word - 1)
            if not self.low[b]:
                self.top &= self.top - 1
        return rank, position


#: Bytes that no UTF-8 text holds.
NEVER_IN_UTF8 = (0xFF, 0xFE, 0xFD, 0xFC, 0xFB, 0xFA, 0xF9, 0xF8, 0xF7, 0xF6, 0xF5, 0xC1, 0xC0)


class Codec:
    """Encodes and decodes by merge ranks; remembers the ids, digits and bytes of up to ``keep`` short pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 400_000):
        self.ranks, self.keep = ranks, keep
        self.split = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.digits_of = {rank: str(rank) for rank in self.bytes_of}
        self.low = RankQueue(max(ranks.values()) + 1).low
        # texts cannot hold the mark, so the tokens that do are none of theirs
        self.mark = bytes(NEVER_IN_UTF8[:1])
        self.pairs = {token: rank for token, rank in ranks.items() if self.mark not in token}
        self.known: dict[str, tuple[int, ...]] = {}
        self.shown: dict[str, tuple[int, str, bytes]] = {}
        self.long: list[str] = []

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        return self.merge_all([piece])[0]

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many pre-tokens, each merged by itself through one queue. It is ``RankQueue``, written out.

        The pre-tokens stand in one row, a mark after each that no pair goes across. The lowest rank of all comes
        first, which is the lowest of its pre-token too; a pair that starts further right waits while a lower one is there.
        """
        get, low, top = self.pairs.get, self.low, 0
        waiting: dict[int, list[int]] = {}
        if not words:
            return []
        row = self.mark.join(words) + self.mark
        n = len(row)
        # the token at i covers row[i:ends[i]]; prev is the start of the token before it; ranks_at
        # is the rank of the pair that starts at i, or None
        ends, prev = list(range(1, n + 1)), list(range(-1, n))
        ranks_at = [get(row[i:i + 2]) for i in range(n)]
        ranks_at[-1] = None
        for i, rank in enumerate(ranks_at):
            if rank is not None:
                if rank in waiting:
                    waiting[rank].append(i)
                else:
                    waiting[rank] = [i]
                    b = rank >> 6
                    low[b] |= 1 << (rank & 63)
                    top |= 1 << b
        while top:
            b = (top & -top).bit_length() - 1
            word = low[b]
            rank = b << 6 | (word & -word).bit_length() - 1
            bucket, lower = waiting[rank], False
            while bucket and not lower:
                i = heappop(bucket)
                if ranks_at[i] != rank:
                    continue  # stale: one side has been merged away
                j = ends[i]
                end = ends[i] = ends[j]
                ranks_at[j] = None
                prev[end] = i  # at the mark at the latest
                h = prev[i]
                changed = get(row[i:ends[end]]) if end < n - 1 else None
                if ranks_at[i] != changed:
                    ranks_at[i] = changed
                    if changed is not None:
                        if changed in waiting:
                            heappush(waiting[changed], i)
                        else:
                            waiting[changed] = [i]
                            b = changed >> 6
                            low[b] |= 1 << (changed & 63)
                            top |= 1 << b
                        lower = changed < rank
                if h >= 0:
                    changed = get(row[h:end])
                    if ranks_at[h] != changed:
                        ranks_at[h] = changed
                        if changed is not None:
                            if changed in waiting:
                                heappush(waiting[changed], h)
                            else:
                                waiting[changed] = [h]
                                b = changed >> 6
                                low[b] |= 1 << (changed & 63)
                                top |= 1 << b
                            lower = lower or changed < rank
            if not bucket:
                del waiting[rank]
                b = rank >> 6
                low[b] &= ~(1 << (rank & 63))
                if not low[b]:
                    top &= ~(1 << b)
        out, i, ranks = [], 0, self.ranks
        for w in words:
            end, ids = i + len(w), []
            while i < end:
                ids.append(ranks[row[i:ends[i]]])
                i = ends[i]
            out.append(tuple(ids))
            i = end + 1
        return out

    def learn(self, tokens: set[str]) -> None:
        """Merge the pre-tokens that are not known; those that are tokens themselves need no merge."""
        known, get = self.known, self.ranks.get
        for t in self.long:
            known.pop(t, None)
            self.shown.pop(t, None)
        new = [t for t in tokens if t not in known]
        if len(known) + len(new) > self.keep:
            known.clear()
            self.shown.clear()
            new = list(tokens)
        self.long = [t for t in new if len(t) > 64]
        left, held = [], 0
        for t in new:
            rank = get(w := t.encode())
            if rank is not None:
                known[t] = (rank,)
                continue
            left.append((t, w))
            held += len(w)
            if held > GATHER:
                known.update(zip([t for t, _ in left], self.merge_all([w for _, w in left])))
                left, held = [], 0
        known.update(zip([t for t, _ in left], self.merge_all([w for _, w in left])))

    def tokens(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of every text, all of them known until the next call."""
        found = list(map(self.split, texts))
        self.learn(set(chain.from_iterable(found)))
        return found

    def ids(self, tokens: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, tokens)))

    def encode(self, text: str) -> list[int]:
        return self.ids(self.tokens([text])[0])

    def digests(self, tokens: list[str]) -> tuple[int, str, str]:
        """Number of ids, and the digests of their digits and of the bytes they decode to."""
        shown, known, found = self.shown, self.known, []
        for t in tokens:
            own = shown.get(t)
            if own is None:
                ids = known[t]
                own = shown[t] = (len(ids), self.digits(ids), self.decode(ids))
            found.append(own)
        sizes, digits, blobs = zip(*found) if found else ((), (), ())
        return sum(sizes), sha(",".join(digits).encode()), sha(b"".join(blobs))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digits(self, ids: list[int]) -> str:
        return ",".join(map(self.digits_of.__getitem__, ids))


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, columns: dict[str, tuple[str, pa.DataType]], found) -> DataFrame:
    ranks = read_ranks(ranks_path)
    name = sha(b"".join(b"%s %d\n" % x for x in ranks.items()))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one fixed vocabulary file

    def run(batches):
        codec = kept(("codec", name, pattern), lambda: Codec(shared.value, pattern))
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                rows = [found(codec, tokens) for tokens in codec.tokens(piece.column(1).to_pylist())]
                made = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays([piece.column(0), *made], names=["doc_id", *columns])

    return texts(docs).mapInArrow(run, ", ".join(["doc_id bigint", *[f"{c} {t}" for c, (t, _) in columns.items()]]))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids: the token ids of every whole text, as one array.

    A null text counts as empty and gives no ids. Every match of ``pattern`` is merged by itself, the
    lowest rank first and the leftmost of equal ranks; special tokens have no meaning. Rows are
    independent, so repeated rows give repeated results. An empty table gives no rows.
    """
    columns = {"n_tokens": ("bigint", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32()))}
    return _mapped(docs, ranks_path, pattern, columns, lambda codec, tokens: (len(ids := codec.ids(tokens)), ids))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again."""
    columns = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _mapped(docs, ranks_path, pattern, columns, Codec.digests)
