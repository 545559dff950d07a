"""Alignment of two tokenizations of a text.

Tokenizer A (byte-level BPE, of space + text) and tokenizer B (pieces with byte fallback, which adds the space
itself) cover the same bytes. Dictionaries from the byte offset at which a token ends to its index are
intersected as sets; the sorted common offsets slice both id lists into groups, and every slice is expanded
into links, the A-B token pairs whose bytes overlap.

Neither tokenizer joins bytes across a single space between two words, so a word and the space before it is
aligned by itself, and remembered. Texts with other white space before a space, or that a tokenizer does not
give back, are aligned as a whole.

Corpus-wide counts of id pairs are exchanged by chunk: a chunk is a run of documents of one input partition,
of at most ``CHUNK`` bytes unless one document is longer. It sends each of its distinct pairs once with the
number of documents that hold it, and gets the sums back. Documents wait in the checkpoint as packed lists of
places in the chunk's pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import kept, pieces, texts
from eventloom.session import cut_lineage

#: Bytes of text in one step, characters tokenized at once, bytes of text in one chunk, words and links remembered.
PIECE, BATCH, CHUNK, KEEP = 1 << 20, 1 << 18, 1 << 24, (300_000, 4_000_000)
#: A space that does not part two words.
UNEVEN = re.compile(r"\s |^ | $")
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


def in_letters(token: str, letters: dict[str, int]) -> bytes:
    return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()


class Side:
    """One tokenizer: bytes of every id, and every id written before a separator."""

    def __init__(self, token_bytes: list[bytes], seps: tuple[str, str]):
        self.bytes = token_bytes
        self.lengths = np.array([len(t) for t in token_bytes], np.int64)
        self.inner, self.last = (np.array([b"%d%s" % (i, s.encode()) for i in range(len(token_bytes))], object) for s in seps)

    def checked(self, found: list[list[int]], whole: list[bytes]) -> list[bool]:
        token = self.bytes.__getitem__
        return [b"".join(map(token, ids)) == text for ids, text in zip(found, whole)]


#: The split of a byte-level tokenizer that brings its own (a fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merges_by_rank(content: dict, of_a: list[bytes], letters: dict[str, int]) -> dict[bytes, int] | None:
    """Ranks of the tokens, if the file is plain byte-level BPE whose n-th merge makes the n-th token after the bytes; else None.

    Merging pairs in the order of the list is then the same as merging by the rank of what they make.
    """
    model, before = content["model"], content.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and content.get("normalizer") is None
    if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    for at, merge in enumerate(model["merges"], start=256):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if of_a[at] != in_letters(left, letters) + in_letters(right, letters):
            return None
    return {of_a[i]: i for i in range(256 + len(model["merges"]))}


class Aligner:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        of_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            of_a[i] = in_letters(token, letters)
        self.by_rank = None
        ranks = merges_by_rank(json.loads(a_json), of_a, letters)
        if ranks is not None:
            import tiktoken

            self.by_rank = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        of_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.side_a, self.side_b = Side(of_a, (",", "|")), Side(of_b, (",", ";"))
        self.width = len(of_b)

    def encode_a(self, batch: list[str]) -> list[list[int]]:
        """Ids of space + text; plain byte-level BPE by ranks, which is faster, any other by its own library."""
        if self.by_rank is not None:
            return [self.by_rank.encode_ordinary(" " + t) for t in batch]
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in batch], add_special_tokens=False)]

    def separable(self) -> bool:
        """Does a single space between two words always part tokens, on both sides?

        The piece model must leave its input as it is and have no piece with a space after another character;
        a byte-level vocabulary with its own pattern starts a token at such a space.
        """
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        before = self.a.pre_tokenizer
        sample = [t for t, _ in before.pre_tokenize_str(" one two,\nthree 4's")] if before is not None else []
        letters = {chr(256 + 32)}
        a_parts = sample and all(letters.isdisjoint(t[1:]) for t in sample)
        trial = "\u0041\u030a  \ufb01 \u3000x\t y"
        plain = self.b.normalize(trial).replace("▁", " ").strip(" ") == trial
        return bool(a_parts and plain and not any(re.search("[^▁]▁", p) for p in pieces))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, batch: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both sides, and whether both give the text back; no ids otherwise and for empty texts."""
        ids_a = self.encode_a(batch)
        ids_b = self.b.encode(batch, num_threads=1)
        whole = [b" " + t.encode() for t in batch]
        good = [bool(t) and x and y for t, x, y in zip(batch, self.side_a.checked(ids_a, whole), self.side_b.checked(ids_b, whole))]
        return [x if g else [] for x, g in zip(ids_a, good)], [x if g else [] for x, g in zip(ids_b, good)], good


class Alignment:
    """Groups and links of the texts of one piece, laid end to end.

    The ends of a document are common to both sides, so no group crosses documents.
    """

    def __init__(self, aligner: Aligner, batch: list[str]):
        found_a, found_b, self.good = aligner.encode(batch)
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(batch)) for x in (found_a, found_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((found_a, self.n_a), (found_b, self.n_b)))
        end_a, end_b = (dict(zip(np.cumsum(side.lengths[ids]).tolist(), range(len(ids)))) for side, ids in ((aligner.side_a, a), (aligner.side_b, b)))
        common = sorted(end_a.keys() & end_b.keys())
        last_a, last_b = (np.fromiter(map(ends.__getitem__, common), np.int64, len(common)) for ends in (end_a, end_b))
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        doc_a = np.repeat(np.arange(len(batch)), self.n_a)
        self.n_groups = np.bincount(doc_a[last_a], minlength=len(batch))
        link_a, link_b = links(last_a, last_b, size_a, size_b, lambda i, ids=a, n=aligner.side_a.lengths: n[ids[i]], lambda j, ids=b, n=aligner.side_b.lengths: n[ids[j]])
        self.link_doc, self.link_pair = doc_a[link_a], a[link_a] * aligner.width + b[link_b]
        self.n_links = np.bincount(self.link_doc, minlength=len(batch))
        # a group takes its A tokens, then its B tokens; a token's place follows from the tokens before its group
        group_a, group_b = np.repeat(np.arange(len(common)), size_a), np.repeat(np.arange(len(common)), size_b)
        self.parts = np.empty(len(a) + len(b), object)
        for side, ids, last, place in (
            (aligner.side_a, a, last_a, np.arange(len(a)) + (last_b - size_b + 1)[group_a]), (aligner.side_b, b, last_b, np.arange(len(b)) + (last_a + 1)[group_b]),
        ):
            self.parts[place] = side.inner[ids]
            self.parts[place[last]] = side.last[ids[last]]

    def written(self) -> list[bytes]:
        """The groups of every text as ``a1,a2|b1;a3|b2,b3``."""
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(self.parts[start:end].tolist())[:-1] for start, end in zip([0, *ends], ends)]


class Memory:
    """Alignments of words, and for the time of one step of whole texts: numbers, written groups and pairs of links."""

    def __init__(self, aligner: Aligner, keep: tuple[int, int] = KEEP):
        self.aligner, self.keep = aligner, keep
        self.separable = aligner.separable()
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.good: list[bool] = []
        self.groups: list[bytes] = []
        self.numbers = np.zeros((len(NUMBERS), 0), np.int64)
        self.starts, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn(self, texts: list[str]) -> int:
        """Align the texts; the place of the first one."""
        first, start, size = len(self.good), 0, 0
        parts = []
        for at, t in enumerate(texts):
            size += len(t)
            if size >= BATCH or at == len(texts) - 1:
                parts.append(Alignment(self.aligner, texts[start:at + 1]))
                start, size = at + 1, 0
        for part in parts:
            self.good += part.good
            self.groups += [g + b";" if g else b"" for g in part.written()]
        if parts:
            self.numbers = np.concatenate([self.numbers, *[np.stack([getattr(p, n) for n in NUMBERS]) for p in parts]], axis=1)
            self.starts = np.concatenate([[0], np.cumsum(self.numbers[NUMBERS.index("n_links")])])
            self.pairs = np.concatenate([self.pairs, *[p.link_pair[np.argsort(p.link_doc, kind="stable")] for p in parts]])
        return first

    def align(self, batch: list[str], width: int) -> tuple[np.ndarray, list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers and written groups of every text, and (text, pair, times) of its distinct pairs, in that order."""
        if len(self.good) > self.keep[0] or len(self.pairs) > self.keep[1]:
            self.clear()
        words = [t.split(" ") if self.separable and t and not UNEVEN.search(t) else None for t in batch]
        new = list(set().union(*[ws for ws in words if ws]) - self.known.keys())
        first = self.learn(new)
        self.known.update(zip(new, range(first, first + len(new))))
        places = [list(map(self.known.__getitem__, ws)) if ws else None for ws in words]
        alone = [k for k, (t, at) in enumerate(zip(batch, places)) if t and (at is None or not all(map(self.good.__getitem__, at)))]
        first = self.learn([batch[k] for k in alone])
        for at, k in enumerate(alone):
            places[k] = [first + at]
        places = [at or [] for at in places]
        sizes = np.fromiter(map(len, places), np.int64, len(places))
        doc = np.repeat(np.arange(len(places)), sizes)
        flat = np.fromiter(chain.from_iterable(places), np.int64, len(doc))
        numbers = np.stack([np.bincount(doc, weights=row[flat], minlength=len(batch)).astype(np.int64) for row in self.numbers])
        groups = [b"".join(map(self.groups.__getitem__, at))[:-1] for at in places]
        counts = np.diff(self.starts)[flat]
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        pair = self.pairs[np.repeat(self.starts[flat], counts) + inside]
        keys, times = np.unique(np.repeat(doc, counts) * width + pair, return_counts=True)
        if alone:
            self.known = {w: at for w, at in self.known.items() if at < first}
        return numbers, groups, (keys // width, keys % width, times)


def links(last_a, last_b, size_a, size_b, length_a, length_b) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the A and B tokens of every link, slice by slice. A slice with one token on a side links it to all of the other."""
    first_a, first_b = last_a - size_a + 1, last_b - size_b + 1
    group_a, group_b = np.repeat(np.arange(len(last_a)), size_a), np.repeat(np.arange(len(last_b)), size_b)
    one_a = size_a == 1
    one_b = (size_b == 1) & ~one_a
    under_a, over_b = np.flatnonzero(one_a[group_b]), np.flatnonzero(one_b[group_a])
    more_a, more_b = [], []
    for g in np.flatnonzero(~one_a & ~one_b).tolist():
        i, j, end_i, end_j = int(first_a[g]), int(first_b[g]), int(last_a[g]), int(last_b[g])
        at_a, at_b = int(length_a(i)), int(length_b(j))
        while True:
            more_a.append(i)
            more_b.append(j)
            if i == end_i and j == end_j:
                break
            if at_a < at_b:
                i += 1
                at_a += int(length_a(i))
            else:
                j += 1
                at_b += int(length_b(j))
    return (
        np.concatenate([first_a[group_b[under_a]], over_b, np.array(more_a, np.int64)]),
        np.concatenate([under_a, first_b[group_a[over_b]], np.array(more_b, np.int64)]),
    )


class Chunk:
    """Documents whose pairs are sent together."""

    def __init__(self):
        self.ids, self.numbers, self.groups, self.sizes, self.pairs, self.times = [], [], [], [], [], []
        self.n_bytes = 0

    def add(self, ids: pa.Array, numbers: np.ndarray, groups: list[bytes], distinct: tuple[np.ndarray, np.ndarray, np.ndarray], n_bytes: int) -> None:
        doc, pair, times = distinct
        self.ids.append(ids)
        self.numbers.append(list(numbers))
        self.groups += groups
        self.sizes.append(np.bincount(doc, minlength=len(ids)))
        self.pairs.append(pair)
        self.times.append(times)
        self.n_bytes += n_bytes

    def packed(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The documents as a compressed batch, the distinct pairs with the most frequent first, and their document counts."""
        pairs, place, counts = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sizes = np.concatenate(self.sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at, times = rank[place], np.concatenate(self.times)
        inside = np.lexsort((at, doc))
        at, times = at[inside], times[inside]
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        step = np.diff(at, prepend=0)
        step[starts] = at[starts]
        offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        columns = [
            pa.concat_arrays(self.ids), *[pa.array(np.concatenate(x)) for x in zip(*self.numbers)], pa.array(self.groups, pa.binary()),
            pa.ListArray.from_arrays(offsets, pa.array(step.astype(np.uint32))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.uint32))),
        ]
        batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", *NUMBERS, "groups", "step", "times"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes(), pairs[order], counts[order]


def unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def chunks_of(docs: DataFrame, a_path: str, b_path: str, digest: bool, chunk_bytes: int, keep: tuple[int, int]) -> DataFrame:
    """(chunk, docs, pairs, counts): one row for each chunk."""
    with open(a_path, "rb") as one, open(b_path, "rb") as two:
        files = (one.read(), two.read())
    name = hashlib.sha256(b"\n".join(files)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(files)  # two fixed vocabulary files

    def run(batches):
        memory = kept(("alignments", name, keep), lambda: Memory(Aligner(*shared.value), keep))
        width = len(memory.aligner.side_a.bytes) * memory.aligner.width
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()

        def sent(number: int, chunk: Chunk) -> pa.RecordBatch:
            blob, pairs, counts = chunk.packed()
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([blob], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))],
                names=["chunk", "docs", "pairs", "counts"],
            )

        for batch in batches:
            for part in pieces(batch, "text", min(PIECE, chunk_bytes)):
                n_bytes = part.column(1).nbytes
                if chunk.ids and chunk.n_bytes + n_bytes > chunk_bytes:
                    yield sent(number, chunk)
                    number, chunk = number + 1, Chunk()
                numbers, groups, distinct = memory.align(part.column(1).to_pylist(), width)
                if digest:
                    groups = [hashlib.sha256(g).hexdigest().encode() if g else b"" for g in groups]
                chunk.add(part.column(0), numbers, groups, distinct, n_bytes)
        if chunk.ids:
            yield sent(number, chunk)

    return docs.mapInArrow(run, "chunk bigint, docs binary, pairs array<bigint>, counts array<bigint>")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text",
                     chunk_bytes: int = CHUNK, keep: tuple[int, int] = KEEP) -> DataFrame:
    """Align both tokenizations of every whole text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3``, or with ``digest`` the SHA-256 of that. A link is a pair of
    token occurrences whose bytes overlap; the count of an id pair is the number of documents of the corpus
    that hold it linked. n_best counts the links whose count is the highest of their A id, count_sum adds up
    the counts of all links. Null and empty texts, and texts that a tokenizer does not give back byte by
    byte, have no tokens: zeros and ''. Repeated rows are documents of their own; an empty table gives no rows.
    """
    with open(a_path, "rb") as one:
        n_a = 1 + max(json.load(one)["model"]["vocab"].values())
    chunks = cut_lineage(chunks_of(texts(docs, id_col, text_col), a_path, b_path, digest, chunk_bytes, keep))
    pair = F.explode(F.arrays_zip("pairs", "counts")).alias("x")
    counts = cut_lineage(chunks.select(pair).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n")))
    width = pieces_of(b_path)
    # one row for each id of A at most, a fixed vocabulary
    best = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(best) if n_a < 1_000_000 else best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = chunks.select(F.col("chunk").alias("to"), F.posexplode("pairs").alias("at", "pair")).join(judged, "pair").select("to", "at", "n", "best")

    def answered(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        rows = unpacked(left.column("docs")[0].as_py())
        step, times, sizes = rows.column("step").flatten().to_numpy().astype(np.int64), rows.column("times").flatten().to_numpy().astype(np.int64), np.diff(rows.column("step").offsets.to_numpy())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        run = np.cumsum(step)
        starts = np.cumsum(sizes) - sizes
        place = run - np.append(0, run)[starts][doc]
        totals = []
        for value in (best, n):
            total = np.zeros(len(sizes), np.int64)
            np.add.at(total, doc, value[place] * times)
            totals.append(pa.array(total))
        return pa.table([rows.column("doc_id"), *[rows.column(c) for c in NUMBERS], *totals, rows.column("groups").cast(pa.string())], names=names)

    names = ["doc_id", *NUMBERS, "n_best", "count_sum", "groups"]
    schema = ", ".join([*[f"{c} bigint" for c in names[:-1]], "groups string"])
    return chunks.select("chunk", "docs").groupBy("chunk").cogroup(asked.groupBy("to")).applyInArrow(answered, schema)


def pieces_of(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
