"""Ranked lexical search with hashed max-sketches.

A document is folded into a sketch: its terms fall by hash into ``WIDTH`` coordinates, and a coordinate holds
the largest impact of the terms in it. For a query, the weighted sum of the coordinates of its terms is an
upper bound of the score. Documents are rescored exactly in descending order of their bounds, until a bound
falls below the lowest score among the best ``k``.

A task goes over its documents once, in pieces; it holds one piece of text, the sketches of that piece and the
best ``k`` of every query. Queries are taken in blocks of a fixed number of items and bytes, and only such a
block is broadcast. All numbers are integers below 2^53 where they pass through floats, so bounds are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import pieces, texts

#: Coordinates of a sketch; bytes of text in one piece; documents rescored at a time.
WIDTH, PIECE, STEP = 4096, 1 << 20, 32
#: Bounds of one block of queries.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 1 << 22
#: Letters and digits of ASCII and all bytes of other characters make up terms; A-Z become lower case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Query:
    """The distinct terms of an item, as numbers in the block's vocabulary, and how often each occurs."""

    item: int | None
    terms: np.ndarray
    times: np.ndarray


@dataclass
class Block:
    vocabulary: dict[bytes, int]
    queries: list[Query]

    @classmethod
    def of(cls, items: list[tuple[int | None, bytes]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        queries = []
        for item, text in items:
            counted = Counter(terms_of(text))
            ids = [vocabulary.setdefault(t, len(vocabulary)) for t in counted]
            queries.append(Query(item, np.array(ids, np.int64), np.array(list(counted.values()), np.int64)))
        return cls(vocabulary, queries)


def query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The items in blocks. Repeated rows count once; null texts and texts without terms are left out."""
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text")).dropna(subset=["text"]).distinct()
    held: list[tuple[int | None, bytes]] = []
    size = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        text = r.text.encode()
        if held and (len(held) >= BLOCK_ITEMS or size + len(text) > BLOCK_BYTES):
            yield Block.of(held)
            held, size = [], 0
        if terms_of(text):
            held.append((r.item_id, text))
            size += len(text)
    if held:
        yield Block.of(held)


@dataclass
class Corpus:
    """N, L and the number of documents that hold each term of a block."""

    n_docs: int
    n_terms: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([floor(1000 * log((2 * self.n_docs + 2) / (2 * int(df) + 1))) for df in self.holding], np.int64)

    def norm(self, length: int) -> int:
        return 75 + (25 * length * self.n_docs) // self.n_terms


def corpus_counts(docs: DataFrame, block: Block) -> Corpus:
    """One pass over all texts; a task sends one row, with a count for each term of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches):
        vocabulary = shared.value
        n_docs, n_terms, holding = 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for t in batch.column(0):
                terms = terms_of(t.as_py())
                if terms:
                    n_docs += 1
                    n_terms += len(terms)
                    for term in vocabulary.keys() & set(terms):
                        holding[vocabulary[term]] += 1
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, [-1, -2])), pa.array(np.append(holding[at], [n_docs, n_terms]))], names=["term", "n"]
        )

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in counted.collect()}  # at most the terms of one block, and two totals
    holding = np.zeros(len(block.vocabulary), np.int64)
    for term, n in found.items():
        if term >= 0:
            holding[term] = n
    return Corpus(found.get(-1, 0), found.get(-2, 0), holding)


class Piece:
    """Sketches and exact impacts of the documents of one piece."""

    def __init__(self, found: list[list[bytes]], vocabulary: dict[bytes, int], corpus: Corpus, width: int):
        counted = [Counter(terms) for terms in found]
        sizes = np.fromiter(map(len, counted), np.int64, len(counted))
        doc = np.repeat(np.arange(len(counted)), sizes)
        tf = np.fromiter(chain.from_iterable(c.values() for c in counted), np.int64, len(doc))
        norms = np.fromiter((corpus.norm(len(terms)) for terms in found), np.int64, len(found))
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * norms[doc])
        flat = list(chain.from_iterable(counted))
        place = np.fromiter(map(crc32, flat), np.int64, len(flat)) % width
        # one row for each coordinate, so that a query reads whole rows
        self.sketch = np.zeros((width, len(found)))
        np.maximum.at(self.sketch.reshape(-1), place * len(found) + doc, impact.astype(np.float64))
        number = np.fromiter(map(vocabulary.get, flat, repeat(-1)), np.int64, len(flat))
        known = number >= 0
        self.n_terms = len(vocabulary)
        keys = doc[known] * self.n_terms + number[known]
        order = np.argsort(keys)
        self.keys, self.impacts = keys[order], impact[known][order]

    def bounds(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return weights @ self.sketch[places]

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(docs), np.int64)
        wanted = docs[:, None] * self.n_terms + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.impacts[at], 0) @ weights


class Best:
    """The best ``k`` of one query so far: higher scores first, then smaller identifiers, null ones last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.missing, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def least(self) -> int:
        """No document with a bound below this can enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, missing: np.ndarray, doc: np.ndarray) -> None:
        score, missing, doc = np.append(self.score, score), np.append(self.missing, missing), np.append(self.doc, doc)
        order = np.lexsort((doc, missing, -score))
        order = order[score[order] > 0][:self.k]
        self.score, self.missing, self.doc = score[order], missing[order], doc[order]


def best_documents(docs: DataFrame, block: Block, corpus: Corpus, k: int, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """(item_id, doc_id, score, task): the best ``k`` of every query among the documents of a task."""
    shared = docs.sparkSession.sparkContext.broadcast((block, corpus, corpus.weights()))

    def run(batches):
        block, corpus, weights = shared.value
        place_of = np.array([crc32(t) % width for t in block.vocabulary], np.int64)
        own = [weights[q.terms] * q.times for q in block.queries]
        best = [Best(k) for _ in block.queries]
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                found = [terms_of(t.as_py()) for t in part.column(1)]
                ids = part.column(0)
                missing, doc = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
                piece = Piece(found, block.vocabulary, corpus, width)
                for query, w, top in zip(block.queries, own, best):
                    bound = piece.bounds(place_of[query.terms], w.astype(np.float64))
                    order = np.flatnonzero(bound >= top.least())
                    order = order[np.argsort(-bound[order])]
                    for start in range(0, len(order), step):
                        some = order[start:start + step]
                        some = some[bound[some] >= top.least()]
                        if not len(some):
                            break
                        top.add(piece.scores(some, query.terms, w), missing[some], doc[some])
        items = [q.item for q, top in zip(block.queries, best) for _ in top.score]
        score = np.concatenate([top.score for top in best])
        missing = np.concatenate([top.missing for top in best])
        doc = pa.array(np.concatenate([top.doc for top in best]), pa.int64(), mask=missing)
        task = np.full(len(score), TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), doc, pa.array(score), pa.array(task)], names=["item_id", "doc_id", "score", "task"])

    numbered = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return numbered.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint, task bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           width: int = WIDTH, step: int = STEP) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: item_id, rank, doc_id, score.

    Terms are maximal runs of ASCII letters, digits and other than ASCII characters, A-Z in lower case. Only
    scores above 0 count; equal scores go by ascending identifier, null identifiers last. Every row of
    ``docs`` is a document: null texts and texts without terms never match, repeated rows each take a rank.
    Repeated rows of ``items`` count once, items without terms get no rows, and no documents give no rows.
    A sketch has ``width`` coordinates; ``step`` documents are rescored at a time.
    """
    own = texts(docs, id_col, text_col)
    found = None
    for block in query_blocks(items, item_col, item_text):
        corpus = corpus_counts(own, block)
        if not corpus.n_docs:
            continue
        some = best_documents(own, block, corpus, k, width, step)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return own.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # the lists of many tasks meet in 64 parts of an item first
    some = found.withColumn("part", F.col("task") % 64).withColumn("n", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("n") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
