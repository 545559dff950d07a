"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax on top."""

from __future__ import annotations

from collections import Counter
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import fold, kept, pieces, sha, texts
from eventloom.session import cut_lineage

#: Bytes of text scored at once, and the multiplier of the subword hashes.
CHUNK, BASE = 1 << 20, np.uint64(0x9E3779B97F4A7C15)
END = "</s>"
#: Stands beside every word that equals the word before it: the word bigrams of equal words share it.
AGAIN = "\x00again"


def marks(words: list[str]) -> list[str]:
    """One mark for every word said twice in a row, and the end mark."""
    return [AGAIN] * sum(map(eq, words, words[1:])) + [END]


def words_of(text: str) -> list[str]:
    """White-space words with their marks."""
    words = text.split()
    return words + marks(words)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def subwords(words: list[str], buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of their character n-grams between word marks, and the word that each belongs to."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    word, at = np.repeat(np.arange(len(marked)), lengths), np.arange(len(codes))
    powers = np.cumprod(np.full(lengths.max(initial=1), BASE, np.uint64))
    hashes, owners = [np.add.reduceat(codes * powers[at - starts[word]], starts)], [np.arange(len(marked))]
    ends = (starts + lengths)[word]
    for n in sizes:
        m = max(0, len(codes) - n + 1)
        gram = np.full(m, n, np.uint64)
        for k in range(n):
            gram = gram * BASE + codes[k:k + m]
        inside = at[:m] + n <= ends[:m]
        hashes.append(gram[inside])
        owners.append(word[:m][inside])
    return (mix(np.concatenate(hashes)) % np.uint64(buckets)).astype(np.int64), np.concatenate(owners)


class SubwordModel:
    """Vectors for hashed subwords and a softmax layer.

    A document is the mean of the vectors of all subwords of all its white-space words, of the repeat
    marks and of one end mark, so the empty text has a vector too. ``fit`` is plain stochastic gradient descent, one
    document at a time, with a linearly falling rate.
    """

    def __init__(self, n_classes: int, dim: int = 10, buckets: int = 1 << 17, sizes: tuple[int, ...] = (3, 4), seed: int = 7):
        self.n_classes, self.buckets, self.sizes = n_classes, buckets, sizes
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.out = np.zeros((n_classes, dim), np.float32)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a text and how often each occurs, in few bytes: all training texts are held so at once."""
        counted = Counter(words_of(text))
        ids, owner = subwords(list(counted), self.buckets, self.sizes)
        weights = np.fromiter(counted.values(), np.float64, len(counted))[owner]
        ids, place = np.unique(ids, return_inverse=True)
        times = np.bincount(place, weights=weights)
        return ids.astype(np.int32), times.astype(np.min_scalar_type(int(times.max())))

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a text and their shares."""
        ids, times = self.counts(text)
        return ids, shares(times)

    def fit(self, rows: list[tuple[str, int]], epochs: int = 5, rate: float = 3.0, seed: int = 11) -> SubwordModel:
        docs = [(*self.counts(text), label) for text, label in rows]
        rng, steps, step = np.random.default_rng(seed), max(1, epochs * len(docs)), 0
        for _ in range(epochs):
            for k in rng.permutation(len(docs)):
                ids, times, label = docs[k]
                share = shares(times)
                own = self.vectors[ids]
                hidden = share @ own
                p = softmax(self.out @ hidden)
                p[label] -= 1.0
                pace = rate * (1 - step / steps)
                back = p @ self.out
                self.out -= pace * np.outer(p, hidden)
                self.vectors[ids] = own - (pace * share)[:, None] * back
                step += 1
        return self

    def folded(self) -> np.ndarray:
        """Class logits of every bucket. Mean and output layer are linear, so logits can be averaged instead of vectors."""
        return self.vectors.astype(np.float64) @ self.out.T.astype(np.float64)


def shares(times: np.ndarray) -> np.ndarray:
    return (times / times.sum()).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Scorer:
    """Class probabilities of whole texts; remembers the logit sums of up to ``keep`` words."""

    def __init__(self, folded: np.ndarray, sizes: tuple[int, ...], keep: int = 400_000):
        self.logits, self.sizes, self.keep = folded, sizes, keep
        self.known: dict[str, int] = {}
        self.sums = np.zeros((0, folded.shape[1] + 1))

    def learn(self, words: list[str]) -> None:
        """Add up the logits of the subwords of words not met before."""
        if len(self.known) + len(words) > self.keep:
            self.known, self.sums = {}, self.sums[:0]
        new = [w for w in words if w not in self.known]
        if not new:
            return
        ids, owner = subwords(new, len(self.logits), self.sizes)
        sums = [np.bincount(owner, weights=column[ids], minlength=len(new)) for column in self.logits.T]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.sums = np.concatenate([self.sums, np.stack([*sums, np.bincount(owner, minlength=len(new))], axis=1)])

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words, and class probabilities, of every text."""
        docs = [text.split() for text in texts]
        n_words = np.fromiter(map(len, docs), np.int64, len(docs))
        for doc in docs:
            doc += marks(doc)
        words = list(chain.from_iterable(docs))
        self.learn(list(set(words)))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        total = np.add.reduceat(self.sums[at], np.cumsum(lengths) - lengths, axis=0)
        return n_words, softmax(total[:, :-1] / total[:, -1:])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int) -> list[tuple[str, int]]:
    """Texts of at most ``per_class`` labelled rows of every class, no text above ``most_bytes``.

    ``labels`` has (doc_id, cls) with a bounded number of classes; repeated identifiers with the same
    class count once. Rows are taken by a hash of the identifier, so the sample does not depend on
    partitions. Labels without such a text do not count. The result is bounded by classes x per_class x
    most_bytes, here a few MB in practice.
    """
    usable = docs.filter(F.octet_length("text") <= most_bytes).select("doc_id")
    known = cut_lineage(labels.select("doc_id", "cls").distinct().join(usable, "doc_id", "left_semi"))
    classes = sorted(r[0] for r in known.select("cls").distinct().collect())
    chosen = None
    for c in classes:
        some = known.filter(F.col("cls") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return []
    # the sample has at most classes x per_class identifiers
    rows = (
        docs.join(F.broadcast(chosen), "doc_id").filter(F.octet_length("text") <= most_bytes)
        .select("doc_id", "text", "cls").toArrow()
    )
    order = pc.sort_indices(rows, [("doc_id", "ascending"), ("cls", "ascending"), ("text", "ascending")])
    seen: set[tuple[int, int]] = set()
    out = []
    ids, cls = rows["doc_id"].to_pylist(), rows["cls"].to_pylist()
    for at in order.to_pylist():
        if (ids[at], cls[at]) not in seen:
            seen.add((ids[at], cls[at]))
            out.append((rows["text"][at].as_py(), cls[at]))
    return out


def posteriors(docs: DataFrame, model: SubwordModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all but the text) of every row, with n_words and p.

    p holds the class probabilities of the whole text, null counting as empty. The columns of ``docs``
    must not be called n_words or p.
    """
    folded = model.folded()
    name, sizes = sha(folded.tobytes()), model.sizes
    shared = docs.sparkSession.sparkContext.broadcast(folded)  # buckets x classes, whatever the corpus
    fields = [f for f in docs.schema.fields if (f.name in keep if keep is not None else f.name != text_col)]

    def run(batches):
        scorer = kept(("scorer", name), lambda: Scorer(shared.value, sizes))
        for batch in batches:
            for piece in pieces(batch, text_col, CHUNK):
                n_words, p = scorer.score([t.as_py() or "" for t in piece.column(text_col)])
                columns = [*[piece.column(f.name) for f in fields], pa.array(n_words), pa.array(list(p), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in fields], "n_words", "p"])

    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    return docs.select(*dict.fromkeys([*[f.name for f in fields], text_col])).mapInArrow(run, schema)


def scored_rows(docs: DataFrame, model: SubwordModel, text_col: str = "text") -> tuple[DataFrame, list]:
    """``docs`` under safe names with n_words and p, and the expressions that give its columns back."""
    safe = [f"c{i}__" for i in range(len(docs.columns))]
    scored = posteriors(docs.toDF(*safe), model, safe[docs.columns.index(text_col)], safe)
    return scored, [F.col(s).alias(c) for s, c in zip(safe, docs.columns)]


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_bytes: int = 1 << 16) -> SubwordModel:
    """Train on (doc_id, cls in 0/1) labels; without any labelled row the model gives 0.5 everywhere."""
    return SubwordModel(2).fit(labelled_sample(docs, labels, per_class, most_bytes))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", per_class: int = 1500, folds: int = 5) -> DataFrame:
    """Score every whole text by a model learned from labels outside the held-out fold.

    Returns doc_id, held_out (crc32 of the identifier modulo ``folds`` is 0), score (probability of
    label 1; also for empty and null texts) and predicted (1 from ``threshold`` on). Only the text
    enters a score. Null labels or identifiers teach nothing; repeated documents score alike.
    """
    own = texts(docs, id_col, text_col)
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("cls"))
        .filter(F.col("doc_id").isNotNull() & F.col("cls").isin(0, 1) & (fold(F.col("doc_id"), folds) != 0))
    )
    model = fit_quality(own, known, per_class)
    return posteriors(own, model).select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), F.col("p")[1].alias("score"),
        (F.col("p")[1] >= threshold).cast("int").alias("predicted"),
    )


def keep_sound(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 1500) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that ``score_quality`` predicts to be good, columns unchanged."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("cls")).filter(
        F.col("doc_id").isNotNull() & F.col("cls").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0)
    )
    scored, back = scored_rows(docs, fit_quality(texts(docs), known, per_class))
    return scored.filter(F.col("p")[1] >= threshold).select(*back)
