"""Ranked search, tokenizer alignment and quality rules against plain forms."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, score string, item_id int, kept boolean, chunk int, rule string"


def rows_of(texts: list[str | None]) -> list[tuple]:
    return [(i, t, None, "s", 1, False, 2, "r") for i, t in enumerate(texts, start=4)]


def some_texts() -> list[str | None]:
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéñß", k=rng.randint(1, 7))) for _ in range(300)]
    texts: list[str | None] = [None, "", "  \t\n", "one", "One ONE one-two", "É É é", "x" * 5000, "7 " * 900, " lead", "trail ", "two  spaces", "tab \there", "a\n b\n\n  c", "ﬁne 　 Å", "nul\x00 byte"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)]
    texts += ["tie terms here"] * 25 + [" ".join(words) * 3, "<|endoftext|> </s> <s> <unk> plain", "😀 emoji 😀😀 ok"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(some_texts()), SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_search(docs: list[tuple[int | None, str | None]], items: list[tuple[int, str]], k: int) -> set[tuple]:
    def terms(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)

    found = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n = sum(1 for _, _, size in found if size)
    total = sum(size for _, _, size in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = set()
    for item, text in items:
        scored = []
        for i, c, size in found:
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * size * n // total))) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out |= {(item, rank, None if missing else i, -s) for rank, (s, missing, i) in enumerate(sorted(scored)[:k], start=1)}
    return out


@pytest.mark.parametrize("width,step", [(4096, 32), (8, 3)])
def test_search(spark, docs, none, width, step, monkeypatch):
    from eventloom.llm import search as s

    monkeypatch.setattr(s, "BLOCK_ITEMS", 3)
    texts = some_texts()
    items = [(1, "One two tie"), (2, texts[20]), (3, texts[30] + " " + texts[31]), (4, "nothingofthekind"), (5, ""), (6, "one one One"), (7, "é É"), (8, "terms")]
    bench = spark.createDataFrame([*items, (9, None), (1, "One two tie")], "item_id bigint, text string")
    rows = [(r[0], r[1]) for r in rows_of(texts)] + [(None, texts[20]), (5, "tie tie"), (5, "tie tie")]
    more = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(*r, None) for r in rows[-3:]], "doc_id bigint, text string, score string"))
    got = [tuple(r) for r in s.search(more, bench, 20, width=width, step=step).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_search(rows, items, 20)
    assert s.search(none, bench).count() == 0 and s.search(more, bench.limit(0)).count() == 0


def plain_alignment(texts: dict) -> dict:
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    from eventloom.llm.align import byte_letters, in_letters

    one = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    letters = byte_letters()
    of_a = {i: in_letters(t, letters) for t, i in one.get_vocab().items()}

    def of_b(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(parts):
        ends = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
        return list(zip(ends, ends[1:]))

    found, counts = {}, Counter()
    for d, text in texts.items():
        whole = (" " + (text or "")).encode()
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        if b"".join(map(of_a.get, a)) != whole or b"".join(map(of_b, b)) != whole:
            a, b = [], []
        sa, sb = spans([of_a[i] for i in a]), spans([of_b(i) for i in b])
        links, j = [], 0
        for i, (s, e) in enumerate(sa):
            while j < len(sb) and sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        groups, before = [], 0
        for end in sorted({e for _, e in sa} & {e for _, e in sb}):
            groups.append("|".join(",".join(str(x) for x, (_, e) in zip(ids, sp) if before < e <= end) for ids, sp in ((a, sa), (b, sb))))
            before = end
        found[d] = (len(a), len(b), len(groups), links, ";".join(groups))
        counts.update(set(links))
    best: dict[int, int] = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return {d: (na, nb, ng, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), g) for d, (na, nb, ng, ls, g) in found.items()}


@pytest.mark.parametrize("chunk,keep", [(1 << 24, (300_000, 4_000_000)), (600, (5, 50))])
def test_alignment(spark, docs, none, chunk, keep):
    import public_tokenizers as public

    from eventloom.llm import align

    paths = (public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    want = plain_alignment({r[0]: r[1] for r in rows_of(some_texts())})
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = {r.doc_id: tuple(r[c] for c in names) for r in align.align_tokenizers(docs, *paths, chunk_bytes=chunk, keep=keep).collect()}
    assert got == want and any(w[0] == 0 for w in want.values()) and sum(w[0] > 0 for w in want.values()) > 60
    hashed = {r.doc_id: r.groups for r in align.align_tokenizers(docs, *paths, digest=True).collect()}
    assert hashed == {d: hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for d, w in want.items()}
    assert align.align_tokenizers(none, *paths).count() == 0


def test_rank_order_is_merge_order():
    """Every token of the file, merged by the ranks below its own, ends in the two parts of its merge; so ranks and merge list agree."""
    import public_tokenizers as public

    from eventloom.llm.align import byte_letters, in_letters, merges_by_rank

    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        content = json.load(file)
    letters = byte_letters()
    of_a = [b""] * (1 + max(content["model"]["vocab"].values()))
    for token, i in content["model"]["vocab"].items():
        of_a[i] = in_letters(token, letters)
    ranks = merges_by_rank(content, of_a, letters)
    assert ranks is not None
    for at, merge in enumerate(content["model"]["merges"], start=256):
        left, right = (in_letters(x, letters) for x in (merge.split(" ") if isinstance(merge, str) else merge))
        parts = [bytes([x]) for x in of_a[at]]
        while len(parts) > 2:
            options = [(ranks.get(x + y, at), k) for k, (x, y) in enumerate(zip(parts, parts[1:]))]
            rank, k = min(options)
            assert rank < at
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [left, right]


def plain_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_of_documents(spark, docs, none):
    from eventloom.llm.rules import COUNTS, document_counts

    rng = random.Random(9)
    base = [f"w{rng.randint(0, 40)}" for _ in range(60)]
    texts = [*some_texts(), " ".join(base + ["x"] + base[10:40] + base[5:20]), "same\nsame\n \n same\nsame\r\n", "a b c d e f g h a b c d e f g h", "a b c d e f g h i a b c d e f g", "a#b *$% &|<>\n" * 3]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in document_counts(df).collect()}
    assert got == {r[0]: plain_counts(r[1]) for r in rows_of(texts)}
    assert document_counts(none).count() == 0


def judged_corpus(n: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(n)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 12))) for _ in range(rng.randint(60, 90))]
        poor = i % 5 == 0
        if poor and i % 2:
            words = [w[:-1] + rng.choice("#%&") for w in words]
        elif poor:
            words = [w.upper() for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not poor)))
    return docs, labels


def test_learned_rules(spark, none):
    from eventloom.llm.rules import base_failed, judge

    docs, labels = judged_corpus(900)
    d = spark.createDataFrame([(i, t, None, "s", 1, False, 2, "r") for i, t in [*docs, (2000, None), (2001, "too short"), (None, docs[1][1]), (1, docs[1][1])]], SCHEMA)
    l = spark.createDataFrame([*labels, (None, 0), (7777, 1), (3, None)], "doc_id bigint, quality int")
    judged, rules = judge(d, l)
    assert 2 <= len(rules) <= 6 and all(r.precision >= 0.9 for r in rules)
    rows = judged.collect()
    truth = dict(labels)
    got = [(r.doc_id, r.kept) for r in rows if r.doc_id in truth]
    assert sum(kept == bool(truth[i]) for i, kept in got) >= 0.98 * len(got)
    assert all(r.kept == (not r.base_failed and r.rule == 0) for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2000].base_failed and by_id[2001].base_failed and len(rows) == len(docs) + 4
    assert len({r.kept for r in rows if r.doc_id in (1, None)}) == 1
    # the ordered list, condition by condition
    from eventloom.llm.rules import RATIOS

    for r in rows:
        value = {k: (r[a] if b is None else r[a] / r[b] if r[b] else 0.0) for k, (a, b) in RATIOS.items()}
        first = next((k for k, rule in enumerate(rules, start=1) if all((value[c.name] >= c.cut) == c.at_least for c in rule.conditions)), 0)
        assert r.rule == first
    assert judged.filter(base_failed() != F.col("base_failed")).count() == 0


def test_rules_without_labels(spark, none):
    from eventloom.llm.rules import judge

    docs, labels = judged_corpus(40)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    judged, rules = judge(d, empty)
    assert rules == [] and judged.filter("kept = base_failed").count() == 0
    _, rules = judge(d, spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id bigint, quality int"))
    assert rules == []
    assert judge(none, empty)[0].count() == 0


def test_new_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_training_rows_of_the_classifier_are_small():
    """All training texts are on the driver at once: at most six bytes for a bucket of a text, with the same shares."""
    import numpy as np

    from eventloom.llm.quality import SubwordModel, shares, subwords, words_of

    model, text = SubwordModel(2), "one two two " * 120 + "three four"
    ids, times = model.counts(text)
    assert ids.nbytes + times.nbytes <= 6 * len(ids)
    words = words_of(text)
    at, _ = subwords(words, model.buckets, model.sizes)
    want = np.bincount(at, minlength=model.buckets)
    assert list(ids) == list(np.flatnonzero(want)) and list(times) == list(want[ids])
    assert list(shares(times)) == list((want[ids] / want.sum()).astype(np.float32))


def test_pre_tokens_merged_together_as_alone():
    """One queue over many pre-tokens gives what the plain rule gives for each; long ones are not remembered."""
    import random

    from eventloom.llm.bpe import Codec

    ranks = {bytes([b]): b for b in range(256)}
    for token in (b"ab", b"bc", b"aa", b"ca", b"abc", b"aab", b"bca", b"aaaa", b"cab", b"abca"):
        ranks[token] = 400 - len(ranks) if token in (b"abc", b"cab") else len(ranks) + 200
    codec, rng = Codec(ranks, r"[a-c]+|\s+", keep=50), random.Random(4)

    def plain(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) for _ in range(120)]
    assert [list(x) for x in codec.merge_all([w.encode() for w in words])] == [plain(w.encode()) for w in words]
    texts = [" ".join(rng.sample(words, 5)) for _ in range(30)] + ["", "é"]
    for at in range(0, len(texts), 8):
        for text, tokens in zip(texts[at:at + 8], codec.tokens(texts[at:at + 8])):
            assert codec.ids(tokens) == [i for t in codec.split(text) for i in plain(t.encode())]
    codec.learn(set())
    assert all(len(t) <= 64 for t in codec.known)
