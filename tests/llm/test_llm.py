"""The llm operators against plain forms, with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

EMPTY_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, p string, run int, node int, score string, digest string"


def sentence(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("aeioustrln", k=rng.randint(2, 7))) for _ in range(n)]


def corpus() -> list[tuple[int, str | None]]:
    """Exact copies, near copies, shared passages, empty, null, short, very long and repetitive texts."""
    rng = random.Random(5)
    rows: list[str | None] = [None, "", " \t\n", "One", "one", "Éclair DE Ville", "éclair de ville", "Éclair de ville"]
    base = sentence(rng, 200)
    for k in range(12):
        copy = list(base)
        for at in rng.sample(range(200), k // 3):
            copy[at] = "changed"
        rows.append(" ".join(copy))
    passage = " ".join(sentence(rng, 130))
    for _ in range(6):
        rows.append(" ".join([*sentence(rng, rng.randint(0, 60)), passage, *sentence(rng, rng.randint(0, 60))]))
    rows += ["same text here " * 3] * 4 + ["SAME text here " * 3]
    rows += ["ab" * 700, "x" * 1300, " ".join(sentence(rng, 9000)), "a" * 30_000]
    rows += ["mail a.b@mail.example.com now", "ip 10.0.0.255 and 300.1.1.1 or 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111111111111112",
             "call +1 (974) 555-3436 please", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "x@y.com..z@w.org é a@b a@b.c_d@e.f 😀 q@r.st", "7" * 5000 + " +" + "1" * 12 + ")"]
    rows += [" ".join(sentence(rng, rng.randint(1, 40))) for _ in range(30)]
    return list(enumerate(rows, start=3))


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s" if i % 3 else None, None, False, "x", 1, 2, "y", "z") for i, t in DOCS]
    return spark.createDataFrame(rows, EMPTY_SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EMPTY_SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i, _ in DOCS] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_duplicates(docs, none, spark):
    from eventloom.llm.exact import drop_exact_duplicates, exact_duplicates

    got = by_id(exact_duplicates(docs, fan_in=2))
    groups: dict[str, list[int]] = {}
    for i, t in DOCS:
        groups.setdefault(brute.lower(t), []).append(i)
    for i, t in DOCS:
        own, r = groups[brute.lower(t)], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), i == max(own), brute.sha(brute.lower(t).encode()))
    assert exact_duplicates(none).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (None, None)], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in exact_duplicates(twice).collect()) == [("1", 3, False), ("1", 3, True), ("None", 1, True), ("None", 3, False)]
    kept = drop_exact_duplicates(twice)
    assert kept.columns == twice.columns and sorted(map(str, kept.collect())) == sorted(map(str, [*twice.limit(1).collect(), *twice.filter("text IS NULL").collect()]))
    assert drop_exact_duplicates(docs).columns == docs.columns


def test_shards(docs, none):
    from eventloom.llm.shards import shard_by_bytes

    rows = sorted(shard_by_bytes(docs, 4).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r["size"], r.text_crc32) for r in rows] == [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in DOCS]
    assert [r.shard for r in rows] == sorted(r.shard for r in rows) and {r.law for r in rows} == {"bytes"}
    for shard in range(4):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    total, before = sum(r["size"] for r in rows), 0
    for r in rows:
        assert r.shard == min(3, (2 * before + r["size"]) * 4 // (2 * total)) and r.grown_shard is None
        before += r["size"]
    assert shard_by_bytes(none, 4).count() == 0


def test_near_duplicates(docs, none, spark):
    from eventloom.llm.minhash import drop_near_duplicates, near_duplicates

    got, want = by_id(near_duplicates(docs)), brute.near(DOCS)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert near_duplicates(none).count() == 0
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if i == c}


@pytest.mark.parametrize("block", [1024, 8])
def test_block_comparison_finds_every_component(spark, docs, block, monkeypatch):
    from eventloom.llm import minhash
    from eventloom.llm.common import texts
    from eventloom.llm.components import connected_components

    monkeypatch.setattr(minhash, "BLOCK", block)
    some = texts(docs.filter(F.length("text").between(1, 3000)))
    sigs = minhash.features(some).filter("sig IS NOT NULL").select(F.col("doc_id").alias("node"), "sig")
    nodes = sigs.select("node")
    one = nodes.select(F.lit(1).cast("long").alias("key"), "node", F.col("node").alias("part"))
    got = {r.node: r.component for r in connected_components(minhash.across(one, sigs, minhash.sets_of(some, nodes), 75)).collect()}
    want = {i: c for i, (_, c) in brute.near([(i, t) for i, t in DOCS if t and len(t) <= 3000]).items()}
    assert all(got.get(i, i) == c for i, c in want.items())


def test_components_of_paths_and_stars(spark):
    from eventloom.llm.components import connected_components

    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7), (200, 150)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == brute.components(nodes, edges)


@pytest.mark.parametrize("length", [400, 40])
def test_repeats(docs, none, length):
    from eventloom.llm.suffix import removal_digests, remove_repeats

    got = by_id(removal_digests(remove_repeats(docs, length)))
    want = brute.repeats([t for _, t in DOCS], length)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {i: w for (i, _), w in zip(DOCS, want)}
    if length == 400:
        assert remove_repeats(none).count() == 0


def test_loser_tree_merges_runs():
    from eventloom.llm.suffix import front_coded, merge

    rng = random.Random(1)
    runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 40))) for _ in range(7)]
    out = merge([front_coded(r) for r in runs])
    strings = [runs[r][i] for r, i, _ in out]
    assert strings == sorted(s for r in runs for s in r)
    for (_, _, p), a, b in zip(out[1:], strings, strings[1:]):
        assert a[:p] == b[:p] and (p == len(a) or p == len(b) or a[p] != b[p])


def test_bpe_like_the_library(docs, none):
    import public_tokenizers
    import tiktoken

    from eventloom.llm.bpe import RankQueue, encode_documents, read_ranks, token_digests

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, ids = by_id(token_digests(docs, path, public_tokenizers.PATTERN)), by_id(encode_documents(docs, path, public_tokenizers.PATTERN))
    for i, t in DOCS:
        want = library.encode_ordinary(t or "")
        assert ids[i].ids == want and got[i].n_tokens == ids[i].n_tokens == len(want)
        assert got[i].ids_sha256 == brute.sha(",".join(map(str, want)).encode()) and got[i].decoded_sha256 == brute.sha((t or "").encode())
    assert token_digests(none, path, public_tokenizers.PATTERN).count() == 0
    rng, queue, held = random.Random(3), RankQueue(5000), []
    for _ in range(2000):
        if held and rng.random() < 0.5:
            assert queue.pop() == held.pop(held.index(min(held)))
        else:
            held.append((rng.randrange(5000), rng.randrange(50)))
            queue.push(*held[-1])


def test_ppm_and_unigrams(docs, none):
    from eventloom.llm.ppm import ORDER, Trie, adaptive_scores, score_documents

    got, want = by_id(score_documents(docs)), brute.unigram(DOCS)
    trie, total = Trie(ORDER), sum(w[0] for i, w in want.items() if brute.fold(i, 7) != 2)
    for i, t in DOCS:
        if brute.fold(i, 7) != 2:
            trie.learn(t or "")
    for i, t in DOCS:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.fold(i, 7) == 2, *want[i][:2], total)
        assert r.base_score == pytest.approx(want[i][2], rel=1e-9)
        if len(t or "") < 3000:
            assert r.score == pytest.approx(trie.score(t or ""), rel=1e-9)
    assert score_documents(none).count() == 0
    small = docs.filter(F.length("text") < 300)
    for i, r in by_id(adaptive_scores(small, 2)).items():
        assert r.score == pytest.approx(Trie(2).score(dict(DOCS)[i], adaptive=True))


def test_ppm_frees_the_chunks_of_the_base_first(spark, docs, monkeypatch):
    import glob
    import time

    from eventloom.llm import ppm
    from eventloom.session import checkpoint_folder

    folder = checkpoint_folder(spark).removeprefix("file:")
    seen, make, before = [], ppm.ppm_scores, set(glob.glob(f"{folder}/rdd-*"))

    def looked(some):
        for _ in range(50):
            if len(set(glob.glob(f"{folder}/rdd-*")) - before) > 1:
                time.sleep(0.1)
        seen.append(len(set(glob.glob(f"{folder}/rdd-*")) - before))
        return make(some)

    monkeypatch.setattr(ppm, "ppm_scores", looked)
    assert len(by_id(ppm.score_documents(docs))) == len(DOCS)
    assert seen == [1]  # the base scores; the trie, which makes chunks of its own, starts after them


def test_ppm_keeps_rare_grams_of_a_large_corpus(spark):
    from eventloom.llm.ppm import ORDER, Trie, score_documents

    n, rare = 9_000_000, ["a word met once", "é another", ""]
    ids = [i for i in range(50) if brute.fold(i, 7) != 2]
    rows = [*zip(ids, ["a" * n, *rare]), (next(i for i in range(50) if brute.fold(i, 7) == 2), "a word met twice")]
    trie = Trie(ORDER)
    for t in ["a" * 20, *rare]:
        trie.learn(t)
    for k in range(ORDER + 1):
        trie.counts[(97,) * k][97] += n - 20
    got = by_id(score_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2, "doc_id")))
    for i, t in rows[1:]:
        assert got[i].score == pytest.approx(trie.score(t), rel=1e-9)


@pytest.mark.parametrize("parts", [1, 3, 60])
def test_ppm_does_not_depend_on_parts(spark, docs, parts, monkeypatch):
    from eventloom.llm import ppm

    some = docs.filter(F.length("text") < 3000).select("doc_id", "text", (F.col("doc_id") % 3 > 0).alias("train"))
    trie = ppm.Trie()
    for r in some.filter("train").collect():
        trie.learn(r.text)
    monkeypatch.setattr(ppm, "THIN", 1)
    monkeypatch.setattr(ppm, "parallelism", lambda _: parts)
    got = by_id(ppm.ppm_scores(some))
    for r in some.collect():
        assert got[r.doc_id].score == pytest.approx(trie.score(r.text), rel=1e-9)


def test_ppm_chances_sum_to_one():
    from eventloom.llm.ppm import END, Tables, Trie, grams, low_bits, merged

    rows = [b"abracadabra", b"abrabra", b"", b"cab"]
    key, count = np.unique(grams(rows, 3)[0], return_counts=True)
    tables = Tables([merged([low_bits(key, o + 1)], [count]) for o in range(4)])
    trie = Trie(3)
    for r in rows:
        trie.learn(r.decode())
    for context in ([97, 98, 114], [122, 98, 114], [122, 122, 122], [99, 97, 98]):
        packed = np.array([(context[0] << 27 | context[1] << 18 | context[2] << 9 | s) for s in range(END + 1)], np.uint64)
        chances = tables.log10(packed)
        assert np.sum(10.0**chances) == pytest.approx(1)
        assert chances == pytest.approx(np.array([trie.log10(tuple(context), s) for s in range(END + 1)]))


def test_pii(docs, none):
    from eventloom.llm.pii import find_pii, span_digests

    got = by_id(span_digests(find_pii(docs)))
    for i, t in DOCS:
        spans = brute.base_spans(t)
        r, joined = got[i], ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == brute.sha(joined.encode()) and set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in brute.BASE]
    secret = next(i for i, t in DOCS if t and t.startswith("token"))
    assert got[secret].spans == "secret:9:49"
    assert find_pii(none).count() == 0


def test_reliabilities_find_the_good_labeler():
    from eventloom.llm.pii import reliabilities

    patterns = [("secret", 1, 1, 1, 1, 50), ("secret", -1, -1, 0, -1, 60), ("secret", 1, 1, 0, 1, 30), ("secret", -1, 0, 0, -1, 40)]
    p = reliabilities(patterns)
    assert p[0] > 0.9 and p[2] > 0.9 and p[1] < 0.1 and p[3] < 0.1


def test_quality_on_held_out_rows(spark, none, labels):
    from eventloom.llm.common import table
    from eventloom.llm.quality import keep_sound, score_quality

    docs, marks = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    scored = score_quality(docs, marks)
    rows = scored.join(marks, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (brute.fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert scored.count() == docs.count()
    assert score_quality(none, labels).count() == 0
    odd = spark.createDataFrame([(1, None, "c"), (1, "", "c"), (None, "word", "c")], "doc_id bigint, text string, p string")
    none_known = score_quality(odd, labels.limit(0)).collect()
    assert len(none_known) == 3 and all(r.score == 0.5 for r in none_known)
    assert keep_sound(odd, labels.limit(0)).columns == odd.columns


def test_mixing_meets_targets(spark, none):
    from eventloom.llm.common import table
    from eventloom.llm.mixing import fit_rates, mixed, mixing_rates, rate_after
    from eventloom.llm.queries import TARGETS, domain_labels

    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.2, 0.2, 0.4], 300)
    tokens = rng.integers(0, 500, 300)
    members = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens bigint, p array<double>")
    targets = [0.2, 0.3, 0.5]
    history = fit_rates(members, targets, tolerance=1e-9, most_steps=200)
    rates = np.array([r[0] for r in members.select(rate_after(history, 1 / 1.01, 0.01)).collect()])
    share, own, rate = tokens @ p / tokens.sum(), p, np.ones(300)
    for _ in range(5000):
        error = (rate * tokens) @ own / tokens.sum() - targets
        rate = np.maximum(0, rate - 0.5 * (own @ (error / share) + 0.01 * (rate - 1)))
    assert np.abs(rates - rate).max() < 1e-3 and np.abs((rates * tokens) @ p / tokens.sum() - targets).max() < 0.02

    docs, marks = table(spark, "/root/testdata/sf0.01", "documents"), domain_labels(spark, "/root/testdata/sf0.01")
    rows = mixing_rates(docs, marks, TARGETS).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows)
    assert mixing_rates(none, marks, TARGETS).count() == 0 and mixed(none, marks, TARGETS).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "a b", 1)], "doc_id bigint, text string, rate int")
    assert mixed(odd, marks.limit(0), TARGETS).columns == odd.columns


@pytest.mark.parametrize("poor_left", [True, False])
def test_mixing_stage_learns_from_all_documents(spark, poor_left):
    import corpus_pipeline
    from eventloom.llm.common import table
    from eventloom.llm.quality import SubwordModel, softmax
    from eventloom.llm.queries import TARGETS, domain_labels

    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    cls = {r.doc_id: r.cls for r in domain_labels(spark, folder).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    known = [(t, cls[i]) for i, t in rows if i in cls and len(t.encode()) <= 1 << 16]
    assert max(np.bincount([c for _, c in known])) <= 2000
    model = SubwordModel(3).fit(known, epochs=8)
    left = [(i, t) for i, t in rows if poor_left or cls.get(i) != 1]
    p = []
    for _, t in left:
        ids, share = model.features(t)
        p.append(softmax(model.out.astype(float) @ (share.astype(float) @ model.vectors[ids].astype(float))))
    p, tokens = np.array(p), np.array([len(t.split()) for _, t in left])
    share, rate = tokens @ p / tokens.sum(), np.ones(len(left))
    last = np.full(3, np.inf)
    for _ in range(60):
        error = ((rate * tokens) @ p / tokens.sum() - TARGETS) / share
        rate = np.maximum(0, rate - (p @ error + 0.01 * (rate - 1)) / 1.01)
        if np.abs(error - last).max() < 1e-4:
            break
        last = error
    some = spark.createDataFrame([(i,) for i, _ in left], "doc_id bigint")
    drawn = {r[0]: r[1] for r in some.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) + 0.5) / (1 << 20)).collect()}
    got = {r.doc_id: r["count"] for r in corpus_pipeline.mixing(spark, docs.join(some, "doc_id", "left_semi"), folder).groupBy("doc_id").count().collect()}
    want = [(got.get(i, 0), x + drawn[i]) for (i, _), x in zip(left, rate)]
    sure = [(n, x) for n, x in want if abs(x - round(x)) > 0.03]
    assert len(sure) > 0.9 * len(want) and all(n == int(x) for n, x in sure)
    toxic = np.array([cls.get(i) == 0 for i, _ in left])
    assert (rate[toxic] < 0.8).mean() > 0.5


def test_mixing_with_missing_domains(spark):
    from eventloom.llm.mixing import mixing_rates

    docs = spark.createDataFrame([(i, "bad awful words" if i % 4 == 0 else "fine sound text") for i in range(80)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 2) for i in range(40)] + [(1000 + i, 1) for i in range(5)], "doc_id bigint, cls int")
    for r in mixing_rates(docs, labels, [0.02, 0.02, 0.96], per_class=100).collect():
        assert r.p[1] == 0 and (r.rate < 0.5 if r.doc_id % 4 == 0 else r.rate > 1)


def test_embedding_links(spark):
    from eventloom.llm.vectors import embedding_links

    rng = np.random.default_rng(2)
    centre = rng.normal(size=12)
    rows: list = [(i, [float(np.float32(x)) for x in centre + rng.normal(size=12) * s], i % 2) for i, s in enumerate(np.linspace(0, 0.4, 60), start=5)]
    rows += [(100 + i, rows[7][1], 1) for i in range(5)] + [(110, [2 * x for x in rows[7][1]], 1), (111, rows[7][1], None), (112, None, 1), (113, [0.0] * 12, 1)]
    rows += [(114, [float("nan")] * 12, 1), (115, [float("inf"), *[1.0] * 11], 1), (116, [None, *[1.0] * 11], 1), (117, [1.0, 2.0], 1), (118, [1.0, 2.0], 1), (119, [], 1)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id bigint, embedding array<float>, label int, node string").repartition(3, "vec_id")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(df).collect()}
    assert got == brute.cosine_links(rows)
    assert embedding_links(df.limit(0)).count() == 0


def test_tiles_miss_no_pair():
    from eventloom.llm.vectors import axes, close_pairs

    rng = np.random.default_rng(8)
    x = rng.normal(size=(6, 16))[rng.integers(0, 6, 400)] + rng.normal(size=(400, 16)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = x @ axes(x.T @ x)
    i, j = close_pairs(z, z, 0.98, same=True)
    want = np.argwhere(np.triu(x @ x.T >= 0.98, 1))
    assert set(map(tuple, want.tolist())) <= set(zip(i.tolist(), j.tolist()))


def test_pipeline_against_plain_forms(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from eventloom.llm.bpe import read_ranks
    from eventloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    groups: dict[str, int] = {}
    for i, t in rows.items():
        groups[brute.lower(t)] = max(i, groups.get(brute.lower(t), i))
    once = {i: rows[i] for i in groups.values()}
    part = brute.near(list(once.items()))
    left = {i: t for i, t in once.items() if part[i][1] == i}
    survivors = corpus_pipeline.near_dedup(spark, corpus_pipeline.exact_dedup(spark, kept, sf_dir), sf_dir)
    assert {r.doc_id for r in survivors.collect()} == set(left)
    mixed = corpus_pipeline.mixing(spark, survivors, sf_dir)
    assert mixed.columns == docs.columns
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, library.encode_ordinary(r.text)) for r in mixed.collect())
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
