"""Hashes that must not collide, ties and ids of searches, extension, recall, models against plain Python, odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, bpe_table, chat_format, common, jaccard_join, language, license_scan, packing, registry, substring_dedup, text, topk_search, toxicity
from tests.conftest import SF
from tests.llm.test_stages import docs_of, near, repeats, words

P = pytest.importorskip("public_tokenizers")


def thue_morse(bits, swap=False):
    return "".join("ab"[bin(i).count("1") % 2 ^ swap] for i in range(1 << bits))


TWINS = [(thue_morse(b), thue_morse(b, True)) for b in (8, 9, 10, 11)]


def test_hashes_of_twins():
    for pair in TWINS:
        data = np.frombuffer(" ".join(pair).encode(), np.uint8)
        for which in (0, 1):
            s, e, _ = text.spans(text._WHITE[data], np.array([0, len(data)]))
            h = text.word_hash(data, s, e, which)
            assert len(h) == 2 and h[0] != h[1]
    seq = np.array([int(c == "b") for c in thue_morse(11)], np.uint64)
    assert text.gram_hash(seq, 2048)[0] != text.gram_hash(1 - seq, 2048)[0]


def test_word_hash_lengths():
    r = random.Random(1)
    seen = {}
    for n in [*range(1, 70), 200]:
        for _ in range(20):
            w = bytes(r.choice(b"ab\x00\xff") for _ in range(n))
            data = np.frombuffer(b"xx" + w + b"yy", np.uint8)
            h = int(text.word_hash(data, np.array([2]), np.array([2 + n]))[0])
            assert seen.setdefault(h, w) == w
    assert (text.gram_hash(np.arange(50, dtype=np.uint64), 7) == text.gram_hash(np.arange(3, 53, dtype=np.uint64) - np.uint64(3), 7)).all()


def test_twins_are_different_words(spark):
    rows = []
    for k, (a, b) in enumerate(TWINS):
        head = words(34, 700 + k)
        rows += [(10 * k, f"{head} {a}"), (10 * k + 1, f"{head} {b}"), (10 * k + 2, " ".join([a] * 5)), (10 * k + 3, " ".join([b] * 5))]
    df = docs_of(spark, rows)
    got = substring_dedup.substring_dedup(df).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got) == repeats(rows)
    linked = jaccard_join.jaccard_join(df).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in linked) == near(rows)
    found = topk_search.search(topk_search.build_index(df), df.filter("doc_id in (2, 12, 22, 32)"), k=40).collect()
    assert {(r["query_id"], r["doc_id"]) for r in found} == {(i, j) for i in (2, 12, 22, 32) for j in (i, i - 2)}


def ranked(rows, queries, k):
    bags = [(i, Counter(topk_search.split(t))) for i, t in rows]
    n, mean = len(rows), sum(sum(c.values()) for _, c in bags) / len(rows)
    df = Counter(w for _, c in bags for w in c)
    out = {}
    for q, t in queries:
        weight = {w: m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w, m in Counter(topk_search.split(t)).items()}
        scored = []
        for i, c in bags:
            s = math.fsum(weight[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in weight.keys() & c.keys())
            if s > 0:
                scored.append((-round(s, 9), i is not None, i or 0, i))
        out[q] = [(i, -s) for s, _, _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("at_once", [3, 4096])
def test_search_ids_and_ties(spark, at_once):
    """Several shards in a task, ties between copies in several shards, a text beyond a block, clashing columns."""
    rows = [(i, words(4 + i % 50, i % 170)) for i in range(900)] + [(5000, words(30_000, 5)), (None, words(9, 4)), (7000, "éÉ xé"), (7001, "éÉ")]
    queries = [(i, t) for i, t in rows if i is not None and i % 100 == 0]
    docs = docs_of(spark, rows)
    index = topk_search.build_index(docs, shard_docs=64)
    assert index.count() > 12
    got = topk_search.search(index, docs.filter("doc_id % 100 = 0").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0)), k=7, at_once=at_once).collect()
    want = ranked(rows, queries, 7)
    own = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        own.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert {q: [i for i, _ in v] for q, v in own.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert all(abs(a[1] - b[1]) < 1e-6 for q, v in own.items() for a, b in zip(v, want[q], strict=True))


def test_search_skips():
    """Pivots and block maxima leave out postings: the rare word's documents are all that is scored."""
    r = random.Random(8)
    rows = [(i, " ".join(["common"] * 3 + [r.choice(["p", "q", "s"]) * 3 for _ in range(9)] + ["rare"] * (i % 256 == 0) * 5)) for i in range(2048)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["id", "text"])
    shard = topk_search.Shard(topk_search._shard([batch]).to_pylist()[0], 12.0)
    query = shard.query(np.array([shard.place_of[b"common"], -1, shard.place_of[b"rare"]]), np.array([0.001, 1.0, 8.0]))
    base = shard.product([query])[0]
    assert len(query.many) == 1 and len(query.few) == 1  # "common" is in the matrix, "rare" has a cursor
    best = shard.search(query, base, 8, 0.0, (np.zeros(0), np.zeros(0, np.int64)))
    assert sorted(best[1].tolist()) == [i for i in range(2048) if i % 256 == 0]
    shard.scored = 0
    again = shard.search(query, base, 8, float(best[0][-1]), (np.zeros(0), np.zeros(0, np.int64)))
    assert (again[1] == best[1]).all() and shard.scored == 8
    shard.scored = 0
    assert not len(shard.search(query, base, 8, 1e6, (np.zeros(0), np.zeros(0, np.int64)))[0]) and shard.scored == 0


@pytest.mark.parametrize("postings", [1, 1 << 16])
def test_search_by_regions(monkeypatch, postings):
    """Two languages are regions; limits are the blocks' best scores, to rounding; queries stay out of the other language."""
    monkeypatch.setattr(topk_search, "POSTINGS", postings)
    monkeypatch.setattr(topk_search, "AT_ONCE", 3)
    r = random.Random(4)
    pool = {c: [f"{c}{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"] for c in "xy"}
    rows = [(i, " ".join([c := "xy"[i * 7 % 3 % 2]] * 4 + [pool[c][min(99, int(r.expovariate(0.05)))] for _ in range(r.randrange(5, 40))])) for i in range(900)] + [(900, ""), (901, "alone")]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["id", "text"])
    row = topk_search._shard([batch]).to_pylist()[0]
    names = sorted({w for _, t in rows for w in topk_search.split(t)})
    place, mean = {w: i for i, w in enumerate(names)}, row["total"] / row["n"]
    queries = []
    for _, t in rows[:40]:
        bag = sorted(Counter(topk_search.split(t)).items())
        queries.append((np.array([place[w] for w, _ in bag], np.int32), np.array([n * r.random() for _, n in bag])))
    score = np.zeros((len(queries), len(rows)))
    for d, t in rows:
        own = topk_search.split(t)
        impact = {place[w]: n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, n in Counter(own).items()}
        for q, (places, weight) in enumerate(queries):
            score[q, d] = sum(x * impact.get(p, 0.0) for p, x in zip(places.tolist(), weight.tolist(), strict=True))
    parts, seen = list(topk_search._split(row, place)), []
    assert len(parts) == 3  # the texts without words of either language come first
    for part in parts:
        shard = topk_search.Shard(part, mean)
        seen += shard.docs.tolist()
        names_at = np.full(len(names), -1)
        names_at[shard.numbers] = np.arange(len(shard.numbers))
        need, met = np.full(len(queries), 1e-6), []
        for numbers, *words in topk_search._reaching(shard, names_at, queries, np.arange(len(queries)), need):
            met += numbers.tolist()
            _, limits = shard.limits(*words)
            for q, limit in zip(numbers, limits, strict=True):
                padded = np.zeros(shard.blocks << topk_search.BLOCK_BITS)
                padded[: len(shard.docs)] = score[q, shard.docs]
                want = padded.reshape(shard.blocks, -1).max(axis=1)
                assert (limit >= want).all() and (limit <= want * 1.0001 + 1e-9).all()
        assert met == np.flatnonzero(score[:, shard.docs].max(axis=1) > 0).tolist()
    assert sorted(seen) == list(range(len(rows)))


@pytest.mark.parametrize("many", [0, 8])
def test_search_holds_asked_words_only(monkeypatch, many):
    """Postings read block by block (0) or through a stretch (8) against all scores; bounds of all queries at once; words not asked for are left out."""
    monkeypatch.setattr(topk_search, "MANY", many)
    monkeypatch.setattr(topk_search, "STRETCH", 5)
    r = random.Random(3)
    pool = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i, " ".join(r.choice(pool[:3] + pool[i % 5 * 20 :][:20]) for _ in range(r.randrange(1, 9)))) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["id", "text"])
    asked = {w.encode(): i for i, w in enumerate(["nowhere", *pool[::2]])}
    shard = topk_search.Shard(topk_search._shard([batch]).to_pylist()[0], 5.0, asked)
    assert set(shard.place_of) == {w.encode() for w in pool[::2]} and len(shard.doc) == sum(len({w for w in t.split() if w.encode() in asked}) for _, t in rows)
    names_at = np.full(len(asked), -1)
    names_at[shard.numbers] = np.arange(len(shard.numbers))
    queries = [(np.array(sorted(r.sample(range(len(asked)), n)), np.int32), np.array([r.random() for _ in range(n)])) for n in (1, 3, 9, 30, 51)]
    most = topk_search.Bounds(queries).most(shard, names_at)
    for i, query, base in topk_search._many(shard, names_at, [(i, *x) for i, x in enumerate(queries)]):
        weight = {w: float(queries[i][1][list(queries[i][0]).index(n)]) for w, n in asked.items() if n in queries[i][0]}
        score = {d: sum(weight[w] * m * 2.2 / (m + 1.2 * (0.25 + 0.75 * len(t.split()) / 5.0)) for w, m in Counter(t.encode().split()).items() if w in weight) for d, t in rows}
        want = sorted((-round(x, 9), d) for d, x in score.items() if x > 0)[:7]
        for least in (0.0, -want[-1][0] - 1e-6 if want else 0.0):
            got = shard.search(query, base, 7, least, (np.zeros(0), np.zeros(0, np.int64)))
            assert [(-round(x, 9), d) for x, d in zip(*got, strict=True)] == want
        assert not want or most[i] >= -want[0][0]


def test_common_words():
    a, b = pa.array([b"a b ", b"ab c ", b"", b"x y z ", b"x "]), pa.array([b"a b ", b"a b c ", b"q ", b"x y zz ", b"x y "])
    assert substring_dedup.common_words(a, b).tolist() == [2, 0, 0, 2, 1]
    room = 23
    for left, right in ((0, 0), (23, 0), (0, 23), (10, 13), (10, 12), (23, 23), (-1, -1)):
        want = sum(1 << d for d in range(room + 1) if d <= left and room - d <= right)
        assert substring_dedup.offsets_mask(np.array([left]), np.array([right]), room)[0] == want


@pytest.mark.parametrize("window", [3, 12, 40, 90])
def test_extension(spark, window):
    """One seed in many contexts: every two of them share another stretch, some through a third text only."""
    r = random.Random(window)
    seed = [f"s{i}" for i in range(max(1, min(12, window)))]
    rows = []
    for i in range(90):
        left = [f"l{r.choice('ab')}{d}" for d in range(window + 5)]
        right = [f"r{r.choice('ab')}{d}" for d in range(window + 5)]
        for d in range(1, window + 5):  # contexts branch rarely, so that long stretches are shared
            if r.random() < 0.93:
                left[d] = f"l{d}"
            if r.random() < 0.93:
                right[d] = f"r{d}"
        cut = r.randrange(window + 5)
        rows.append((i, " ".join([*left[::-1][cut:], *seed, *right[: r.randrange(window + 5)]])))
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, rows[5][1] + " " + rows[6][1])]
    got = substring_dedup.substring_dedup(docs_of(spark, rows), window=window).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"], bytes(x["kept"])) for x in got) == repeats(rows, window)


def test_recall_of_the_join(spark):
    """Links found, against a comparison of all pairs."""
    docs = common.table(spark, SF.replace("0.001", "0.01"), "documents").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = near(rows)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs).collect())
    have, all_ = sum(n * k for (_, _, n), k in got.items()), sum(n * k for (_, _, n), k in want.items())
    assert have <= all_ and have >= 0.99 * all_ and sum((got & want).values()) >= 0.99 * len(rows)


def test_links_at_the_threshold(spark):
    """Eight of ten shingles, seven of nine, sizes at the edge of a band."""
    tail = lambda n, k: " ".join(f"{k}{i}" for i in range(n))
    rows = []
    for g in range(12):
        base = tail(4 + 8 + 3 * g, f"b{g}_")
        n = 8 + 3 * g
        rows.append((10 * g, base))
        rows.append((10 * g + 1, base + " " + tail(n // 4, f"x{g}_")))  # n of n + n // 4
        rows.append((10 * g + 2, base + " " + tail(n // 4 + 1, f"y{g}_")))
    got = jaccard_join.jaccard_join(docs_of(spark, rows))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == near(rows)


def test_packing_many_open(spark):
    """More than 4,096 sequences that nothing else fits into, a null id, a long text."""
    n = 4300
    one = " ".join(["the"] * 1200)
    rows = spark.range(n, numPartitions=1).select("id", F.lit(one).alias("text"))
    extra = spark.createDataFrame([(None, "x y"), (9999, " ".join(["of"] * 300_000)), (9998, None)], "id long, text string")
    docs = rows.union(extra).coalesce(1).withColumn("start", F.lit("clash")).withColumnRenamed("id", "doc_id")
    got = packing.pack(docs, P.path("word_bpe_49k.json")).select("doc_id", "start", "length", "sequence_id", "offset", "doc_tokens").toPandas()
    assert got.length.sum() == n * 1201 + 300_001 + 3 + 1
    fill = got.groupby("sequence_id").length.sum()
    assert (fill[fill < 2048].map(lambda x: x & (x - 1)) == 0).all() and len(fill[fill < 2048]) <= 11
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all()


def test_sum_of_squares_places_most():
    """The share of tokens whose sequence was filled before the open ones were emptied into one another."""
    r = np.random.default_rng(3)
    packer = packing.Packer(2048, 0)
    closed = total = 0
    for n in np.minimum(40_000, np.exp(r.normal(6.1, 1.2, 8000))).astype(int) + 1:
        total += n
        closed += sum(p[2] for p in packer.add(0, bytes(4 * int(n))))
    assert closed >= 0.9 * total
    assert closed + sum(p[2] for p in packer.drain()) == total


def test_packing_control_strings():
    tokenizers = pytest.importorskip("tokenizers")
    t, w = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")), packing.Words(P.path("word_bpe_49k.json"))
    texts = ["A <|endoftext|> b", "A <|EndOfText|> B", "x\x1cy\x1dz", "H̱ J̌ T̈ W̊", "İı ẞ ﬁ", "OΔΟΣ ΣΣ", "é é", "a,b a, a. a.. a,, .a ,a", "9, 9. é, 漢.", " x  y z　", "''s's 'S don'T'll"]
    for x in texts:
        assert np.frombuffer(w.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
    packing_kept, packing.KEPT = packing.KEPT, 3  # generations change at every call
    try:
        for _ in range(3):
            for x in texts:
                assert np.frombuffer(w.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    finally:
        packing.KEPT = packing_kept


def test_chat_roles_and_long_texts(spark):
    roles = ["a\x00b", "\\\x00n", "\\n", "\n", "\\\\n", "\\\n\\", "", "assistant"]
    rows = [(1, k, role, "t") for k, role in enumerate(roles)] + [(2, 0, "user", "<|" * 200_000), (2, 1, "assistant", "<\\|x|>" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("segments", F.lit(1)).withColumn("state", F.lit(2))
    out = chat_format.format_chats(df)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_chats(out).collect()}
    assert back[1] == [(r, "t") for r in roles] and back[2] == [(r, x) for _, _, r, x in rows[-2:]]


def test_language_against_plain_python(spark):
    """Counts, IDF, centroids and scores from the definition."""
    model = language.fit(common.table(spark, SF, "documents").select("doc_id", "text", "lang"))
    texts = ["The quick brown fox", "Über den Wolken", "a", "x1y2 zz", "Hello, hello!\tHELLO", "漢字 kanji"]
    column = pa.array(texts)
    for i, j, rows in language.counts(column):
        for r in range(i, j):
            raw = "".join(chr(b).lower() if chr(b).isalpha() and b < 128 else (" " if b < 128 else chr(b)) for b in texts[r].encode()).encode("latin-1")
            want = np.zeros(language.DIMS)
            for k in range(len(raw) - 2):
                a, b, c = raw[k : k + 3]
                if not (a == 32 and b == 32):
                    want[((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
            assert (rows[r - i] == want).all()
            v = np.log1p(want) * model.idf
            v /= max(np.linalg.norm(v), 1e-12)
            best = max((float(c @ v), -o) for c, o in zip(model.centroids, model.owner, strict=True))
            lang, score, _ = language.predict_rows(model, pa.array([texts[r]]))
            assert abs(score[0] - min(1, max(0, best[0]))) < 1e-4 and lang[0] == model.langs[-best[1]]
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4) and set(model.owner) == set(range(len(model.langs)))


def test_language_odd_rows(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(9000, "zq xk vv zq jj xk", "xx")], "doc_id long, text string, lang string")
    model = language.fit(docs.union(rare))
    long = "the cat and the dog of the house " * 30_000
    odd = spark.createDataFrame([(1, long, 5), (2, "der Hund und die Katze", 5), (2, "der Hund und die Katze", 5), (3, "zq xk vv zq jj xk", 5)], "doc_id long, text string, score int").withColumn("lang_pred", F.lit(0))
    got = language.identify(odd, model).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in got) == Counter({(1, "en"): 1, (2, "de"): 2, (3, "xx"): 1})
    again = language.fit(docs.union(rare))
    assert (again.centroids == model.centroids).all()


def risk(model_w, b, p_rows, u_rows, prior, corrected):
    z = lambda rows: np.array([sum(model_w[w] for w in r) + b for r in rows])
    zp, zu = z(p_rows), z(u_rows)
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return positive + (max(0.0, negative) if corrected else negative), negative


def test_toxicity_against_plain_python():
    """The gradient against finite differences of the risk, and both branches of the correction."""
    r = np.random.default_rng(6)
    names = 8
    for prior, scale in ((0.2, 1.0), (0.95, 4.0)):
        p_rows = [np.unique(r.integers(0, names, 4)) for _ in range(20)]
        u_rows = [np.unique(r.integers(0, names, 3)) for _ in range(40)]
        w, b = (r.normal(0, scale, names), 0.3) if prior < 0.5 else (np.abs(r.normal(0, scale, names)), 5.0)
        p, u = [toxicity._sparse(x, np.arange(names)) for x in (p_rows, u_rows)]
        gradient, negative = toxicity.risk_gradient(w, b, p, u, len(p_rows), len(u_rows), prior)
        value, own = risk(w, b, p_rows, u_rows, prior, True)
        assert abs(own - negative) < 1e-9 and (negative >= 0) == (prior < 0.5)
        for k in range(names + 1):
            at = lambda d: (w + d * (np.arange(names) == k), b + d * (k == names))  # noqa: E731, B023
            if negative >= 0:
                slope = (risk(*at(1e-5), p_rows, u_rows, prior, True)[0] - risk(*at(-1e-5), p_rows, u_rows, prior, True)[0]) / 2e-5
            else:  # the step goes up the negatives' risk
                slope = -(risk(*at(1e-5), p_rows, u_rows, prior, True)[1] - risk(*at(-1e-5), p_rows, u_rows, prior, True)[1]) / 2e-5
            assert abs(slope - gradient[k]) < 1e-6


def test_toxicity_scores(spark):
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -1.0)
    column = pa.array(["vile word", "VILE vile", "", None, "vileness"])
    for i, _, row, word in toxicity.features(pa.array(["vile"])):
        model.weights[word[row == 0]] = 3.0
    got = toxicity.scores(model, column)
    sure = 1 / (1 + math.exp(-2.0))
    assert np.allclose(got[:2], sure, atol=1e-6) and np.allclose(got[2:4], 1 / (1 + math.e), atol=1e-6)
    docs = spark.createDataFrame([(None, "vile"), (1, "vile " * 200_000), (2, "x"), (2, "x")], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(9))
    out = Counter((r["doc_id"], r["predicted"]) for r in toxicity.score(docs, model).collect())
    assert out == Counter({(None, 1): 1, (1, 1): 1, (2, 0): 2})


def test_license_model_against_plain_python(spark):
    """Probabilities and containment of the SQL functions against the same model in Python."""
    docs = common.table(spark, SF, "documents")
    model = license_scan.fit(docs)
    units = [t for ts in license_scan.NOTICES.values() for t in ts] + list(license_scan.DECOYS) + ["Licensed under the BSD License", "nothing here", "MIT"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(units)], "doc_id long, text string")
    got = {r["doc_id"]: r["notices"] for r in license_scan.scan(df, model).collect()}
    for i, u in enumerate(units):
        grams = license_scan._grams(license_scan._tokens(u))
        z = np.sum([model.weights[g] for g in sorted(grams & model.weights.keys())] + [model.bias], axis=0)
        top = int(np.argmax(z[:-1]))
        p = math.exp(z[top]) / np.exp(z).sum()
        if p >= license_scan.THRESHOLD:
            assert len(got[i]) == 1 and got[i][0]["family"] == model.families[top] and abs(got[i][0]["p"] - p) < 1e-9
            three = [license_scan._grams(license_scan._tokens(t), (3,)) or {" ".join(license_scan._tokens(t))} for t in license_scan.NOTICES[model.families[top]]]
            assert abs(got[i][0]["contained"] - max(len(t & grams) / len(t) for t in three)) < 1e-9
        else:
            assert got[i] == []
    assert all(not got[len(units) - 3 - len(license_scan.DECOYS) + k] for k in range(len(license_scan.DECOYS)))


def test_license_odd_rows(spark):
    line = "Released under the MIT License."
    rows = [(None, line), (1, "word " * 100_000), (2, line), (2, line), (3, f"{words(3000, 1)} {line} {words(3000, 2)}\n{line}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("families", F.lit(1)).withColumn("notices", F.lit("clash"))
    got = Counter((r["doc_id"], r["families"]) for r in license_scan.license_scan(df).collect())
    assert got == Counter({(None, "mit"): 1, (1, ""): 1, (2, "mit"): 2, (3, "mit"): 1})


def test_bpe_one_long_piece(spark):
    tiktoken = pytest.importorskip("tiktoken")
    c = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(4)
    for t in ("".join(r.choice("etaoin") for _ in range(60_000)), "漢" * 20_000):
        assert next(iter(c.encode([t]))) == e.encode_ordinary(t)
    assert bpe_table.encode_table(spark.createDataFrame([(1, None, 3)], "doc_id long, text string, ids int"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first()["n_tokens"] == 0


def test_pipeline_odd_rows(spark):
    """Nulls, empty and repeated rows, copies under one id and extra columns go through every stage; so does an empty table."""
    import corpus_pipeline

    base = " ".join(t for t in ["the house and the garden of the old town were full of people who had come to see the river"] * 1)
    rows = [(1, base, "en"), (1, base, "en"), (2, base + " ", "en"), (3, None, "en"), (4, "", None), (None, "der Hund und die Katze sind in dem Haus und auf dem Dach", "de"), (5, "12 34", "en")]
    rows += [(100 + i, words(60, i) + " the of and to in", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text"), "k1": F.lit("x"), "kept": F.lit(1), "removed": F.lit(2), "sid": F.lit(3)})
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = common.written(stage(spark, at, SF), name)
            assert at.columns == docs.columns
        if table is docs:
            ids = Counter(r["doc_id"] for r in at.collect())
            assert ids[1] == 1 and not ids.keys() & {2, 3, 4, 5}
        last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
        assert (last.count() == 0) == (table is not docs)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda d: sorted(repr([None if pd.isna(x) else (round(float(x), 5) if not isinstance(x, str) else x) for x in r]) for r in d[sorted(d.columns)].itertuples(index=False))
    assert plain(got) == plain(want)


def test_methods_are_named():
    assert all(re.match(r"op\d+_", n) for n in registry.queries())
