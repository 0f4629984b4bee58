"""Corpus operators against brute force, exact round trips and held-out accuracy, with odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, bpe_table, chat_format, common, exact_dedup, jaccard_join, language, license_scan, packing, registry, substring_dedup, topk_search, toxicity
from tests.conftest import SF

P = pytest.importorskip("public_tokenizers")
KIND = "doc_id long, text string, lang string, k1 int, id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "clash") for i, t in rows], KIND).repartition(3)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and white texts, copies with other white space, repeated rows, a null id, a very long text."""
    base, long = words(200, 1), words(60_000, 2)
    rows = [(1, base), (2, base.replace(" ", "\n\t", 5)), (3, None), (4, ""), (5, " \t"), (5, " \t"), (6, "one two"), (7, "one  two"), (8, base + " tail words here"), (None, words(100, 3)), (9, long), (10, long + " x"), (11, words(40, 4) + " " + base[:400]), (12, "caf\u00e9 \u00e9"), (6, "one two"), (13, words(30, 5)), (14, words(90, 6) + " " + words(90, 6))]
    return rows, docs_of(spark, rows)


def spaced(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("broadcast", [common.BROADCAST_BYTES, -1])
def test_exact_dedup(spark, odd, broadcast):
    rows, df = odd
    got = sorted(map(tuple, exact_dedup.exact_dedup(df, broadcast_bytes=broadcast).collect()), key=repr)
    by = {}
    for i, t in rows:
        by.setdefault(spaced(t), []).append(i)
    least = {t: None if None in g else min(g) for t, g in by.items()}
    assert Counter((i, k, n, s) for i, k, n, _, s in got) == Counter((i, least[spaced(t)] if len(by[spaced(t)]) > 1 else i, len(by[spaced(t)]), hashlib.sha256(spaced(t).encode()).hexdigest()) for i, t in rows)
    assert sum(k for *_, k, _ in got) == len(by)
    kept = exact_dedup.drop_copies(df, broadcast_bytes=broadcast)
    assert kept.columns == df.columns and kept.count() == len(by)


def test_golomb_codes():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 1000):
        v = np.unique(r.integers(0, 2**50, n).astype(np.uint64))
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v, 50)) == v).all()


def shingle_set(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, least.get(find(k)), links[k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("broadcast", [common.BROADCAST_BYTES, -1])
def test_jaccard_join(spark, odd, broadcast):
    rows, df = odd
    got = jaccard_join.jaccard_join(df, broadcast_bytes=broadcast)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == near(rows)


def test_jaccard_large_group(spark):
    """A group of near copies larger than a bucket and a block, among others."""
    base = words(120, 9).split()
    r = random.Random(3)
    rows = []
    for i in range(700):
        w = list(base)
        w[r.randrange(120)] = f"w{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, words(80, 100 + i)) for i in range(50)]
    got = jaccard_join.jaccard_join(docs_of(spark, rows))
    assert Counter((x["doc_id"], x["class_id"], x["n_links"]) for x in got.collect()) == near(rows)
    assert jaccard_join.drop_near_copies(docs_of(spark, rows)).count() == len({c for _, c, _ in near(rows)})


def repeats(rows, window=35):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[p : p + window]) for w in split for p in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = bytearray(len(w))
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = b"\1" * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize("broadcast", [common.BROADCAST_BYTES, -1])
def test_substring_dedup(spark, odd, broadcast):
    rows, df = odd
    got = substring_dedup.substring_dedup(df, broadcast_bytes=broadcast).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got) == repeats(rows)


def test_substring_dedup_random(spark):
    """Passages of many lengths, cut and shifted, in a small vocabulary with ties."""
    r = random.Random(11)
    source = [r.choice(["a", "b", "c", "dd", "e"]) for _ in range(3000)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randint(0, 4)):
            at, n = r.randrange(2900), r.choice([5, 33, 34, 35, 36, 60, 150])
            w += source[at : at + n] + [f"x{r.randrange(10**6)}" for _ in range(r.choice([0, 1, 3]))]
        rows.append((i, " ".join(w)))
    got = substring_dedup.substring_dedup(docs_of(spark, rows)).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"], bytes(x["kept"])) for x in got) == repeats(rows)
    out = substring_dedup.remove_repeats(docs_of(spark, rows))
    assert out.columns == docs_of(spark, rows).columns and out.count() == len(rows)


def test_bpe_matches_and_round_trips(spark, odd):
    tiktoken = pytest.importorskip("tiktoken")
    c = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(7)
    alphabet = "aAbc \u00e9\u6f22\U0001f389 \n\tsre12'\u0301\x1c"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(150))) for _ in range(300)] + ["", "a" * 3000, "ab" * 900, " " * 500, "don't <|endoftext|>"]
    for text, ids in zip(texts, c.encode(texts), strict=True):
        assert ids == e.encode_ordinary(text) and c.decode(ids) == text.encode()
    rows, df = odd
    got = bpe_table.encode_table(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert Counter((x["doc_id"], bytes(x["decoded"]), x["n_tokens"]) for x in got) == Counter((i, (t or "").encode(), len(e.encode_ordinary(t or ""))) for i, t in rows)


def test_packing(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(k, x) for k, (_, x) in enumerate(odd[0])] + [(100 + i, words(20 + i, i)) for i in range(60)]
    got = packing.pack(docs_of(spark, rows), P.path("word_bpe_49k.json"), size=256).toPandas()
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = got[got.doc_id == i].sort_values("start")
        assert b"".join(map(bytes, own.ids)) == ids and (own.doc_tokens == len(ids) // 4).all()
        assert (own.start == own.length.cumsum() - own.length).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        n = s.length.sum()
        assert n <= 256 and (s.offset == s.length.cumsum() - s.length).all() and (n == 256 or n & (n - 1) == 0)


def test_packing_words():
    tokenizers = pytest.importorskip("tokenizers")
    t, w = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")), packing.Words(P.path("word_bpe_49k.json"))
    r = random.Random(2)
    alphabet = "aAeE\u00c9\u0130\u03a3\u6f22 .,'!s12\n\t\x0b\x85\u0301"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(120))) for _ in range(500)] + ["It's DON'T. a., b,. c.\nd", "x<|endoftext|>y"]
    for text in texts:
        assert np.frombuffer(w.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_topk_search(spark):
    rows = [(i, words(5 + i % 40, i % 90)) for i in range(300)] + [(400, None), (500, "..."), (None, words(9, 0)), (2, words(7, 2))]
    tok = lambda t: re.findall(rb"[a-z\x80-\xff]+", (t or "").lower().encode())
    bags = [(i, Counter(tok(t))) for i, t in rows]
    n, mean = len(rows), sum(sum(c.values()) for _, c in bags) / len(rows)
    df = Counter(w for _, c in bags for w in c)
    docs = docs_of(spark, rows)
    got = topk_search.search(topk_search.build_index(docs), docs.filter("doc_id % 100 = 0"), k=5, at_once=2).toPandas()
    for q in (0, 100, 200):
        bag = next(c for i, c in bags if i == q)
        weight = {w: m * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w, m in bag.items()}
        want = sorted((sum(weight[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in weight.keys() & c.keys()) for _, c in bags), reverse=True)
        own = got[got.query_id == q].sort_values("rank")
        assert np.allclose(own.score, [s for s in want if s > 0][:5]) and list(own["rank"]) == list(range(1, len(own) + 1))
    assert not set(got.query_id) & {400, 500}


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\|", "<", "|", "\\n\n", "", None, "<|", "tail <"]
    rows = [(1, k, role, t) for k, t in enumerate(nasty) for role in ("user",)] + [(1, 50, "assistant", "<|im_end|>"), (2, 1, None, "a"), (2, 1, "we\nird\\n\\", "b"), (None, None, "user", "x"), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(df)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_chats(out).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        assert back[c] == [(r, x) for _, _, r, x in own]
    state = {r["conv_id"]: (r["state"], r["first_bad"]) for r in out.collect()}
    assert state[3] == ("invalid", 2) and state[None] == ("open", None)
    digest = {r["conv_id"]: r for r in chat_format.chat_digest(out).collect()}
    assert digest[3]["loss_chars"] == 2 and digest[1]["loss_sha256"] == hashlib.sha256(b"<|im_end|>").hexdigest()


def test_language(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text", "lang")
    held = F.pmod(common.crc_of_id(), F.lit(5)) == 0
    model = language.fit(docs.filter(~held))
    got = language.identify(docs.filter(held), model).join(docs, "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (None, "the of and")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] for i in (1, 2, 3)) and found[None]["lang_pred"] == "en"
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    assert language.identify(odd, language.fit(docs.limit(0))).filter("lang_pred <> 'und'").isEmpty()


def test_toxicity(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = i % 9 == 0
        t = words(60, i).split()
        if bad:
            t[5:5] = r.sample(["vile", "rotten", "nasty", "foul"], 2)
        rows.append((i, " ".join(t)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.pmod(common.crc_of_id(), F.lit(3)) == 1
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs.filter(~held), lab.filter(~held))
    got = toxicity.score(docs.filter(held), model).toPandas()
    bad = got.doc_id % 9 == 0
    assert got[~bad].predicted.sum() == 0 and got[bad].predicted.mean() > 0.9 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert toxicity.score(odd, model).filter("predicted = 1").isEmpty()
    assert toxicity.score(odd, toxicity.fit(docs, lab.limit(0))).count() == 3


def test_license_scan(spark):
    texts = {1: "some words\nLicensed under the Apache License, Version 2.0.\nmore words", 2: "Released under the MIT License.", 3: "She renewed her driving license in public.", 4: None, 5: "", 6: "x\n\nThis work is licensed under the GNU\nGeneral Public License, version 3.\n\ny", 7: "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."}
    texts |= {10 + i: words(50, i) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    assert [got[i]["families"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["apache-2.0", "mit", "", "", "", "gpl-3.0", "cc-by-nc,mit"]
    assert all(got[i]["families"] == "" for i in range(10, 50))
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_license_scan_sentences_alone(spark):
    texts = {1: f"{words(20, 1)}\nAll rights reserved.\n{words(20, 2)}", 2: "All rights of way are reserved for the public.", 3: "Confidential and proprietary.", 4: "You may obtain a copy of the License at", 5: "All rights reserved. No part of this publication may be reproduced without prior written permission."}
    texts |= {10 + i: f"{words(50, i)}\nAll rights reserved." if i % 2 else words(50, i) for i in range(40)}
    got = {r["doc_id"]: r["families"] for r in license_scan.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(1, 6)] == ["proprietary", "", "proprietary", "apache-2.0", "proprietary"]
    assert [got[10 + i] for i in range(40)] == ["", "proprietary"] * 20


def test_empty_tables(spark):
    empty = docs_of(spark, []) if False else spark.createDataFrame([], KIND)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0
    assert bpe_table.encode_table(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert topk_search.search(topk_search.build_index(empty), empty).count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.chat_digest(chat_format.format_chats(chats)).count() == 0


def test_pipeline(spark):
    """The stages one after the other, each against brute force on what the one before kept."""
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text").collect()
        docs = common.written(stage(spark, docs, SF), name)
        rows = [(r["doc_id"], r["text"]) for r in before]
        if name != "packing":
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if name == "exact_dedup":
            first = {}
            for i, t in sorted(rows):
                first.setdefault(spaced(t), i)
            assert set(after) == set(first.values())
        if name == "jaccard_join":
            assert set(after) == {c for _, c, _ in near(rows)}
        if name == "substring_dedup":
            want = {i: k for i, _, _, k in repeats(rows)}
            assert {i: b" ".join((t or "").encode().split()) for i, t in after.items()} == want
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == {i for i, _ in rows}


def test_one_worker_a_task(spark, odd, monkeypatch):
    """No stage has two steps in Python one above the other, even where a join between them becomes a broadcast: each
    task would hold two workers, which stay with the executor."""
    import corpus_pipeline

    seen, written = {}, common.written

    def deepest(node):
        below = node.children()
        name = node.nodeName()
        return ("Arrow" in name or "Python" in name) + max((deepest(below.apply(k)) for k in range(below.size())), default=0)

    def noted(df, name):
        seen[name] = max(seen.get(name, 0), deepest(df._jdf.queryExecution().optimizedPlan()))
        return written(df, name)

    monkeypatch.setattr(common, "written", noted)
    docs = odd[1]
    for name, stage in corpus_pipeline.STAGES:
        if name == "packing":  # its rows come from a written table
            break
        docs = common.written(stage(spark, docs, SF), name)
    assert max(seen.values()) == 1, seen


def test_queries_are_whole():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 11))
    assert zlib.crc32(b"0") == 4108050209
