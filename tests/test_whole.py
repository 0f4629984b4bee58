"""Queries over tables whose ids go far beyond any prefix, against plain Python."""

import pandas as pd

from tessera import registry


def run(spark, folder, name, **tables):
    for table, rows in tables.items():
        pd.DataFrame(rows).to_parquet(f"{folder}/{table}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    return [tuple(r) for r in registry.queries()[name](spark, str(folder)).collect()]


def test_components_of_late_orders(spark, tmp_path):
    pairs = [(o, o % 7 + 1, o // 900 + 100) for o in range(1, 9000, 450)]
    rows = [{"l_orderkey": o, "l_suppkey": s, "l_partkey": p, "l_quantity": 50.0, "l_tax": 0.08} for o, s, p in pairs]
    rows += [{"l_orderkey": 1, "l_suppkey": 8, "l_partkey": 999, "l_quantity": 1.0, "l_tax": 0.08}]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for _, s, p in pairs:
        a, b = sorted((find(f"s{s}"), find(f"p{p}")))
        root[b] = a
    assert sorted(run(spark, tmp_path, "components", lineitem=rows)) == sorted((n, find(n)) for n in list(root))


def test_subtype_chain_of_large_keys(spark, tmp_path):
    keys = [1, 2, 5, 150, 199, 200, 250, 500, 1001, 2002]
    parent = {k: k // 2 for k in keys if k > 1}
    want = set()
    for k in parent:
        up = k
        for level in range(1, 6):
            if up not in parent:
                break
            up = parent[up]
            want.add((k, up, level))
    assert {(2002, 1001, 1), (2002, 250, 3), (500, 250, 1)} <= want
    assert set(run(spark, tmp_path, "subtype_chain", customer=[{"c_custkey": k} for k in keys])) == want


def test_merge_spans_of_every_key(spark, tmp_path):
    rows = [{"l_suppkey": k, "l_partkey": k * 13 + i * i, "l_linenumber": i % 7 + 1} for k in (1, 39, 40, 41, 700) for i in range(12)]
    want = []
    for k in sorted({r["l_suppkey"] for r in rows}):
        merged = []
        for a, b in sorted((r["l_partkey"] % 500, r["l_partkey"] % 500 + r["l_linenumber"]) for r in rows if r["l_suppkey"] == k):
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(k, a, b) for a, b in merged]
    assert sorted(run(spark, tmp_path, "merge_spans", lineitem=rows)) == want


def test_merge_spans_of_nulls_equals_its_sql(spark, tmp_path):
    import duckdb

    spans = [(1, 5, None), (1, 5, 2), (1, None, 3), (1, 30, 1), (2, 7, None), (2, 3, 5), (None, 4, 1), (None, 5, None), (3, -7, -2), (3, -7, -2), (4, 10, -5), (4, 8, 1)]
    rows = pd.DataFrame(spans, columns=["l_suppkey", "l_partkey", "l_linenumber"]).astype("Int64")
    got = run(spark, tmp_path, "merge_spans", lineitem=rows)
    want = duckdb.sql(registry.oracle_sql()["merge_spans"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet'")).fetchall()
    assert (1, 5, 7) in want and sorted(map(str, got)) == sorted(map(str, want))


def test_metric_match_broadcasts_labels_only(spark, tmp_path):
    from tessera.operators import metrics

    rows = pd.DataFrame({"conv_id": range(6), "turn": 1, "text": ["The one and the other", "that the", None, "THAT_THE", "other", "x.the"]})
    rows.to_parquet(f"{tmp_path}/conversations.parquet")
    df = registry.queries()["metric_match"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    want = [(1, "greeting", 1, 2), (1001, "greeting", 1, 1), (1001, "two_words", 0, 1), (3001, "two_words", 0, 1), (5001, "greeting", 1, 1)]
    assert sorted(tuple(r) for r in df.collect()) == want
    q = spark.createDataFrame([(1, "the total_sales of the year"), (2, "???"), (3, None)], "qid long, question string")
    m = spark.createDataFrame([("sales", "", "total sales", True), ("the", "", "the", False), ("odd", "", "???", True), ("none", "", None, True)], "metric string, namespace string, label string, is_name boolean")
    both = [metrics.match_metrics(q, m, label_bytes=b) for b in (metrics.LABEL_BYTES, -1)]
    assert "SortMergeJoin" in both[1]._jdf.queryExecution().executedPlan().toString()
    found = [sorted(tuple(r) for r in b.collect()) for b in both]
    assert found[0] == found[1] == [(1, "sales", 1, 1), (1, "the", 0, 1), (2, "odd", 1, 1)]


def test_metric_cascade_of_many_customers(spark, tmp_path):
    import duckdb

    rows = [{"c_custkey": k, "c_mktsegment": ("BUILDING", "MACHINERY", "HOUSEHOLD")[k % 7 % 3]} for k in (*range(60), 10**9, 10**9 + 1, 10**9 + 2)]
    pd.DataFrame(rows).to_parquet(f"{tmp_path}/customer.parquet")
    df = registry.queries()["metric_cascade"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Inner, BuildRight, RLIKE" in plan and "Inner, BuildLeft" not in plan  # labels are sent, questions aren't
    want = duckdb.sql(registry.oracle_sql()["metric_cascade"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet'")).fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted((q, m, h, float(f)) for q, m, h, f in want)


def test_best_ratio_passes_over_no_better_run():
    import difflib
    import random

    from tessera.functions import fuzzy

    pick, asked = random.Random(5), []
    for _ in range(300):
        text, label = (" ".join("".join(pick.choice("abC_") for _ in range(pick.randrange(1, 6))) for _ in range(pick.randrange(n))) for n in (9, 4))
        words, n = text.lower().split(), len(label.split())
        runs = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] + [" ".join(words)]
        assert fuzzy._best_ratio(text, label) == max(difflib.SequenceMatcher(None, r, label.lower()).ratio() for r in runs)
    whole = fuzzy.best_window_ratio.func
    was, fuzzy._best_ratio = fuzzy._best_ratio, lambda t, name: asked.append((t, name)) or was(t, name)
    try:
        assert list(whole(pd.Series(["a b", None, "a b", "a b"]), pd.Series(["b", "b", "b", "c"]))) == [1.0, 0.0, 1.0, 0.0]
    finally:
        fuzzy._best_ratio = was
    assert len(asked) == 3  # equal pairs once


def test_incremental_dedup_of_all_conversations(spark, tmp_path):
    rows = [{"conv_id": c, "turn": t} for c in (0, 1, 2, 59, 60, 61, 1000) for t in (1, 2, 2)]
    assert sorted(run(spark, tmp_path, "incremental_dedup", conversations=rows)) == sorted({(r["conv_id"], r["turn"]) for r in rows})


def test_literal_type_of_all_parts(spark, tmp_path):
    rows = [{"p_partkey": k, "p_retailprice": k + 0.5, "p_brand": "Brand#1"} for k in (1, 49, 50, 9000)]
    want = {"boolean": 1, "integer": 1, "decimal": 1 + 4, "date": 1, "dateTime": 1, "string": 1 + 4}
    assert dict(run(spark, tmp_path, "literal_type", part=rows)) == want


def test_fn_date_add_of_all_orders(spark, tmp_path):
    rows = [{"o_orderkey": k, "o_orderdate": pd.Timestamp("1995-01-31")} for k in (1, 499, 500, 90000)]
    assert sorted(run(spark, tmp_path, "fn_date_add", orders=rows)) == [(k, "1995-03-02") for k in (1, 499, 500, 90000)]


def test_upsert_merge_of_all_customers(spark, tmp_path):
    keys = [1, 2, 6, 99, 100, 101, 102, 5001]
    assert sorted(run(spark, tmp_path, "upsert_merge", customer=[{"c_custkey": k} for k in keys])) == [(k, "old" if k % 2 else "new") for k in keys]


def test_hop_union_takes_every_arm(spark):
    from tessera.operators import graphs

    one = {("s", "out", "c"), ("b", "in", "s")}
    sibling, bridge, beyond = {("e", "r", "c"), ("e", "r", "d")}, {("b", "r", "n")}, {("x", "r", "n"), ("x", "r", "y")}
    far = {("q", "r", "y"), ("u", "r", "v"), ("d", "r", "w")}
    edges = spark.createDataFrame(sorted(one | sibling | bridge | beyond | far), "src string, rel string, dst string")
    seeds = spark.createDataFrame([("s",)], "node string")
    assert {tuple(r)[:3] for r in graphs.expand(edges, seeds, hops=1).collect()} == one
    got = {tuple(r)[:3]: r["hop"] for r in graphs.expand(edges, seeds).collect()}
    assert got == {**dict.fromkeys(sibling | bridge | beyond, 2), **dict.fromkeys(one, 1)}


def test_cluster_classes_in_chunks(spark):
    """Groups of several chunks and of one, copies, near copies, ties, zero and missing vectors, a null group; against a plain fold."""
    import numpy as np

    from tessera.functions import fuzzy

    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = []
    for i in range(900):
        v = base[rng.integers(30)] * rng.uniform(0.5, 2) + rng.normal(size=8) * rng.choice([0, 0.05, 0.25, 0.6])
        rows.append(((1 if i % 5 < 3 else None) if i % 7 else 2, i * 37 % 900, v.astype("float32").tolist()))
    rows += [(1, 2000 + i, [float(j == i % 8) for j in range(8)]) for i in range(16)] + [(1, 2050, [0.0] * 8), (1, 2051, [0.0] * 8), (1, -5, None), (1, 2052, [float("nan")] * 8)]
    rows += [(1, 2060, [1.0, 1.0] + [0.0] * 6)]
    want = []
    for g in {r[0] for r in rows}:
        index = []
        for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            if v is None or not np.isfinite(v).all():
                want.append((g, o, o, "novel"))
                continue
            v = np.array(v)
            v = v / (np.linalg.norm(v) or 1)
            score, first = max(((round(float(w @ v), 12), -i) for i, (_, w) in enumerate(index)), default=(-1.0, 0))
            if score >= 0.95:
                want.append((g, o, index[-first][0], "exact"))
            else:
                want.append((g, o, o, "close_match" if score >= 0.8 else "novel"))
                index.append((o, v))
    assert {r[3] for r in want} == {"exact", "close_match", "novel"}
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>")
    for chunk in (37, 300, 5000):
        got = [tuple(r) for r in fuzzy.cluster_classes(df, "label", "vec_id", "vec_id", "embedding", chunk=chunk).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
