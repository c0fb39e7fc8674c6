"""Metrics, ranks, splits, joins and retrieval against brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lurewatch.functions.calc import wilson
from lurewatch.operators import isotonic as I
from lurewatch.operators import joins as J
from lurewatch.operators import metrics as M
from lurewatch.operators import ranks as R
from lurewatch.operators import sampling as S
from lurewatch.operators import vector_index as VI
from lurewatch.operators import vectors as V
from lurewatch.operators import windows as WN


def scored(spark, n=400, seed=1, hot=False):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 1), 0.5 if hot and i % 3 == 0 else round(rng.random(), 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, y int, p double")


def test_wilson_golden(spark):
    df = spark.createDataFrame([(85, 150), (150, 150), (120, 120), (0, 0)], "k int, n int")
    low, high = wilson("k", "n")
    got = [(round(r.a, 10), round(r.b, 10)) for r in df.select(low.alias("a"), high.alias("b")).collect()]
    assert got == [(0.4866784071, 0.643325441), (0.9750288609, 1.0), (0.9689797289, 1.0), (0.0, 0.0)]


def test_auc_against_all_pairs(spark):
    for hot in (False, True):  # a third of all rows may share one score
        rows, df = scored(spark, hot=hot)
        pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
        want = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
        assert abs(M.roc_auc(df).first()["auc"] - want) < 1e-12
    assert M.roc_auc(df.filter("y = 1")).first()["auc"] is None


def test_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, yhat int")
    r = M.binary_metrics(df).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1.0, 0.0, 0.0, 0.0)


def test_ranks_are_exact_for_any_skew(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(0)))
    got = R.hash_rank(df, "id", 9, by=["g"]).groupBy("g").agg(
        F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_distinct("rank").alias("d")).collect()
    assert all(r.a == 1 and r.b == r.n == r.d for r in got)
    assert S.sample_n(df, "id", 777).count() == 777
    assert S.sample_n(df, "id", 9999).count() == 3000
    assert sorted(r.pos for r in R.ordinal(df, "id").collect()) == list(range(3000))


def test_value_at_and_upper_median(spark):
    for n in (1, 2, 7, 100, 101):
        vals = [random.Random(n * 7 + i).random() for i in range(n)]
        df = spark.createDataFrame([(v,) for v in vals], "p double")
        assert R.upper_median(df, "p").first()["value"] == sorted(vals)[n // 2]


def test_domain_split_is_disjoint(spark):
    df = spark.createDataFrame([(f"https://s{i}.d{i % 37}.com/x",) for i in range(500)], "url string")
    for exact in (False, True):
        out = S.domain_split(df, exact=exact)
        assert out.count() == 500
        assert out.groupBy("domain").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    sides = out.select("domain", "split").distinct().groupBy("split").count().collect()
    assert {r.split: r["count"] for r in sides} == {"train": 27, "test": 10}


def test_stratified_split_sizes(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    got = S.stratified_split(df, "y", "id", 0.111).groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in got} == {(0, "test"): 100, (0, "train"): 800, (1, "test"): 11, (1, "train"): 89}


def test_caps_and_first_wins_prune_before_the_shuffle(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "b").otherwise("a"))
    capped = WN.cap_per_group(df, "g", {"a": 7, "b": 3}, "id")
    assert sorted((r.g, r.id) for r in capped.collect()) == [("a", i) for i in (1, 2, 4, 5, 7, 8, 10)] + [("b", i) for i in (0, 3, 6)]
    for job in (capped, WN.dedupe_first(df, "g", "id")):
        assert "WindowGroupLimit" in job._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_interval(spark):
    counts = spark.createDataFrame([(11327, 273, 228, 5902)], "tn long, fp long, fn long, tp long")
    got = {r.metric: (r.ci_low, r.ci_high) for r in M.bootstrap_ci(counts).collect()}
    assert abs(got["precision"][0] - 0.951) < 0.002 and abs(got["precision"][1] - 0.961) < 0.002
    assert abs(got["recall"][0] - 0.958) < 0.002 and abs(got["recall"][1] - 0.968) < 0.002
    assert got == {r.metric: (r.ci_low, r.ci_high) for r in M.bootstrap_ci(counts).collect()}


def test_threshold_sweep(spark):
    rows, df = scored(spark)
    best = None
    for i in range(13):
        t = round(0.2 + 0.05 * i, 2)
        tp = sum(y and p >= t for _, y, p in rows)
        fp = sum((not y) and p >= t for _, y, p in rows)
        fn = sum(y and p < t for _, y, p in rows)
        f1 = 2 * tp / (2 * tp + fp + fn)
        if best is None or f1 > best[1]:
            best = (t, f1)
    assert M.sweep_threshold(df).filter("chosen").first()["threshold"] == best[0]


def test_calibration_equals_interp(spark):
    rng = np.random.default_rng(4)
    x = np.sort(rng.random(60))
    y = np.cumsum(rng.random(60))
    p = np.concatenate([rng.random(500) * 1.4 - 0.2, x, [x[0], x[-1]]])
    knots = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "id long, p double")
    got = [r.calibrated for r in J.calibrate(df, knots).orderBy("id").collect()]
    assert np.allclose(got, np.interp(p, x, y))


def _pooled(rows):
    """max over j <= i of min over k >= i of the mean of scores j..k"""
    ps = sorted({p for p, _ in rows})
    at = [[y for p, y in rows if p == v] for v in ps]
    mean = lambda j, k: sum(map(sum, at[j:k + 1])) / sum(map(len, at[j:k + 1]))
    return ps, [max(min(mean(j, k) for k in range(i, len(ps))) for j in range(i + 1)) for i in range(len(ps))]


def test_isotonic_equals_max_min(spark):
    for seed, scores in [(1, 40), (2, 12), (3, 1)]:
        rng = random.Random(seed)
        rows = [(rng.randrange(scores) / 40, rng.randint(0, 1)) for _ in range(300)]
        ps, want = _pooled(rows)
        df = spark.createDataFrame(rows + [(None, 1), (0.5, None), (float("nan"), 1), (float("inf"), 0)], "p double, y int")
        for parts in ("1", "8", "40"):      # 40: ranges are merged in two rounds
            old = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            try:
                blocks = sorted(I.isotonic_blocks(df).collect(), key=lambda r: r.lo)
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", old)
            assert sum(b.n for b in blocks) == 300 and [b.is_last for b in blocks] == [False] * (len(blocks) - 1) + [True]
            got = [next(b.fitted for b in blocks if b.lo <= p <= b.hi) for p in ps]
            assert np.allclose(got, want)
        knots = sorted(I.isotonic_knots(I.isotonic_blocks(df)).collect(), key=lambda r: r.pos)
        assert [k.pos for k in knots] == list(range(201))
        assert np.allclose([k.y for k in knots], np.interp([k.x for k in knots], ps, want))


def test_isotonic_of_nothing_and_of_rising_labels(spark):
    empty = spark.createDataFrame([], "p double, y int")
    assert I.isotonic_blocks(empty).count() == 0 and I.isotonic_knots(I.isotonic_blocks(empty)).count() == 0
    rising = spark.createDataFrame([(i / 100, i / 100) for i in range(101)], "p double, y double")
    assert I.isotonic_blocks(rising).count() == 101


def test_redirects(spark):
    edges = spark.createDataFrame([
        ("http://a.org", 301, "http://b.org", True), ("http://b.org", 302, "http://c.org", True), ("http://c.org", 302, "http://a.org", True),
        ("http://s.org", 301, "http://s.org", True), ("http://bit.ly/x", 301, "/y", True), ("http://bit.ly/y", 301, "http://10.0.0.1/z", True),
        ("http://p.org", 301, "http://q.org", False), ("http://n.org", 301, None, True), ("http://o.org", 200, "http://a.org", True),
        *[(f"http://l{i}.org", 302, f"http://l{i + 1}.org", True) for i in range(9)]],
        "url string, status int, location string, public boolean")
    urls = ["a.org", "http://a.org", "http://s.org", "http://bit.ly/x", "http://p.org", "http://n.org", "http://o.org", "http://l0.org", "http://zzz.org"]
    df = spark.createDataFrame([(u,) for u in urls * 2], "url string")
    out = J.resolve_redirects(df, edges)
    assert out.count() == len(urls) * 2
    got = {r.url: r for r in out.collect()}
    assert got["a.org"].redirect_chain == ["http://b.org", "http://c.org", "http://a.org"]
    assert got["a.org"].final_url == "http://a.org" and got["a.org"].original_url == "http://a.org"
    assert not got["http://s.org"].redirected and not got["http://n.org"].redirected and not got["http://o.org"].redirected
    assert got["http://bit.ly/x"].final_url == "http://10.0.0.1/z" and got["http://bit.ly/x"].blocked and got["http://bit.ly/x"].was_shortener
    assert got["http://p.org"].blocked and got["http://p.org"].final_url == "http://p.org"
    assert got["http://l0.org"].final_url == "http://l5.org" and not got["http://zzz.org"].redirected


def test_knn_is_exact_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    c, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    c[100:200] = c[0]  # a third of the corpus are copies of one vector
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "vec_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    sims = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    want = {i: [int(j) for j in np.lexsort((np.arange(300), -np.round(sims[i], 9)))[:10]] for i in range(7)}
    for limit, cut in ((1 << 20, 1 << 20), (100, 5000)):  # broadcast, then joined in blocks
        monkeypatch.setattr(V, "MAX_QUERY_BYTES", limit)
        monkeypatch.setattr(V, "MAX_CORPUS_BYTES", cut)
        got = {}
        for r in V.knn(queries, corpus, 10).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert {k: sims[k][v].round(9).tolist() for k, v in got.items()} == {k: sims[k][v].round(9).tolist() for k, v in want.items()}
    monkeypatch.setattr(V, "MAX_QUERY_BYTES", 1 << 20)
    exact = V.ann(queries, corpus, 10, lists=4, probe=4)
    assert V.recall(exact, V.knn(queries, corpus, 10)).first()["recall"] == 1.0


def test_best_keeps_ties_by_id_over_tiles(monkeypatch):
    rng = np.random.default_rng(3)
    q, m = rng.integers(-1, 2, (9, 3)).astype(float), rng.integers(-1, 2, (500, 3)).astype(float)
    names = rng.permutation(500)
    monkeypatch.setattr(V._Best, "TILE", 64)
    best = V._Best(9, 5)
    for at in range(0, 500, 70):
        best.add_dot(q, m[at:at + 70], names[at:at + 70])
    sims = q @ m.T
    want = [[int(n) for n in names[np.lexsort((names, -sims[i]))[:5]]] for i in range(9)]
    assert [list(r) for r in best.name] == want


def test_stored_index(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    hubs = rng.normal(size=(12, 8))
    c = hubs[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.1
    c[300:600] = c[0]       # a third of the rows are one vector
    vec = lambda v: [float(x) for x in v]
    corpus = spark.createDataFrame([(i, vec(v), "x") for i, v in enumerate(c)] + [(900, None, "x")],
                                   "vec_id long, embedding array<double>, rank string").repartition(5)
    queries = spark.createDataFrame([(i, vec(c[i])) for i in range(0, 900, 45)] + [(1, None)], "query_id long, embedding array<double>")
    path = str(tmp_path / "index")
    VI.build_index(corpus, path, lists=10, rows_per_file=40)
    assert spark.read.parquet(f"{path}/cells").agg(F.sum("n")).first()[0] == 900
    rows = lambda df: [(r.query_id, r["rank"], r.vec_id, round(r.vector_score, 9)) for r in df.orderBy("query_id", "rank").collect()]
    truth = rows(V.knn(queries.dropna(), corpus.dropna().drop("rank"), 10))
    assert rows(VI.search_index(queries, path, 10, probe=10)) == truth
    some = VI.search_index(queries, path, 10, probe=3)
    few = rows(some)
    assert V.recall(some, V.knn(queries.dropna(), corpus.dropna().drop("rank"), 10)).first()["recall"] >= 0.9
    enough = VI.probe_for_recall(queries, path, 10, 0.95)
    truth_df = V.knn(queries.dropna(), corpus.dropna().drop("rank"), 10)
    share = lambda probe: V.recall(VI.search_index(queries, path, 10, probe), truth_df).first()["recall"]
    assert share(enough) >= 0.95 and (enough == 1 or share(enough - 1) < 0.95)
    monkeypatch.setattr(V, "MAX_QUERY_BYTES", 300)      # query blocks against slices of cells
    assert rows(VI.search_index(queries, path, 10, probe=3)) == few
    assert rows(VI.search_index(queries, path, 10, probe=10)) == truth
    assert VI.search_index(queries.filter("query_id = 1"), path).count() == 0
    # a search reads the folders of its cells only, and a long cell is many files
    files = lambda df: df.select("_metadata.file_path").distinct().count()
    hot = spark.read.parquet(f"{path}/vectors").groupBy("cell").count().orderBy(F.desc("count")).first().cell
    assert 7 <= files(VI.probed_vectors(spark, path, [hot])) < files(spark.read.parquet(f"{path}/vectors"))


def test_index_refuses_what_it_cannot_hold(spark, tmp_path):
    import pytest
    row = spark.createDataFrame([(1, [1.0], 2)], "vec_id long, embedding array<double>, cell int")
    for bad, lists in ((row, 1), (row.drop("cell"), 1 << 24), (row.drop("cell").filter("vec_id > 1"), 1)):
        with pytest.raises(ValueError):
            VI.build_index(bad, str(tmp_path / "i"), lists=lists)


def test_asn_prefers_the_longest_prefix(spark):
    prefixes = spark.createDataFrame([("10.0.0.0", 8, 1), ("10.1.0.0", 16, 2), ("10.1.2.0", 24, 3), ("0.0.0.0", 0, 9)], "network string, bits int, asn int")
    df = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("10.9.9.9",), ("11.0.0.1",), ("x",)], "ip string")
    assert {r.ip: r.asn for r in J.asn_for_ip(df, prefixes).collect()} == {"10.1.2.3": 3, "10.1.9.9": 2, "10.9.9.9": 1, "11.0.0.1": 9, "x": -1}


def test_grid_has_every_combination(spark):
    got = {(r.a, r.b) for r in J.grid(spark, a=["x", "y", "z"], b=["1", "2"]).collect()}
    assert got == set(itertools.product("xyz", "12"))
    pool = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "k int, t string")
    assert [r.t for r in S.cycle_to(pool, 17, "k").orderBy("i").collect()] == [f"t{i % 7}" for i in range(17)]
    assert S.cycle_to(pool, 3, "k").count() == 3
