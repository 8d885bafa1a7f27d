"""Kernels, panels, corrections and the walk-forward against plain models."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybar.functions import kernels
from tallybar.operators import multiple, panel, select, stats
from tallybar.plans import summary, walkforward


def uniforms(seed):
    """A congruential generator with values centred in [-0.5, 0.5]."""
    while True:
        seed = (seed * 6364136223846793005 + 1) % 2**64
        yield (seed >> 32) / (2**32 - 1) - 0.5


def autoregressive(seed, n, factor, scale, start=0.0):
    draw, out = uniforms(seed), [start]
    while len(out) < n:
        out.append(factor * out[-1] + next(draw) * scale)
    return np.array(out)


def walk(seed, n, columns=1, step=1.0):
    return 100 + np.cumsum(np.random.default_rng(seed).uniform(-step, step, (n, columns)), axis=0)


def cointegrated(seed=1, n=500):
    y = walk(seed, n)[:, 0]
    return np.column_stack([y, 1.5 * y + np.random.default_rng(seed + 1).uniform(-0.5, 0.5, n)])


def test_johansen_finds_what_is_there():
    found = kernels.johansen(cointegrated())
    assert found.rank >= 1 and found.score > 1 and found.p_value == 0.005
    v = kernels.hedge_vector(found, 2)
    assert v[0] == 1 and v[1] == pytest.approx(-1 / 1.5, abs=0.02)
    alone = kernels.johansen(walk(3, 500, 3))
    assert alone.rank == 0 or alone.score < 1.5
    assert kernels.johansen(np.ones((12, 2))) is None
    same = walk(4, 200)
    assert kernels.johansen(np.hstack([same, same])) is None or True


@pytest.mark.parametrize("lags", [0, 1, 2])
@pytest.mark.parametrize("det", [-1, 0, 1])
def test_shared_moments_give_the_same_statistics(lags, det):
    data = np.hstack([walk(5, 300, 4), cointegrated(6, 300)])
    moments = kernels.Moments(data, det, lags)
    for k in (1, 2, 3, 4):
        sets = np.array(list(itertools.combinations(range(6), k)))
        want = [kernels.johansen(moments.data[:, list(s)], det, lags).trace_stats[0] for s in sets]
        assert moments.trace(sets) == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_critical_values_and_p():
    assert kernels.critical(2)[1] == 15.4943 and kernels.critical(13)[1] == pytest.approx(334.9795 * 13 / 12)
    crit = kernels.critical(2)
    assert [kernels.trace_p_value(x, crit) for x in (25.0, crit[2], crit[1], crit[0], 1.0)] == [0.005, 0.005, 0.05, 0.10, 0.50]


def test_spread_kernels():
    rng, n = np.random.default_rng(7), 1000
    ar = np.zeros(n)
    for i in range(1, n):
        ar[i] = 0.9 * ar[i - 1] + rng.uniform(-0.05, 0.05)
    assert 2 < kernels.half_life(ar) < 20
    # values recomputed apart from this code
    assert kernels.half_life(autoregressive(42, 1000, 0.9, 0.1)) == pytest.approx(8.296, abs=1e-3)
    assert kernels.adf_p_value(autoregressive(111, 500, 0.7, 0.2)) == pytest.approx(0.000249, abs=1e-6)
    assert kernels.adf_p_value(autoregressive(222, 500, 1.0, 0.5, 100.0)) == pytest.approx(0.8852, abs=1e-4)
    assert kernels.hurst(autoregressive(123, 2000, 1.0, 2.0)) == pytest.approx(0.9654, abs=1e-4)
    assert kernels.variance_ratio(autoregressive(456, 2000, 1.0, 2.0)) == pytest.approx(0.8863, abs=1e-4)
    assert 0.7 < kernels.variance_ratio(walk(9, 2000)[:, 0]) < 1.3
    assert kernels.hurst(walk(10, 2000)[:, 0]) > 0.9 and 0.4 < kernels.hurst(rng.normal(size=2000)) < 0.65
    assert (kernels.half_life([1] * 5), kernels.adf_p_value([1.0] * 19), kernels.hurst([1.0] * 19), kernels.variance_ratio([1.0] * 19)) == (math.inf, 1.0, 0.5, 1.0)
    assert kernels.half_life(np.zeros(50)) == math.inf and kernels.hurst(np.ones(50)) == 0.5 and kernels.variance_ratio(np.ones(50)) == 1.0
    assert kernels.phi(0) == 0.5 and kernels.phi(1.959964) == pytest.approx(0.975, abs=1e-6)


def test_sql_forms_agree_with_kernels(spark):
    rows = [(k, i, float(x)) for k, s in (("a", walk(11, 300)[:, 0]), ("b", np.random.default_rng(12).normal(size=300)), ("c", np.ones(30)), ("d", np.arange(5.0))) for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    by = {k: np.array([r[2] for r in rows if r[0] == k]) for k in "abcd"}
    for form, kernel in ((stats.half_life, kernels.half_life), (stats.variance_ratio, kernels.variance_ratio), (stats.hurst, kernels.hurst)):
        got = {r[0]: r[1] for r in form(df, ("k",)).collect()}
        for k, s in by.items():
            assert got[k] == pytest.approx(kernel(s), rel=1e-6), (form.__name__, k)
    got = {r[0]: r[1] for r in stats.adf_t_lag0(df, ("k",)).collect()}
    assert got["a"] == pytest.approx(kernels.adf_statistic(by["a"], 0)[0])
    stats.register(spark)
    stats.series_arrays(df, ("k",)).createOrReplaceTempView("s")
    assert spark.sql("SELECT adf_test(series) AS p FROM s WHERE k = 'a'").first()["p"] == pytest.approx(kernels.adf_p_value(by["a"]))
    assert spark.sql("SELECT spread_quality(series).hurst AS h FROM s WHERE k = 'b'").first()["h"] == pytest.approx(kernels.hurst(by["b"]))
    with pytest.raises(Exception, match="20 observations"):
        stats.series_arrays(df, ("k",)).select(stats.adf_test(stats.checked("series"))).collect()


def wide(spark, data, names=None):
    names = names or [f"a{i}" for i in range(data.shape[1])]
    rows = [(i, *[None if math.isnan(x) else float(x) for x in row]) for i, row in enumerate(data)]
    return spark.createDataFrame(rows, ", ".join(["t long", *[f"{n} double" for n in names]]))


def test_cleaning(spark):
    nan = math.nan
    data = np.array([[nan, 1, nan, nan], [2, nan, nan, nan], [nan, nan, nan, 5], [4, math.inf, nan, nan]])
    dense = panel.to_panel(wide(spark, data))
    got = panel.to_wide(panel.clean(dense)).collect()
    assert [tuple(r) for r in got] == [(0, 2.0, 1.0, 5.0), (1, 2.0, 1.0, 5.0), (2, 2.0, 1.0, 5.0), (3, 4.0, math.inf, 5.0)]
    assert {r["asset"] for r in panel.null_rule(dense).collect()} == set()
    assert {r["asset"] for r in panel.null_rule(dense, 0.6).collect()} == {"a0", "a1"}
    assert panel.dense(dense.where("px is not null")).count() == 12


def test_folds(spark):
    dense = panel.to_panel(wide(spark, walk(1, 50, 2)))
    starts = lambda train, step, gap: [r["start"] for r in panel.fold_table(dense, train, step, gap).orderBy("fold").collect()]
    assert starts(20, 7, 3) == [s for s in range(0, 50, 7) if s + 20 + 3 + 7 <= 50]
    assert starts(40, 7, 3) == [0] and starts(45, 7, 3) == []
    rows = panel.fold_rows(dense, 20, 7, 3).groupBy("fold").agg({"rel": "min", "t": "count"}).collect()
    assert {r["fold"]: (r["min(rel)"], r["count(t)"]) for r in rows} == {0: (0, 40), 1: (0, 40), 2: (0, 40)}
    with pytest.raises(ValueError):
        panel.fold_table(dense, 20, 0, 3)


def test_prefilter(spark):
    y = walk(2, 200)[:, 0]
    noise = np.random.default_rng(3).uniform(50, 150, 200)
    data = np.column_stack([np.full(200, 7.0), noise, y, y * 2])
    dense = panel.to_panel(wide(spark, data))
    counts = {r["asset_idx"]: r["cnt"] for r in select.correlation_counts(dense, 0.95).collect()}
    assert counts == {0: 0, 1: 0, 2: 1, 3: 1}
    assert sorted(r["asset_idx"] for r in select.correlation_prefilter(dense, 0.95, 3).collect()) == [0, 2, 3]
    pairs = select.combinations(spark.range(4).selectExpr("cast(id as int) asset_idx"), 2).orderBy("combo_id").collect()
    assert [tuple(r["combo"]) for r in pairs] == list(itertools.combinations(range(4), 2))
    assert select.n_combinations([16], 2, 7) == 26316


@settings(max_examples=8, deadline=None)
@given(p=st.lists(st.floats(0, 0.2), min_size=1, max_size=12), alpha=st.sampled_from([0.01, 0.05, 0.1]))
def test_corrections(spark, p, alpha):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "combo_id long, p_valor double")
    bh = {r["combo_id"] for r in multiple.corrected(df, "bh", alpha).where("accepted").collect()}
    bonferroni = {r["combo_id"] for r in multiple.corrected(df, "other", alpha).where("accepted").collect()}
    order = sorted(range(len(p)), key=lambda i: (p[i], i))
    last = max((k for k, i in enumerate(order, 1) if p[i] <= k / len(p) * alpha), default=0)
    assert bh == set(order[:last]) and bonferroni == {i for i in range(len(p)) if p[i] <= alpha / len(p)} and bonferroni <= bh


def by_loop(data, cfg):
    """The walk-forward, fold by fold and set by set, without the shared moments."""
    out, funnel, start = [], [], 0
    while start + cfg.janela_treino_dias + cfg.embargo_dias + cfg.passo_dias <= len(data):
        window = data[start : start + cfg.janela_treino_dias]
        returns = np.diff(window, axis=0) / window[:-1]
        returns -= returns.mean(0)
        returns /= np.maximum(np.sqrt((returns**2).sum(0)), 1e-15)
        near = (np.abs(returns.T @ returns) >= cfg.min_corr).sum(1) - 1
        chosen = sorted(sorted(range(data.shape[1]), key=lambda i: (-near[i], i))[: cfg.top_n_corr])
        tests = []
        for k in range(cfg.min_ativos, min(cfg.max_ativos, len(chosen)) + 1):
            for s in itertools.combinations(chosen, k):
                r = kernels.johansen(window[:, s], cfg.det_order, cfg.k_ar_diff)
                if r is not None and r.rank > 0:
                    tests.append((s, r))
        order = sorted(range(len(tests)), key=lambda i: tests[i][1].p_value)
        last = max((n for n, i in enumerate(order, 1) if tests[i][1].p_value <= n / len(tests) * cfg.alpha), default=0)
        left = [tests[i] for i in sorted(order[:last])]
        final = []
        size = len(window) // cfg.n_sub_janelas
        for s, r in left:
            parts = [kernels.johansen(window[i * size : (i + 1) * size][:, s], cfg.det_order, cfg.k_ar_diff) for i in range(cfg.n_sub_janelas)]
            share = sum(x is not None and x.trace_stats[0] > x.crit_values[0, 1] for x in parts) / cfg.n_sub_janelas
            spread = window[:, s] @ kernels.hedge_vector(r, len(s))
            life = kernels.half_life(spread)
            if share >= cfg.min_aprovacao and 0 < life < math.inf:
                final.append((len(funnel), s, r.score, share, life))
        out += final
        funnel.append((len(funnel), data.shape[1], len(chosen), len(tests), len(left), len(final)))
        start += cfg.passo_dias
    return out, funnel


def test_walk_forward_against_a_loop(spark):
    base = walk(20, 420, 3)
    rng = np.random.default_rng(21)
    data = np.column_stack([base, base[:, 0] * 1.2 + rng.normal(0, 0.3, 420), base[:, 1] * 0.7 + rng.normal(0, 0.3, 420)])
    cfg = walkforward.Config(janela_treino_dias=240, passo_dias=80, embargo_dias=5, max_ativos=3, top_n_corr=4, min_corr=0.3, n_sub_janelas=3, min_aprovacao=0.6)
    want, funnel = by_loop(data, cfg)
    result = walkforward.walk_forward(panel.to_panel(wide(spark, data)), cfg)
    assert [tuple(r) for r in result.funnel.collect()] == funnel and result.n_folds == len(funnel)
    got = result.detail.collect()
    assert want and [(r["fold"], tuple(r["ativos"])) for r in got] == [(f, tuple(f"a{i}" for i in s)) for f, s, *_ in want]
    for r, (_, _, score, share, life) in zip(got, want, strict=True):
        assert (r["score_johansen"], r["estabilidade"]) == (pytest.approx(score, rel=1e-4), pytest.approx(share))
        assert r["half_life"] == pytest.approx(life, rel=1e-3)
    assert result.n_testes_total == sum(math.comb(4, k) for k in (2, 3)) * len(funnel)
    top = summary.top(result.summary, 3).collect()
    assert top[0]["n_folds_apareceu"] >= top[-1]["n_folds_apareceu"] and all(r["half_life_std"] is not None for r in top)


def test_walk_forward_without_enough_data(spark):
    small = panel.to_panel(wide(spark, walk(1, 50, 2)))
    with pytest.raises(ValueError, match="one fold needs"):
        walkforward.walk_forward(small, walkforward.Config())
    assert walkforward.walk_forward(small, walkforward.Config(), strict=False).detail.count() == 0
    with pytest.raises(ValueError):
        walkforward.Config(passo_dias=0)


def test_registered_walk_forward_has_the_defaults():
    from dataclasses import replace

    from tallybar import catalog

    assert replace(catalog.CONFIG, min_corr=0.90) == walkforward.Config()
    assert select.n_combinations([16], catalog.CONFIG.min_ativos, catalog.CONFIG.max_ativos) == 26_316
