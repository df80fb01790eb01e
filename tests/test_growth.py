"""Steps whose cost grew too fast or lay in one task: right on odd rows, and planned so that it stays bounded."""

import contextlib
import io
import math
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quantloom import catalogue, queries_models
from quantloom.functions import frames
from quantloom.functions.order import quantiles
from quantloom.operators import construction, cross_section, diagnostics, evaluation, experiments, factor_risk, feature_review, features, gates, intervals, ledgers, panel, styles
from quantloom.sources import appends


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def odd_panel(spark):
    rnd, rows = random.Random(5), []
    for t in range(6):
        for i in range(1 if t == 5 else 12):
            x, z = float(rnd.randint(0, 4)), rnd.choice([None, 1.5, float(rnd.randint(0, 9))])
            rows.append((i, pd.Timestamp(2020, 1, 1 + t).date(), t // 3, x, z, None if t == 4 else 2.0, rnd.choice([None, rnd.random() - 0.5])))
    return rows, spark.createDataFrame(rows, "id long, date date, fold int, x double, z double, flat double, y double")


def test_rank_agreement_repeats_no_row_and_ranks_rows_that_have_both(spark):
    rows, df = odd_panel(spark)
    got = diagnostics.rank_agreement(df, ["x", "z", "flat"], least=3)
    assert "Generate" not in plan(got) and plan(got).count("FlatMapGroupsInArrow") == 1
    p = pd.DataFrame(rows, columns=df.columns)
    for r in got.collect():
        c = []
        for _, g in p.groupby("date"):
            if len(g) >= 3:
                both = g[[r.a, r.b]].astype(float).dropna().rank()
                v = both[r.a].corr(both[r.b]) if len(both) > 1 and (both.nunique() > 1).all() else 0.0
                c.append(v)
        assert r.dates == len(c) and math.isclose(r.agreement, sum(c) / len(c), abs_tol=1e-12)


def test_fold_metrics_repeat_no_row_for_a_feature(spark):
    rows, df = odd_panel(spark)
    got = feature_review.fold_metrics(df, ["x", "z", "flat"], "y", top=4)
    assert plan(got).count("Window") <= 2 and plan(got).count("FlatMapGroupsInArrow") == 1
    p = pd.DataFrame(rows, columns=df.columns)
    for r in got.collect():
        f = p[p.fold == r.fold]
        v = f[[r.feature, "y", "id", "date"]].dropna()
        days = [g.sort_values([r.feature, "id"], ascending=[False, True]) for _, g in v.groupby("date") if len(g) >= 2]
        k = [min(4, len(g) // 2) for g in days]
        mean = lambda x: float(np.mean(x)) if len(x) else 0.0
        assert (r.rows, r.valid) == (len(f), len(v))
        assert math.isclose(r.std, mean([g[r.feature].std(ddof=0) for g in days]), abs_tol=1e-12)
        assert math.isclose(r.spread, mean([g.y[:n].mean() - g.y[-n:].mean() for g, n in zip(days, k, strict=True)]), abs_tol=1e-12)
        assert math.isclose(r.hit_rate, mean([(g.y[:n] > 0).mean() for g, n in zip(days, k, strict=True)]), abs_tol=1e-12)
        ics = [g[r.feature].rank().corr(g.y.rank()) for g in days if g[r.feature].nunique() > 1 and g.y.nunique() > 1]
        assert r.dates == len(ics) and math.isclose(r.rank_ic, mean(ics), abs_tol=1e-12)


def test_quantiles_equal_numpy_with_ties_and_without_rows(spark):
    rnd = random.Random(3)
    marks = [0.0, 0.2, 0.5, 0.9, 1.0]
    for values in ([rnd.choice([1.0, 2.0, rnd.random()]) for _ in range(997)] + [None], [4.0] * 50, [7.5]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = quantiles(df, "v", marks).first().quantiles
        assert np.allclose(got, np.quantile([v for v in values if v is not None], marks), atol=1e-12)
    assert quantiles(spark.createDataFrame([], "v double"), "v", marks).first().quantiles == [None] * 5


def test_calibrator_gathers_no_whole_column(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, rnd.random(), 0.5]), rnd.choice([None, rnd.random() - 0.4])) for _ in range(500)]
    got = gates.calibrator(spark.createDataFrame(rows, "s double, y double"), "s", "y")
    assert "percentile" not in plan(got)
    s = np.array([a for a, b in rows if a is not None and b is not None])
    edges = np.quantile(s, [0.2, 0.4, 0.6, 0.8])
    bucket = (edges[None, :] < s[:, None]).sum(axis=1) + 1
    out = {r.bucket: r for r in got.collect()}
    assert sorted(out) == [1, 2, 3, 4, 5] and all(out[k].n == (bucket == k).sum() for k in out)
    assert np.allclose([out[k].upper for k in range(1, 5)], edges, atol=1e-12)


def test_percentile_of_last_compares_no_lists_and_equals_a_loop(spark):
    rnd = random.Random(6)
    values = [rnd.choice([None, 1.0, 2.0, rnd.random()]) for _ in range(600)]
    df = spark.createDataFrame([(1, pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=i), v) for i, v in enumerate(values)], "id long, date date, x double")
    got = features.percentile_of_last(df, "x", 40, 2)
    assert "collect_list" not in plan(got)
    for i, r in enumerate(got.orderBy("date").collect()):
        last, now = [v for v in values[max(0, i - 39) : i + 1] if v is not None], values[i]
        want = None if now is None or len(last) < 2 else (sum(v < now for v in last) + (sum(v == now for v in last) + 1) / 2 - 0.5) / len(last)
        assert (r.pct is None) == (want is None) and (want is None or math.isclose(r.pct, want))


def test_merged_ranges_keep_equal_ranges_together(spark):
    """Of equal ranges the first opens a run and the others belong to it, in whichever order they come."""
    d = lambda n: pd.Timestamp(2001, 6, n).date()
    ranges = [(1, d(1), d(4)), (1, d(9), d(12)), (1, d(9), d(12)), (1, d(9), d(12)), (1, d(13), d(20)), (2, d(3), d(2))]
    df = spark.createDataFrame(ranges, "key long, start date, end date").repartition(3)
    assert sorted(map(tuple, intervals.merged(df, ["key"]).collect())) == [(1, d(1), d(4), 1), (1, d(9), d(20), 4)]


def test_factor_models_do_not_depend_on_the_blocks(spark):
    """Late, rare and missing assets included; no window of all assets is gathered."""
    rnd, rows = random.Random(8), []
    for i in range(40):
        for t in range(rnd.randint(0, 30) if i % 4 else 70, 120):
            if t != 55 and rnd.random() < (0.1 if i == 7 else 0.8):
                rows.append((i, pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=t), rnd.random() - 0.5 + (t % 3) * 0.1 * i / 40))
    df = spark.createDataFrame(rows, "id long, date date, ret double")
    cal = spark.createDataFrame([(t + 1, pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=t)) for t in range(120)], "seq int, date date")
    for halflife in (None, 20.0):
        one, many = (factor_risk.factor_models(df, cal, every=30, days=50, halflife=halflife, block=b).toPandas().sort_values(["asof", "id"]).reset_index(drop=True) for b in (1000, 5))
        assert one[["asof", "id", "dates"]].equals(many[["asof", "id", "dates"]]) and len(one) > 100
        for c in ("loadings", "variances"):
            assert np.allclose(np.concatenate(one[c].tolist()), np.concatenate(many[c].tolist()), atol=1e-9)
        assert np.allclose(one.specific, many.specific, atol=1e-9)


def test_hold_band_gathers_no_book(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.5), (1, 2, 1, 0.5)], "book int, date int, id int, s double")
    assert "FlatMapGroupsInPandas" not in plan(styles.hold_band(df, "s"))


def test_budget_safe_orders_repeat_no_row_and_equal_a_loop(spark):
    rnd = random.Random(9)
    rows = []
    for book in ("a", "b", "c", None):
        for i in range(40):
            held = float(rnd.randint(0, 900))
            price = rnd.choice([None, 0.0, *(round(rnd.uniform(2, 90), 2) for _ in range(12))])
            rows.append((book, i, rnd.choice([None, 0.0, 0.01, 0.03, 0.05 if book == "c" else 0.02]), price, held, min(held, float(rnd.randint(0, 900))), 100, 100, rnd.choice([None, False, False, True]), price and price * rnd.choice([1.0, 1.5]), price and price * 0.6, 30_000.0))
    names = "book id weight price held closable min_qty lot suspended limit_up limit_down cash".split()
    df = spark.createDataFrame(rows, "book string, id long, weight double, price double, held double, closable double, min_qty int, lot int, suspended boolean, limit_up double, limit_down double, cash double")
    out = construction.budget_safe_orders(df)
    assert "Generate" not in plan(out)
    got = {(r.book, r.id): (r.safety, r.quantity) for r in out.collect()}

    def quantity(x, total, s):
        d = (round(total * s * (x.weight or 0.0) / x.price) if x.price else 0.0) - x.held
        d = d if -d == x.held else 0.0 if abs(d) < 50 else math.copysign(100, d) if abs(d) < 100 else round(d / 100) * 100.0
        d = -x.held if d < 0 and -d > x.held else d
        if x.suspended or x.price is None or d > 0 and x.price >= x.limit_up or d < 0 and x.price <= x.limit_down:
            d = 0.0
        return max(d, -x.closable)

    for book in ("a", "b", "c"):
        mine = [SimpleNamespace(**dict(zip(names, r, strict=True))) for r in rows if r[0] == book]
        total, want = 30_000 + sum(x.held * (x.price or 0.0) for x in mine), sum(x.weight or 0.0 for x in mine)

        def best(steps):
            found = []
            for s in steps:
                money = [quantity(x, total, s) * (x.price or 0.0) for x in mine]
                fee = sum(max(abs(m) * 8e-4, 5) + (abs(m) * 5e-4 if quantity(x, total, s) < 0 else 0) for m, x in zip(money, mine, strict=True) if quantity(x, total, s))
                if sum(money) + fee < 30_000:
                    found.append((round(abs((total - 30_000 + sum(money)) / total - want), 9), -s))
            return -min(found)[1] if found else None

        top = 1.2 if want > 0.95 else 1.0
        near = best([round(k * 0.02, 6) for k in range(round(top / 0.02) + 1)])
        s = None if near is None else best([v for v in (round(near + k * 0.001, 6) for k in range(-20, 21)) if 0 <= v <= top])
        assert all(got[book, x.id] == (s, int(quantity(x, total, s)) if s is not None else 0) for x in mine), book


def test_wide_windows_are_arrays_and_equal_pandas(spark):
    rnd = random.Random(12)
    v = [rnd.choice([None, 2.0, 2.0, rnd.random()]) for _ in range(300)] + [5.1] * 30
    x = frames.Series(np.array(v, float), np.array([e is not None for e in v]))
    p = pd.Series(v, dtype=float)
    for n, least in ((20, None), (20, 3), (60, 10), (600, 1)):
        w = p.rolling(n, min_periods=n if least is None else least)
        n_there = p.notna().astype(float).rolling(n, min_periods=1).sum()
        want = {"mean": w.mean(), "std": w.std(), "std0": w.std(ddof=0), "min": w.min(), "max": w.max(), "skew": w.skew() * (n_there - 2) / np.sqrt(n_there * (n_there - 1))}
        for kind, e in want.items():
            got = frames.rolling(kind, x, n, least)
            mine = pd.Series(np.where(got.there, got.v, np.nan))
            if kind == "skew":  # pandas gives 0 for equal values, null for fewer than three
                mine, e = mine[(n_there > 2) & (w.max() > w.min())], e[(n_there > 2) & (w.max() > w.min())]
            assert np.allclose(mine, e, atol=1e-8, equal_nan=True), (kind, n, least)
    still = slice(320, 330)
    assert (frames.rolling("std0", x, 10).v[still] == 0).all() and not frames.rolling("skew", x, 10).there[still].any()
    t0 = pd.Timestamp(2020, 1, 1)
    bars = spark.createDataFrame([(i, (t0 + pd.Timedelta(days=k)).date(), 3.0, 3.5, 2.5, rnd.choice([3.0, 2.9]), 10.0, 30.0) for i in range(2) for k in range(70)], "id long, date date, open double, high double, low double, close double, volume double, turnover double")
    for f in (features.volatility, features.oscillators, features.regression_slope, features.common):
        assert "ROWS BETWEEN" not in plan(f(bars)).upper() and "rowframe, -5" not in plan(f(bars)) and plan(f(bars)).count("FlatMapGroupsInArrow") == 1
    typed = bars.withColumn("asset_type", F.when(F.col("id") == 0, "ETF").otherwise("stock"))
    assert {r.cost for r in features.common(typed).where("id = 0").collect()} == {4e-4} and features.common(typed).count() == 140


def test_fees_join_rates_without_a_shuffle_by_product(spark):
    fills = spark.createDataFrame([(k, k % 3, 2.0, 100.0, "open", 0.0) for k in range(9)], "seq long, product long, lots double, amount double, effect string, today double")
    rates = spark.createDataFrame([(0, "money", 0.01, 0.0, 0.0), (1, "volume", 1.5, 2.0, 3.0)], "product long, kind string, open_rate double, close_rate double, close_today_rate double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ledgers.futures_fees(fills, rates)
        assert "hashpartitioning" not in plan(out)
        assert [r.commission for r in out.orderBy("seq").collect()] == [1.0, 3.0, 0.0] * 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_models_compute_the_panel_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(queries_models, "written", lambda df, label: calls.append(label) or df)
    catalogue.queries()["model_heads"](spark, "/root/testdata/sf0.001")
    assert calls == ["panel"]


def test_quality_sorts_once_and_counts_repeated_keys(spark):
    d = [pd.Timestamp(2020, 1, k).date() for k in range(1, 6)] + [None]
    rows = [(i, day, c) for i, day, c in [(1, d[0], 1.0), (1, d[1], 2.0), (1, d[1], 2.0), (1, d[1], 2.0), (1, d[3], None), (2, d[0], -1.0), (2, d[4], 0.0), (2, d[4], 5.0), (None, d[2], 1.0), (None, d[2], 1.0), (3, d[5], 1.0), (3, d[5], 1.0), (3, d[0], 1.0)]]
    out = panel.quality(spark.createDataFrame(rows, "id long, date date, close double"))
    assert "Expand" not in plan(out) and "Join" not in plan(out) and plan(out).count("Window ") == 1
    r = out.first()
    assert (r.n, r.ids, r.dates, r.missing, r.not_positive, r.repeated_keys) == (13, 3, 5, 1, 2, 4)


def test_experiments_are_summed_up_in_one_aggregate(spark):
    ic = {"a": [0.1, 0.3, 0.05, 0.02, 0.2, None], "b": [0.2, -0.1, 0.2, 0.1, 0.1, 0.1], "c": [None] * 6, None: [1.0] * 6}
    rows = [(k, 2000 + i, v, 0.1, 0.2, 0.1, 0.0, 0.01 * (i + 1), 0.1, 0.3) for k, x in ic.items() for i, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    folds = spark.createDataFrame(rows, "experiment string, fold int, ic double, spread double, val_ic double, val_spread double, gross double, net double, max_drawdown double, turnover double")
    out = experiments.summaries(folds)
    assert "Window" not in plan(out) and "Join" not in plan(out)
    got = {r.experiment: r for r in out.collect()}
    assert set(got) == {"a", "b"}  # no information of c, no name of the last
    for k, long in (("a", 2), ("b", 1)):
        x = [v for v in ic[k] if v is not None]
        m, mid = np.mean(x), np.median(x)
        cv = np.std(x) / abs(m)
        ramp = lambda v: min(100.0, max(0.0, (0.5 - v) / 0.4 * 100))
        want = 0.5 * ramp(cv) + 0.3 * min(100.0, max(0.0, min(x) / mid / 0.8 * 100)) + 0.2 * ramp(long / len(x))
        assert got[k].folds == 6 and math.isclose(got[k].stability, want) and math.isclose(got[k].stability_cv, cv) and got[k].stability_worst == min(x)
    assert {r.experiment: r.s for r in experiments.stability(folds, "ic", "s").where("experiment is not null").collect()} == {k: got[k].stability for k in got}
    assert "Window" not in plan(experiments.compared(folds, "b"))


def test_best_by_score_repeats_no_row_for_a_score(spark):
    rnd, nan = random.Random(6), float("nan")
    rows = [(rnd.choice([None, *range(40)]) if i % 9 == 0 else 100 + i, pd.Timestamp(2020, 1, 1 + i % 3).date(), rnd.choice([None, nan, 1.0, 2.0, rnd.random()]), None if i % 3 == 1 else float(rnd.randint(0, 3)), float(i)) for i in range(60)]
    rows += [(1, pd.Timestamp(2020, 2, 1).date(), None, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, date date, x double, z double, y double")
    out = cross_section.best_by_score(df, ["x", "z"], 4, ["y"])
    assert "Generate" not in plan(out) and "Window" not in plan(out) and plan(out).count("FlatMapGroupsInArrow") == 1
    want = {}
    for at, score in ((2, "x"), (3, "z")):
        for date in {r[1] for r in rows}:
            names = sorted((r for r in rows if r[1] == date and r[at] is not None), key=lambda r: (not math.isnan(r[at]), -r[at] if not math.isnan(r[at]) else 0.0, r[0] is not None, r[0] or 0))[:4]
            want |= {(score, date, r[4]): 1 / len(names) for r in names}
    assert {(r.score, r.date, r.y): r.weight for r in out.collect()} == want


def test_signal_summary_sorts_a_date_once(spark):
    rnd, nan = random.Random(8), float("nan")
    rows = [(i, pd.Timestamp(2020, 1, 1 + t).date(), rnd.choice([None, nan, 1.0, 2.0, rnd.random()]) if t < 4 else 3.0, rnd.choice([None, 0.0, 0.5, rnd.random() - 0.5])) for t in range(6) for i in range(30 if t else 3)]
    random.Random(2).shuffle(rows)
    out = evaluation.signal_summary(spark.createDataFrame(rows, "id long, date date, x double, y double"), "x", "y", 4)
    assert "Window" not in plan(out) and plan(out).count("FlatMapGroupsInArrow") == 1
    ics, spreads, hits = [], [], []
    for date in {r[1] for r in rows}:
        day = sorted((math.inf if math.isnan(r[2]) else r[2], r[0], r[3]) for r in rows if r[1] == date and r[2] is not None and r[3] is not None)
        if len(day) < 5:
            continue
        best = [y for _, _, y in sorted(day, key=lambda r: (-r[0], r[1]))[:4]]
        spreads.append(np.mean(best) - np.mean([y for _, _, y in day[:4]])), hits.append(np.mean([y > 0 for y in best]))
        a, b = pd.Series([r[0] for r in day]).rank(), pd.Series([r[2] for r in day]).rank()
        if a.nunique() > 1 and b.nunique() > 1:
            ics.append(a.corr(b))
    r = out.first()
    assert r.dates == len(ics) < len(spreads) and all(math.isclose(g, w, abs_tol=1e-12) for g, w in ((r.ic_mean, np.mean(ics)), (r.ic_ir, np.mean(ics) / np.std(ics)), (r.spread_mean, np.mean(spreads)), (r.hit_rate, np.mean(hits))))
    assert evaluation.signal_summary(spark.createDataFrame([], "id long, date date, x double, y double"), "x", "y").first().dates == 0


def test_unseen_rows_come_from_one_sort_by_instrument(spark, tmp_path):
    day = lambda k: pd.Timestamp(2020, 1, 1 + k).date() if k is not None else None
    df = lambda rows: spark.createDataFrame([(i, day(d), v, w) for i, d, v, w in rows], "id long, date date, v string, w double")
    marks = spark.createDataFrame([(1, day(3), "a", day(3)), (1, day(3), None, day(3)), (1, day(1), "b", day(1)), (2, day(5), "a", day(5))], "id long, date date, v string, _mark date")
    rows = [(1, 3, "a", 1.0), (1, 3, None, 2.0), (1, 3, "c", 3.0), (1, 2, "z", 4.0), (1, None, "z", 5.0), (1, 4, "a", 6.0), (1, 4, "a", 6.0), (2, 4, "q", 7.0), (3, None, None, 8.0), (3, None, None, 8.0), (None, 1, "x", 9.0), (1, 1, "b", 10.0)]
    new = appends.unseen(df(rows), marks, ["id", "date", "v"], "date")
    assert "Join" not in plan(new) and "Aggregate" not in plan(new) and plan(new).count("Exchange") == plan(new).count("Sort [") == 1
    assert new.columns == ["id", "date", "v", "w"] and sorted(r.w for r in new.collect()) == [3.0, 6.0, 8.0, 9.0]
    assert [r.w for r in appends.unseen(df([(1, 1, "k", 1.0), (1, 3, "k", 3.0), (1, 2, "k", 2.0)]), None, ["id", "v"], "date").collect()] == [3.0]  # the newest of a key
    path = str(tmp_path / "table")
    for number in range(2):  # a null in a key is no new key
        appends.append_batch(df([(1, 3, None, 1.0), (1, 3, "a", 2.0)]), number, path, ["id", "date", "v"], "date")
    assert sorted(r.w for r in appends.appended(spark, path).collect()) == [1.0, 2.0]
