"""Path-dependent and structural operators against plain loops: stops, percentiles, weights, factor models, lots, appends, chains, draws."""

import collections
import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest

from quantloom.functions import graphs, walks
from quantloom.operators import construction, factor_risk, intervals, ledgers, pointintime, resampling, stops, valuation
from quantloom.sources import appends

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def looped_stops(rows):
    """Levels of one portfolio by the rules, written as one loop."""
    equity = peak = 1.0
    level, cooldown, dead, out = "normal", 0, False, []
    for ret, risk in rows:
        equity *= 1 + (ret or 0.0)
        dead = dead or equity <= 0
        peak = max(peak, equity)
        fall = min(1.0, max(0.0, 1 - equity / peak))
        cooldown -= cooldown > 0
        new = None
        if dead or level == "red" and (cooldown > 0 or risk == "risk_off"):
            new = "red"
        else:
            new = "red" if fall >= 0.2 else "orange" if fall >= 0.15 else "yellow" if fall >= 0.1 else "normal"
            if new == "red" and level != "red":
                cooldown = 10
        out.append((new, {"red": 0.0, "orange": 0.4, "yellow": 0.7, "normal": 1.0}[new], cooldown, new != level))
        level = new
    return out


def series(seed, n=40):
    rng = random.Random(seed)
    return [(None if rng.random() < 0.02 else -1.5 if seed % 97 == 0 and i == 20 else rng.gauss(0, 0.05), rng.choice(["risk_on", "risk_off", None])) for i in range(n)]


def test_stops_of_a_thousand_portfolios(spark):
    data = {k: series(k) for k in range(1000)}
    rows = [(k, day(i), *r) for k, x in data.items() for i, r in enumerate(x)]
    random.Random(1).shuffle(rows)
    got = collections.defaultdict(list)
    out = stops.drawdown_levels(spark.createDataFrame(rows, "book long, date date, ret double, risk string"))
    for r in out.toPandas().sort_values(["book", "date"]).itertuples():
        got[r.book].append((r.level, r.cap, r.cooldown, r.changed))
    assert got == {k: looped_stops(x) for k, x in data.items()}
    weights = spark.createDataFrame([(0, day(39), 7, 0.5), (5000, day(1), 7, 0.5)], "book long, date date, id long, weight double")
    assert {r.book: r.weight for r in stops.capped(weights, out).collect()} == {0: 0.5 * looped_stops(data[0])[-1][1], 5000: 0.5}


def test_streamed_stops_go_on_from_the_checkpoint(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "book long, ts timestamp, ret double, risk string"
    data = {k: series(k) for k in range(20)}
    part = lambda a, b: [(k, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *x[i]) for k, x in data.items() for i in range(a, b)]
    for cut, (a, b) in enumerate([(0, 13), (13, 14), (14, 40)]):  # each time a new query, from the same checkpoint
        spark.createDataFrame(part(a, b), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stops.streaming_levels(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), idle="3600" if cut == 9 else None)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    got = collections.defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["book", "ts"]).itertuples():
        got[r.book].append((r.level, r.cap, r.cooldown, r.changed))
    assert got == {k: looped_stops(x) for k, x in data.items()}


def test_hazen_percentiles_equal_pandas(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, float("nan"), *map(float, range(6))]), rng.random()) for k in "ab" for i in range(60)]
    got = walks.hazen_percentiles(spark.createDataFrame(rows, "id string, date int, x double, y double"), ["x", "y"], 9, 3, inverted=("y",)).toPandas()
    df = pd.DataFrame(rows, columns=["id", "date", "x", "y"])
    for k, g in df.groupby("id"):
        mine = got[got.id == k].sort_values("date")
        for c in "xy":
            p = []
            for i in range(len(g)):
                v = g[c].iloc[max(0, i - 8) : i + 1].dropna()
                p.append((len(v), (v.rank().iloc[-1] - 0.5) / len(v) if len(v) >= 3 else np.nan))
            assert mine[f"{c}_n"].tolist() == [n for n, _ in p]
            want = np.array([x for _, x in p])
            assert np.allclose(mine[f"{c}_percentile"].astype(float), 1 - want if c == "y" else want, equal_nan=True)


def test_student_p_values():
    for t, freedom, p in [(2.228138852, 10, 0.05), (12.706204736, 1, 0.05), (4.302652730, 2, 0.05), (1.699127027, 29, 0.1), (0.0, 7, 1.0), (3.182446305, 3, 0.05), (2.570581836, 5, 0.05)]:
        assert abs(valuation.two_sided_p(t, freedom) - p) < 1e-6
        assert valuation.two_sided_p(-t, freedom) == valuation.two_sided_p(t, freedom)


def fitted(x, close, row):
    """Weights as of a row, fitted from scratch on the table up to it."""
    names = list(valuation.FEATURES)
    train = x.iloc[: row + 1]
    prices = close[: row + 1]
    prior = {k: f[2] for k, f in valuation.FEATURES.items()}
    if len(train) > 252:
        train, prices = train.iloc[:-252], prices[:-252]
    if len(train) < 730:
        return prior, "training_history_too_short"
    future = pd.Series(prices).shift(-60) / pd.Series(prices) - 1
    sampled, future = train.iloc[::60], future.iloc[::60]
    keep = future.notna().values
    sampled, future = sampled[keep], future[keep]
    if len(sampled) < 6:
        return prior, "independent_samples_too_few"
    raw = {}
    for k in names:
        ok = sampled[k].notna().values
        a, b = sampled[k].values[ok], future.values[ok]
        ics = []
        for e in range(6, len(a) + 1):
            u, v = pd.Series(a[max(0, e - 30) : e]), pd.Series(b[max(0, e - 30) : e])
            if u.nunique() > 1 and v.nunique() > 1:
                ics.append(u.rank().corr(v.rank()))
        m, s = (np.mean(ics), np.std(ics, ddof=1)) if len(ics) > 1 else (0.0, 0.0)
        ir = abs(m) / s if s else 0.0
        p = valuation.two_sided_p(m / (s / math.sqrt(len(ics))), len(ics) - 1) if s else 1.0
        raw[k] = ir if m < 0 and p <= 0.1 and ir >= 0.3 else 0.0
    if sum(v > 0 for v in raw.values()) < 5:
        return prior, "surviving_features_too_few"
    own = {k: v / sum(raw.values()) for k, v in raw.items()}
    return {k: 0.7 * prior[k] + 0.3 * own[k] for k in names}, None


def test_weights_of_each_date_equal_a_fit_from_scratch(spark):
    rng = np.random.default_rng(4)
    n, names = 3600, list(valuation.FEATURES)
    close = np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    ahead = np.concatenate([close[60:] / close[:-60], np.ones(60)])
    x = pd.DataFrame({k: -np.argsort(np.argsort(ahead + rng.normal(0, 0.15, n))) / n + 1 for k in names})
    x.loc[rng.random(n) < 0.05, names[2]] = np.nan
    rows = [("a", day(i), float(close[i]), *(None if v != v else float(v) for v in x.iloc[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, date date, close double, " + ", ".join(f"{c}_percentile double" for c in names))
    got = valuation.weights_by_date(df).toPandas().sort_values("date").reset_index(drop=True)
    assert {"training_history_too_short", "shrunk_ic_ir"} <= set(got.reason.dropna()) | set(got.method)
    for row in [10, 700, 981, 1000, 1400, 1401, 2000, 2777, 3599]:
        weights, reason = fitted(x, close, row)
        assert got.reason[row] == reason or reason is None and pd.isna(got.reason[row]), row
        assert np.allclose([got[f"w_{k}"][row] for k in names], [weights[k] for k in names], atol=1e-9), row


def test_factor_models_equal_whole_covariances(spark):
    rng = np.random.default_rng(2)
    days, assets = 130, 12
    x = rng.normal(size=(days, 2)) @ rng.normal(size=(2, assets)) * 0.02 + rng.normal(size=(days, assets)) * 0.01
    rows = [(i, day(t), float(x[t, i])) for t in range(days) for i in range(assets) if rng.random() > 0.02 or t < 5]
    seen = {(i, d): r for i, d, r in rows}
    cal = spark.createDataFrame([(day(t), t + 1) for t in range(days)], "date date, seq int")
    got = factor_risk.factor_models(spark.createDataFrame(rows, "id long, date date, ret double"), cal, every=50, days=60, factors=3).toPandas()
    for end in (50, 100):
        lo = max(0, end - 60)
        m = np.array([[seen.get((i, day(t)), 0.0) for i in range(assets)] for t in range(lo, end)])
        n, p = m.shape
        c = m - m.mean(axis=0)
        s = c.T @ c / n
        mu = np.trace(s) / p
        delta = ((s - mu * np.eye(p)) ** 2).sum() / p
        beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / (n * n * p), delta)
        cov = ((1 - beta / delta) * s + beta / delta * mu * np.eye(p)) * n / (n - 1)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:3], vectors[:, ::-1][:, :3]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(3)] < 0, -1, 1)
        mine = got[got["asof"] == day(end - 1)].sort_values("id")
        assert np.allclose(np.array(mine.loadings.tolist()), vectors, atol=1e-8) and np.allclose(mine.variances.iloc[0], values, atol=1e-8)
        rest = np.diag(cov) - (vectors**2) @ values
        assert np.allclose(mine.specific, np.maximum(rest, 1e-8), atol=1e-8)
        w = spark.createDataFrame([(day(end - 1), i, 1 / assets) for i in range(assets)], "asof date, id long, weight double")
        full = vectors @ np.diag(values) @ vectors.T + np.diag(rest)
        v = factor_risk.model_volatility(w, spark.createDataFrame(got), shrink=0.2).first().volatility
        full = 0.8 * full + 0.2 * np.diag(np.diag(full))
        assert abs(v - math.sqrt(full.sum() / assets**2 * 252)) < 1e-8
    short = factor_risk.factor_models(spark.createDataFrame(rows[:60], "id long, date date, ret double"), cal, every=50, days=60).toPandas()
    assert (short.specific == 1e-8).all() and all(len(v) == 0 for v in short.loadings)


def queued(trades):
    """Lots by a plain queue: closes (opened, closed, n) and what stays."""
    q, out = collections.deque(), []
    for date, quantity, today, ratio in trades:
        if ratio and q:
            from decimal import Decimal

            total = round(Decimal(sum(n for _, n in q)) * Decimal(repr(ratio)))
            q = collections.deque((d, round(Decimal(n) * Decimal(repr(ratio)))) for d, n in q)
            q[-1] = (q[-1][0], q[-1][1] + total - sum(n for _, n in q))
        if not quantity:
            continue
        if q and q[0][1] * quantity < 0:
            left = quantity

            def close(i):
                nonlocal left
                d, n = q[i]
                if abs(n) <= abs(left):
                    out.extend([(d, date, n)] if n else [])
                    del q[i]
                    left += n
                else:
                    out.append((d, date, -left))
                    q[i] = (d, n + left)
                    left = 0

            if today and q[-1][0] >= date:
                close(-1)
            while left and q:
                close(0)
            if left:
                q.append((date, left))
        elif q and q[-1][0] == date:
            q[-1] = (date, q[-1][1] + quantity)
        else:
            q.append((date, quantity))
    return out, [(d, None, n) for d, n in q if n]


def test_lot_matches_equal_a_queue(spark):
    rng = random.Random(9)
    data = {k: [(day(i // 4), rng.choice([-7, -3, -1, 2, 3, 5, 0]), rng.random() < 0.4, rng.choice([None] * 12 + [1.1, 2.0, 0.7])) for i in range(80)] for k in range(30)}
    rows = [(k, i, *t) for k, x in data.items() for i, t in enumerate(x)]
    rng.shuffle(rows)
    got = collections.defaultdict(list)
    for r in ledgers.lot_matches(spark.createDataFrame(rows, "id long, seq long, date date, quantity long, today boolean, ratio double")).collect():
        got[r.id].append((r.opened, r.closed, r.quantity))
    for k, x in data.items():
        closed, still = queued(x)
        assert sorted(got[k], key=str) == sorted(closed + still, key=str), k


def test_lot_pairs_equal_a_queue(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([-6, -2, 1, 3, 4])) for k in range(20) for i in range(60)]
    got = {(r.id, r.opened.seq, r.closed.seq): r.quantity for r in ledgers.lot_pairs(spark.createDataFrame(rows, "id long, seq long, quantity long"), ["id"], ["seq"]).collect()}
    want = {}
    for k in range(20):
        q = collections.deque()
        for _, i, n in [r for r in rows if r[0] == k]:
            if n > 0:
                q.append([i, n])
            while n < 0 and q:
                take = min(-n, q[0][1])
                want[k, q[0][0], i] = take
                q[0][1] -= take
                n += take
                if not q[0][1]:
                    q.popleft()
    assert got == want


def test_appends_know_each_instrument(spark, tmp_path):
    path = str(tmp_path / "bars")
    df = lambda rows: spark.createDataFrame([(k, day(d), float(v)) for k, d, v in rows], "id long, date date, v double")
    add = lambda n, rows: appends.append_batch(df(rows), n, path, ["id", "date"], "date")
    with pytest.raises(ValueError):
        appends.appended(spark, path)
    add(0, [(1, 5, 1), (1, 5, 1)])
    add(1, [(2, 4, 2), (1, 8, 3), (1, 3, 9), (1, 5, 9)])  # a late instrument; rows behind the mark
    add(1, [(2, 4, 2), (1, 8, 3)])  # again
    df([(1, 9, 7), (2, 9, 7)]).write.parquet(f"{path}/rows/batch=2")  # a batch that broke off before its record
    assert sorted(map(tuple, appends.appended(spark, path).collect())) == [(1, day(5), 1.0), (1, day(8), 3.0), (2, day(4), 2.0)]
    add(2, [(1, 9, 8), (2, 9, 8), (3, 1, 8)])
    add(3, [])
    assert sorted(map(tuple, appends.appended(spark, path).collect()))[-1] == (3, day(1), 8.0) and appends.appended(spark, path).count() == 6
    ties = str(tmp_path / "ties")
    for n, rows in enumerate([[(1, 1, 1)], [(1, 1, 1), (1, 1, 2)]]):  # two keys at one time, in two batches
        appends.append_batch(df(rows), n, ties, ["id", "date", "v"], "date")
    assert appends.appended(spark, ties).count() == 2


def test_a_stream_appends_its_batches_once(spark, tmp_path):
    schema = "id long, date date, v double"
    rows = [[(1, day(1), 1.0), (2, day(3), 2.0)], [(2, day(4), 3.0), (1, day(1), 9.0)], [(3, day(0), 4.0)]]
    path = str(tmp_path / "table")
    for part in rows:  # each time a new query from the same checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        write = lambda batch, number: [appends.append_batch(batch, number, path, ["id", "date"], "date") for _ in range(2)]  # noqa: E731  delivered twice
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, appends.appended(spark, path).collect())) == [(1, day(1), 1.0), (2, day(3), 2.0), (2, day(4), 3.0), (3, day(0), 4.0)]


def test_audit_of_scores_equals_pandas(spark):
    rng = np.random.default_rng(9)
    rows = [("a", day(i), float(100 + rng.normal() * 5), None if i % 17 == 0 else float(rng.normal()), None if i < 30 else float(rng.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, date date, close double, total_score double, score_percentile double")
    got = {(r.period, r.horizon): r for r in valuation.score_audit(df, {"late": (str(day(150)), str(day(260)))}, horizons=(20,)).collect()}
    p = pd.DataFrame(rows, columns=["k", "date", "close", "s", "q"])
    p["ret"] = p.close.shift(-20) / p.close - 1
    flags = 0
    for period, part in (("overall", p), ("late", p[(p.date >= day(150)) & (p.date <= day(260))])):
        x = part.dropna(subset=["s", "q", "ret"])
        low, high = x[x.q <= 0.2], x[x.q >= 0.8]
        r = got[period, 20]
        assert np.allclose([r.samples, r.score_spearman, r.percentile_spearman, r.low_ret, r.high_ret, r.low_win_rate], [len(x), x.s.rank().corr(x.ret.rank()), x.q.rank().corr(x.ret.rank()), low.ret.mean(), high.ret.mean(), (low.ret > 0).mean()])
        own = int(low.ret.mean() - high.ret.mean() <= 0) + int(len(low) < 20) + int(len(high) < 20)
        assert (r.flags, r.low_count, r.high_count) == (own, len(low), len(high))
        flags += own
    assert {r.verdict for r in got.values()} == {"accurate" if not flags else "mixed" if flags <= 3 else "overfit_risk"}


def test_joins_say_what_does_not_match(spark):
    from quantloom.operators import reads, universe

    w = spark.createDataFrame([(day(0), 1, 0.5), (day(0), 2, 0.5)], "date date, id int, weight double")
    labels = spark.createDataFrame([(day(0), 1, 0.1)], "date date, id int, y double")
    assert universe.labelled(w, labels, "y", strict=False).where("y is null").count() == 1
    with pytest.raises(Exception, match="a weight has no y"):
        universe.labelled(w, labels, "y").collect()
    bars = spark.createDataFrame([(1, day(i), v, v, v, v, n, v) for i, (v, n) in enumerate([(1.0, 5.0), (2.0, 0.0)])], "id long, date date, open double, high double, low double, close double, volume double, turnover double")
    none = spark.createDataFrame([], "id long, ex_date date, factor double")
    ask = lambda **k: reads.prices(bars, none, [1], "2020-01-01", "2020-01-02", **k)
    assert ask(fields=["close"]).columns == ["id", "date", "close"] and ask(skip_suspended=True).count() == 1
    for bad in (dict(fields=["nothing"]), dict(adjust="sideways"), dict(frequency="1h"), dict(today="2020-01-02")):
        with pytest.raises(ValueError):
            ask(**bad)
    folds = lambda rows: spark.createDataFrame(rows, "fold int, test_start string, ic double")
    a, b = folds([(1, "a", 0.1), (2, "b", 0.2)]), folds([(1, "b", 0.5), (2, "c", 0.7)])
    assert [(r.test_start, r.delta_ic) for r in universe.aligned_folds(a, b, ["ic"]).collect()] == [("a", 0.4), ("b", 0.49999999999999994)] or universe.aligned_folds(a, b, ["ic"]).count() == 2


def test_chains_and_circles(spark):
    links = [(i, i + 1, 1.001) for i in range(1000)] + [(2000, 2001, 2.0), (2001, 2002, 3.0), (3000, 3001, 1.0), (3001, 3000, 1.0), (3002, 3000, 1.0), (None, 1, 1.0), (4000, None, 1.0)]
    got = {r.node: (r.end, r.hops, r.cyclic, r.ratio) for r in graphs.chain_ends(spark.createDataFrame(links, "node long, next long, ratio double"), "ratio").collect()}
    assert all(got[i][:3] == (1000, 1000 - i, False) for i in range(1000)) and abs(got[0][3] - 1.001**1000) < 1e-6
    assert got[2000][:3] == (2002, 2, False) and got[2000][3] == 6.0 and all(got[i] == (None, None, True, None) for i in (3000, 3001, 3002)) and len(got) == 1005
    assert graphs.chain_ends(spark.createDataFrame([], "node long, next long")).count() == 0
    c = {r.node: r.component for r in graphs.components(spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("q", "q"), ("r", None)], "a string, b string")).collect()}
    assert c == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_draws_do_not_depend_on_partitions(spark):
    rows = [("m", f, float(v)) for f, v in enumerate([0.1, -0.2, 0.4, 0.3, 0.05, -0.1, 0.2])] + [("one", 1, 0.5), ("gap", 1, None)]
    df = spark.createDataFrame(rows, "metric string, fold int, x double")
    exact = lambda r: tuple(round(v, 12) if isinstance(v, float) else v for v in r)  # noqa: E731  sums may run in another order
    one, four, many = (sorted(map(exact, resampling.bootstrap(df.repartition(n), "x", draws=200).collect())) for n in (1, 4, 16))
    assert one == four == many and [r[0] for r in one] == ["m", "one"]
    m = one[0]
    assert m[1] == 7 and m[3] <= m[2] <= m[4] and one[1][2:] == (0.5, 0.5, 0.5, False)


def water(scores, budget, cap):
    """Capped shares by repeated cutting."""
    s = {k: max(0.0, v) for k, v in scores.items()}
    if sum(s.values()) <= 0:
        s = dict.fromkeys(s, 1.0)
    left, out = min(budget, cap * len(s)), {}
    while s and left > 1e-15:
        total = sum(s.values())
        raw = {k: v / total * left if total > 0 else left / len(s) for k, v in s.items()}
        over = [k for k, v in raw.items() if v > cap + 1e-15]
        if not over:
            out |= raw
            break
        for k in over:
            out[k] = cap
            del s[k]
        left -= cap * len(over)
    return {k: v for k, v in out.items() if v > 1e-15}


def test_capped_shares_equal_repeated_cutting(spark):
    rng = random.Random(8)
    data = {d: {i: rng.choice([0.0, -1.0, rng.random(), rng.random() ** 4 * 10, 1.0]) for i in range(rng.randrange(1, 25))} for d in range(60)}
    df = spark.createDataFrame([(d, i, s) for d, x in data.items() for i, s in x.items()], "date int, id int, s double")
    for budget, cap in ((1.0, 0.1), (0.6, 0.3), (1.0, 1.0)):
        got = collections.defaultdict(dict)
        for r in construction.allocated(df, "s", cap, budget).collect():
            got[r.date][r.id] = r.weight
        for d, x in data.items():
            want = water(x, budget, cap)
            assert got[d].keys() == want.keys() and all(abs(got[d][k] - v) < 1e-12 for k, v in want.items()), (d, budget, cap)
    w = spark.createDataFrame([(1, i, 0.1, g) for i, g in enumerate(["a", "a", "a", "b", None, " "])] + [(2, i, 0.2, "Unknown") for i in range(4)] + [(3, i, 0.2, None) for i in range(4)], "date int, id int, weight double, g string")
    got = {(r.date, r.id): r.weight for r in construction.group_capped(w, "g", 0.25).collect()}
    want = water({"a": 0.3, "b": 0.1, "Unknown": 0.2}, 0.6, 0.25)
    assert all(abs(got[1, i] - want["a"] / 3) < 1e-12 for i in range(3)) and abs(got[1, 3] - want["b"]) < 1e-12 and abs(got[1, 4] - want["Unknown"] / 2) < 1e-12 and all(got[2, i] == 0.2 and abs(got[3, i] - 0.0625) < 1e-12 for i in range(4))


def test_budget_safe_orders_stay_within_cash(spark):
    rows = [
        ("a", 1, 0.5, 10.0, 0.0, 0.0, 100, 100, False, 11.0, 9.0, 100_000.0), ("a", 2, 0.5, 33.0, 1000.0, 1000.0, 100, 100, False, 36.0, 30.0, 100_000.0), ("a", 3, 0.0, 5.0, 777.0, 777.0, 100, 100, False, 6.0, 4.0, 100_000.0),
        ("a", 4, 0.0, 5.0, 500.0, 200.0, 100, 100, False, 6.0, 4.0, 100_000.0), ("a", 5, 0.0, 5.0, 500.0, 500.0, 100, 100, True, None, None, 100_000.0), ("b", 1, 1.0, 10.0, 0.0, 0.0, 100, 100, False, 10.0, 9.0, 1000.0),
    ]
    got = {(r.book, r.id): r for r in construction.budget_safe_orders(spark.createDataFrame(rows, "book string, id long, weight double, price double, held double, closable double, min_qty int, lot int, suspended boolean, limit_up double, limit_down double, cash double")).collect()}
    q = {k: r.quantity for k, r in got.items()}
    assert q["a", 3] == -777 and q["a", 4] == -200 and q["a", 5] == 0 and q["b", 1] == 0 and q["a", 1] % 100 == 0
    spent = sum(q["a", r[1]] * r[3] + (max(5, abs(q["a", r[1]] * r[3]) * 8e-4) + (abs(q["a", r[1]] * r[3]) * 5e-4 if q["a", r[1]] < 0 else 0) if q["a", r[1]] else 0) for r in rows[:5])
    assert spent < 100_000 and spent > 90_000


def test_quarters_as_they_were_known(spark):
    facts = spark.createDataFrame([(1, 8080 + i, dt.date(2020 + i // 4, 1 + 3 * (i % 4), 20), float(i)) for i in range(6)] + [(1, 8082, dt.date(2021, 1, 1), 99.0)], "id long, quarter int, info_date date, v double")
    probes = spark.createDataFrame([(1, dt.date(2020, 12, 31)), (1, dt.date(2021, 1, 1)), (1, dt.date(2019, 1, 1)), (2, dt.date(2021, 1, 1))], "id long, asof date")
    got = [(r.asof, r.quarter, r.v, r.place) for r in pointintime.latest_quarters(probes, facts, ["v"], count=2).orderBy("asof", "place").collect()]
    assert got == [(dt.date(2020, 12, 31), 8083, 3.0, 1), (dt.date(2020, 12, 31), 8082, 2.0, 2), (dt.date(2021, 1, 1), 8083, 3.0, 1), (dt.date(2021, 1, 1), 8082, 99.0, 2)]
    every = [(r.quarter, r.v) for r in pointintime.latest_quarters(probes.where("asof = date'2021-01-01'"), facts, ["v"], count=2, statements="all").orderBy("place").collect()]
    assert every == [(8083, 3.0), (8082, 99.0), (8082, 2.0), (8081, 1.0)]


def test_futures_are_active_on_their_last_day(spark):
    listed = spark.createDataFrame([(1, "x", day(0), day(10)), (2, "x", day(10), None)], "id long, code string, listed date, delisted date")
    asks = spark.createDataFrame([("x", day(n)) for n in (-1, 0, 10, 11)] + [("y", day(0))], "code string, date date")
    at = lambda inclusive: [(r.status, r.id) for r in intervals.active_on(asks, listed, inclusive=inclusive).orderBy("code", "date").collect()]
    assert at(False) == [("none", None), ("found", 1), ("found", 2), ("found", 2), ("none", None)] and at(True) == [("none", None), ("found", 1), ("several", None), ("found", 2), ("none", None)]
    assert intervals.clashes(listed).count() == 0 and intervals.clashes(listed, inclusive=True).first().days == 1


def looped_day(targets, current, r):
    """One date's executable weights by plain dictionaries; r: the rules."""
    def caps(weights, industry, gross):
        pos = {k: max(0.0, v) for k, v in weights.items()}
        if sum(pos.values()) <= 0 or gross <= 0:
            return {}
        out = water(pos, gross, r.max_weight if r.max_weight is not None else gross)
        if r.max_industry is not None and {industry.get(k) for k in pos} != {"Unknown"}:
            group = {k: industry.get(k) or "Unknown" for k in out}
            sums = collections.Counter()
            for k, v in out.items():
                sums[group[k]] += v
            goal = water(dict(sums), min(gross, sum(out.values())), r.max_industry)
            out = {k: v * goal.get(group[k], 0.0) / sums[group[k]] for k, v in out.items()}
        return {k: v for k, v in out.items() if v > 0}

    industry = {k: t[1] for k, t in targets.items()}
    alpha = {k: t[2] for k, t in targets.items()}
    liquid = {k: t[3] for k, t in targets.items()}
    held = {k: c[0] for k, c in current.items()}
    locked = {k: c[1] for k, c in current.items()}

    def limit(k, w):
        h = held.get(k, 0.0)
        if r.lock and w < h:
            w = max(w, locked.get(k, 0.0))
        if r.participation and r.value and w != h and liquid.get(k) is not None:
            most = liquid[k] * r.participation / r.value
            w = h + math.copysign(min(abs(w - h), most), w - h)
        return h if r.min_trade and abs(w - h) * r.value < r.min_trade else w

    def turn(w, rank):
        d = {k: v - held.get(k, 0.0) for k, v in w.items()}
        if r.max_turnover is None or sum(map(abs, d.values())) / 2 <= r.max_turnover:
            return w
        left = {1: r.max_turnover, -1: r.max_turnover}
        out = {}
        for k in sorted(w, key=lambda k: (-rank(k, d[k]), k)):
            side = 1 if d[k] > 0 else -1
            n = min(abs(d[k]), left[side])
            left[side] -= n
            out[k] = held.get(k, 0.0) + side * n
        return out

    first = caps({k: t[0] for k, t in targets.items() if abs(t[0]) >= r.min_weight}, industry, r.gross)
    liquid = {k: v for k, v in liquid.items() if k in first}  # what is known of a name goes with its target
    w = {}
    for k in set(first) | set(held):
        h, v = held.get(k, 0.0), first.get(k, 0.0)
        if abs(v - h) < r.buffer or r.alpha and v > h and (alpha.get(k) is None or k not in first or alpha[k] < r.alpha):
            v = h
        w[k] = limit(k, v)
    w = turn(w, lambda k, d: abs(d) * abs((alpha.get(k) if k in first else 0.0) or 0.0))
    seen = {k: industry[k] if k in first else None for k in w}
    again = caps(w, seen, min(r.gross, sum(max(0.0, v) for v in w.values())))
    w = {k: limit(k, again.get(k, 0.0)) for k in set(again) | set(held)}
    w = turn({k: v for k, v in w.items() if v > 0}, lambda k, d: 0.0)
    return {k: v for k, v in w.items() if v > 0}


@pytest.mark.parametrize("odd", [dict(), dict(max_weight=0.2, max_industry=0.4, buffer=0.02), dict(lock=True, max_turnover=0.15, alpha=0.01), dict(max_weight=0.25, participation=0.1, value=1e6, min_trade=3000.0, lock=True, buffer=0.005, alpha=0.005, max_turnover=0.3, min_weight=0.01, gross=0.9, max_industry=0.5)])
def test_executable_weights_equal_a_loop(spark, odd):
    from quantloom.operators.execution import Rules, executable

    rules, rng = Rules(**odd), random.Random(len(odd))
    targets, current = {}, {}
    for d in range(12):
        targets[d] = {i: (rng.random() / 8, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.gauss(0.01, 0.01)]), rng.choice([None, rng.random() * 1e6])) for i in rng.sample(range(20), 12)}
        current[d] = {i: (w := rng.random() / 10, w * rng.choice([0, 0, 0.5, 1])) for i in rng.sample(range(20), 8)}
    t = spark.createDataFrame([(d, i, *v) for d, x in targets.items() for i, v in x.items()], "date int, id int, weight double, industry string, alpha double, liquidity double")
    c = spark.createDataFrame([(d, i, *v) for d, x in current.items() for i, v in x.items()], "date int, id int, weight double, locked double")
    got = collections.defaultdict(dict)
    for row in executable(t, c, rules).collect():
        got[row.date][row.id] = row.weight
    for d in targets:
        want = looped_day(targets[d], current[d], rules)
        assert got[d].keys() == want.keys() and all(abs(got[d][k] - v) < 1e-9 for k, v in want.items()), d


def test_feature_reviews(spark):
    from quantloom.operators import feature_review

    rng = np.random.default_rng(6)
    rows = [(f, day(10 * f + t), i, float(y := rng.normal()), float(y + rng.normal()), float(rng.normal()), None if rng.random() < 0.7 else 1.0, 3.0) for f in range(4) for t in range(6) for i in range(15)]
    df = spark.createDataFrame(rows, "fold int, date date, id int, y double, good double, noise double, thin double, flat double")
    folds = feature_review.fold_metrics(df, ["good", "noise", "thin", "flat"], "y", top=4)
    p = pd.DataFrame(rows, columns=["fold", "date", "id", "y", "good", "noise", "thin", "flat"])
    for r in folds.where("feature in ('good', 'noise')").collect():
        x = p[p.fold == r.fold]
        stds, ics, spreads, hits, parts = [], [], [], [], collections.defaultdict(list)
        for _, g in x.groupby("date"):
            g = g.sort_values(r.feature, ascending=False)
            stds.append(g[r.feature].std(ddof=0)), ics.append(g[r.feature].rank().corr(g.y.rank())), spreads.append(g.y[:4].mean() - g.y[-4:].mean()), hits.append((g.y[:4] > 0).mean())
            for k in range(5):
                parts[k].append(g.y[3 * k : 3 * k + 3].mean())
        mono = pd.Series([5.0 - k for k in range(5)]).corr(pd.Series([np.mean(parts[k]) for k in range(5)]).rank())
        assert np.allclose([r.std, r.rank_ic, r.spread, r.hit_rate, r.monotonicity], [np.mean(stds), np.mean(ics), np.mean(spreads), np.mean(hits), mono]) and r.coverage == 1.0
    s = feature_review.summary(folds)
    twins = spark.createDataFrame([("noise", "good"), ("good", "good")], "feature string, representative string")
    got = {r.feature: (r.decision, r.reasons) for r in feature_review.reviewed(s, twins).collect()}
    assert got["good"] == ("keep", "") and got["noise"][0] == "drop_candidate" and "redundant" in got["noise"][1] and "low_coverage" in got["thin"][1] and "low_variance" in got["flat"][1]
    audit = {r.feature: (r.decision, r.reasons) for r in feature_review.audited(s, twins).collect()}
    assert audit["good"][0] == "keep_candidate" and audit["noise"][0] == "hard_exclude" and "redundant" in audit["noise"][1] and audit["flat"][0] == audit["thin"][0] == "hard_exclude"
