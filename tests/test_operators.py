"""Operators on hand-made frames, leakage and streams."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.operators import cross_section, evaluation, features, labels, panel, portfolio
from quantloom.streaming import ticks


def bars(spark, n=90, ids=3):
    rows = []
    for i in range(ids):
        for t in range(n):
            c = 100 + i + t * 0.3 + (t * 7919 % 13)
            rows.append((i, dt.date(2024, 1, 1) + dt.timedelta(days=t), c - 1, c + 2, c - 2, c, float(100 + t % 7), c * 100))
    return spark.createDataFrame(rows, "id long, date date, open double, high double, low double, close double, volume double, turnover double")


def test_entry_query_has_one_row(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_features_do_not_look_ahead(spark):
    df = bars(spark)
    cut = dt.date(2024, 3, 10)
    for f in (features.momentum, features.volatility, features.liquidity, features.oscillators, features.regression_slope, features.crossings):
        whole = f(df).where(f"date <= '{cut}'").toPandas().sort_values(["id", "date"]).reset_index(drop=True)
        part = f(df.where(f"date <= '{cut}'")).toPandas().sort_values(["id", "date"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(whole, part)


def test_exponential_equals_recursion(spark):
    got = R.exponential(bars(spark, 30, 1), {"y": ("close", 0.25, 3)}).orderBy("date").toPandas()
    want = got["close"].ewm(alpha=0.25, adjust=False, min_periods=3).mean()
    assert (got["y"].isna() == want.isna()).all() and (got["y"] - want).abs().max() < 1e-9


def test_asof_is_inclusive_and_per_key(spark):
    facts = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k int, at int, v string")
    probes = spark.createDataFrame([(1, 9), (1, 10), (1, 25), (2, 5), (3, 1)], "k int, t int")
    got = {(r.k, r.t): r.v for r in R.asof(probes, facts, ["k"], "t", "at", ["v"]).collect()}
    assert got == {(1, 9): None, (1, 10): "a", (1, 25): "b", (2, 5): "c", (3, 1): None}


def test_capped_weights_sum_to_one(spark):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate([10.0, 5.0, 1.0, 1.0, 1.0, -1.0])], "date string, id int, score double")
    got = {r.id: r.weight for r in cross_section.capped_weights(df, "score", 0.3).collect()}
    assert abs(sum(got.values()) - 1) < 1e-12 and max(got.values()) <= 0.3 + 1e-12 and 5 not in got
    assert abs(got[0] - 0.3) < 1e-12 and abs(got[1] - 0.3) < 1e-12 and abs(got[2] - 0.4 / 3) < 1e-12


def test_folds_keep_the_embargo(spark):
    cal = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), i + 1) for i in range(60)], "date date, seq int")
    rows = {(r.fold, r.part): (r.first, r.last) for r in labels.folds(cal, 20, 5, 5, 2, 10).collect()}
    assert rows[1, "train"] == (1, 20) and rows[1, "valid"] == (23, 27) and rows[1, "test"] == (30, 34)
    assert max(r[1] for r in rows.values()) <= 60


def test_labels_look_only_ahead_of_the_entry(spark):
    got = labels.forward_returns(bars(spark, 20, 1)).orderBy("date").collect()
    close = [r.close for r in bars(spark, 20, 1).orderBy("date").collect()]
    assert abs(got[0].fwd5 - (close[6] / close[1] - 1)) < 1e-12 and got[-1].fwd1 is None


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "k int, a double, b double")
    new = spark.createDataFrame([(1, None, 9.0), (3, 5.0, None)], "k int, a double, b double")
    keep = {r.k: (r.a, r.b) for r in panel.upserted(old, new, ["k"]).collect()}
    over = {r.k: (r.a, r.b) for r in panel.upserted(old, new, ["k"], keep_old_on_null=False).collect()}
    assert keep == {1: (1.0, 9.0), 2: (3.0, 4.0), 3: (5.0, None)} and over[1] == (None, 9.0)


def test_layers_fill_by_field(spark):
    a = spark.createDataFrame([(1, 1.0, None)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "k int, x double, y double")
    assert {r.k: (r.x, r.y) for r in panel.layered([a, b], ["k"]).collect()} == {1: (1.0, 3.0), 2: (4.0, 5.0)}


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")
    got = {r.test: round(r.adjusted, 6) for r in evaluation.adjusted_p(df, "p").collect()}
    assert got == {"a": 0.03, "b": 0.04, "c": 0.04}


def test_minimum_commission_is_paid_once(spark):
    df = spark.createDataFrame([(1, 1, 1, dt.date(2024, 1, 1), "BUY", 1000.0), (1, 1, 2, dt.date(2024, 1, 1), "SELL", 100000.0)], "account int, day int, order_id int, date date, side string, amount double")
    got = [(r.commission, r.tax) for r in panel.order_fees(df, 0.0001, 5.0).orderBy("order_id").collect()]
    assert abs(got[0][0] - 5.0) < 1e-9 and abs(got[0][0] + got[1][0] - 10.1) < 1e-9 and abs(got[1][1] - 50.0) < 1e-9


def test_tick_bars_stream_equals_batch(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, h, m), float(h * 60 + m), "x", h * 100 + m) for h in range(3) for m in (0, 20, 40)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, price double, event_type string, event_id long")
    df.write.parquet(str(tmp_path / "in"))
    stream = ticks.tick_bars(ticks.read_ticks(spark, str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    key = lambda r: (r.start, r.open, r.close, r.n)
    assert sorted(map(key, spark.table("bars_out").collect())) == sorted(map(key, ticks.tick_bars(df).collect()))


def test_hurst_and_percentile_need_their_history_and_variance(spark):
    b = bars(spark, n=100, ids=2)
    assert {r.id: r.hurst is None for r in features.hurst(b, "close").collect()} == {0: False, 1: False}
    assert all(r.hurst is None for r in features.hurst(b.withColumn("close", F.lit(5.0)), "close").collect())
    assert all(r.hurst is None for r in features.hurst(b.where("date > '2024-01-01'"), "close").collect())
    few = b.where("date < '2024-01-15'").withColumn("close", F.when(F.col("id") == 0, F.col("close")))
    assert [(r.id, r.percentile) for r in features.latest_percentile(few, "close").collect()] == [(0, None)]
    assert features.hurst(b.where("false"), "close").count() == features.latest_percentile(b.where("false"), "close").count() == 0


def test_common_factors_give_funds_a_flat_cost(spark):
    b = bars(spark, n=30, ids=2).withColumn("asset_type", F.when(F.col("id") == 0, "ETF").otherwise("stock"))
    got = features.common(b).groupBy("id").agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"), F.count("vol5").alias("n")).orderBy("id").collect()
    assert (got[0].lo, got[0].hi) == (4e-4, 4e-4) and got[1].lo > 1e-3 and got[0].n == 28


def test_active_share_activity_and_up_down(spark):
    w = spark.createDataFrame([(1, 1, 0.6), (1, 2, 0.4), (2, 1, 1.0), (3, 1, None)], "date int, id int, weight double")
    bench = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.5), (4, 1, 1.0)], "date int, id int, weight double")
    assert [(r.date, round(r.active_share, 9)) for r in portfolio.active_share(w, bench).collect()] == [(1, 0.5)]
    a = portfolio.activity(w).first()
    assert [round(x, 9) for x in a] == [round(2 / 3, 9), 1.0, round(2 / 3, 9), round(1 / 3, 9), round(1 / 3, 9)]
    u = portfolio.up_down(spark.createDataFrame([(1, 0.2), (1, -0.1), (2, 0.0), (2, None)], "fold int, ret double"), "ret", "fold").first()
    assert (u.up_periods, u.down_periods, u.positive_folds, u.folds, u.up_mean, u.down_mean) == (1, 2, 1, 2, 0.2, -0.05)


def test_equal_redistribution_smoothing_and_budget(spark):
    from quantloom.operators import construction

    df = spark.createDataFrame([(1, i, w) for i, w in enumerate([0.6, 0.2, 0.15, 0.05])], "date int, id int, weight double")
    got = {r.id: r.weight for r in construction.capped_equally(df, 0.3).collect()}
    w = [0.6, 0.2, 0.15, 0.05]
    for _ in range(10):
        cut = [min(x, 0.3) for x in w]
        free = [i for i, x in enumerate(cut) if x < 0.3]
        if sum(w) - sum(cut) < 1e-10 or not free:
            break
        w = [min(x + (sum(w) - sum(cut)) / len(free), 0.3) if i in free else x for i, x in enumerate(cut)]
    assert all(abs(got[i] - x / sum(w)) < 1e-12 for i, x in enumerate(w))
    rows = [(1, d, i, x) for d, day in enumerate([{1: 0.5, 2: 0.5}, {1: 1.0}, {3: 1.0}]) for i, x in day.items()]
    got = {(r.date, r.id): r.weight for r in construction.smoothed_weights(spark.createDataFrame(rows, "book int, date int, id int, weight double"), 3.0).collect()}
    assert abs(got[1, 1] - 0.75) < 1e-12 and abs(got[1, 2] - 0.25) < 1e-12  # alpha = 0.5
    assert abs(got[2, 3] - 1.0 / 1.5) < 1e-12 and abs(got[2, 1] - 0.375 / 1.5) < 1e-12
    b = spark.createDataFrame([(1, 1, 0.0, 0.3, 2.0), (1, 2, 0.0, 0.3, 1.0), (1, 3, 0.5, 0.1, 1.0)], "date int, id int, current double, target double, alpha double")
    assert {r.id: round(r.moved, 9) for r in construction.within_budget(b, 0.4).collect()} == {1: 0.3, 2: 0.1, 3: -0.4}


def test_lots_and_average_cost_equal_a_queue(spark):
    import random

    from quantloom.operators import ledgers

    rng = random.Random(5)
    rows = [(k, i, rng.choice([5, 3, 8, -4, -9, 2]), 10.0 + rng.random(), 1.0) for k in range(6) for i in range(40)]
    want, costs = {}, {}
    for k in range(6):
        queue, held, cost = [], 0.0, 0.0
        for _, i, n, price, fee in (r for r in rows if r[0] == k):
            gain = 0.0
            if n > 0:
                queue.append([i, n])
                cost = (held * cost + n * price + fee) / (held + n)
                held += n
            else:
                sold = min(-n, held)
                gain = sold * (price - cost) - fee if sold else 0.0
                held -= sold
                cost = cost if held > 0 else 0.0
                n = -n
                while n and queue:
                    take = min(n, queue[0][1])
                    queue[0][1] -= take
                    n -= take
                    if not queue[0][1]:
                        queue.pop(0)
            costs[k, i] = (held, cost, gain)
        want |= {(k, i): n for i, n in queue}
    df = spark.createDataFrame(rows, "id int, seq int, quantity long, price double, fee double")
    assert {(r.id, r.seq): r.quantity for r in ledgers.open_lots(df, ["id"], ["seq"]).collect()} == want
    for r in ledgers.average_cost(df).collect():
        assert all(abs(a - b) < 1e-9 for a, b in zip((r.held, r.cost, r.realised), costs[r.id, r.seq], strict=True))


def test_hold_band_equals_a_loop(spark):
    import random

    from quantloom.operators import styles

    rng = random.Random(3)
    rows = [(t, i, rng.random()) for t in range(30) for i in range(12) if rng.random() < 0.9]
    held, since, want = set(), 5, set()
    for t in range(30):
        order = [i for _, i, _ in sorted((r for r in rows if r[0] == t), key=lambda r: (-r[2], r[1]))]
        if since >= 5 or not held:
            held, since = set(order[:3]) | held & set(order[:6]), 0
        now = [i for i in order if i in held]
        want |= {(t, i, round(1 / len(now), 9)) for i in now}
        since += 1
    got = styles.hold_band(spark.createDataFrame(rows, "date int, id int, s double"), "s", 3, 6, 5).collect()
    assert {(r.date, r.id, round(r.weight, 9)) for r in got} == want


def test_models_fit_what_they_should(spark):
    import random

    import numpy as np

    from quantloom.models import baselines

    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random()) for i in range(400)]
    rows = [(i, a, b, 2 + 3 * a - b, 1.0 if a <= 0.4 else 5.0) for i, a, b in rows] + [(999, None, 0.1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "date int, a double, b double, y double, z double")
    got = baselines.least_squares(df, ["a", "b"], "y")
    assert abs(got["intercept"] - 2) < 1e-6 and abs(got["a"] - 3) < 1e-6 and abs(got["b"] + 1) < 1e-6
    split = baselines.one_split(df, ["b", "a"], "z")
    assert split["feature"] == "a" and split["left"] < 1.3 and split["right"] > 4.7
    model = baselines.boosted(df, ["a", "b"], "z", df["date"] % 5 == 0, trees=8)
    out = baselines.predicted(df, model, ["a", "b"]).toPandas()
    assert ((out.prediction - out.z) ** 2).mean() < 0.1 * np.var(out.z) and len(out) == 400
    assert {r.feature: r.importance > 0.8 for r in baselines.importances(model, ["a", "b"], spark).collect()} == {"a": True, "b": False}


def test_p_values_and_fingerprint(spark):
    from quantloom.operators import pointintime, significance

    t = spark.createDataFrame([(0.0,), (1.959963984540054,), (None,)], "t double")
    got = [r[0] for r in t.select(significance.normal_p("t")).collect()]
    assert got[0] == 1.0 and abs(got[1] - 0.05) < 1e-9 and got[2] is None
    a = spark.createDataFrame([(1, "x", None), (2, "y", 3.0)], "k int, s string, v double")
    b = spark.createDataFrame([(3.0, 2, "y"), (None, 1, "x")], "v double, k int, s string")
    assert pointintime.fingerprint(a).first() == pointintime.fingerprint(b).first() != pointintime.fingerprint(a.where("k = 1")).first()
    assert pointintime.fingerprint(a.where("false")).first().n == 0


def test_scalars_on_texts(spark):
    from quantloom.functions import scalars as S

    df = spark.createDataFrame([("35-37,1,36", "a:0.6, b:0.4", '{"x":1.0,"y":2.0}', '{"y":null,"z":4.0}', " Fund ", "label_return_10d"), ("5", "c", None, '{"q":1.0}', None, "close")], "w string, b string, o string, n string, t string, c string")
    one, two = df.select(S.window_numbers(F.col("w")), S.blend_spec(F.col("b")), S.merged_payload(F.col("o"), F.col("n")), S.asset_type(F.col("t")), S.horizon_of(F.col("c"))).collect()
    assert one[0] == [1, 35, 36, 37] and one[1] == {"a": 0.6, "b": 0.4} and one[3] == "etf" and one[4] == 10
    assert two[0] == [5] and two[1] == {"c": 1.0} and two[2] == '{"q":1.0}' and two[3] == "stock" and two[4] is None
    import json

    assert json.loads(one[2]) == {"x": 1.0, "y": 2.0, "z": 4.0}


def test_streams_keep_state_and_append_once(spark, tmp_path):
    from quantloom.sources import appends

    rows = [(1, dt.datetime(2024, 1, 1, 0, m), p, "x", m) for m, p in enumerate([100.0, 120.0, 110.0, 107.0, 130.0])] + [(2, dt.datetime(2024, 1, 1, 0, 1), 50.0, "x", 9)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, price double, event_type string, event_id long")
    df.write.parquet(str(tmp_path / "in"))
    run = ticks.drawdown_stops(ticks.read_ticks(spark, str(tmp_path / "in")), 0.1).writeStream.format("memory").queryName("stops").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    got = {(r.id, r.ts.minute): (r.peak, r.stopped) for r in spark.table("stops").collect()}
    assert got == {(1, 0): (100.0, False), (1, 1): (120.0, False), (1, 2): (120.0, False), (1, 3): (120.0, True), (1, 4): (130.0, True), (2, 1): (50.0, False)}
    path = str(tmp_path / "bars")
    for _ in range(2):
        appends.append_batch(df, 0, path, ["id", "event_id"], "event_id")
    assert appends.appended(spark, path).count() == 6
    averages = ticks.moving_averages(df, "10 minutes", "5 minutes").where("id = 1 and start = timestamp'2024-01-01 00:00:00'").first()
    assert averages.n == 5 and abs(averages.mavg - 113.4) < 1e-9 and abs(averages.vwap - 113.4) < 1e-9
    snap = ticks.snapshots(ticks.merged(df.where("id = 1"), df.where("id = 2")), spark.createDataFrame([(1, 100.0)], "id long, prev_close double"))
    assert {r.id: (r.last, None if r.change is None else round(r.change, 9)) for r in snap.collect()} == {1: (130.0, 0.3), 2: (50.0, None)}
    assert ticks.fresh(snap, "2024-01-01 00:05:00", "2 minutes").first().open is False and ticks.fresh(snap, "2024-01-01 00:05:00").first().open is True
