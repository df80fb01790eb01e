"""Statistical factor risk models, one per as-of date."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.sources.shared import written

MODEL = "asof date, id long, dates int, loadings array<double>, variances array<double>, specific double"
OUT = pa.schema([("asof", pa.date32()), ("id", pa.int64()), ("dates", pa.int32()), ("loadings", pa.list_(pa.float64())), ("variances", pa.list_(pa.float64())), ("specific", pa.float64())])


def _weights(n: int, halflife: float | None) -> np.ndarray:
    w = 0.5 ** (np.arange(n)[::-1] / halflife) if halflife else np.ones(n)
    return w / w.sum()


def _factors(products: np.ndarray, assets: int, factors: int, halflife: float | None) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """What a block of assets needs of a window's model, from the products of its dates' returns summed over all assets: dates x factors that turn centred returns into loadings, factor variances, and intensity, target and scale of the shrinking.

    Covariance is Ledoit and Wolf's, shrunk towards a scaled identity, or with
    weights that halve every `halflife` dates. Its eigenvectors come from the
    dates x dates matrix of products, so nothing has the size of assets x
    assets: shrinking moves eigenvalues and leaves the vectors."""
    n, p = len(products), assets
    w = _weights(n, halflife)
    mean = products @ w
    gram = products - mean[:, None] - mean[None, :] + w @ mean
    by = np.sqrt(w) / np.sqrt(1 - (w * w).sum()) if halflife else np.full(n, 1 / np.sqrt(n))
    gram = gram * by[:, None] * by[None, :]
    values, left = np.linalg.eigh(gram)
    values, left = values[::-1], left[:, ::-1]
    mu, scale, intensity = np.trace(gram) / p, 1.0, 0.0
    if not halflife:
        squares = (gram * gram).sum()
        delta = (squares - p * mu * mu) / p
        beta = min((np.diag(gram) ** 2).sum() / p - squares / (n * p), delta)
        intensity = beta / delta if delta else 1.0
        scale = n / (n - 1)
    k = int((values[: min(factors, p, max(n - 1, 1))] > values[0] * 1e-12).sum()) if values[0] > 0 else 0
    return by[:, None] * left[:, :k] / np.sqrt(values[:k]), ((1 - intensity) * values[:k] + intensity * mu) * scale, intensity, mu, scale


def factor_models(returns: DataFrame, calendar: DataFrame, every: int = 20, days: int = 252, factors: int = 3, least: int = 20, halflife: float | None = None, floor: float = 1e-8, block: int = 1000) -> DataFrame:
    """Per as-of date (each `every`-th of the calendar) and asset: number of dates, loadings, factor variances and specific variance, over the last `days` dates. The largest loading of a factor in size is positive.

    Assets are cut into blocks of about `block`. A block gives the products of
    its dates' returns, which are summed over the blocks to a row a date; with
    a window's sums its model is solved (dates x dates), and the blocks turn
    their own returns into loadings. So a task holds a block of assets or a
    window of dates, whatever the number of assets. Missing returns count as 0;
    below `least` dates, and without variance, assets have no factors and the
    floor as variance."""
    rows = returns.where("ret is not null").join(calendar.select("date", F.col("seq").cast("int").alias("seq")), "date")
    rows = written(rows.select(F.col("id").cast("long").alias("id"), "seq", F.col("ret").cast("double").alias("ret")), "returns")  # read several times
    blocks = F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("id") / block)).cast("int")
    cut = rows.crossJoin(F.broadcast(rows.agg(blocks.alias("_n")))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_n"))).drop("_n")  # one row

    def whole(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dates from the block's first on, ids, returns and where there are some."""
        seq, ids = t.column("seq").to_numpy(), t.column("id").to_numpy()
        names, col = np.unique(ids, return_inverse=True)
        first = int(seq.min())
        x = np.full((int(seq.max()) - first + 1, len(names)), np.nan)
        x[seq - first, col] = t.column("ret").to_numpy()
        return first, names, x

    def multiplied(t: pa.Table) -> pa.Table:
        first, _, x = whole(t)
        there = np.isfinite(x)
        x = np.nan_to_num(x)
        at, band, seen, assets = [], [], [], []
        for lo in range(0, len(x), 64):
            hi = min(len(x), lo + 64)
            start = max(0, lo - days + 1)
            p = x[lo:hi] @ x[start:hi].T
            for s in range(lo, hi):  # products with the date itself and with those before it, the newest first
                at.append(first + s), band.append(p[s - lo, max(0, s - days + 1) - start : s - start + 1][::-1]), seen.append(int(there[s].sum()))
        last = first + len(x) - 1
        for end in range(-(-first // every) * every, last + days, every):  # assets of each window
            part = there[max(0, end - days + 1 - first) : max(0, end + 1 - first)]
            if part.any():
                at.append(-end), band.append(np.zeros(0)), seen.append(0), assets.append((end, int(part.any(axis=0).sum())))
        known = dict(assets)
        return pa.table({"seq": pa.array(at, pa.int32()), "products": pa.array(band, pa.list_(pa.float64())), "seen": pa.array(seen, pa.int64()), "assets": pa.array([known.get(-a, 0) if a < 0 else 0 for a in at], pa.int64())})

    def summed(t: pa.Table) -> pa.Table:
        total = np.zeros(days)
        for v in t.column("products").to_pylist():
            total[: len(v)] += v
        return pa.table({"seq": pa.array([t.column("seq")[0].as_py()], pa.int32()), "products": pa.array([total], pa.list_(pa.float64())), "seen": pa.array([sum(t.column("seen").to_pylist())], pa.int64()), "assets": pa.array([sum(t.column("assets").to_pylist())], pa.int64())})

    kind = "seq int, products array<double>, seen long, assets long"
    sums = written(cut.groupBy("block").applyInArrow(multiplied, kind).groupBy("seq").applyInArrow(summed, kind), "products")
    # a row a date and a row a window
    windows = sums.where("seq < 0").select((-F.col("seq")).alias("at"), "assets").join(calendar.select(F.col("seq").cast("int").alias("at"), F.col("date").alias("asof")), "at")
    dates = sums.where("seq > 0 and seen > 0").drop("assets")
    inside = dates.join(F.broadcast(windows), F.col("seq").between(F.col("at") - days + 1, F.col("at")))

    def solved(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        seq, band = t.column("seq").to_numpy(), t.column("products").to_pylist()
        n, assets = len(seq), t.column("assets")[0].as_py()
        products = np.zeros((n, n))
        for i, s in enumerate(seq):
            products[i, : i + 1] = products[: i + 1, i] = np.asarray(band[i])[s - seq[: i + 1]]
        mixed, variances, intensity, mu, scale = np.zeros((n, 0)), np.zeros(0), None, None, None
        if n >= least and products.any():
            mixed, variances, intensity, mu, scale = _factors(products, assets, factors, halflife)
        return pa.table({
            "at": t.column("at").slice(0, 1), "asof": t.column("asof").slice(0, 1), "seqs": pa.array([seq.tolist()], pa.list_(pa.int32())), "mixed": pa.array([mixed.ravel().tolist()], pa.list_(pa.float64())),
            "variances": pa.array([variances.tolist()], pa.list_(pa.float64())), "intensity": pa.array([intensity], pa.float64()), "mu": pa.array([mu], pa.float64()), "scale": pa.array([scale], pa.float64()),
        })

    models = written(inside.groupBy("at").applyInArrow(solved, "at int, asof date, seqs array<int>, mixed array<double>, variances array<double>, intensity double, mu double, scale double"), "models")
    needed = cut.select(F.col("block").alias("of")).distinct().crossJoin(F.broadcast(models))  # dates x factors numbers a window

    def loaded(keys: tuple, t: pa.Table, m: pa.Table) -> Iterator[pa.RecordBatch]:
        first, names, x = whole(t)
        there = np.isfinite(x)
        x = np.nan_to_num(x)
        for model in m.to_pylist():
            seqs = np.array(model["seqs"])
            at = seqs - first
            inside = (at >= 0) & (at < len(x))
            own = there[at[inside]].any(axis=0)
            if not own.any():
                continue
            y = np.zeros((len(seqs), int(own.sum())))
            y[inside] = x[at[inside]][:, own]
            n = len(seqs)
            if model["scale"] is None:
                vectors, specific = np.zeros((y.shape[1], 0)), np.full(y.shape[1], floor)
            else:
                w = _weights(n, halflife)
                y -= w @ y
                variances = np.array(model["variances"])
                vectors = y.T @ np.array(model["mixed"]).reshape(n, len(variances))
                diagonal = w @ (y * y) / ((1 - (w * w).sum()) if halflife else 1.0)
                diagonal = ((1 - model["intensity"]) * diagonal + model["intensity"] * model["mu"]) * model["scale"]
                specific = np.maximum(diagonal - (vectors * vectors) @ variances, floor)
            k = y.shape[1]
            yield pa.record_batch([
                pa.array([model["asof"]] * k, pa.date32()), pa.array(names[own], pa.int64()), pa.array([n] * k, pa.int32()), pa.array(vectors.tolist(), pa.list_(pa.float64())),
                pa.array([model["variances"]] * k, pa.list_(pa.float64())), pa.array(specific, pa.float64()),
            ], names=["asof", "id", "dates", "loadings", "variances", "specific"])

    def loaded_table(keys: tuple, t: pa.Table, m: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(loaded(keys, t, m)), schema=OUT)

    out = written(cut.groupBy("block").cogroup(needed.groupBy("of")).applyInArrow(loaded_table, MODEL), "loadings")  # read twice
    size = F.struct(F.abs(F.col("v")).alias("size"), (-F.col("id")).alias("id"))
    turn = out.select("asof", "id", F.posexplode("loadings").alias("k", "v")).groupBy("asof", "k").agg(F.max_by(F.signum("v"), size).alias("s")).groupBy("asof").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("_turn"))  # a row a window
    signs = F.transform(F.col("_turn"), lambda t: F.when(t["s"] < 0, -1.0).otherwise(1.0))
    turned = F.when(F.size("loadings") == 0, F.col("loadings")).otherwise(F.zip_with("loadings", signs, lambda v, s: v * s))
    return out.join(F.broadcast(turn), "asof", "left").select("asof", "id", "dates", turned.alias("loadings"), "variances", "specific")


def model_volatility(weights: DataFrame, models: DataFrame, shrink: float = 0.0, year: int = 252) -> DataFrame:
    """Per as-of date the yearly volatility of weights (asof, id, weight) under the model, its factor and its specific part: a sum per factor, no pairs of assets. `shrink` takes that share off what lies off the diagonal."""
    x = weights.join(models, ["asof", "id"])
    part = x.select("asof", "id", "weight", F.posexplode(F.arrays_zip("loadings", "variances")).alias("k", "f"))
    by = part.groupBy("asof", "k").agg(F.sum(F.col("weight") * F.col("f.loadings")).alias("e"), F.max("f.variances").alias("v"), F.sum(F.pow(F.col("weight") * F.col("f.loadings"), 2)).alias("own"))
    common = by.groupBy("asof").agg(F.sum(F.col("v") * F.col("e") * F.col("e")).alias("_c"), F.sum(F.col("v") * F.col("own")).alias("_own"))
    alone = x.groupBy("asof").agg(F.sum(F.col("weight") * F.col("weight") * F.col("specific")).alias("_s"))
    y = alone.join(common, "asof", "left").select("asof", "_s", ((1 - shrink) * F.coalesce("_c", F.lit(0.0)) + shrink * F.coalesce("_own", F.lit(0.0))).alias("_c"))
    vol = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)) * year)
    return y.select("asof", vol(F.col("_c") + F.col("_s")).alias("volatility"), vol(F.col("_c")).alias("factor_volatility"), vol(F.col("_s")).alias("specific_volatility"))
