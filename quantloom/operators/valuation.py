"""The valuation line: percentiles of valuation features, their weights from past information, the score, its percentile and its audit."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.functions.walks import hazen_percentiles, walk

# Feature, its dimension, whether high is cheap (inverted), and its prior weight.
FEATURES = {
    "dividend_yield_pct": ("dividend", True, 0.175),
    "yield_spread": ("dividend", True, 0.175),
    "pe_percentile": ("pe", False, 0.20),
    "ma250_deviation": ("price", False, 0.10),
    "price_percentile": ("price", False, 0.10),
    "rsi_20": ("price", False, 0.10),
    "premium_rate": ("premium", False, 0.075),
    "premium_rate_ma20": ("premium", False, 0.075),
}
# Features of confidence; percentiles at or beyond these count as extreme.
CONFIDENCE, LOW, HIGH = ("volatility_percentile", "volume_ratio"), 0.1, 0.9
# Windows and thresholds of percentiles, samples, information, weights and scores.
WINDOW, LEAST = 730, 120
LABEL, EVERY, ROLLING, POINTS, HELD_OUT = 60, 60, 30, 6, 252
MAX_P, MIN_IR, SURVIVORS = 0.1, 0.3, 5
MAX_DIMENSION, MIN_DIVIDEND, MIN_COSINE, PRIOR = 0.6, 0.1, 0.5, 0.7
SCORE_WINDOW, SCORE_LEAST, BUY, SELL, DIMENSIONS = 504, 120, 0.2, 0.8, 3


def raw_features(history: DataFrame, key: str = "k") -> DataFrame:
    """key, date, close and the ten raw features of a history of close, volume, dividend_yield, bond, pe and premium; rounded to 9 digits, so that equal values rank as equal."""
    h = Window.partitionBy(key).orderBy("date")
    mean = lambda x, n, least: F.when(F.count(x).over(h.rowsBetween(1 - n, 0)) >= least, F.avg(x).over(h.rowsBetween(1 - n, 0)))
    change = F.col("close") - F.lag("close").over(h)
    df = history.withColumn("_ret", R.ratio(F.col("close"), F.lag("close").over(h)) - 1).withColumn("_gain", F.greatest(change, F.lit(0.0) * change)).withColumn("_loss", F.greatest(-change, F.lit(0.0) * change))
    w20 = h.rowsBetween(-19, 0)
    df = df.select(
        key, "date", "close", "_gain", "_loss", F.col("dividend_yield").alias("dividend_yield_pct"), (F.col("dividend_yield") - F.col("bond")).alias("yield_spread"), F.col("pe").alias("pe_percentile"),
        (R.ratio(F.col("close"), mean("close", 250, 20)) - 1).alias("ma250_deviation"), F.col("close").alias("price_percentile"), F.col("premium").alias("premium_rate"), mean("premium", 20, 5).alias("premium_rate_ma20"),
        (F.when(F.count("_ret").over(w20) >= 5, F.stddev_samp("_ret").over(w20)) * F.sqrt(F.lit(252.0))).alias("volatility_percentile"), R.ratio(F.col("volume"), mean("volume", 20, 5)).alias("volume_ratio"),
    )
    df = R.exponential(df, {"_g": ("_gain", 1 / 20, 20), "_l": ("_loss", 1 / 20, 20)}, key=key)
    df = df.withColumn("rsi_20", 100 - 100 / (1 + R.ratio(F.col("_g"), F.col("_l"))))
    return df.select(key, "date", "close", *(F.round(c, 9).alias(c) for c in (*FEATURES, *CONFIDENCE)))


def percentiles(raw: DataFrame, key: str = "k", size: int = WINDOW) -> DataFrame:
    """For each feature its percentile (inverted where high is cheap) and the number of values behind it."""
    return hazen_percentiles(raw, [*FEATURES, *CONFIDENCE], size, 1, key, inverted=tuple(k for k, (_, inverted, _) in FEATURES.items() if inverted))


def two_sided_p(t: float, freedom: int) -> float:
    """P(|T| >= |t|) of Student's t for whole degrees of freedom, by its finite sum."""
    if math.isinf(t):
        return 0.0
    angle = math.atan(abs(t) / math.sqrt(freedom))
    s, c = math.sin(angle), math.cos(angle)
    if freedom % 2:
        term, total = c, c if freedom > 1 else 0.0
        for j in range(3, freedom - 1, 2):
            term *= c * c * (j - 1) / j
            total += term
        return max(0.0, 1 - 2 / math.pi * (angle + s * total))
    term = total = 1.0
    for j in range(2, freedom - 1, 2):
        term *= c * c * (j - 1) / j
        total += term
    return max(0.0, 1 - s * total)


def _ranks(x: list[float]) -> list[float]:
    order = sorted(range(len(x)), key=x.__getitem__)
    out = [0.0] * len(x)
    i = 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and x[order[j + 1]] == x[order[i]]:
            j += 1
        for k in order[i : j + 1]:
            out[k] = (i + j) / 2
        i = j + 1
    return out


def spearman(x: list[float], y: list[float]) -> float | None:
    """Rank correlation of two short lists; null where one does not vary."""
    a, b = _ranks(x), _ranks(y)
    m = (len(x) - 1) / 2
    va, vb = sum((p - m) ** 2 for p in a), sum((q - m) ** 2 for q in b)
    return sum((p - m) * (q - m) for p, q in zip(a, b, strict=True)) / math.sqrt(va * vb) if va and vb else None


class _Information:
    """Rolling rank information of one feature: the points of the window, and count, mean and squared deviations of its values so far."""

    def __init__(self):
        self.points: deque[tuple[float, float]] = deque(maxlen=ROLLING)
        self.samples = self.n = 0
        self.mean = self.square = 0.0

    def push(self, x: float, y: float) -> None:
        self.points.append((x, y))
        self.samples += 1
        if self.samples >= POINTS and (ic := spearman(*map(list, zip(*self.points, strict=True)))) is not None:
            self.n += 1
            away = ic - self.mean
            self.mean += away / self.n
            self.square += away * (ic - self.mean)

    def summary(self) -> tuple[float, bool]:
        """Mean over deviation, and whether the feature survives."""
        std = math.sqrt(max(0.0, self.square) / (self.n - 1)) if self.n > 1 else 0.0
        ir = abs(self.mean) / std if std else 0.0
        p = two_sided_p(self.mean / (std / math.sqrt(self.n)), self.n - 1) if std else 1.0
        return ir, self.samples >= POINTS and self.n > 0 and self.mean < 0 and p <= MAX_P and ir >= MIN_IR


def _scaled(weights: dict[str, float]) -> dict[str, float]:
    total = sum(w for w in weights.values() if w > 0)
    return {k: w / total if total > 0 and w > 0 else 0.0 for k, w in weights.items()}


def _objection(weights: dict[str, float]) -> str | None:
    """What speaks against the structure of the weights."""
    by: dict[str, float] = {}
    for k, w in weights.items():
        by[FEATURES[k][0]] = by.get(FEATURES[k][0], 0.0) + w
    if max(by.values()) > MAX_DIMENSION:
        return "single_dimension_overweight"
    if by["dividend"] < MIN_DIVIDEND:
        return "dividend_dimension_underweight"
    prior = {k: f[2] for k, f in FEATURES.items()}
    size = math.sqrt(sum(w * w for w in weights.values()) * sum(p * p for p in prior.values()))
    cosine = sum(w * prior[k] for k, w in weights.items()) / size if size else 0.0
    return "weight_structure_deviates_from_domain_knowledge" if cosine < MIN_COSINE else None


class _Weights:
    """State of one history: samples that wait for their label and for the end of the held-out year, and the information of each feature."""

    def __init__(self):
        self.row = self.used = 0
        self.open: deque[tuple[int, tuple, float]] = deque()
        self.ready: deque[tuple[int, tuple, float]] = deque()
        self.seen: set[str] = set()
        self.information = {k: _Information() for k in FEATURES}

    def step(self, row: tuple) -> list[tuple]:
        date, close, *x = row
        self.row += 1
        self.seen.update(k for k, v in zip(FEATURES, x, strict=True) if v is not None)
        if self.open and self.open[0][0] + LABEL == self.row:
            at, then, price = self.open.popleft()
            self.ready.append((at, then, close / price - 1 if price and close is not None else math.nan))
        if (self.row - 1) % EVERY == 0:
            self.open.append((self.row, tuple(x), close))
        trained = self.row - HELD_OUT if self.row > HELD_OUT else self.row
        if self.row > HELD_OUT:  # before, every row trains and none of the histories is long enough
            while self.ready and self.ready[0][0] + LABEL <= trained:
                _, then, gain = self.ready.popleft()
                if gain == gain:
                    self.used += 1
                    for k, v in zip(FEATURES, then, strict=True):
                        if v is not None:
                            self.information[k].push(v, gain)
        weights, method, reason = self.weights(trained)
        return [(date, *(weights[k] for k in FEATURES), method, reason, self.used)]

    def weights(self, trained: int) -> tuple[dict[str, float], str, str | None]:
        prior = _scaled({k: f[2] if k in self.seen else 0.0 for k, f in FEATURES.items()})
        if trained < max(WINDOW, LABEL + EVERY):
            return prior, "domain_knowledge_fallback", "training_history_too_short"
        if self.used < POINTS:
            return prior, "domain_knowledge_fallback", "independent_samples_too_few"
        found = {k: i.summary() for k, i in self.information.items()}
        if sum(ok for _, ok in found.values()) < SURVIVORS:
            return prior, "domain_knowledge_fallback", "surviving_features_too_few"
        own = _scaled({k: ir if ok else 0.0 for k, (ir, ok) in found.items()})
        mixed = _scaled({k: PRIOR * prior[k] + (1 - PRIOR) * own[k] for k in FEATURES})
        against = _objection(mixed)
        return (prior, "domain_knowledge_fallback", against) if against else (mixed, "shrunk_ic_ir", None)


def weights_by_date(normalised: DataFrame, key: str = "k") -> DataFrame:
    """Per row the weights fitted on what was known a year before: columns `w_` and the feature, method, reason, samples.

    Every 60th row is a sample: its percentiles against the return of the 60
    rows after it. A feature's information is the rank correlation over the last
    30 samples, taken anew with each one; its mean over its deviation, where the
    mean is negative and significant, is its weight, blended with the prior. The
    reference date's own year is held out, so each date has weights of its own;
    samples only ever come on, so one pass keeps 30 points a feature."""
    kinds = dict(normalised.dtypes)
    schema = f"{key} {kinds[key]}, date {kinds['date']}, " + ", ".join(f"w_{k} double" for k in FEATURES) + ", method string, reason string, samples int"
    return walk(normalised, [key], ["date"], ["close", *(f"{k}_percentile" for k in FEATURES)], _Weights, _Weights.step, schema)


def scores(normalised: DataFrame, weights: DataFrame, key: str = "k") -> DataFrame:
    """total_score (weighted mean of ten times the percentiles there are; null without the dividend dimension or with fewer than three), confidence, and the score's own percentile over 504 rows, null below 120 scores."""
    df = normalised.join(weights, [key, "date"])
    has = {k: F.col(f"{k}_percentile").isNotNull() & (F.col(f"w_{k}") > 0) for k in FEATURES}
    total = sum((F.when(ok, F.col(f"w_{k}")).otherwise(0.0) for k, ok in has.items()), F.lit(0.0))
    mean = sum((F.when(ok, F.col(f"w_{k}") * 10 * F.col(f"{k}_percentile")).otherwise(0.0) for k, ok in has.items()), F.lit(0.0))
    there = {d: F.lit(False) for d, _, _ in FEATURES.values()}
    for k, (d, _, _) in FEATURES.items():
        there[d] = there[d] | has[k]
    enough = there["dividend"] & (sum((x.cast("int") for x in there.values()), F.lit(0)) >= DIMENSIONS) & (total > 0)
    extreme = sum((F.when((F.col(f"{k}_percentile") <= LOW) | (F.col(f"{k}_percentile") >= HIGH), 1).otherwise(0) for k in CONFIDENCE), F.lit(0))
    thin = F.lit(False)
    for k in FEATURES:
        thin = thin | (F.col(f"{k}_n") < LEAST)
    trust = F.when(extreme >= 2, "low").when((extreme == 1) | thin, "lowered").otherwise("normal")
    df = df.select(key, "date", "close", F.when(enough, F.round(mean / total, 4)).alias("total_score"), F.when(enough, trust).alias("confidence"), "method", "reason")
    ranked = hazen_percentiles(df, ["total_score"], SCORE_WINDOW, SCORE_LEAST, key).withColumnsRenamed({"total_score_percentile": "score_percentile", "total_score_n": "score_n"})
    return df.join(ranked, [key, "date"])


def score_audit(scored: DataFrame, periods: dict[str, tuple[str, str]], horizons: tuple[int, ...] = (20, 60, 120), key: str = "k", least: int = 20) -> DataFrame:
    """Per key, period ("overall" is all) and horizon: rank correlation of score and percentile with the return ahead, returns and win rates at low and high percentiles; `flags` counts what speaks against them and `verdict` names their number over the key: accurate, mixed (up to 3) or overfit_risk."""
    h = Window.partitionBy(key).orderBy("date")
    ahead = F.array(*(F.named_struct(F.lit("horizon"), F.lit(n), F.lit("ret"), R.ratio(F.lead("close", n).over(h), F.col("close")) - 1) for n in horizons))
    spans = F.array(F.lit("overall"), *(F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(p)) for p, (a, b) in periods.items()))
    x = scored.withColumn("a", ahead)  # before rows are repeated for their periods
    x = x.select(key, "total_score", "score_percentile", F.explode(F.array_compact(spans)).alias("period"), "a").select("*", F.explode("a").alias("e")).select(key, "period", "e.horizon", "total_score", "score_percentile", "e.ret")
    x = x.where("total_score is not null and score_percentile is not null and ret is not null")
    by = [key, "period", "horizon"]
    for c in ("total_score", "score_percentile", "ret"):
        x = x.withColumn(f"_{c}", R.average_rank(c, by))
    low, high = F.col("score_percentile") <= BUY, F.col("score_percentile") >= SELL
    mean = lambda cond, v: F.avg(F.when(cond, v))
    won = (F.col("ret") > 0).cast("double")
    g = x.groupBy(*by).agg(
        F.count("*").alias("samples"), R.correlation("_total_score", "_ret").alias("score_spearman"), R.correlation("_score_percentile", "_ret").alias("percentile_spearman"), F.count_if(low).alias("low_count"), F.count_if(high).alias("high_count"),
        mean(low, F.col("ret")).alias("low_ret"), mean(high, F.col("ret")).alias("high_ret"), mean(low, won).alias("low_win_rate"), mean(high, won).alias("high_win_rate"),
    )
    g = g.withColumn("spread", F.col("low_ret") - F.col("high_ret"))
    bad = F.coalesce(F.col("spread") <= 0, F.lit(True)).cast("int") + (F.col("low_count") < least).cast("int") + (F.col("high_count") < least).cast("int")
    g = g.withColumn("flags", bad)
    every = F.sum("flags").over(Window.partitionBy(key))
    return g.withColumn("verdict", F.when(every == 0, "accurate").when(every <= 3, "mixed").otherwise("overfit_risk"))
