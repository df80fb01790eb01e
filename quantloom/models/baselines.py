"""Models on panels, fitted by Spark: least squares, one split, boosted trees, several heads, walk-forward."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATES = 50


def _vectors(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    whole = df.dropna(subset=[*features, *([label] if label else [])])
    return VectorAssembler(inputCols=features, outputCol="_x").transform(whole)


def least_squares(train: DataFrame, features: list[str], label: str) -> dict[str, float]:
    """Intercept and one coefficient per feature, from the normal equations, whose size is that of the feature list; rows with a missing value are left out."""
    model = LinearRegression(featuresCol="_x", labelCol=label, solver="normal", standardization=False).fit(_vectors(train, features, label))
    return {"intercept": float(model.intercept), **dict(zip(features, (float(v) for v in model.coefficients), strict=True))}


def linear(df: DataFrame, coefficients: dict[str, float], name: str = "prediction") -> DataFrame:
    """Add the linear prediction as one column expression."""
    return df.withColumn(name, sum((F.col(c) * v for c, v in coefficients.items() if c != "intercept"), F.lit(coefficients["intercept"])))


def one_split(train: DataFrame, features: list[str], label: str) -> dict:
    """The single threshold, among 50 inner quantiles of each feature, that leaves the least squared error: feature, threshold, mean left (at or below) and right.

    The candidates, 50 per feature, are collected; all their sums come from one
    pass over the rows. Ties go to the first feature and the lowest threshold;
    without a split that leaves rows on both sides, the mean on both."""
    rows = train.dropna(subset=[*features, label])
    marks = [(i + 1) / (CANDIDATES + 1) for i in range(CANDIDATES)]
    edges = rows.agg(*(F.percentile(c, F.array(*map(F.lit, marks))).alias(c) for c in features), F.avg(label).alias("_mean"), F.avg(features[0]).alias("_first")).first()
    candidates = [(f, t) for f in features for t in sorted(set(edges[f] or []))]
    parts = [x for k, (f, t) in enumerate(candidates) for x in (F.sum((F.col(f) <= t).cast("long")).alias(f"n{k}"), F.sum(F.when(F.col(f) <= t, F.col(label))).alias(f"s{k}"))]
    got = rows.agg(F.count("*").alias("n"), F.sum(label).alias("s"), *parts).first()
    best = None
    for k, (f, t) in enumerate(candidates):
        n, s = got[f"n{k}"], got[f"s{k}"]
        if n and n < got["n"]:
            gain = s * s / n + (got["s"] - s) ** 2 / (got["n"] - n)  # the error is the same sum of squares less this
            if best is None or gain > best[0] + 1e-12 * abs(best[0]):
                best = gain, f, t, s / n, (got["s"] - s) / (got["n"] - n)
    if best is None:
        return {"feature": features[0], "threshold": edges["_first"], "left": edges["_mean"], "right": edges["_mean"]}
    return dict(zip(("feature", "threshold", "left", "right"), best[1:], strict=True))


def split_prediction(df: DataFrame, split: dict, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, F.when(F.col(split["feature"]) <= split["threshold"], split["left"]).otherwise(split["right"]))


def boosted(train: DataFrame, features: list[str], label: str, valid: F.Column, trees: int = 20, depth: int = 3, seed: int = 7):
    """Gradient-boosted trees that stop when the rows of `valid` no longer gain."""
    rows = _vectors(train, features, label).withColumn("_valid", valid)
    return GBTRegressor(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed, validationIndicatorCol="_valid").fit(rows)


def predicted(df: DataFrame, model, features: list[str], name: str = "prediction") -> DataFrame:
    return model.transform(_vectors(df, features)).withColumnRenamed("prediction", name).drop("_x")


def heads(train: DataFrame, test: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """`test` with one prediction per label, `head_<label>`, each from a model of its own."""
    for label in labels:
        test = linear(test, least_squares(train, features, label), f"head_{label}")
    return test


def fits_by_group(train: DataFrame, group: str, features: list[str], label: str) -> DataFrame:
    """Least squares of every group in one pass: group, `_k` (intercept, then one coefficient a feature), `_n`.

    A group's means and covariances are all that its normal equations need, so
    one aggregation serves all groups; the solutions, features + 1 numbers a
    group, are found on the driver. Features that do not vary get 0."""
    cols = [*features, label]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols)) if i < len(features)]
    sums = train.dropna(subset=cols).groupBy(group).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs))
    rows = []
    for r in sums.collect():
        p = len(features)
        xx = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        k = np.linalg.lstsq(xx, np.array([r[f"c{i}_{p}"] for i in range(p)]), rcond=1e-12)[0]
        rows.append((r[group], [float(r[f"m{p}"] - sum(k[i] * r[f"m{i}"] for i in range(p))), *map(float, k)], int(r["n"])))
    return train.sparkSession.createDataFrame(rows, f"`{group}` {dict(train.dtypes)[group]}, _k array<double>, _n long")


def applied(df: DataFrame, fits: DataFrame, group: str, features: list[str], name: str = "prediction") -> DataFrame:
    """Rows with all features, with the prediction of their group's fit; groups without one are left out."""
    x = df.dropna(subset=features).join(F.broadcast(fits.drop("_n")), group)  # a few numbers a group
    return x.withColumn(name, sum((F.col("_k")[i + 1] * F.col(c) for i, c in enumerate(features)), F.col("_k")[0])).drop("_k")


def walk_forward(panel: DataFrame, folds: DataFrame, features: list[str], label: str) -> DataFrame:
    """Out-of-sample predictions: per fold a least-squares fit on its train rows, applied to its test rows. Columns of folds: fold, part, date. All folds are fitted in one pass."""
    tagged = panel.join(folds, "date")
    fits = fits_by_group(tagged.where("part = 'train'"), "fold", features, label)
    return applied(tagged.where("part = 'test'"), fits, "fold", features)


def shadow_fit(panel: DataFrame, calendar: DataFrame, features: list[str], label: str, recent: int = 60, embargo: int = 5, train: int = 500) -> DataFrame:
    """Predictions for the last `recent` trading dates from a fit on the `train` dates that end `embargo` dates before them, for calibration on what has been seen since."""
    last = calendar.agg(F.max("seq").alias("_top"))
    x = panel.join(calendar, "date").crossJoin(F.broadcast(last)).withColumn("_back", F.col("_top") - F.col("seq")).withColumn("_g", F.lit(1))  # one row
    fits = fits_by_group(x.where((F.col("_back") >= recent + embargo) & (F.col("_back") < recent + embargo + train)), "_g", features, label)
    return applied(x.where(F.col("_back") < recent), fits, "_g", features).drop("_back", "_top", "_g", "seq")


def importances(model, features: list[str], spark) -> DataFrame:
    """feature, importance of a fitted tree model."""
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def confidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of several predictions and 1 - 2 x their population deviation in percent ranks of the date, the agreement of the models."""
    from quantloom.functions import rolling as R

    for c in columns:
        df = df.withColumn(f"_r_{c}", R.percent_rank(c, ["date"]))
    ranks = F.array(*(F.col(f"_r_{c}") for c in columns))
    mean = F.aggregate(ranks, F.lit(0.0), lambda s, v: s + v) / len(columns)
    spread = F.sqrt(F.aggregate(ranks, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / len(columns))
    return df.withColumn("blend", mean).withColumn("reliability", F.greatest(F.lit(0.0), 1 - 2 * spread)).drop(*(f"_r_{c}" for c in columns))


