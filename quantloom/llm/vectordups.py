"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Equal vectors form one class. Each class representative, normalised, gets one
bucket per table: k Gaussian projections, shifted and cut to cells of one
width. The members of a bucket are compared by matrix products; a pair counts
in the first table in which it meets, so that no pair has to be kept to be told
from itself. Large buckets are compared in blocks. Their tight core needs no
comparison at all: vectors within half the threshold angle of one leader are
linked to each other, so they form a ball whose links are its size less one."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .graph import components
from .storage import scratch, staged

NODE = "struct<id:bigint,key:bigint>"
_BUCKET = ["dim", "table", "cell"]


def meets(distance: float, width: float) -> float:
    """Probability that one quantised Gaussian projection puts two points of that distance into one cell."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


@functools.cache
def tables_for(vectors: int, cosine: float, miss: float, company: int, width: float = 4.0) -> tuple[int, int]:
    """Projections per table so that about `company` unrelated (orthogonal) vectors share a bucket, and tables so that a pair at the threshold is missed with probability `miss` at most."""
    near, far = meets(math.sqrt(2 - 2 * cosine), width), meets(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(vectors, 2) / company) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log1p(-(near**k)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """Bytes of each usable vector, null for the others, and a hash to name it."""
    for batch in batches:
        raw: list[bytes | None] = []
        for v in batch.column(1):
            x = None if not v.is_valid else v.values
            if x is None or not len(x) or x.null_count:
                raw.append(None)
                continue
            a = x.to_numpy(zero_copy_only=False).astype(dtype)
            raw.append(a.tobytes() if np.isfinite(a).all() and a.any() else None)
        yield pa.record_batch([batch.column(0), pa.array(raw, pa.binary())], names=["id", "vec"])


def _cells(batches: Iterator[pa.RecordBatch], dtype: str, k: int, tables: int, width: float) -> Iterator[pa.RecordBatch]:
    """Per representative its dimension and the cell hash of each table."""
    coef = (textkit._stream(131, k) | np.uint64(1)).reshape(k, 1)
    for batch in batches:
        raw = batch.column("vec").to_pylist()
        dims = np.array([len(r) for r in raw], np.int64) // np.dtype(dtype).itemsize
        cells = np.zeros((len(raw), tables), np.int32)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            x = _unit(np.frombuffer(b"".join(raw[i] for i in at), dtype).reshape(-1, d).astype(np.float64))
            rng = np.random.default_rng([d, 7])  # the same directions in every task
            for t in range(tables):
                q = np.floor(x @ rng.standard_normal((d, k)) / width + rng.random(k)).astype(np.int64).astype(np.uint64)
                h = textkit.mix((q[:, :, None] * coef).sum(axis=1, dtype=np.uint64)[:, 0] + np.uint64(t))
                cells[at, t] = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * tables, pa.int32()), pa.array(cells.ravel(), pa.int32()))
        yield pa.record_batch([batch.column("rep"), batch.column("n"), batch.column("vec"), pa.array(dims, pa.int32()), flat], names=["rep", "n", "vec", "dim", "cells"])


def _ball_test(batches: Iterator[pa.RecordBatch], dtype: str, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [float((_unit(np.frombuffer(a, dtype).astype(np.float64)[None]) * _unit(np.frombuffer(b, dtype).astype(np.float64)[None])).sum()) >= least for a, b in zip(batch.column("vec").to_pylist(), batch.column("lead_vec").to_pylist(), strict=True)]
        yield batch.select(["rep", "leader"]).filter(pa.array(near, pa.bool_()))


def _lowest(adj: np.ndarray) -> np.ndarray:
    """The first row that each row reaches over the links of a symmetric matrix."""
    label = np.arange(len(adj))
    while True:
        new = np.minimum(label, np.where(adj, label[None, :], len(adj)).min(axis=1, initial=len(adj)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(rows: pa.Table, dtype: str, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a bucket or block (`side` 2), or between two blocks (`side` 0 and 1): which have links, how many rows they link to, and the first row that they reach."""
    raw = rows.column("vec").to_pylist()
    x = _unit(np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64))
    adj = x @ x.T >= cosine
    np.fill_diagonal(adj, False)
    ball = rows.column("ball").to_numpy()
    adj &= (ball[:, None] != ball[None, :]) | (ball[:, None] == -1)
    side = rows.column("side").to_numpy()
    if side[0] != 2:
        adj &= side[:, None] != side[None, :]
    one, two = np.nonzero(adj)
    earlier = rows.column("earlier").combine_chunks()
    cells = earlier.flatten().to_numpy().reshape(len(raw), -1)
    if cells.shape[1] and len(one):
        for i in range(0, len(one), 65536):
            met = (cells[one[i : i + 65536]] == cells[two[i : i + 65536]]).any(axis=1)
            adj[one[i : i + 65536][met], two[i : i + 65536][met]] = False
    n = rows.column("n").to_numpy()
    some = np.flatnonzero(adj.any(axis=1))
    return some, adj[some] @ n, _lowest(adj)[some]


def _linked(batches: Iterator[pa.RecordBatch], group: list[str], dtype: str, cosine: float) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows that agree in `group`; a run has two blocks of rows at most, so little waits for the next batch."""
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.rec.fromarrays([table.column(c).to_numpy() for c in group])
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                run = table.slice(a, b - a)
                some, n, root = _compared(run, dtype, cosine)
                if len(some):
                    rep = run.column("rep").combine_chunks()
                    yield pa.record_batch([rep.take(pa.array(some)), pa.array(n, pa.int64()), rep.take(pa.array(root))], names=["rep", "links", "root"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = np.rec.fromarrays([batch.column(c).to_numpy() for c in group])
        if keys[0] == keys[-1] and len(held) > 1 and held[-2].num_rows and tuple(held[-2].column(c)[-1].as_py() for c in group) == tuple(keys[0]):
            continue  # the run goes on
        table = pa.Table.from_batches(held)
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0  # the last run may go on
        done = table.num_rows - batch.num_rows + last
        yield from out(table.slice(0, done))
        held = table.slice(done).to_batches()
    if held:
        yield from out(pa.Table.from_batches(held))


def _balls(signed: DataFrame, hot: DataFrame, dtype: str, cosine: float) -> DataFrame:
    """`rep`, `ball`: representatives of large buckets that lie within half the threshold angle of the smallest member of one of them."""
    least = math.cos(math.acos(cosine) / 2) + 1e-9
    asks = staged(hot.select("rep", "leader").distinct(), "asks")
    vecs = signed.select("rep", "vec")
    wide = asks.join(vecs, "rep").join(vecs.select(F.col("rep").alias("leader"), F.col("vec").alias("lead_vec")), "leader").select("rep", "leader", "vec", "lead_vec")
    near = wide.mapInArrow(lambda it: _ball_test(it, dtype, least), f"rep {NODE}, leader {NODE}")
    return staged(near.groupBy("rep").agg(F.min("leader").alias("ball")), "balls")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, miss: float = 0.001, company: int = 128, block: int = 512) -> DataFrame:
    """One row per input row: id, `n_links` (other rows whose vectors have at least that cosine, in double precision), `component_id` (smallest id reached), `kept` (id = component_id).

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing, nor do vectors of different lengths. Rows with a null id
    have a null component, no links and are kept. Repeated ids: each row links
    by its own vector and all report the smallest id. Equal vectors are linked
    without being compared. An empty table gives an empty result. `miss` bounds
    the probability to lose a pair right at the threshold; `company` is how many
    unrelated vectors share a bucket. A task holds two blocks of `block` vectors."""
    element = vectors.schema[vector_col].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    cast = F.col(vector_col) if dtype == "<f4" else F.col(vector_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), cast.alias("embedding"))
    with scratch(vectors.sparkSession):
        usable = src.mapInArrow(lambda it: _valid(it, dtype), "id long, vec binary")
        rows = staged(usable.withColumn("key", F.xxhash64("vec")), "vectors")
        some = rows.where("id is not null and vec is not null")
        reps = staged(some.groupBy("vec").agg(F.min(F.struct("id", "key")).alias("rep"), F.count("*").alias("n")), "classes")
        k, tables = tables_for(reps.count(), cosine, miss, company)
        sign = f"rep {NODE}, n long, vec binary, dim int, cells array<int>"
        width = 4.0
        signed = staged(reps.select("rep", "n", "vec").mapInArrow(lambda it: _cells(it, dtype, k, tables, width), sign), "signed")
        final, links = _components(signed, dtype, cosine, block)
        named = reps.select("vec", "rep", "n").join(links, "rep", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
        named = staged(named.select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "named")
        out = rows.withColumn("_vec", F.when(F.col("id").isNotNull(), F.col("vec"))).drop("vec").join(named, F.col("_vec") == F.col("vec"), "left")
        own = F.coalesce(F.col("component.id"), F.col("id"))
        out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))
        return staged(out, "vector-duplicates", keep=True)


def _components(signed: DataFrame, dtype: str, cosine: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Components of the representatives, and the rows that each links to besides its own copies."""
    at = signed.select("rep", "dim", F.posexplode("cells").alias("table", "cell"))
    sizes = at.groupBy(*_BUCKET).agg(F.count("*").alias("size"), F.min("rep").alias("leader"))
    large = staged(sizes.where(F.col("size") > block).select(*_BUCKET, "leader"), "large")
    hot = staged(at.join(large, _BUCKET), "hot")
    balls = _balls(signed, hot, dtype, cosine)
    # the ball that most of a large bucket belongs to is its core; the others are compared with it and with each other
    inside = staged(hot.join(balls, "rep", "left").select(*_BUCKET, "rep", "ball"), "inside")
    counts = inside.groupBy(*_BUCKET, "ball").agg(F.count("*").alias("c"))
    core = counts.groupBy(*_BUCKET).agg(F.max(F.when(F.col("ball").isNotNull(), F.struct("c", "ball"))).alias("core"), F.sum("c").alias("size"))
    core = core.select(*_BUCKET, F.col("core.ball").alias("core"), F.ceil(F.coalesce("core.c", F.lit(0)) / block).cast("int").alias("inner"), F.ceil((F.col("size") - F.coalesce("core.c", F.lit(0))) / block).cast("int").alias("outer"))
    core = staged(core, "cores")

    wide = signed.join(balls, "rep", "left").select("rep", "n", "vec", "dim", F.when(F.col("ball").isNull(), -1).otherwise(F.xxhash64("ball.id", "ball.key").bitwiseAND((1 << 62) - 1)).alias("ball_hash"), "ball", "cells")
    wide = wide.select("*", F.posexplode("cells").alias("table", "cell")).withColumn("earlier", F.slice("cells", 1, F.col("table"))).drop("cells")
    is_core = F.coalesce(F.col("ball") == F.col("core"), F.lit(False))
    own = F.pmod(F.xxhash64("rep"), F.when(is_core, F.col("inner")).otherwise(F.col("outer"))).cast("int")
    # outer blocks meet each other and every core block; core blocks do not meet each other
    with_outer = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda o: F.struct(F.lit(0).alias("kind"), F.least(own, o).alias("x"), F.greatest(own, o).alias("y"), F.when(own == o, 2).otherwise((own > o).cast("int")).alias("side")))
    with_core = F.when(F.col("inner") > 0, F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda c: F.struct(F.lit(1).alias("kind"), own.alias("x"), c.alias("y"), F.lit(0).alias("side"))))
    core_out = F.when(F.col("outer") > 0, F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda o: F.struct(F.lit(1).alias("kind"), o.alias("x"), own.alias("y"), F.lit(1).alias("side"))))
    alone = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(2).alias("side")))
    none = F.array().cast("array<struct<kind:int,x:int,y:int,side:int>>")
    meet = F.when(F.col("inner").isNull(), alone).when(is_core, F.coalesce(core_out, none)).otherwise(F.concat(with_outer, F.coalesce(with_core, none)))
    group = [*_BUCKET, "kind", "x", "y"]
    dealt = wide.join(core, _BUCKET, "left").select("rep", "n", "vec", "ball_hash", "earlier", *_BUCKET, F.explode(meet).alias("m"))
    dealt = dealt.select(*_BUCKET, F.col("m.kind").alias("kind"), F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.col("m.side").alias("side"), "rep", "n", "vec", F.col("ball_hash").alias("ball"), "earlier")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)
    found = staged(dealt.mapInArrow(lambda it: _linked(it, group, dtype, cosine), f"rep {NODE}, links long, root {NODE}"), "found")

    in_ball = balls.join(signed.select("rep", "n"), "rep")
    in_ball = in_ball.join(in_ball.groupBy("ball").agg(F.sum("n").alias("_all")), "ball").withColumn("links", F.col("_all") - F.col("n"))
    links = staged(found.select("rep", "links").unionByName(in_ball.select("rep", "links")).groupBy("rep").agg(F.sum("links").alias("links")), "links")
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(balls.select(F.col("rep").alias("a"), F.col("ball").alias("b")))
    return components(edges), links

