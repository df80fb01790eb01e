"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form one class, so copies are never compared.
Class representatives are banded; in each band bucket the smallest one is the
leader and is paired with every member. A pair compares its signatures batch by
batch and is dropped once the posterior probability that its similarity reaches
the threshold falls below the chosen miss probability; survivors are verified
on the full sets. Buckets whose members are then still in several components
are compared in blocks of bounded size: first signatures alone, then the texts
of those that survive, where only a spanning forest of verified links leaves a
pair of blocks. A class is named by id and text hash of its smallest row, so
rows that repeat an id with other texts are nodes of their own."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .graph import components
from .storage import scratch, staged

#: similarities on which the posterior is integrated
_GRID = np.linspace(0.0005, 0.9995, 1000)


def bands_for(threshold: float, miss: float, hashes: int = 128) -> tuple[int, int]:
    """Bands and rows of the most selective banding that misses a pair at the threshold with at most `miss`."""
    best = (hashes, 1)
    for rows in range(1, 9):
        bands = hashes // rows
        if (1 - threshold**rows) ** bands <= miss:
            best = (bands, rows)
    return best


@functools.cache
def least_matches(threshold: float, miss: float, hashes: int, batch: int) -> tuple[tuple[int, int], ...]:
    """(n, m) per batch: a pair with fewer than m matches in its first n signature bytes has
    P(similarity >= threshold | matches) < miss under a uniform prior. Signature bytes also match by chance, once in 256."""
    r = _GRID + (1 - _GRID) / 256
    high = _GRID >= threshold
    out = []
    for n in [*range(batch, hashes, batch), hashes]:
        for m in range(n + 1):
            like = m * np.log(r) + (n - m) * np.log1p(-r)
            like = np.exp(like - like.max())
            if like[high].sum() >= miss * like.sum():
                out.append((n, m))
                break
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float, batch: int = 32) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential test."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    last = 0
    for n, m in least_matches(threshold, miss, a.shape[1], batch):
        matches[alive] += (a[alive, last:n] == b[alive, last:n]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= m]
        last = n
    return alive


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted distinct arrays."""
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if 100 * small < percent * large:
        return False
    if not small:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sketches(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20240229)
    flip = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]
    times = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
    coef = textkit._stream(71, rows) | np.uint64(1)
    for batch in textkit.parts(batches, 1):
        h, bounds = textkit.word_hashes(*textkit.utf8(batch.column(1)), fold=True)
        sizes, lows, highs, sigs, keys = [], [], [], [], []
        for s in textkit.shingle_sets(h, bounds, words):
            sizes.append(len(s))
            if not len(s):
                lows.append(0), highs.append(0), sigs.append(b""), keys.append([])
                continue
            low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
            x = (s >> np.uint64(32)).astype(np.uint32)
            for i in range(0, len(x), 2048):
                m = x[None, i : i + 2048] ^ flip
                m *= times
                np.minimum(low, m.min(axis=1), out=low)
            band = textkit.mix((low.reshape(bands, rows).astype(np.uint64) * coef).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
            lows.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
            highs.append(int(textkit.mix(s).sum(dtype=np.uint64).astype(np.int64)))
            sigs.append((low & np.uint32(255)).astype(np.uint8).tobytes())
            keys.append(band.astype(np.int64))
        yield pa.record_batch(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["id", "key", "n", "f1", "f2", "sig", "keys"],
        )


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts: a third of the size of their sets, so these are what the joins move."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in textkit.parts(batches, 1):
        yield pa.record_batch([batch.column(0), pa.array(map(pack, textkit.texts(batch.column(1))), pa.binary())], names=["node", "pack"])


def _sets_of(packs: list[bytes], words: int, size: int = 4 << 20) -> dict[bytes, np.ndarray]:
    """The shingle set of each distinct compressed text; at most `size` bytes of text, or one longer text, are hashed at once."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out: dict[bytes, np.ndarray] = {}
    run: list[bytes] = []
    texts: list[bytes] = []

    def hash_run() -> None:
        h, bounds = textkit.word_hashes(*textkit.utf8(pa.array(texts, pa.binary())), fold=True)
        out.update(zip(run, textkit.shingle_sets(h, bounds, words), strict=True))
        run.clear(), texts.clear()

    held = 0
    for p in dict.fromkeys(packs):
        run.append(p), texts.append(unpack(p))
        held += len(texts[-1])
        if held > size:
            hash_run()
            held = 0
    hash_run()
    return out


def _signature_test(batches: Iterator[pa.RecordBatch], percent: int, miss: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).take(pa.array(plausible(a, b, percent / 100, miss)))


def _set_test(batches: Iterator[pa.RecordBatch], percent: int, words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textkit.parts(textkit.parts([whole], 2, 1 << 20), 3, 1 << 20):  # column 2 is ta, 3 is tb
            left, right = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            sets = _sets_of(left + right, words)
            yield batch.select(["a", "b"]).filter(pa.array([similar(sets[x], sets[y], percent) for x, y in zip(left, right, strict=True)], pa.bool_()))


def _rivals(t: pa.Table, percent: int, miss: float, words: int | None) -> tuple[list[int], list[int]]:
    """Pairs of rows of two blocks, in different components, that survive the signature test; with `words` only those that the full sets
    confirm and that connect what the pairs before did not."""
    component = t.column("component").combine_chunks()
    _, group = np.unique(np.rec.fromarrays([x.to_numpy() for x in component.flatten()]), return_inverse=True)
    block, pair = t.column("block").to_numpy(), t.column("pair")[0].as_py()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(group), -1)
    packs = t.column("pack").to_pylist() if words else []
    sets = _sets_of(packs, words) if words else {}
    parent = list(range(len(group)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = np.flatnonzero(block == pair["x"]), np.flatnonzero(block == pair["y"])
    one: list[int] = []
    two: list[int] = []
    for i in left.tolist():
        js = right[right > i] if pair["x"] == pair["y"] else right
        js = js[group[js] != group[i]]
        js = js[plausible(np.broadcast_to(sig[i], (len(js), sig.shape[1])), sig[js], percent / 100, miss)]
        for j in js.tolist():
            x, y = root(int(group[i])), root(int(group[j]))
            if not words or x != y and similar(sets[packs[i]], sets[packs[j]], percent):
                if words:
                    parent[max(x, y)] = min(x, y)
                one.append(i), two.append(j)
    return one, two


def _block_rivals(t: pa.Table, percent: int, miss: float) -> pa.Table:
    """The members of two blocks that a signature test leaves."""
    at = np.unique(np.array(sum(_rivals(t, percent, miss, None), []), np.int64))
    return t.select(["band", "key", "pair", "rep", "component", "block"]).take(pa.array(at))


def _block_links(t: pa.Table, percent: int, miss: float, words: int) -> pa.Table:
    """Verified links between members of two blocks that are not connected yet."""
    one, two = (pa.array(x, pa.int64()) for x in _rivals(t, percent, miss, words))
    return pa.table({"a": t.column("rep").take(one), "b": t.column("rep").take(two)})


NODE = "struct<id:bigint,key:bigint>"


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, miss: float = 1e-6, block: int = 512, keyed: bool = False
) -> DataFrame:
    """One row per input row: id, `n_shingles`, `component_id` (smallest id reached over links of
    100 * intersection >= percent * union), `kept` (id = component_id).

    Words are `[^\\x20\\x09-\\x0D]+` of the A-Z lower-cased whole text. Null or
    wordless text: empty set, linked with nothing. Rows with a null id: their
    component is null and `kept` is true. Repeated ids: each row gets its own
    set and joins whichever class its set belongs to; all report the smallest
    id. Texts of any length are read whole. An empty table gives an empty
    result. `miss` bounds the probability to lose a pair at the threshold, once
    in banding and once in the Bayesian test. Memory per task: the texts of two
    blocks of `block` documents of a bucket."""
    bands, rows = bands_for(percent / 100, miss)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    sketch = staged(
        src.mapInArrow(lambda it: _sketches(it, words, bands, rows), "id long, key long, n long, f1 long, f2 long, sig binary, keys array<long>"), "sketches"
    )
    with scratch(docs.sparkSession):
        classes = staged(_classes(src, sketch, percent, words, miss, block), "final", keep=True)
    out = sketch.select("id", "key", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left")
    own = F.coalesce(F.col("component.id"), F.col("id"))
    more = [F.col("key"), F.coalesce(F.col("component.key"), F.col("key")).alias("component_key")] if keyed else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"), *more)


def _classes(src: DataFrame, sketch: DataFrame, percent: int, words: int, miss: float, block: int) -> DataFrame:
    """The component of each class of equal sets."""
    links_schema = f"a {NODE}, b {NODE}"
    some = sketch.where("n > 0 and id is not null")
    reps = some.groupBy("n", "f1", "f2").agg(F.min(F.struct("id", "key", "sig", "keys")).alias("m"))
    reps = staged(reps.select("n", "f1", "f2", F.struct("m.id", "m.key").alias("rep"), F.col("m.sig").alias("sig"), F.col("m.keys").alias("keys")), "classes")
    members = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("rep").alias("leader")).where("size > 1")
    buckets = staged(buckets, "buckets")
    filled = staged(members.join(buckets, ["band", "key"]).select("band", "key", "size", "leader", "rep"), "members")
    pairs = staged(filled.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    sig_a, sig_b = (reps.select(F.col("rep").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab")
    alive = pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sa", "sb")
    alive = staged(alive.mapInArrow(lambda it: _signature_test(it, percent, miss), links_schema), "survivors")
    wide = filled.where("size > 2").select("rep")
    wanted = alive.select(F.col("a").alias("rep")).union(alive.select("b")).union(wide).distinct()
    texts = src.where("id is not null").select(F.struct("id", "key").alias("rep"), "text")
    packs = texts.mapInArrow(_packs, f"node {NODE}, pack binary").withColumnRenamed("node", "rep").join(staged(wanted, "wanted").hint("merge"), "rep", "left_semi")
    packs = staged(packs.groupBy("rep").agg(F.min("pack").alias("pack")), "packs")  # in the order that the join leaves, no further shuffle
    pack_a, pack_b = (packs.select(F.col("rep").alias(c), F.col("pack").alias(f"t{c}")) for c in "ab")
    tested = alive.join(pack_a, "a").join(pack_b, "b").select("a", "b", "ta", "tb")
    links = staged(tested.mapInArrow(lambda it: _set_test(it, percent, words), links_schema), "links")
    first = components(links)

    # buckets that still hold several components
    labelled = filled.where("size > 2").join(first, F.col("rep") == F.col("node"), "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = staged(labelled, "labelled")
    mixed = labelled.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = staged(mixed.where("lo <> hi").select("band", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "mixed")
    rest = labelled.join(mixed, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("x"), F.greatest(F.col("block"), o).alias("y")))
    rest = rest.select("band", "key", "rep", "component", "block", "blocks")
    sigs = reps.select("rep", "sig")
    rest = staged(rest.join(sigs, "rep"), "rest").select("band", "key", "rep", "component", "block", "sig", F.explode(both).alias("pair"))
    group = ["band", "key", "pair"]
    schema = rest.select(*group, "rep", "component", "block").schema
    rivals = staged(rest.groupBy(*group).applyInArrow(lambda t: _block_rivals(t, percent, miss), schema), "rivals")
    near = rivals.join(sigs, "rep").join(packs, "rep").select(*group, "rep", "component", "block", "sig", "pack")
    more = near.groupBy(*group).applyInArrow(lambda t: _block_links(t, percent, miss, words), links_schema)
    final = components(links.union(staged(more, "more")))

    return reps.join(final, reps["rep"] == final["node"], "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
