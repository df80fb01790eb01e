"""Removal of repeated multi-line chunks with content-defined boundaries.

A rolling hash over the hashes of the last lines decides after which lines a
chunk ends, so an inserted or deleted line moves only the boundaries next to
it. Chunks that occur in several places of the corpus are found by their
128-bit hashes; the first occurrence stays, and each other one is removed after
its bytes were compared with the first one's.

The lines of a passage before its first boundary and after its last one share
their chunk with what stands around. For whole passages each two consecutive
lines that do not lie together in a repeated chunk are therefore looked up as
well: with the chunks they join to the run from its first repeated line to its
last, whatever stands around it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .storage import scratch, staged

WINDOW = 2
DIVISOR = 2
_MASK = (1 << 64) - 1


def chunks(text: bytes, window: int = WINDOW, divisor: int = DIVISOR) -> list[list[bytes]]:
    """The lines of a text in chunks: a chunk ends after a line if the hash of the last `window` line hashes is divisible by `divisor`."""
    import xxhash

    out: list[list[bytes]] = [[]]
    rolling: list[int] = []
    for line in text.split(b"\n"):
        out[-1].append(line)
        rolling = [*rolling[-(window - 1) :], xxhash.xxh3_64_intdigest(line)] if window > 1 else [xxhash.xxh3_64_intdigest(line)]
        mixed = 0
        for h in rolling:
            mixed = (mixed * 0x9E3779B97F4A7C15 + h) & _MASK
        if (mixed >> 32) % divisor == 0:
            out.append([])
    if not out[-1]:
        out.pop()
    return out


def _multi(chunk: list[bytes]) -> bool:
    """A chunk can be removed if two or more of its lines have something besides white space."""
    return len(chunk) > 1 and sum(1 for x in chunk if x.strip()) > 1


def pairs(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The lines of a text, and the places of each two consecutive lines that are more than white space; empty lines between belong to the two."""
    lines = text.split(b"\n")
    shown = [i for i, x in enumerate(lines) if x.strip()]
    return lines, list(zip(shown[:-1], shown[1:], strict=True))


#: what a piece is: a chunk, or two consecutive lines
CHUNK, PAIR = 0, 1


def _owners(found: list[list[bytes]]) -> list[int]:
    """For each line the number of its chunk."""
    return [k for k, c in enumerate(found) for _ in c]


def _pieces(text: bytes, whole: bool) -> list[tuple[int, int, int, bytes]]:
    """Kind, place and bytes of all that can be removed from a text, after the place the number of the chunk that a pair lies in, -1 outside."""
    found = chunks(text)
    out = [(CHUNK, k, -1, b"\n".join(c)) for k, c in enumerate(found) if _multi(c)]
    if whole:
        owner, (lines, both) = _owners(found), pairs(text)
        out += [(PAIR, k, owner[a] if owner[a] == owner[b] else -1, b"\n".join(lines[a : b + 1])) for k, (a, b) in enumerate(both)]
    return out


def _without(text: bytes, drop: list[dict], whole: bool) -> tuple[bytes, int, int]:
    """The text without the pieces whose bytes equal those of the first occurrence, and how many chunks (whole passages: runs of lines) and lines went."""
    own = {(kind, place): piece for kind, place, _, piece in _pieces(text, whole)}
    same = [(x["kind"], x["place"]) for x in drop if own[x["kind"], x["place"]] == x["chunk"]]
    found, n = chunks(text), 0
    if whole:
        lines, both = pairs(text)
        owner = _owners(found)
        cut = {place for kind, place in same if kind == CHUNK}
        spans = [both[place] for kind, place in same if kind == PAIR] + [(a, b) for a, b in both if owner[a] == owner[b] and owner[a] in cut]
        gone = [False] * len(lines)
        for a, b in spans:
            gone[a : b + 1] = [True] * (b + 1 - a)
        runs = sum(x and not y for x, y in zip(gone, [False, *gone], strict=False))
        return b"\n".join(x for x, y in zip(lines, gone, strict=True) if not y), runs, sum(gone)
    for _, k in same:
        n += len(found[k])
        found[k] = []
    return b"\n".join(line for c in found for line in c), len(same), n


def _hashes(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in textkit.parts(batches, 2):
        rows, kinds, place, owner, high, low = [], [], [], [], [], []
        for i, text in enumerate(textkit.texts(batch.column(2))):
            for kind, k, inside, piece in _pieces(text, whole):
                h = xxhash.xxh3_128_intdigest(piece)
                rows.append(i), kinds.append(kind), place.append(k), owner.append(inside), high.append((h >> 64) - (1 << 63)), low.append((h & _MASK) - (1 << 63))
        at = pa.array(rows, pa.int64())
        columns = [pa.array(kinds, pa.int32()), *(pa.array(x, pa.int64()) for x in (place, owner, high, low))]
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["id", "key", "kind", "place", "owner", "high", "low"])


def _texts_at(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in textkit.parts(batches, 0):
        high, low, out = [], [], []
        for text, wanted in zip(textkit.texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            own = {(kind, place): piece for kind, place, _, piece in _pieces(text, whole)}
            for x in wanted:
                high.append(x["high"]), low.append(x["low"]), out.append(own[x["kind"], x["place"]])
        yield pa.record_batch([pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(out, pa.binary())], names=["high", "low", "chunk"])


def _cut(batches: Iterator[pa.RecordBatch], whole: bool, text: int) -> Iterator[pa.RecordBatch]:
    """The texts without the chunks that equal the first occurrence's bytes, and how many chunks and lines went."""
    for batch in textkit.parts(batches, text):
        texts, gone, lines = [], [], []
        raw = batch.column("_ql_text")
        for body, is_null, drop in zip(textkit.texts(raw), raw.is_null().to_pylist(), batch.column("_ql_drop").to_pylist(), strict=True):
            n = m = 0
            if drop:
                body, n, m = _without(body, drop, whole)
            texts.append(None if is_null else body.decode("utf-8", "replace")), gone.append(n), lines.append(m)
        rest = [i for i, name in enumerate(batch.schema.names) if name not in ("_ql_text", "_ql_drop")]
        yield pa.record_batch(
            [*(batch.column(i) for i in rest), pa.array(texts, pa.string()), pa.array(gone, pa.int64()), pa.array(lines, pa.int64())],
            names=[*(batch.schema.names[i] for i in rest), "_ql_clean", "_ql_chunks", "_ql_lines"],
        )


def _later(found: DataFrame, kind: int, label: str) -> tuple[DataFrame, DataFrame]:
    """The first occurrences of the pieces of a kind that occur again, and the places of all others."""
    first = found.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "place")).alias("first"))
    first = staged(first.where("n > 1").select("high", "low", "first"), f"repeated-{label}")
    again = found.join(first, ["high", "low"]).where(~F.struct("id", "key", "place").eqNullSafe(F.col("first")))
    if kind == PAIR:  # two lines that overlap their first occurrence, as three equal lines do, are no copy of it
        again = again.where(~F.struct("id", "key", F.col("place") - 1).eqNullSafe(F.struct("first.id", "first.key", "first.place")))
    again = staged(again.select("id", "key", F.lit(kind).alias("kind"), "place", "high", "low"), f"again-{label}")
    return first.select(F.lit(kind).alias("kind"), "high", "low", "first"), again


def _repeats(src: DataFrame, whole: bool) -> DataFrame:
    """The pieces to cut out of each document, with the bytes of their first occurrences.

    Pairs of lines inside a chunk that stood before went with it, and its first
    occurrence holds the same pairs, so only the others are looked up."""
    found = staged(src.mapInArrow(lambda it: _hashes(it, whole), "id long, key long, kind int, place long, owner long, high long, low long"), "chunks").distinct()
    first, again = _later(found.where(F.col("kind") == CHUNK), CHUNK, "chunks")
    if whole:
        gone = again.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("place").alias("_place")).hint("merge")  # one plan at every size
        rest = found.where(F.col("kind") == PAIR).join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("owner") == F.col("_place")), "left_anti")
        rest = staged(rest, "pairs")
        first_pairs, again_pairs = _later(rest, PAIR, "pairs")
        first, again = first.unionByName(first_pairs), again.unionByName(again_pairs)
    holds = first.groupBy(F.col("first.id").alias("fid"), F.col("first.key").alias("fkey")).agg(F.collect_list(F.struct("kind", F.col("first.place").alias("place"), "high", "low")).alias("wanted"))
    holds = staged(holds, "holders").hint("merge")  # one plan at every size
    texts = src.join(holds, src["id"].eqNullSafe(holds["fid"]) & (src["key"] == holds["fkey"])).select("text", "wanted")
    texts = staged(texts.mapInArrow(lambda it: _texts_at(it, whole), "high long, low long, chunk binary").dropDuplicates(["high", "low"]), "first-texts")
    again = again.join(texts, ["high", "low"])
    return again.groupBy(F.col("id").alias("_ql_id"), F.col("key").alias("_ql_key")).agg(F.collect_list(F.struct("kind", "place", "chunk")).alias("_ql_drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, whole: bool = False) -> DataFrame:
    """`docs` with the repeated multi-line chunks cut out of `text_col`; with `counts` also n_chunks_removed and n_lines_removed.

    With `whole`, every run of two or more lines that stood before goes from
    its first line to its last: chunks first, then each two lines that no
    repeated chunk holds; n_chunks_removed counts the runs cut out. The
    first copy of each line always stays.

    The first occurrence, by id and then by place, stays. Null texts stay null,
    empty ones empty; a text may become empty, its row stays. Rows with a null
    id take part and come first. Rows that repeat both id and text count as one
    document: they keep and lose the same chunks. All other columns are carried
    along unchanged; with `counts`, columns of the names of the counts are
    replaced. Whole texts of any length are read. An empty table gives an empty one."""
    key = F.xxhash64(F.col(text_col))
    src = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        drop = staged(_repeats(src, whole), "cuts", keep=True).hint("merge")  # one plan at every size
    all_rows = docs.withColumnRenamed(text_col, "_ql_text")
    wide = all_rows.join(drop, F.col(id_col).cast("long").eqNullSafe(F.col("_ql_id")) & (F.xxhash64("_ql_text") == F.col("_ql_key")), "left").drop("_ql_id", "_ql_key")
    fields = [f for f in wide.schema.fields if f.name not in ("_ql_text", "_ql_drop")]
    schema = T.StructType([*fields, T.StructField("_ql_clean", T.StringType()), T.StructField("_ql_chunks", T.LongType()), T.StructField("_ql_lines", T.LongType())])
    place = wide.columns.index("_ql_text")
    out = wide.mapInArrow(lambda it: _cut(it, whole, place), schema)
    more = [F.col("_ql_chunks").alias("n_chunks_removed"), F.col("_ql_lines").alias("n_lines_removed")] if counts else []
    own = [c for c in docs.columns if not counts or c not in ("n_chunks_removed", "n_lines_removed")]
    return out.select(*(F.col("_ql_clean").alias(text_col) if c == text_col else F.col(c) for c in own), *more)
