"""Best-fit packing of tokenised documents by minimum bin slack.

All pieces are described by the histogram of their lengths, which has at most
`capacity` entries whatever the size of the corpus. The fill plan is made on
that histogram: the largest open length seeds a bin, a bitset subset-sum over
the available lengths finds the fullest feasible combination with it, and the
combination is removed as often as its lengths last. Pieces then find their
place by their rank among the pieces of equal length; a piece that fills a
sequence needs none."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .storage import staged

#: entries of a worker's cache of tokenised words; others are tokenised each time
CACHE_WORDS = 700_000
_TOKENIZERS: dict[str, object] = {}


#: bytes of text whose new words are tokenised together
RUN = 1 << 22
#: new words of one call of the tokenizer
TOGETHER = 64
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _ends_in_letter(word: bytes) -> bool:
    """Whether the last character is a-z, 0-9 or a letter of Latin-1."""
    last = word[-1]
    return 97 <= last <= 122 or 48 <= last <= 57 or len(word) > 1 and word[-2] == 0xC3 and 0x80 <= last <= 0xBF and last not in (0x97, 0xB7)


class _Ids(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, of runs without white space.

    The vocabulary's pre-tokeniser drops white space, so a text's ids are those
    of its runs; and it cuts where marks follow a letter, so a run's ids are those
    of what stands before its last marks and of those marks. New runs of a few
    megabytes of text are told first, each once, and tokenised many at a call."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            texts = [w.decode("utf-8", "replace") for w in some]
            out = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            cuts = (4 * np.searchsorted([o[0] for o in out.offsets], starts)).tolist()
            raw = np.array(out.ids, "<u4").tobytes()
            found.update(zip(some, (raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
        return found

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct words that are not known yet; kept while there is room."""
        parted: list[tuple[bytes, int]] = []
        plain: dict[bytes, None] = {}
        special: list[bytes] = []
        for w in words:
            n = len(w.rstrip(_MARKS))
            if b"<|" in w:  # may hold a special token
                special.append(w)
            elif 0 < n < len(w) and _ends_in_letter(w[:n]):
                parted.append((w, n))
                plain[w[:n]] = plain[w[n:]] = None
            else:
                plain[w] = None
        found = self.encode_words([w for w in plain if w not in self])
        known = lambda w: found.get(w) or self[w]
        found |= {w: known(w[:n]) + known(w[n:]) for w, n in parted} | {w: self.encode(w.decode("utf-8", "replace")) for w in special}
        if len(self) < CACHE_WORDS:
            self.update(found)
        return found

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Runs are told by 64-bit hashes: each distinct one is looked up once, and its ids are dealt to its places."""
        texts = [t if b"<|" in t else t.lower() for t in texts]  # as the vocabulary does; special tokens keep their case
        raw = b"".join(texts)
        data, offs = np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)])
        hashes, bounds = textkit.word_hashes(data, offs, fold=False)
        if not len(hashes):
            return [b""] * len(texts)
        starts, ends = textkit.word_places(data, offs)
        _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        words = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        found = list(map(self.get, words))
        new = self.learn([w for w, x in zip(words, found, strict=True) if x is None])
        found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        n = sizes[place]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat((np.cumsum(sizes) - sizes)[place] - upto[:-1], n) + np.arange(upto[-1])]
        cuts = upto[bounds].tolist()
        return [out[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def text(self, text: bytes) -> bytes:
        """The ids of a text of any length, in parts that end at white space."""
        if len(text) <= RUN:
            return self.texts([text])[0]
        out, at = [], 0
        special = b"<|" in text
        while at < len(text):
            to = min(len(text), at + RUN)
            while to < len(text) and not text[to : to + 1].isspace():
                to += 1
            part = text[at:to]
            out.append(self.texts([part if special else part.lower()])[0])
            at = to
        return b"".join(out)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    ids = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, _Ids(path))
    tail = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    for batch in textkit.parts(batches, 1, RUN):
        rows, piece, start, length, crc = [], [], [], [], []
        texts = textkit.texts(batch.column(1))
        for i, raw in enumerate(ids.texts(texts) if len(texts) > 1 else map(ids.text, texts)):
            raw += tail
            for k, at in enumerate(range(0, len(raw), step)):
                part = raw[at : at + step]
                rows.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
        yield pa.record_batch(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def fullest(target: int, lengths: list[int], counts: np.ndarray) -> dict[int, int]:
    """The multiset of available lengths (descending) whose sum is largest within `target`, by bitset subset sums."""
    mask = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        left = min(int(counts[n]), target // n) if n <= target else 0
        part = 1
        while left:
            take = min(part, left)
            new = (reach | reach << (n * take)) & mask
            if new != reach:
                steps.append((n, take, reach))
                reach = new
            left -= take
            part *= 2
        if reach >> target & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            used[n] = used.get(n, 0) + take
            total -= n * take
    return used


def fill_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, lengths and how often each in every such bin)."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    plan: list[tuple[int, dict[int, int]]] = []
    seed = capacity
    open_lengths = [n for n in range(capacity, 0, -1) if counts[n]]
    while seed:
        if not counts[seed]:
            seed -= 1
            continue
        counts[seed] -= 1
        if open_lengths and open_lengths[0] > seed:
            open_lengths = [n for n in open_lengths if n <= seed and (counts[n] or n == seed)]
        bin_ = fullest(capacity - seed, [n for n in open_lengths if counts[n] and n <= capacity - seed], counts)
        counts[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(int(counts[n]) // k for n, k in bin_.items())
        for n, k in bin_.items():
            counts[n] -= times * k
        plan.append((times, bin_))
    return plan


def _placement(plan: list[tuple[int, dict[int, int]]], capacity: int) -> dict[int, dict[str, np.ndarray]]:
    """Per length, by first rank: first bin, copies in a bin, offset of the first copy."""
    used = np.zeros(capacity + 1, np.int64)
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for times, bin_ in plan:
        at = 0
        for n in sorted(bin_, reverse=True):
            rows.setdefault(n, []).append((int(used[n]), first_bin, bin_[n], at))
            used[n] += times * bin_[n]
            at += n * bin_[n]
        first_bin += times
    return {n: dict(zip(("rank", "bin", "copies", "at"), np.array(x, np.int64).T, strict=True)) for n, x in rows.items()}


def _place(batches: Iterator[pa.RecordBatch], base: dict[tuple[int, int], int], places: dict[int, dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        length, group, rank = (batch.column(c).to_numpy() for c in ("length", "bucket", "rank"))
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            r = np.array([base[n, g] for g in group[at].tolist()], np.int64) + rank[at]
            p = places[n]
            k = np.searchsorted(p["rank"], r, side="right") - 1
            inside = r - p["rank"][k]
            seq[at] = p["bin"][k] + inside // p["copies"][k]
            off[at] = p["at"][k] + inside % p["copies"][k] * n
        yield pa.record_batch([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, buckets: int = 64, group: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut documents into pieces of at most `capacity` tokens and pack the pieces into few sequences.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; the
    places of a sequence are gapless from 0. A null or empty text is the end id
    alone; texts of any length are read whole; rows with a null or repeated id
    are packed like any other, equal rows in any order; other columns of the
    input are not read. An empty table packs to no rows. `tokenizer_path` is
    readable on every executor. The pieces of one length are ranked in
    `buckets` parts, or more, so that a part holds about `group` pieces at
    most. To the driver and the tasks go the counts of these parts: capacity x
    buckets, and one for each `group` pieces."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = staged(src.mapInArrow(lambda it: _pieces(it, tokenizer_path, capacity, end_id), schema), "pieces")
    spark = docs.sparkSession
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    pieces = pieces.where(F.col("length") < capacity)
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    parts = spark.createDataFrame([(n, max(buckets, -(-c // group))) for n, c in counts], "length long, parts long")
    pieces = pieces.join(F.broadcast(parts), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")).cast("int"))  # at most `capacity` rows
    cells = pieces.groupBy("length", "bucket").count().orderBy("length", "bucket").collect()
    base: dict[tuple[int, int], int] = {}
    histogram: dict[int, int] = {}
    for n, g, c in cells:
        base[n, g] = histogram.get(n, 0)
        histogram[n] = base[n, g] + c
    places = _placement(fill_plan(histogram, capacity), capacity)
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "bucket").withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    sent = spark.sparkContext.broadcast((base, places))
    placed = ranked.mapInArrow(lambda it: _place(it, *sent.value), f"{schema}, sequence_id long, offset long")
    return placed.unionByName(full)
