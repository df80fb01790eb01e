"""Quality rules: counted base rules and the perplexity of a modified Kneser-Ney model per language.

The model predicts each byte of a text from the four bytes before it, across
word ends: the words of a text are joined by single spaces, and four symbols 0
stand before the first. Spark counts the n-grams of all texts and smooths them
by joins and windows. As every text that is scored was counted too, the model
holds the probability of each n-gram that can be asked for: a sorted array of
n-gram hashes with their log probabilities, in pieces of a bounded size. A
document is rejected when its perplexity a byte or a word lies outside the band
of its language, whose ends follow from all documents of that language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .storage import scratch, staged

#: bytes of an n-gram; a code of ORDER bytes fits a long
ORDER = 5
SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = textkit.WHITE + bytes(range(0x80, 0xC0))
#: distinct n-grams of a language that a task holds before it passes them on
HELD = 1 << 20
#: n-grams of the model that are broadcast at once, 12 bytes each; a larger model is met piece by piece
PIECE = 1 << 23


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code of the n-gram that ends at each byte of each text, the last byte lowest, and the text it belongs to.

    White space is one space, and one ends each text; a text without words has no codes."""
    pad = bytes(ORDER - 1)
    plain = [b" ".join(words) + b" " if (words := t.replace(b"\0", b"\1").split()) else b"" for t in texts]
    data = np.frombuffer(pad.join([b"", *plain]), np.uint8)
    n = max(0, len(data) - ORDER + 1)
    code = np.zeros(n, np.uint64)
    for k in range(ORDER):
        code <<= np.uint64(8)
        code |= data[k : k + n]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    return code[data[ORDER - 1 :] != 0], np.repeat(np.arange(len(plain)), sizes)


def _by_language(batch: pa.RecordBatch, lang: str, text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Per language of a batch: its rows, their codes and the place in those rows of each code."""
    texts = textkit.texts(batch.column(text))
    rows: dict[str, list[int]] = {}
    for i, name in enumerate(batch.column(lang).to_pylist()):
        rows.setdefault(name, []).append(i)
    for name, at in rows.items():
        yield name, np.array(at), *_codes([texts[i] for i in at])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a task, by language."""

    def emit(name: str, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], names=["model", "gram", "n"])

    seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in textkit.parts(batches, 1):
        for name, _, code, _ in _by_language(batch, "model", "text"):
            grams, n = np.unique(code, return_counts=True)
            if name in seen:
                old, m = seen[name]
                grams, at = np.unique(np.concatenate((old, grams)), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate((m, n)), minlength=len(grams)).astype(np.int64)
            seen[name] = grams, n
            if len(grams) > HELD:
                yield emit(name, *seen.pop(name))
    for name, (grams, n) in seen.items():
        yield emit(name, grams, n)


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """model, gram, p: interpolated modified Kneser-Ney probability of the last byte of each n-gram in `counts` (model, gram, n).

    Below the highest order an n-gram counts by how many bytes precede it. The
    three discounts of an order come from its counts of counts by the usual
    formulas, each count of counts taken as 1 at least. Under the lowest order
    lies a uniform choice among the model's bytes and one more. A context has
    256 successors at most, which bounds each window; an empty table gives an
    empty one."""
    levels = {order: counts.select("model", "gram", F.col("n").alias("c"))}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        levels[k] = staged(levels[k + 1].groupBy("model", suffix.alias("gram")).agg(F.count("*").alias("c")), f"grams-{k}")
    counted = None
    for k, rows in levels.items():
        some = rows.groupBy("model").agg(*(F.greatest(F.count_if(F.col("c") == j), F.lit(1)).alias(f"n{j}") for j in (1, 2, 3, 4)), F.count("*").alias("kinds"))
        some = some.withColumn("order", F.lit(k))
        counted = some if counted is None else counted.unionByName(some)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    cut = lambda j: F.least(F.greatest(j - (j + 1) * y * F.col(f"n{j + 1}") / F.col(f"n{j}"), F.lit(0.1 * j)), F.lit(0.9 * j))
    # staged, so that its size is known: Spark broadcasts it below its threshold, and does not deal the n-grams out by language
    discounts = staged(counted.select("order", "model", "kinds", *(cut(j).alias(f"d{j}") for j in (1, 2, 3))), "discounts")
    lower = None
    for k in range(1, order + 1):
        context = Window.partitionBy("model", F.shiftright("gram", 8))
        with_counts = {"total": F.sum("c").over(context), "one": F.count_if(F.col("c") == 1).over(context), "two": F.count_if(F.col("c") == 2).over(context), "more": F.count_if(F.col("c") > 2).over(context)}
        rows = levels[k].withColumns(with_counts).join(discounts.where(F.col("order") == k).drop("order"), "model")
        if lower is None:
            rows = rows.withColumn("low", 1 / (F.col("kinds") + 1))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            rows = rows.withColumn("suffix", suffix).join(lower.select(F.col("model").alias("m"), F.col("gram").alias("g"), F.col("p").alias("low")), (F.col("model") == F.col("m")) & (F.col("suffix") == F.col("g")))
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        spread = F.col("one") * F.col("d1") + F.col("two") * F.col("d2") + F.col("more") * F.col("d3")
        lower = staged(rows.select("model", "gram", ((F.col("c") - off + spread * F.col("low")) / F.col("total")).alias("p")), f"smooth-{k}")
    return lower


def _language(name: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(name))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each n-gram and its language, one to one within a language, and its log probability."""
    known: dict[str, np.uint64] = {}
    for batch in batches:
        langs = np.fromiter((known.get(x) or known.setdefault(x, _language(x)) for x in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
        key = textkit.mix(batch.column(1).to_numpy().astype(np.uint64) ^ langs)
        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.log(batch.column(2).to_numpy()).astype(np.float32))], names=["key", "logp"])


class Piece:
    """A sorted hash array of n-grams with their log probabilities, entered by the leading bits of the hash."""

    def __init__(self, key: np.ndarray, logp: np.ndarray):
        order = np.argsort(key)
        self.key, self.logp = np.append(key[order], np.uint64((1 << 64) - 1)), np.append(logp[order], np.float32(0))
        self.start: np.ndarray | None = None

    def look(self, key: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram hash; 0 for those of other pieces."""
        if self.start is None:
            bits = max(1, int(len(self.key)).bit_length())
            self.shift = np.uint64(64 - bits)
            self.start = np.searchsorted(self.key[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        at = self.start[key >> self.shift]
        here = self.key[at]
        todo = np.flatnonzero(here < key)
        while len(todo):
            at[todo] += 1
            todo = todo[self.key[at[todo]] < key[todo]]
        return np.where(self.key[at] == key, self.logp[at], np.float32(0))


def _losses(batch: pa.RecordBatch, piece: Piece) -> np.ndarray:
    """Minus the sum of the log probabilities of each text's n-grams in the piece."""
    loss = np.zeros(batch.num_rows)
    for name, rows, code, owner in _by_language(batch, "model", "text"):
        found = piece.look(textkit.mix(code ^ _language(name)))
        loss[rows] = -np.bincount(owner, weights=found, minlength=len(rows))
    return loss


def _repeats(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document, and how many of them lie in a 3-word window that the document has twice or more."""
    h, bounds = textkit.word_hashes(data, offs, fold=False)
    w = textkit.windows(h, 3)
    repeated = np.zeros(len(bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a < 4:
            continue
        own = w[a : b - 2]
        order = np.argsort(own, kind="stable")
        s = own[order]
        same = s[1:] == s[:-1]
        if same.any():
            at = np.concatenate((order[1:][same], order[:-1][same]))
            hit = np.zeros(b - a, bool)
            for k in range(3):
                hit[at + k] = True
            repeated[i] = hit.sum()
    return np.diff(bounds), repeated


def _measure(batches: Iterator[pa.RecordBatch], piece) -> Iterator[pa.RecordBatch]:
    for batch in textkit.parts(batches, 3):
        data, offs = textkit.utf8(batch.column("text"))
        n_words, repeated = _repeats(data, offs)
        chars, symbols, dup_lines, size = [], [], [], []
        for text in textkit.texts(batch.column("text")):
            chars.append(len(text.translate(None, _NOT_CHARS)))
            symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
            lines = [x for x in text.split(b"\n") if x.strip()]
            dup_lines.append(len(lines) - len(set(lines)))
            size.append(len(text.translate(None, textkit.WHITE)))
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("key"), batch.column("model"), *(pa.array(x, pa.int64()) for x in (n_words, chars, symbols, dup_lines, repeated, size + n_words)), pa.array(_losses(batch, piece.value))],
            names=["doc_id", "key", "model", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "loss"],
        )


def _further(batches: Iterator[pa.RecordBatch], piece) -> Iterator[pa.RecordBatch]:
    for batch in textkit.parts(batches, 3):
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(_losses(batch, piece.value))], names=["doc_id", "key", "more"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", piece: int = PIECE) -> DataFrame:
    """Base counts, `n_bytes` (of the words, and one for the end of each) and `loss` (nats of the whole text) of every row.

    Null texts count as empty: no words, loss 0. Null and empty languages share
    one model; every other language has its own. A row keeps `key`, a hash of
    its text, to tell repeated ids apart; repeated rows are counted and
    measured as often as they stand there. Whole texts are read in runs of at
    most 4 MB or one longer text. An empty table gives an empty result. To the
    driver and from there to the tasks go at most about `piece` n-grams at
    once; a model of more is met in as many passes over the texts as it has
    pieces, whose losses add up."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("model"), F.col(text_col).alias("text"))
    with scratch(spark):
        counts = src.select("model", "text").mapInArrow(_count, "model string, gram long, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))
        model = kneser_ney(staged(counts, "grams")).mapInArrow(_hashed, "key long, logp float")
        model = staged(model, "model")
        pieces = max(1, -(-model.count() // piece))
        part = F.pmod(F.shiftright("key", 20), F.lit(pieces))
        schema = "doc_id long, key long, model string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, loss double"
        more = None
        for k in range(pieces):
            table = model.where(part == k).toArrow()
            sent = spark.sparkContext.broadcast(Piece(table.column("key").to_numpy().view(np.uint64), table.column("logp").to_numpy()))
            if k == 0:
                rows = staged(src.mapInArrow(lambda it, sent=sent: _measure(it, sent), schema), "measured", keep=True)
            else:
                losses = staged(src.mapInArrow(lambda it, sent=sent: _further(it, sent), "doc_id long, key long, more double"), "losses").groupBy("doc_id", "key").agg(F.first("more").alias("more"))
                more = losses if more is None else more.unionByName(losses)
            sent.unpersist()
        if more is None:
            return rows
        more = more.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.sum("more").alias("more"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
        return staged(rows.join(more, same).withColumn("loss", F.col("loss") + F.col("more")).drop("d", "k", "more"), "all-measured", keep=True)


def judged(rows: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, width: float = 4.0, floor: float = 0.25) -> DataFrame:
    """Add `base_failed`, `perplexity` a byte, `word_perplexity`, the ends of the bands of the row's language and `kept`.

    base_failed: fewer than `min_words` words, or more than `max_repeat_percent`
    of the words in repeated 3-word windows. A band's ends lie `width` robust
    standard deviations from the median, each end by the rows on its own side:
    1.4826 x median distance of the log perplexity of the language's rows that
    pass the base rules. As few rows give no certain spread, an end is `floor` x
    median / sqrt(rows) away at least. The mean over few words strays further:
    for a text of n words, fewer than the language's median, the ends are
    sqrt(median / n) times as far away. A language without such a row has no band
    and rejects by the base rules only. Rows without words have no perplexity;
    an empty table gives an empty result."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measures = {"byte": "n_bytes", "word": "n_words"}
    rows = rows.withColumn("base_failed", failed)
    for m, n in measures.items():
        rows = rows.withColumn(f"_{m}", F.try_divide(F.col("loss"), F.col(n)))
    fair = rows.where("not base_failed")
    middle = fair.groupBy("model").agg(F.count("*").alias("n"), F.percentile_approx("n_words", 0.5, 10000).alias("typical"), *(F.percentile_approx(f"_{m}", 0.5, 10000).alias(f"{m}_mid") for m in measures))
    middle = staged(middle, "medians")
    side = lambda x: F.coalesce(F.percentile_approx(F.when(x >= 0, x), 0.5, 10000), F.lit(0.0))
    far = {m: F.col(f"_{m}") - F.col(f"{m}_mid") for m in measures}
    spread = fair.join(middle, "model").groupBy("model", "n", "typical", *(f"{m}_mid" for m in measures)).agg(*(side(s * far[m]).alias(f"{m}_{e}") for m in measures for e, s in (("lower", -1), ("upper", 1))))
    half = lambda m, e: F.greatest(floor * F.col(f"{m}_mid") / F.sqrt("n"), width * 1.4826 * F.col(f"{m}_{e}"))
    bands = spread.select("model", "typical", *(F.col(f"{m}_mid") for m in measures), *(half(m, e).alias(f"{m}_{e}") for m in measures for e in ("lower", "upper")))
    out = rows.join(staged(bands, "bands"), "model", "left")  # one row a language
    stretch = F.sqrt(F.greatest(F.lit(1.0), F.try_divide(F.col("typical"), F.col("n_words"))))
    far = {m: F.col(f"_{m}") - F.col(f"{m}_mid") for m in measures}
    inside = [F.coalesce((far[m] >= -stretch * F.col(f"{m}_lower")) & (far[m] <= stretch * F.col(f"{m}_upper")), F.lit(True)) for m in measures]
    out = out.withColumn("kept", ~F.col("base_failed") & inside[0] & inside[1])
    out = out.withColumns({f"{m}_{e}": F.exp(F.col(f"{m}_mid") + s * stretch * F.col(f"{m}_{e}")) for m in measures for e, s in (("lower", -1), ("upper", 1))})
    return out.withColumn("perplexity", F.exp("_byte")).withColumn("word_perplexity", F.exp("_word")).drop("_byte", "_word", "typical", *(f"{m}_mid" for m in measures))
