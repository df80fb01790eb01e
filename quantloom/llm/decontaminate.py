"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text is cut into tokens; numbers, names and units among them become typed
placeholders, one for one, so a question keeps its template when its values
change and each placeholder keeps its value beside it. Windows of canonical
tokens are hashed and joined with those of the benchmark; matches on one
diagonal (document place minus item place) are counted, and the values that
stand in the placeholders there must map one to one, as they do in a
re-parameterised question. Items that are too short or hold too few plain words
for a template are matched by their own tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import staged

WINDOW = 8
#: other tokens than placeholders that a window needs to be a template
LEAST_WORDS = 5
#: tokens that an item needs to be told from plain language
SHORTEST = 4
NUMBER, NAME, UNIT = "0number", "0name", "0unit"
# Units of measure, currency and time that follow a number.
UNITS = "km m cm mm mi ft in kg g mg lb oz l ml s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years percent usd eur gbp dollar dollars euro euros pound pounds cent cents mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres foot feet inch inches mph kmh"
#: a number with its separators, a word, another numeral, a sign of a unit, the end of a sentence or line
_TOKEN = r"\d+(?:[.,]\d+)*|[\p{L}\p{M}]+|\p{N}|[%$€£°]|[.!?\n]"
_NAMES = r"(?<=[\p{L}\p{M}\p{N}] )\p{Lu}\p{Ll}[\p{L}\p{M}]*"
_NUMBERS = r"(?<![^ ])\d[\d.,]*(?![^ ])"
_UNITS = rf"(?<={NUMBER} )(?:{'|'.join(sorted(UNITS.split(), key=len, reverse=True))}|[%$€£°])(?![^ ])|[$€£](?= {NUMBER})"
#: signs that belong to no number, and ends of sentences, are no tokens of a window
_NO_TOKEN = tuple("%$€£°.!?\n")


def _cut(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _placeheld(cut: Column) -> Column:
    """Canonical tokens: as many as there are in `cut`, as each replacement takes one token for one."""
    t = F.regexp_replace(F.array_join(cut, " "), _NAMES, NAME)
    t = F.regexp_replace(F.lower(t), _NUMBERS, NUMBER)
    return F.split(F.regexp_replace(t, _UNITS, UNIT), " ")


def tokens(text: Column) -> Column:
    """Canonical tokens of the text."""
    return F.filter(_placeheld(_cut(text)), lambda x: ~x.isin(*_NO_TOKEN) & (x != ""))


def raw_tokens(text: Column) -> Column:
    """Lower-cased tokens of the text itself, one for each canonical token."""
    pairs = F.transform(F.array(_cut(text)), lambda t: F.arrays_zip(_placeheld(t).alias("c"), t.alias("r")))
    kept = F.filter(F.element_at(pairs, 1), lambda x: ~x["c"].isin(*_NO_TOKEN) & (x["c"] != ""))
    return F.transform(kept, lambda x: F.lower(x["r"]))


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """Hash of each run of `size` tokens; none if there are fewer. The tokens are bound to a lambda variable, so they are made once a text;
    tokens are taken one by one, as slice() would copy the whole text for each window."""

    def hashes(w: Column) -> Column:
        last = F.size(w) - size
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(size))))

    return F.element_at(F.transform(F.array(words), hashes), 1)


def _windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of the benchmark: templates (hash, item, item_at), and windows of own tokens (size, hash, item, item_at) of items without a template."""
    words = staged(items.select("item", tokens(F.col("text")).alias("words"), raw_tokens(F.col("text")).alias("raw")), "benchmark-tokens")
    at = words.select("item", "words", F.posexplode(window_hashes(F.col("words"))).alias("item_at", "hash"))
    plain = F.size(F.filter(F.slice("words", F.col("item_at") + 1, WINDOW), lambda x: ~x.isin(NUMBER, NAME, UNIT)))
    templates = staged(at.where(plain >= LEAST_WORDS).select("hash", "item", "item_at"), "benchmark-windows")
    rest = words.where(F.size("raw") >= SHORTEST).join(templates.select("item").distinct(), "item", "left_anti").withColumn("size", F.least(F.size("raw"), F.lit(WINDOW)))
    own = [rest.where(F.col("size") == n).select("size", "item", F.posexplode(window_hashes(F.col("raw"), n)).alias("item_at", "hash")) for n in range(SHORTEST, WINDOW + 1)]
    for x in own[1:]:
        own[0] = own[0].unionByName(x)
    return templates, staged(own[0], "benchmark-own")


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, long_match: int = 13) -> DataFrame:
    """doc_id, key, item_id, n_windows, coverage, n_slots, consistent, template: one row per document and benchmark item found in it.

    An item is found if, on one diagonal, its matched windows are the share
    `coverage` of its windows or span `long_match` tokens. `consistent`: the
    document's values in placeholders map one to one to the item's there;
    without placeholders (`n_slots` = 0) there is nothing to contradict. An item
    of fewer than 8 tokens, or none of whose windows has 5 plain words, is
    matched by its own tokens (`template` is false), values included; one of
    fewer than 4 tokens is no more than plain language and never found. Null
    and empty texts match nothing. A null or repeated document id is kept apart
    by `key`, the hash of the text; null and repeated item ids are items of
    their own if their texts differ. Whole texts of any length are read; empty
    tables give empty results. The benchmark's windows are joined by hash:
    Spark broadcasts them only below its size threshold."""
    items = staged(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"), F.xxhash64("item_id", "text").alias("item")).dropDuplicates(), "items")
    bench, own = _windows(items)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").alias("text"))
    keep = ("doc_id", "key", "item", "item_at", (F.col("doc_at") - F.col("item_at")).alias("shift"))
    hits = src.select("doc_id", "key", F.posexplode(window_hashes(tokens(F.col("text")))).alias("doc_at", "hash")).join(bench, "hash").select(*keep, F.lit(True).alias("template"))
    for (n,) in own.select("size").distinct().collect():  # at most five sizes
        by_own = src.select("doc_id", "key", F.posexplode(window_hashes(raw_tokens(F.col("text")), n)).alias("doc_at", "hash"))
        hits = hits.unionByName(by_own.join(own.where(F.col("size") == n).drop("size"), "hash").select(*keep, F.lit(False).alias("template")))
    sizes = staged(bench.select("item", "item_at").unionByName(own.select("item", "item_at")).groupBy("item").agg(F.countDistinct("item_at").alias("of")), "benchmark-sizes")
    runs = hits.groupBy("doc_id", "key", "item", "template", "shift").agg(F.countDistinct("item_at").alias("n_windows"), F.min("item_at").alias("lo"), F.max("item_at").alias("hi"))
    runs = staged(runs, "runs").join(sizes, "item")
    runs = runs.where((F.col("n_windows") >= coverage * F.col("of")) | (F.col("n_windows") >= long_match - WINDOW + 1))
    runs = staged(runs.withColumn("coverage", F.col("n_windows") / F.col("of")), "found")

    # values in placeholders, of the few documents found
    ids = runs.where("template").select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct()
    texts = src.join(ids, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")
    slots = lambda df, *keep: df.select(*keep, tokens(F.col("text")).alias("c"), raw_tokens(F.col("text")).alias("r"))
    texts = staged(slots(texts, "doc_id", "key").dropDuplicates(["doc_id", "key"]), "found-texts").withColumnsRenamed({"doc_id": "d", "key": "k", "c": "dc", "r": "dr"})
    held = staged(slots(items, "item"), "item-tokens").withColumnsRenamed({"item": "i", "c": "ic", "r": "ir"})
    pairs = runs.join(texts, F.col("template") & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").join(held, F.col("item") == F.col("i"))
    there = F.transform(
        F.filter(F.sequence(F.col("lo"), F.col("hi") + WINDOW - 1), lambda p: F.get("ic", p).isin(NUMBER, NAME, UNIT) & (F.get("ic", p) == F.get("dc", p + F.col("shift")))),
        lambda p: F.struct(F.get("ir", p).alias("item"), F.get("dr", p + F.col("shift")).alias("doc")),
    )
    pairs = pairs.withColumn("slots", F.when(F.col("template"), there).otherwise(F.array().cast("array<struct<item:string,doc:string>>")))
    n = F.size(F.array_distinct("slots"))
    one_to_one = (F.size(F.array_distinct(F.col("slots.item"))) == n) & (F.size(F.array_distinct(F.col("slots.doc"))) == n)
    rows = pairs.select("doc_id", "key", "item", "template", "n_windows", "coverage", F.size("slots").alias("n_slots"), one_to_one.alias("consistent"))
    best = F.max_by(F.struct("n_windows", "coverage", "n_slots", "consistent", "template"), F.struct("consistent", "n_windows", "n_slots"))
    found = rows.groupBy("doc_id", "key", "item").agg(best.alias("b"))
    return found.join(items.select("item", "item_id"), "item").select("doc_id", "key", "item_id", "b.*")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold a benchmark item with consistent slots: doc_id, item_id, n_windows, coverage, n_slots."""
    return matches(docs, benchmark).where("consistent").select("doc_id", "item_id", "n_windows", F.round("coverage", 6).alias("coverage"), "n_slots")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold a benchmark item with consistent slots; all columns stay."""
    bad = staged(matches(docs, benchmark).where("consistent").select(F.col("doc_id").alias("_ql_id"), F.col("key").alias("_ql_key")).distinct(), "contaminated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_ql_id")) & (F.xxhash64("text") == F.col("_ql_key"))
    return docs.join(bad, same, "left_anti")
