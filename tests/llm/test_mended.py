"""What operators did wrong before: mentions of names in other forms, very long lines, maps with other numbers of shards."""

import collections
import random
import time

import pytest

from quantloom.llm import licenses, linededup, packing, sharding, storage, surrogates
from quantloom.llm.queries import tokenizer_path
from quantloom.llm.storage import fresh_path


def test_names_in_other_forms_are_one_entity(spark):
    text = "Mr Smith's car broke. Smith drove home, and SMITH paid; a smith forged it. Dr. Anna Weber’s note: WEBER, Anna."
    parts = surrogates.detect(text)
    found = [(text[p.start : p.end], p.canonical) for p in parts]
    assert found == [("Smith", "smith"), ("Smith", "smith"), ("SMITH", "smith"), ("Anna", "anna"), ("Weber", "weber"), ("WEBER", "weber"), ("Anna", "anna")]
    out = surrogates.pseudonymised(spark.createDataFrame([(1, text)], "doc_id long, text string"), key=b"k").first().text
    assert "Smith" not in out and "SMITH" not in out and "Weber" not in out and "a smith forged" in out
    new = out.split("Mr ")[1].split("'s car")[0]
    assert f"broke. {new} drove home, and {new.upper()} paid" in out


def slow_in_order(words, notice, need):
    for first in range(len(words)):
        best = [0] * (len(notice) + 1)
        for w in words[first : first + 2 * len(notice)]:
            best, was = best[:], best
            for j, v in enumerate(notice, 1):
                best[j] = was[j - 1] + 1 if w == v else max(was[j], best[j - 1])
        if best[-1] >= need:
            return True
    return False


def test_order_of_words_equals_the_plain_search():
    rng = random.Random(2)
    for _ in range(400):
        notice = [rng.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(rng.randrange(2, 7))]
        words = [rng.choice([b"a", b"b", b"c", b"d", b"e", b"x", b"y", b"z"]) for _ in range(rng.randrange(0, 40))]
        need = rng.randrange(1, len(notice) + 1)
        # a run begins with a word of the notice; an earlier beginning holds nothing more
        assert licenses.in_order(words, notice, need) == slow_in_order(words, notice, need)


def test_a_very_long_line_of_license_words_is_read_in_seconds():
    notice = licenses.words_of(max((t for _, _, t in licenses.TEMPLATES.values()), key=len).encode()).split()
    words = [random.Random(5).choice(notice) for _ in range(1)] + [w for w in reversed(notice)] * (180_000 // len(notice))
    began = time.time()
    assert not licenses.in_order(words, notice, len(notice))
    assert time.time() - began < 30


def test_maps_shrink_and_keep_their_slots(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(400)], "doc_id long, text string")
    path = fresh_path(spark, "map")
    before = {r.doc_id: r.shard for r in sharding.shard(docs, shards=4, slots=64, map_path=path).collect()}
    after = {r.doc_id: r.shard for r in sharding.shard(docs, shards=3, slots=64, map_path=path).collect()}
    assert set(before.values()) == {0, 1, 2, 3} and set(after.values()) == {0, 1, 2}
    stay = sharding.shrunk_map([0, 1, 2, 3, 3, 2, 1, 0], 3)
    assert stay == [0, 1, 2, 0, 1, 2, 1, 0]
    with pytest.raises(ValueError, match="64 slots"):
        sharding.shard(docs, shards=3, slots=128, map_path=path)


def test_ids_of_runs_equal_the_tokenizer():
    ids = packing._Ids(tokenizer_path())
    plain = lambda t: ids.encode(t.decode("utf-8", "replace"))
    rng = random.Random(3)
    alphabet = "abcXYZ éÉñß×÷.,!?&%$#*|<>'\"-_/\\()[]{}09 \n\t\x0b\x1c ’…́ΩДж中«¿ﬁİ😀"
    texts = []
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25)))
        texts.append((t[:5] + "<|endoftext|>" + t[5:] if rng.random() < 0.05 else t).encode())
    assert ids.texts(texts) == [plain(t) for t in texts]
    assert ids.texts([]) == [] and ids.text(b"") == b"" and ids.texts([b" ", b"\n"]) == [b"", b""]


def test_long_texts_and_a_full_cache_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "RUN", 100)
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    ids = packing._Ids(tokenizer_path())
    text = b" ".join(f"word{i % 37} Foo's &&& bar{i}%%".encode() for i in range(300))
    assert ids.text(text) == ids.encode(text.decode()) and len(ids) < 200


def _pairs_alone(rows):
    """Plain rule of whole passages: each two lines that stood before go, without chunks."""
    first, out = {}, {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for at, (_, t) in enumerate(texts):
        lines, both = linededup.pairs(t)
        for k, (a, b) in enumerate(both):
            first.setdefault(b"\n".join(lines[a : b + 1]), (at, k))
    for at, (d, t) in enumerate(texts):
        lines, both = linededup.pairs(t)
        gone = set()
        for k, (a, b) in enumerate(both):
            if first[b"\n".join(lines[a : b + 1])] not in ((at, k), (at, k - 1)):
                gone |= set(range(a, b + 1))
        out[d] = b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode()
    return out


def test_line_dedup_finds_passages_by_chunks_and_looks_up_only_the_rest_by_pairs(spark):
    rnd = random.Random(8)
    blocks = [[rnd.choice(["", "  ", f"line {rnd.randint(0, 30)}", f"other {rnd.randint(0, 400)}"]) for _ in range(rnd.randint(1, 14))] for _ in range(12)]
    rows = [(i, "\n".join(x for _ in range(rnd.randint(0, 5)) for x in (rnd.choice(blocks) if rnd.random() < 0.6 else [rnd.choice(["a", "a", "b", "", f"own {i}"])] * rnd.randint(1, 3)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(df, whole=True).collect()} == _pairs_alone(rows)
    passage = "\n".join(f"line {i} of one passage" for i in range(40))
    src = spark.createDataFrame([(i, i, f"before {i}\n{passage}\nafter {i}") for i in range(3)], "id long, key long, text string")
    with storage.scratch(spark):
        cuts = {r._ql_id: collections.Counter(x.kind for x in r._ql_drop) for r in linededup._repeats(src, True).collect()}
    inner = linededup.chunks(passage.encode())
    assert set(cuts) == {1, 2} and all(c[linededup.CHUNK] >= sum(map(linededup._multi, inner[1:-1])) > 3 and 0 < c[linededup.PAIR] < 39 for c in cuts.values())
