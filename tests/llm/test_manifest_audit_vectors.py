"""The Merkle manifest, the filter audit and the vector near-duplicates against brute force, also on odd rows."""

import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from quantloom.llm import filteraudit, merkle, queries, vectordups

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, g string, pos long, total long, part string, id long, row long"
ODD = [
    (1, None, None, "s", 0), (2, "", "en", None, 0), (3, " \n\t ", "en", "s", 4), (4, "one TWO", "en", "s", 7), (4, "one TWO", "en", "s", 7), (4, "other", "en", "s", 5),
    (None, "LOST id", "en", "s", 28), (None, "LOST id", "en", "s", 28), (5, "Ünï CODE ΩΩ ﬁ $", "-", None, None), (6, "Word " * 5000, "", "s", 25000), (7, "a b\x1cc D e", "=en", "s", 9),
    (8, "one TWO", "fr", "s", 7), (9, None, "fr", "s", 7), (10, "x y " * 80, "zz", "s", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "n", "g", 1, 1, "p", 3, 4) for r in ODD], DOCS)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes, fan):
    return [h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]


def tree(nodes, fan):
    """The levels of a tree, and per leaf its (left, right) siblings at each level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1], fan))
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = i // fan * fan
            path.append((level[run:i], level[i + 1 : run + fan]))
            i //= fan
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows, fan):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        head = [enc(doc_id), enc(source), enc(lang), enc(n_chars)]
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(b"-" if lang is None else b"=" + lang.encode(), []).append((doc_id, h(*head, enc(text)), h(*head, enc(low if hit else text))))
    names = sorted(groups)
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = tree([r[1] for r in groups[g]], fan)
    root, tops = tree([trees[g][0] for g in names], fan) if names else (None, [])
    out = []
    for g, top in zip(names, tops):
        for (doc_id, leaf, shown), path in zip(groups[g], trees[g][1]):
            whole = path + top
            node = shown
            for left, right in whole:
                node = h(*left, node, *right)
            out.append((doc_id, leaf, trees[g][0], root, h(*(x for left, right in whole for x in left + right)), node, node == root))
    return out


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("fan", [2, 8])
def test_manifest_equals_brute_force(spark, odd, fan, monkeypatch):
    monkeypatch.setattr(merkle, "RUNS", 3)  # so that a level spans several windows
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    every = docs.union(odd.select(*docs.columns))
    got = listed(merkle.manifest(every, fan=fan))
    assert got == sorted(brute_manifest([tuple(r) for r in every.collect()], fan), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_tables(spark, odd):
    assert listed(merkle.manifest(odd)) == sorted(brute_manifest(ODD, 8), key=str)
    one = merkle.manifest(odd.where("doc_id = 9")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h()
    empty = merkle.manifest(odd.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_is_the_same_on_any_partitioning(spark, odd):
    one, many = merkle.manifest(odd.coalesce(1)), merkle.manifest(odd.repartition(7))
    assert listed(one) == listed(many)


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    docs = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": bool(set(t) & set("#$%&*|")), "E": doc_id is not None and doc_id > least[t],
        }
        docs.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                f, before = order[step - 1], set(order[: step - 1])
                gone = [d for d in mine if f in d[1] and not d[1] & before]
                total[f] += len(gone)
                out[part, order, step] = [
                    sum(not d[1] & (before | {f}) for d in mine), len(gone), sum(f in d[1] and bool(d[1] & before) for d in mine), sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_brute_force_on_odd_rows(spark, odd):
    labels = [(1, 1, 0), (4, 0, 1), (4, 1, None), (6, None, 1), (None, 1, 1), (8, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audited(filteraudit.audit(odd, table))
    assert got == brute_audit(ODD, labels) and len(got) == 600 * len({r[2] or "" for r in ODD})
    no_labels = audited(filteraudit.audit(odd.where("doc_id = 10"), table.limit(0)))
    assert no_labels == brute_audit([r for r in ODD if r[0] == 10], [])
    assert filteraudit.audit(odd.limit(0), table).count() == 0


def brute_links(rows, cosine=0.9):
    """n_links and component per row of (id, vector)."""
    usable = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(usable, 2):
        x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
        if len(x) == len(y):
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y >= cosine * math.sqrt(x @ x) * math.sqrt(y @ y):
                near[i].add(j), near[j].add(i)
    out = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        low = min((rows[j][0] for j in seen), default=None) if k is not None else None
        out.append((k, len(near[i]), low, k is None or k == low))
    return sorted(out, key=str)


def clustered(rng, sizes, dim=24, spread=0.05):
    rows = []
    for n in sizes:
        centre = rng.normal(size=dim)
        for _ in range(n):
            rows.append((centre + spread * rng.normal(size=dim) * np.linalg.norm(centre) / math.sqrt(dim) * rng.choice([1, 4, 8])).astype(np.float32).tolist())
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [8, 512])
def test_vectors_equal_brute_force_with_large_buckets(spark, block):
    rng = np.random.default_rng(5)
    rows = clustered(rng, [60, 40, 25, 3, 2] + [1] * 60)
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in vectordups.near_duplicate_vectors(df, block=block, company=64, miss=1e-9).collect()), key=str)
    assert got == brute_links(rows)


def test_vectors_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.1]), (9, [0.0, 5.0]), (10, [0.0, 5.0]), (7, [1.0, 0.0]),
        (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1e300, 0.0]), (13, [1e-300, 0.0]), (14, [-1.0, 0.0]), (15, [0.9, math.sqrt(1 - 0.81)]),
    ]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "vec_id long, embedding array<double>, id string, n int, rep string")
    got = sorted((tuple(r) for r in vectordups.near_duplicate_vectors(df, cosine=0.89, miss=1e-9).collect()), key=str)
    want = brute_links(rows, 0.89)
    assert [r for r in got if r[0] != 9] == [r for r in want if r[0] != 9]  # a repeated id reports the smallest id of its own row's class
    empty = vectordups.near_duplicate_vectors(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_tables_bound_the_miss_probability():
    for n in (100, 10_000, 10_000_000):
        k, tables = vectordups.tables_for(n, 0.9, 0.001, 128)
        near = vectordups.meets(math.sqrt(0.2), 4.0)
        assert (1 - near**k) ** tables <= 0.001
    rng = np.random.default_rng(1)
    x, shift = rng.normal(size=200_000), rng.random(200_000)
    for d in (0.3, 1.4):
        seen = (np.floor(shift) == np.floor(shift + d * x / 4.0)).mean()
        assert abs(seen - vectordups.meets(d, 4.0)) < 0.01


@pytest.mark.parametrize("name", ["op11_merkle", "op12_filter_audit", "op13_vector_dups"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DATA).toPandas()[list(want.columns)]
    order = list(want.columns)[:3]
    assert got.astype(str).sort_values(order).values.tolist() == want.astype(str).sort_values(order).values.tolist()
