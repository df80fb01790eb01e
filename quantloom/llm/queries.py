"""The operators as queries over the whole tables, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filteraudit, licenses, linededup, merkle, minhash, packing, perplexity, sharding, sitetree, surrogates, vectordups, warc

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(_table(spark, sf_dir, "documents"), key=b"rotate this key with every release")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), containment=0.8)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=40)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"), counts=True, whole=True).select("doc_id", "text", "n_chunks_removed", "n_lines_removed")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perplexity.judged(perplexity.measured(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("perplexity", 6).alias("perplexity"), F.round("word_perplexity", 4).alias("word_perplexity"))


def op10_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(_table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter")


def op13_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordups.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc, op2_packing, op3_surrogates, op4_licenses, op5_minhash, op6_sharding, op7_decontamination, op8_line_dedup, op9_quality, op10_site_tree, op11_merkle, op12_filter_audit, op13_vector_dups)
    return {f.__name__: f for f in own}


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {5 * (3 - j)}) & 31), 1)" for k in range(8) for j in range(4)
)

OP1_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h AS oh, max(page_id) AS owner FROM p GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM p JOIN o ON h = oh
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END AS shs FROM w), unnest(shs) AS u(sh)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""


_CRC32 = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)),"
    " lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, e: xor(d >> 1, 3988292384::BIGINT * (d & 1)))), 4294967295::BIGINT)"
)


def _encoded(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_LEVELS = 7  # of the tree that the SQL unrolls: 8**7 documents a language, and as many languages


def _level(i: int, table: str, key: str) -> str:
    """One level of the SQL's tree: siblings of each node from the list of its run, and the level above."""
    return f"""{table}s{i} AS MATERIALIZED (SELECT {key}, pos, total, node, list(node ORDER BY pos) OVER (PARTITION BY {key}, pos // 8) AS run FROM {table}{i}),
{table}{i + 1} AS MATERIALIZED (SELECT {key}, pos // 8 AS pos, (total + 7) // 8 AS total, CASE WHEN total = 1 THEN node ELSE sha256(array_to_string(run, '')) END AS node FROM {table}s{i} WHERE pos % 8 = 0)"""


def _side(alias: str, left: bool) -> str:
    part = f"{alias}.run[1:({alias}.pos % 8)]" if left else f"{alias}.run[({alias}.pos % 8) + 2:]"
    return f"CASE WHEN {alias}.total > 1 THEN array_to_string({part}, '') ELSE '' END"


def _climb(i: int, table: str, key: str, source: str) -> str:
    """The next fold: siblings of level i around what each row has so far."""
    a = f"{table}s{i}"
    return f"""f{table}{i} AS (SELECT f.* EXCLUDE (h, proof), CASE WHEN a.total > 1 THEN sha256({_side("a", True)} || h || {_side("a", False)}) ELSE h END AS h, proof || {_side("a", True)} || {_side("a", False)} AS proof
FROM {source} f JOIN {a} a ON a.{key} = f.{key} AND a.pos = f.{table}pos // {8**i})"""


OP11_SQL = f"""
WITH d AS (SELECT *, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS g, doc_id::VARCHAR AS s FROM documents),
e AS (SELECT doc_id, g, {' || '.join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, text,
  CASE WHEN {_CRC32} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown FROM d),
n0 AS MATERIALIZED (SELECT doc_id, g, sha256(head || {_encoded("text")}) AS node, sha256(head || {_encoded("shown")}) AS bad,
  row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS npos, count(*) OVER (PARTITION BY g) AS total FROM e),
t0 AS (SELECT g, npos AS pos, total, node FROM n0),
{", ".join(_level(i, "t", "g") for i in range(_LEVELS))},
r0 AS MATERIALIZED (SELECT 0 AS one, g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS total, node FROM t{_LEVELS}),
{", ".join(_level(i, "r", "one") for i in range(_LEVELS))},
f AS (SELECT n0.doc_id, n0.g, n0.npos AS tpos, 0 AS one, r0.pos AS rpos, n0.node AS leaf, r0.node AS subroot, r{_LEVELS}.node AS root, n0.bad AS h, '' AS proof FROM n0 JOIN r0 ON r0.g = n0.g JOIN r{_LEVELS} ON true),
{", ".join(_climb(i, "t", "g", "f" if i == 0 else f"ft{i - 1}") for i in range(_LEVELS))},
{", ".join(_climb(i, "r", "one", f"ft{_LEVELS - 1}" if i == 0 else f"fr{i - 1}") for i in range(_LEVELS))}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM fr{_LEVELS - 1}
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
fl AS MATERIALIZED (SELECT doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM d),
m AS (SELECT doc_id, part, [a, b, c, d, e] AS bad, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM fl LEFT JOIN labels USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
p AS (SELECT filter_order, step, list_transform(range(1, 6), lambda i: ascii(filter_order[i]) - 64) AS k FROM g),
q AS (SELECT part, filter_order, step, count(*) FILTER (NOT list_bool_or(list_transform(k[1:step], lambda i: bad[i]))) AS kept,
  count(*) FILTER (bad[k[step]] AND NOT coalesce(list_bool_or(list_transform(k[1:step - 1], lambda i: bad[i])), false)) AS removed,
  count(*) FILTER (bad[k[step]] AND coalesce(list_bool_or(list_transform(k[1:step - 1], lambda i: bad[i])), false)) AS redundant,
  count(*) FILTER (bad[k[step]] AND len(list_filter(bad, lambda x: x)) = 1) AS unique_fails,
  count(*) FILTER (good AND bad[k[step]] AND NOT coalesce(list_bool_or(list_transform(k[1:step - 1], lambda i: bad[i])), false)) AS good_lost,
  count(*) FILTER (toxic AND bad[k[step]] AND NOT coalesce(list_bool_or(list_transform(k[1:step - 1], lambda i: bad[i])), false)) AS toxic_lost
  FROM m, p GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM q
"""

OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_dot_product(p.x, q.x) >= 0.9 * p.size * q.size),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op5_minhash": OP5_SQL, "op11_merkle": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_vector_dups": OP13_SQL}
