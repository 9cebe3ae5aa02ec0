"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketladder.llm import bpe, jaccard, media, merkle, negatives, neighbours, packing, quality, secrets, shards, suffix, tokencounts, toxicity
from marketladder.llm.training import training_rows
from marketladder.session import checkpoint_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


REPEATS = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k,
         lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (
  SELECT r, k, i, substr(h, 2 * i + 1, 100) AS s
  FROM d, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS u(i)),
c AS (SELECT r, i FROM (SELECT r, i, k, min(k) OVER (PARTITION BY s) AS m FROM w) WHERE k > m),
e AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS n FROM e),
p AS (SELECT r, n, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY r, n),
q AS (SELECT r, n, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY n), 0) AS z FROM p),
t AS (
  SELECT q.r, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
         string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY n) AS kept
  FROM q JOIN d USING (r) GROUP BY q.r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""


@query("op2_repeats", REPEATS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix.report(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_media")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_folder(spark).rstrip('/')}/marketladder/media-{uuid.uuid4().hex}"
    media.store_documents(table(spark, sf_dir, "documents"), path)
    return media.read_features(spark, path)


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weight = quality.train(stored(training_rows(docs, table(spark, sf_dir, "labels"), "quality")))
    return quality.score_documents(docs, weight)


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


NEAREST = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op6_neighbours", NEAREST)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"))


@query("op7_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(training_rows(docs, table(spark, sf_dir, "labels"), "toxic"))
    return toxicity.score_documents(docs, lexicon)


SHINGLES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a
  FROM d),
s AS (
  SELECT r, doc_id, CASE WHEN len(a) = 0 THEN [] ELSE list_distinct(list_transform(
           range(1, greatest(len(a) - 3, 1) + 1), lambda i: array_to_string(a[i:i + 3], ' '))) END AS t
  FROM w),
g AS (SELECT r, unnest(t) AS x FROM s),
l AS (SELECT x FROM g GROUP BY x HAVING count(*) > 1),
m AS (SELECT r, x FROM g SEMI JOIN l USING (x)),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM m a JOIN m b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
e AS (
  SELECT p.a, p.b FROM p JOIN s x ON x.r = p.a JOIN s y ON y.r = p.b
  WHERE 100 * p.n >= 85 * (len(x.t) + len(y.t) - p.n)),
f AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (
  WITH RECURSIVE reach(r, z) AS (
    SELECT r, r FROM s UNION SELECT reach.r, f.b FROM reach JOIN f ON f.a = reach.z)
  SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN s o ON o.r = reach.z GROUP BY reach.r)
SELECT s.doc_id, CAST(len(s.t) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c USING (r)
"""


@query("op10_jaccard", SHINGLES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


HARD_NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
a AS (SELECT row_number() OVER () AS r, * FROM v WHERE vec_id % 50 = 0),
p AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
    coalesce(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])), 0)::BIGINT AS score
  FROM a JOIN v c ON a.vec_id IS DISTINCT FROM c.vec_id AND len(a.e) = len(c.e)),
b AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS place, vec_id AS positive_id, score AS positive_score
  FROM p WHERE same),
n AS (
  SELECT p.anchor_id, b.positive_id, row_number() OVER (PARTITION BY p.r, b.place ORDER BY p.score DESC, p.vec_id NULLS LAST) AS rank,
    p.vec_id AS negative_id, b.positive_score, p.score AS negative_score
  FROM b JOIN p USING (r) WHERE b.place <= 5 AND NOT p.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op11_negatives", HARD_NEGATIVES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull() & negatives.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), negatives.quantised(F.col("embedding")).alias("vector"))
    return negatives.mine(rows, F.col("id") % 50 == 0)


@query("op12_tokens")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokencounts.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), vocabulary, tokencounts.new_cache(spark))


TREE_LEVELS = 6  # levels of 16 that the SQL unrolls; enough for 16 million leaves a source


def _tree_sql(name: str, nodes: str) -> str:
    """Levels of a forest of ``nodes`` (grp, pos, h): the runs of each level, and the roots in the last."""
    parts = [f"{name}0 AS (SELECT grp, pos, h, count(*) OVER (PARTITION BY grp) AS n FROM {nodes})"]
    for k in range(TREE_LEVELS):
        parts.append(f"{name}r{k} AS (SELECT grp, pos // 16 AS pos, any_value(n) AS n, list(h ORDER BY pos) AS l FROM {name}{k} GROUP BY grp, pos // 16)")
        parts.append(
            f"{name}{k + 1} AS (SELECT grp, pos, CASE WHEN n > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS h, "
            f"CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n FROM {name}r{k})"
        )
    return ",\n".join(parts)


def _climb_sql(name: str, start: str, leaves: str) -> str:
    """Proof text and folded node of every leaf of ``leaves`` (r, grp, pos, proof, f), level by level."""
    parts, last = [], leaves
    for k in range(TREE_LEVELS):
        at = f"((c.pos // {16**k}) % 16)"
        left, right = f"array_to_string(l[1:{at}], '')", f"array_to_string(l[{at} + 2:], '')"
        parts.append(
            f"{name}{k} AS (SELECT c.r, c.grp, c.pos, CASE WHEN n > 1 THEN c.proof || {left} || {right} ELSE c.proof END AS proof, "
            f"CASE WHEN n > 1 THEN sha256({left} || c.f || {right}) ELSE c.f END AS f "
            f"FROM {last} c JOIN {start}r{k} t ON t.grp = c.grp AND t.pos = c.pos // {16 ** (k + 1)})"
        )
        last = f"{name}{k}"
    return ",\n".join(parts)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
MANIFEST = f"""
WITH crc AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS b))),
d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_FIELDS} AS head, text,
    doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(crc.t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 5 = 0 AS hit FROM documents, crc),
e AS (
  SELECT r, doc_id, source, sha256(head || {_FIELD.format('text')}) AS leaf,
    sha256(head || CASE WHEN hit THEN {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
      ELSE {_FIELD.format('text')} END) AS claimed FROM d),
o AS (
  SELECT r, doc_id, leaf, claimed, dense_rank() OVER (ORDER BY source COLLATE C NULLS FIRST) - 1 AS grp,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS pos FROM e),
ol AS (SELECT grp, pos, leaf AS h FROM o),
{_tree_sql('s', 'ol')},
sub AS (SELECT 0 AS grp, grp AS pos, h FROM s{TREE_LEVELS}),
{_tree_sql('t', 'sub')},
begin AS (SELECT r, grp, pos, '' AS proof, claimed AS f FROM o),
{_climb_sql('u', 's', 'begin')},
between AS (SELECT r, 0 AS grp, grp AS pos, proof, f FROM u{TREE_LEVELS - 1}),
{_climb_sql('v', 't', 'between')}
SELECT o.doc_id, o.leaf, sub.h AS subroot, t{TREE_LEVELS}.h AS root, sha256(v.proof) AS proof_sha256, v.f AS folded_root, v.f = t{TREE_LEVELS}.h AS verified
FROM o JOIN v{TREE_LEVELS - 1} v USING (r) JOIN sub ON sub.pos = o.grp CROSS JOIN t{TREE_LEVELS}
"""


def signed(docs: DataFrame) -> DataFrame:
    """The manifest of documents, a fifth of them tampered with: A-Z of the text in lower case."""
    text, number = F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    claimed = F.when(F.pmod(number, F.lit(5)) == 0, merkle.lowered(text)).otherwise(text)
    return merkle.manifest(docs, claimed).withColumnRenamed("proof", "proof_sha256")


@query("op13_merkle", MANIFEST)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed(table(spark, sf_dir, "documents"))
