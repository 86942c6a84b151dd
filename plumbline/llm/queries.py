"""One query per operator over the whole of its table, under the names ``op<N>_<operator>``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, katz, language, lines, merkle, mixing, neardup, quality, rules, secrets, sharding, tokens, whitening
from plumbline.llm.common import fold, stored

SHARDS = 40

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sharding.shard_documents(documents(spark, sf_dir), SHARDS, keep=["doc_id"]))
    return sharding.number_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir), keep=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@query
def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 4) == 2)
    model = language.fit(docs.where(~F.col("held_out")))
    return language.predict(docs, model, keep=["doc_id", "held_out"])


@query
def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 5) == 0)
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return quality.score(docs, model, keep=["doc_id", "held_out"])


@query
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated(documents(spark, sf_dir), keep=["doc_id"])


ORACLES["op5_lines"] = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM split),
worded AS (SELECT * FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
win AS (SELECT * FROM (SELECT doc_id, i AS a, lead(i, 2) OVER d AS z, l AS l1, lead(l) OVER d AS l2, lead(l, 2) OVER d AS l3
  FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY i)) WHERE z IS NOT NULL),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, a) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM later),
cleaned AS (SELECT doc_id, count(gone.i) AS n_removed, string_agg(l, chr(10) ORDER BY i) FILTER (WHERE gone.i IS NULL) AS text
  FROM line LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ls), 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed,
  CASE WHEN split.text IS NOT NULL THEN coalesce(cleaned.text, '') END AS text
FROM split LEFT JOIN cleaned USING (doc_id)"""


@query
def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep=["doc_id"], short=True)
    return found.select("doc_id", F.inline("leaks"))


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(documents(spark, sf_dir), keep=["doc_id"]).select("doc_id", "class_id")


@query
def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 7) == 2)
    return katz.score(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])


@query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir), keep=["doc_id"])
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != secrets.MODEL)
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_SIZED = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_SIZED.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
ORACLES["op13_manifest"] = f"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
crcs AS (SELECT doc_id, list_reduce([4294967295] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table),
hashed AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({_HEAD} || {_SIZED.format('text')}) AS leaf,
  CASE WHEN xor(c, 4294967295) % 3 = 0 THEN sha256({_HEAD} || {_SIZED.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed
  FROM documents LEFT JOIN crcs USING (doc_id)),
d AS (SELECT doc_id, tree, leaf, coalesce(changed, leaf) AS shown, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
nodes AS (SELECT tree, 0 AS level, slot, leaf AS digest, n FROM d
  UNION ALL SELECT tree, level + 1, slot // 8, sha256(string_agg(digest, '' ORDER BY slot)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, slot // 8, n),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS slot, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, slot, digest, n FROM subroots
  UNION ALL SELECT level + 1, slot // 8, sha256(string_agg(digest, '' ORDER BY slot)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, slot // 8, n),
near AS (SELECT d.tree, d.slot, 0 AS part, a.level, a.slot AS pos, d.slot >> (3 * a.level) AS own, a.digest FROM d JOIN nodes a ON a.tree = d.tree AND a.n > 1 AND (a.slot >> 3) = (d.slot >> (3 * a.level + 3))
  UNION ALL SELECT d.tree, d.slot, 1, a.level, a.slot, s.slot >> (3 * a.level), a.digest FROM d JOIN subroots s USING (tree) JOIN tops a ON a.n > 1 AND (a.slot >> 3) = (s.slot >> (3 * a.level + 3))),
steps AS (SELECT tree, slot, part, level, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < own), '') AS l, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > own), '') AS r FROM near GROUP BY ALL),
paths AS (SELECT tree, slot, string_agg(l || r, '' ORDER BY part, level) AS siblings, list(l || '|' || r ORDER BY part, level) AS sides FROM steps GROUP BY 1, 2),
folded AS (SELECT d.*, sha256(coalesce(siblings, '')) AS proof_sha256, list_reduce([shown] || coalesce(sides, []), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM d LEFT JOIN paths USING (tree, slot))
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, proof_sha256, folded_root, folded_root = t.digest AS verified
FROM folded JOIN subroots s USING (tree), tops t WHERE t.n = 1"""
