"""The thin queries opN_* over the tables documents, labels and benchmark, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(remainder("doc_id", 4) != 2))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return toxicity.score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repetition

    return repetition.rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


SQL["op5_repetition"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, i AS p, length(w[i]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
gram AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([5, 6, 7, 8, 10]) AS n) WHERE len(w) >= n)
), twice AS (SELECT doc_id, n, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, n, s) > 1),
cover AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS p FROM twice),
share AS (
  SELECT doc_id, count(*) FILTER (n = 5) AS words_5, sum(c) FILTER (n = 5) AS c5, sum(c) FILTER (n = 6) AS c6, sum(c) FILTER (n = 7) AS c7, sum(c) FILTER (n = 8) AS c8, sum(c) FILTER (n = 10) AS c10
  FROM cover JOIN word USING (doc_id, p) GROUP BY doc_id
), line AS (SELECT doc_id, j, l[j] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM d)) WHERE regexp_matches(l[j], '[^\x20\x09-\x0D]')),
again AS (SELECT doc_id, s FROM line QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY j) > 1),
dup AS (SELECT doc_id, count(*) AS lines, sum(length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g'))) AS c FROM again GROUP BY doc_id),
total AS (SELECT doc_id, sum(c) AS c FROM word GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(total.c, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(lines, 0) AS n_dup_lines, coalesce(words_5, 0) AS n_repeat_words,
    len(w) < 10 OR 100 * coalesce(words_5, 0) > 20 * len(w) AS base_failed, CAST(coalesce(dup.c, 0) AS DOUBLE) / greatest(coalesce(total.c, 0), 1) AS dup_line_share,
    CAST(coalesce(c5, 0) AS DOUBLE) / greatest(coalesce(total.c, 0), 1) AS share_5, CAST(coalesce(c6, 0) AS DOUBLE) / greatest(coalesce(total.c, 0), 1) AS share_6, CAST(coalesce(c7, 0) AS DOUBLE) / greatest(coalesce(total.c, 0), 1) AS share_7,
    CAST(coalesce(c8, 0) AS DOUBLE) / greatest(coalesce(total.c, 0), 1) AS share_8, CAST(coalesce(c10, 0) AS DOUBLE) / greatest(coalesce(total.c, 0), 1) AS share_10
  FROM d LEFT JOIN share USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN total USING (doc_id)
)
SELECT *, NOT base_failed AND dup_line_share <= 0.30 AND share_5 <= 0.25 AND share_6 <= 0.24 AND share_7 <= 0.23 AND share_8 <= 0.22 AND share_10 <= 0.21 AS kept FROM m
"""


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    from .common import checkpointed

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = checkpointed(quality.with_statistics(docs).drop("text"))
    model = quality.fit(rows, table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    return quality.score(rows, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontam.measure(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), decontam.is_contaminated(5).alias("contaminated"))


SQL["op3_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), 13) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  ) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM item)
), gram AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM item) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, gram.n AS n, i FROM gram JOIN win USING (n, s)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    got = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, distance=3)
    return got.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    got = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pst

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trained = remainder("doc_id", 7) != 2
    model, words = pst.fit(docs.where(trained))
    return pst.score(docs, model, words, trained=trained).withColumn("held_out", remainder("doc_id", 7) == 2)


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    got = suffix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op9_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
win AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
later AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
fresh AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS f FROM later),
run AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM fresh) GROUP BY doc_id, r),
piece AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM run UNION ALL SELECT doc_id, coalesce(e, 0), n FROM d LEFT JOIN (SELECT doc_id, max(b) AS e FROM run GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import radix_dedup

    return radix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL["op13_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import centroids

    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=16, rounds=3, dims=64, scale=64, seed=1)


def _assigned(k: int) -> str:
    """Step k of the clustering in SQL: the nearest centroid of each vector, and the centroids after it."""
    return f"""
near{k} AS (
  SELECT r, cluster, distance FROM (SELECT r, cluster, CAST(sum((v - c) * (v - c)) AS BIGINT) AS distance FROM part JOIN cent{k} USING (pos) GROUP BY r, cluster)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1
), mean{k} AS (SELECT cluster, pos, sum(v) AS s, count(*) AS n FROM part JOIN near{k} USING (r) GROUP BY cluster, pos),
cent{k + 1} AS (SELECT cluster, pos, CAST(CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS c FROM cent{k} LEFT JOIN mean{k} USING (cluster, pos))"""


SQL["op11_centroids"] = f"""
WITH vec AS (
  SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), part AS (SELECT r, pos, CAST(floor(64 * CAST(e[pos] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT r, e, unnest(range(1, 65)) AS pos FROM vec)),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster FROM vec QUALIFY cluster < 16),
cent0 AS (SELECT cluster, pos, v AS c FROM first JOIN part USING (r)),{",".join(_assigned(k) for k in range(4))},
sha AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM cent3 GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near3 JOIN vec USING (r) JOIN sha USING (cluster)
"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = periodic.find(docs, least=24, exponent=3, rearrange=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    return got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
