"""Queries of the text, style and detector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import HAN, TERMINATORS, UNIT, WS, han, keep_lines, redact, repeated_ratio, squeeze, sufficient, units
from ..functions.text import redact_paths as paths_masked
from ..functions.typed import spread
from ..operators import detector, style
from .views import ZH_SQL, documents, table, zh_corpus

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def counted(text: str, rx: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(rx)}))"


SQUEEZE = lambda t: f"trim(regexp_replace(coalesce({t}, ''), {quoted(f'[{WS}]+')}, ' ', 'g'))"
KEEP = lambda t: f"regexp_replace(regexp_replace(regexp_replace(coalesce({t}, ''), '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\x0b]+', ' ', 'g'), {quoted(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"
FOLD = lambda t: f"replace(lower({t}), 'ß', 'ss')"
UNITS = lambda t: f"regexp_extract_all({FOLD(t)}, {quoted(UNIT)})"
GRAMS = lambda u: f"list_transform(range(1, len({u}) - 2), lambda i: array_to_string({u}[i : i + 3], chr(1)))"
REPEATED = f"CASE WHEN len(u) < 4 THEN 0.0 ELSE 1 - len(list_distinct({GRAMS('u')})) / len({GRAMS('u')}) END"
SENTENCES = f"list_filter(list_transform(regexp_extract_all({KEEP('text')}, {quoted(f'[^{TERMINATORS}' + chr(92) + f'n]+(?:[{TERMINATORS}]+|$)')}), lambda s: {SQUEEZE('s')}), lambda s: s <> '')"


@query(f"""
WITH t AS (SELECT doc_id, {SQUEEZE('text')} AS s, {UNITS(KEEP('text'))} AS u FROM documents)
SELECT doc_id, length(s) AS chars, CAST({counted('s', HAN)} AS BIGINT) AS han, CAST(len(u) AS BIGINT) AS n_units, round({REPEATED}, 6) AS repeated_4 FROM t
""")
def text_features(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text").select("doc_id", squeeze("text").alias("s"), units(keep_lines("text")).alias("u"))
    return d.select("doc_id", F.length("s").cast("long").alias("chars"), han("s").cast("long").alias("han"), F.size("u").cast("long").alias("n_units"), F.round(repeated_ratio(F.col("u")), 6).alias("repeated_4"))


@query(f"""
WITH t AS (SELECT doc_id, lang AS language, {SQUEEZE('text')} AS s FROM documents UNION ALL SELECT doc_id + 1000000000, language, {SQUEEZE('text')} FROM zh), n AS (SELECT doc_id, language, s, {counted('s', HAN)} AS h FROM t)
SELECT doc_id, language, CASE WHEN language = 'zh' THEN h >= 500 ELSE length(s) >= 1000 END AS sufficient FROM n
""".replace("WITH t", f"WITH {ZH_SQL}, t"))
def text_sufficiency(spark, sf_dir):
    a = documents(spark, sf_dir, "doc_id", F.col("lang").alias("language"), "text")
    b = zh_corpus(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + 1000000000)
    return a.unionByName(b).select("doc_id", "language", sufficient(squeeze("text"), "language").alias("sufficient"))


@query(f"""
WITH {ZH_SQL}, t AS (SELECT doc_id, {KEEP('text')} AS k, language FROM zh), n AS (SELECT *, CAST({counted('k', HAN)} AS BIGINT) AS han FROM t)
SELECT doc_id, han, length(regexp_replace(k, {quoted(f'[{WS}]+')}, '', 'g')) AS chars, CASE WHEN k <> '' AND language <> 'zh' THEN 'unsupported' WHEN han >= 500 THEN 'full' WHEN han >= CASE WHEN language = 'zh' THEN 200 ELSE 400 END THEN 'limited' ELSE 'insufficient' END AS coverage FROM n
""")
def detector_coverage_level(spark, sf_dir):
    return detector.coverage(zh_corpus(spark, sf_dir)).select("doc_id", "han", "chars", "coverage")


@query(f"""
WITH {ZH_SQL}, s AS (SELECT doc_id, {SENTENCES} AS s FROM (SELECT doc_id, text FROM zh UNION ALL SELECT conv_id * 100 + turn + 2000000000, text FROM conversations))
SELECT doc_id, i AS sentence_index, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)
""")
def sentence_split(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn") + 2000000000).alias("doc_id"), "text")
    return detector.sentence_rows(zh_corpus(spark, sf_dir).select("doc_id", "text").unionByName(talk))


@query(f"SELECT unit, n FROM (SELECT unit, count(*) AS n FROM (SELECT unnest({UNITS(KEEP('text'))}) AS unit FROM documents) GROUP BY unit) ORDER BY n DESC, unit LIMIT 500")
def unit_frequency_topk(spark, sf_dir):
    return documents(spark, sf_dir, "text").select(F.explode(units(keep_lines("text"))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit").limit(500)


_COUNTS = f"c AS (SELECT doc_id, unit, count(*) AS n FROM (SELECT doc_id, unnest({UNITS(KEEP('text'))}) AS unit FROM @TABLE) GROUP BY doc_id, unit)"


@query(f"""
WITH {_COUNTS.replace('@TABLE', 'documents')}, t AS (SELECT doc_id, sum(n) AS n_units, count(*) AS d, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY doc_id)
SELECT doc_id, CAST(n_units AS BIGINT) AS n_units, d AS n_distinct, round(CASE WHEN d < 2 THEN 0.0 ELSE h / log2(d) END, 6) AS entropy FROM t
""")
def unit_entropy(spark, sf_dir):
    return detector.unit_statistics(documents(spark, sf_dir, "doc_id", "text")).withColumn("entropy", F.round("entropy", 6))


_SENTENCE_ROWS = f"""{_COUNTS.replace('@TABLE', 'zh')}, total AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
r AS (SELECT doc_id, i AS sentence_index, s[i] AS sentence, {UNITS('s[i]')} AS u FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENTENCES} AS s FROM zh))),
b AS (SELECT doc_id, sentence_index, avg(-log2(n / total)) AS surprisal FROM (SELECT doc_id, sentence_index, unnest(u) AS unit FROM r) JOIN c USING (doc_id, unit) JOIN total USING (doc_id) GROUP BY doc_id, sentence_index),
q AS (SELECT r.doc_id, r.sentence_index, sentence, CAST(len(u) AS BIGINT) AS n_units, array_to_string(u[1:2], '') AS opener, coalesce(surprisal, 0.0) AS surprisal FROM r LEFT JOIN b USING (doc_id, sentence_index))"""


@query(f"WITH {ZH_SQL}, {_SENTENCE_ROWS} SELECT doc_id, sentence_index, n_units, opener, round(surprisal, 6) AS surprisal FROM q")
def self_surprisal(spark, sf_dir):
    return detector.sentence_findings(zh_corpus(spark, sf_dir)).select("doc_id", "sentence_index", "n_units", "opener", F.round("surprisal", 6).alias("surprisal"))


_STATS = """m AS (SELECT doc_id, count(*) AS sentence_count, avg(CASE WHEN n_units > 0 THEN n_units END) AS mean_length, median(CASE WHEN n_units > 0 THEN CAST(n_units AS DOUBLE) END) AS median_length,
  CASE WHEN count(CASE WHEN n_units > 0 THEN 1 END) < 2 THEN 0.0 ELSE coalesce(stddev_pop(CASE WHEN n_units > 0 THEN n_units END) / avg(CASE WHEN n_units > 0 THEN n_units END), 0.0) END AS length_cv,
  avg(surprisal) AS surprisal_mean, CASE WHEN count(*) < 2 OR avg(surprisal) = 0 THEN 0.0 ELSE stddev_pop(surprisal) / avg(surprisal) END AS surprisal_cv FROM q GROUP BY doc_id),
o AS (SELECT doc_id, sum(n) AS reused FROM (SELECT doc_id, opener, count(*) AS n FROM q WHERE opener <> '' GROUP BY doc_id, opener) WHERE n > 1 GROUP BY doc_id)"""


@query(f"""
WITH {ZH_SQL}, {_SENTENCE_ROWS}, {_STATS}
SELECT doc_id, sentence_count, round(coalesce(mean_length, 0), 6) AS mean_length, coalesce(median_length, 0) AS median_length, round(length_cv, 6) AS length_cv, round(surprisal_mean, 6) AS surprisal_mean, round(surprisal_cv, 6) AS surprisal_cv, round(coalesce(reused, 0) / sentence_count, 6) AS opener_reuse
FROM m LEFT JOIN o USING (doc_id)
""")
def sentence_statistics(spark, sf_dir):
    s = detector.sentence_statistics(zh_corpus(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("doc_id", "sentence_count", r("mean_length"), "median_length", r("length_cv"), r("surprisal_mean"), r("surprisal_cv"), r("opener_reuse"))


@query()
def compression_ratio(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.round(detector.compression_ratio(keep_lines("text")), 6).alias("compression"))


_FAMILIES = [(f.id, f.category, 1, counted("s", f.rx)) for f in P.STYLE] + [(f.id, f.category, f.least, " + ".join(counted("s", rx) for rx in f.rxs)) for f in P.STRUCTURAL]
_FOUND = "f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{i}' AS pattern_id, '{cat}' AS category, CAST({n} AS BIGINT) AS n, {least} AS least FROM z" for i, cat, least, n in _FAMILIES) + "), g AS (SELECT * FROM f WHERE n >= least)"
_Z = f"z AS (SELECT doc_id, {SQUEEZE('text')} AS s FROM zh WHERE language = 'zh' AND {SQUEEZE('text')} <> '')"


@query(f"WITH {ZH_SQL}, {_Z}, {_FOUND} SELECT doc_id, pattern_id, category, n FROM g")
def style_pattern_counts(spark, sf_dir):
    scanned = spread(style.scan(zh_corpus(spark, sf_dir)), ["doc_id"], F.col("style_matches"), "m")
    return scanned.select("doc_id", "m.pattern_id", "m.category", F.col("m.count").alias("n"))


_STYLE = f"""{_Z}, {_FOUND}, k AS (SELECT doc_id, count(*) AS pc, CAST(sum(n) AS BIGINT) AS oc FROM g GROUP BY doc_id),
y AS (SELECT zh.doc_id, z.doc_id IS NOT NULL AS applies, coalesce(pc, 0) AS pattern_count, coalesce(oc, 0) AS occurrence_count FROM zh LEFT JOIN z USING (doc_id) LEFT JOIN k USING (doc_id)),
a AS (SELECT *, CASE WHEN NOT applies THEN 'not_applicable' WHEN pattern_count >= 6 AND occurrence_count >= 10 THEN 'strong_ai_style_patterns' WHEN pattern_count >= 3 AND occurrence_count >= 4 THEN 'some_ai_style_patterns' ELSE 'few_ai_style_patterns' END AS assessment FROM y)"""


@query(f"WITH {ZH_SQL}, {_STYLE} SELECT doc_id, pattern_count, occurrence_count, assessment FROM a")
def style_assessment(spark, sf_dir):
    return style.scan(zh_corpus(spark, sf_dir)).select("doc_id", F.col("style_patterns").alias("pattern_count"), F.col("style_occurrences").alias("occurrence_count"), F.col("style_assessment").alias("assessment"))


@query(f"""WITH {ZH_SQL}, {_STYLE}, h AS (SELECT doc_id, len(regexp_extract_all(s, '@[\\p{{L}}\\p{{N}}_]+|#[^ #]+|https?://|[\\x{{1F300}}-\\x{{1FAFF}}]')) >= 2 AS markers, {counted('s', HAN)} < 200 AS short FROM z),
o AS (SELECT doc_id, string_agg(pattern_id || ':' || n, ',' ORDER BY n DESC, pattern_id) AS found FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(found, '') AS found, CASE assessment WHEN 'strong_ai_style_patterns' THEN 'ai_assistance_plausible' WHEN 'some_ai_style_patterns' THEN 'ai_assistance_possible' WHEN 'not_applicable' THEN 'unknown' ELSE 'not_supported_by_style_alone' END AS inference,
coalesce(markers, false) AS markers, coalesce(short, false) AS short FROM a LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)""")
def style_decision(spark, sf_dir):
    """The matches in their order, the inference, platform markers, and texts too short to say more."""
    s = style.scan(zh_corpus(spark, sf_dir))
    found = F.array_join(F.transform("style_matches", lambda m: F.concat(m["pattern_id"], F.lit(":"), m["count"].cast("string"))), ",")
    return s.select("doc_id", found.alias("found"), F.col("style_inference").alias("inference"), F.array_contains("style_counter_signals", "platform_specific_markers").alias("markers"), F.col("style_short").alias("short"))


STREAM_SQL = f"""WITH {ZH_SQL}, {_STYLE}, v AS (SELECT doc_id, language, {KEEP('text')} AS k, CAST({counted(KEEP('text'), HAN)} AS BIGINT) AS han FROM zh)
SELECT doc_id, language, han, CASE WHEN k <> '' AND language <> 'zh' THEN 'unsupported' WHEN han >= 500 THEN 'full' WHEN han >= CASE WHEN language = 'zh' THEN 200 ELSE 400 END THEN 'limited' ELSE 'insufficient' END AS coverage,
  pattern_count AS style_patterns, occurrence_count AS style_occurrences, assessment AS style_assessment FROM v JOIN a USING (doc_id)"""


@query(f"""
WITH {ZH_SQL}, {_Z}
SELECT doc_id, regexp_matches(s, '(^|[^0-9A-Za-z_一-鿿])(19|20)[0-9][0-9]([^0-9A-Za-z_一-鿿]|$)|公元\\s*[0-9][0-9][0-9][0-9]?\\s*年') AS dates, len(list_distinct(regexp_extract_all(s, {quoted(P.VOICE)}))) >= 2 AS voice,
  regexp_matches(s, {quoted(P.GAME)}) AND regexp_matches(s, {quoted(P.HISTORY)}) AS satire, contains(s, '#') AS hashtags FROM z
""")
def style_context(spark, sf_dir):
    s = style.scan(zh_corpus(spark, sf_dir).where(style.applicable()))
    has = lambda c, v, name: F.array_contains(f"style_{c}", v).alias(name)
    return s.select("doc_id", has("counter_signals", "concrete_dates", "dates"), has("counter_signals", "personal_or_comedic_voice", "voice"), has("confounds", "game_history_satire", "satire"), has("confounds", "hashtags", "hashtags"))


_SCANS = [(f.id, 1, True, (f.rx,)) for f in P.STYLE] + [(f.id, f.least, False, f.rxs) for f in P.STRUCTURAL]
_MATCHED = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS pattern_id, {least} AS least, {distinct} AS once, {r} AS r, s, regexp_extract_all(s, {quoted(rx)}) AS ms, regexp_split_to_array(s, {quoted(rx)}) AS ps FROM z WHERE regexp_matches(s, {quoted(rx)})"
    for name, least, distinct, rxs in _SCANS for r, rx in enumerate(rxs)
)


@query(f"""
WITH {ZH_SQL}, z AS (SELECT doc_id, {SQUEEZE('text')} AS s FROM zh WHERE language = 'zh' AND {SQUEEZE('text')} <> ''), f AS ({_MATCHED}),
enough AS (SELECT doc_id, pattern_id FROM f GROUP BY doc_id, pattern_id, least HAVING sum(len(ms)) >= least),
m AS (SELECT * FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM f) JOIN enough USING (doc_id, pattern_id)),
-- where a match starts: the text between the matches before it, and those matches
p AS (SELECT *, coalesce(list_sum(list_transform(ps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS a FROM m),
w AS (SELECT doc_id, pattern_id, once, r, k, trim(substr(s, CAST(greatest(a - 24, 0) AS BIGINT) + 1, CAST(a + length(ms[k]) + 48 - greatest(a - 24, 0) AS BIGINT))) AS w FROM p),
e AS (SELECT doc_id, pattern_id, once, r, k, CASE WHEN length(w) <= 120 THEN w ELSE rtrim(left(w, 119)) || '…' END AS e FROM w),
d AS (SELECT * FROM e QUALIFY NOT once OR row_number() OVER (PARTITION BY doc_id, pattern_id, e ORDER BY r, k) = 1),
t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, pattern_id ORDER BY r, k) <= 3)
SELECT doc_id, pattern_id, string_agg(e, '|' ORDER BY r, k) AS excerpts FROM t GROUP BY doc_id, pattern_id
""")
def style_excerpts(spark, sf_dir):
    return style.excerpts(zh_corpus(spark, sf_dir)).withColumn("excerpts", F.array_join("excerpts", "|"))


_W = "OVER (PARTITION BY doc_id)"
_CUES = " + ".join(f"CASE WHEN regexp_matches(sentence, {quoted(c.rx)}) THEN {c.weight} ELSE 0 END" for c in P.CUES)
_POINTS = f"""w AS (SELECT *, count(*) {_W} AS sn, coalesce(median(CASE WHEN n_units > 0 THEN CAST(n_units AS DOUBLE) END) {_W}, 0.0) AS ml, median(surprisal) {_W} AS ms, count(*) OVER (PARTITION BY doc_id, opener) AS oc2 FROM q),
p AS (SELECT doc_id, sentence_index, {_CUES} + CASE WHEN {counted('sentence', P.QUOTED)} >= 3 THEN 1 ELSE 0 END + CASE WHEN opener <> '' AND oc2 > 1 THEN 1 ELSE 0 END
  + CASE WHEN sn >= 5 AND ml > 0 AND abs(n_units - ml) <= 0.25 * ml THEN 1 ELSE 0 END + CASE WHEN sn >= 5 AND surprisal <= ms + 1e-12 THEN 1 ELSE 0 END AS points FROM w)"""


@query(f"WITH {ZH_SQL}, {_SENTENCE_ROWS}, {_POINTS} SELECT doc_id, sentence_index, CAST(points AS BIGINT) AS points, points >= 4 AS pattern_match FROM p")
def sentence_cues(spark, sf_dir):
    return detector.sentence_findings(zh_corpus(spark, sf_dir)).select("doc_id", "sentence_index", "points", "pattern_match")


@query(f"""
WITH {ZH_SQL}, {_SENTENCE_ROWS}, {_STATS}, {_POINTS}, {_STYLE.replace('z AS (', 'z AS (', 1)},
sh AS (SELECT doc_id, avg(CASE WHEN points >= 4 THEN 1.0 ELSE 0.0 END) AS share FROM p GROUP BY doc_id),
lx AS (SELECT doc_id, {REPEATED} AS repeated FROM (SELECT doc_id, {UNITS(KEEP('text'))} AS u FROM zh)),
cv AS (SELECT doc_id, language, {KEEP('text')} AS k, {counted(KEEP('text'), HAN)} AS han FROM zh),
e AS (SELECT cv.doc_id, CASE WHEN k <> '' AND language <> 'zh' THEN 'unsupported' WHEN han >= 500 THEN 'full' WHEN han >= CASE WHEN language = 'zh' THEN 200 ELSE 400 END THEN 'limited' ELSE 'insufficient' END AS coverage, han, language,
  CASE WHEN language = 'zh' THEN coalesce(share, 0) ELSE 0 END AS share, CASE WHEN language = 'zh' THEN coalesce(sentence_count, 0) ELSE 0 END AS sc, coalesce(length_cv, 0) AS lcv, coalesce(reused / sentence_count, 0) AS reuse, CASE WHEN language = 'zh' THEN repeated ELSE 0 END AS repeated, assessment, pattern_count, occurrence_count
  FROM cv LEFT JOIN sh USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN lx USING (doc_id) LEFT JOIN a USING (doc_id)),
pts AS (SELECT *, CASE assessment WHEN 'strong_ai_style_patterns' THEN 5 WHEN 'some_ai_style_patterns' THEN 2 ELSE 0 END + CASE WHEN pattern_count >= 8 THEN 2 ELSE 0 END + CASE WHEN occurrence_count / greatest(han, 1) * 100 >= 2 THEN 2 ELSE 0 END + CASE WHEN share >= 0.45 THEN 3 WHEN share >= 0.25 THEN 2 ELSE 0 END
  + CASE WHEN sc >= 5 AND (lcv <= 0.4 OR reuse >= 0.3) THEN 1 ELSE 0 END + CASE WHEN repeated >= 0.05 THEN 1 ELSE 0 END AS points,
  CASE WHEN assessment IN ('strong_ai_style_patterns', 'some_ai_style_patterns') THEN 1 ELSE 0 END + CASE WHEN share >= 0.25 THEN 1 ELSE 0 END + CASE WHEN sc >= 5 AND (lcv <= 0.4 OR reuse >= 0.3) THEN 1 ELSE 0 END + CASE WHEN repeated >= 0.05 THEN 1 ELSE 0 END AS families FROM e)
SELECT doc_id, coverage, CAST(points AS BIGINT) AS points, CAST(families AS BIGINT) AS families, round(share, 6) AS share, CASE WHEN coverage = 'unsupported' THEN 'unsupported_language' WHEN coverage = 'full' AND points >= 8 AND families >= 3 AND share >= 0.45 THEN 'strong_pattern_match' WHEN coverage IN ('full', 'limited') AND points >= 5 AND families >= 2 THEN 'localized_pattern_match' WHEN coverage IN ('full', 'limited') THEN 'unresolved' ELSE 'insufficient_evidence' END AS classification FROM pts
""")
def doc_decision(spark, sf_dir):
    got = detector.analyze(zh_corpus(spark, sf_dir), compress=False)
    return got.select("doc_id", "coverage", "points", F.size("families").cast("long").alias("families"), F.round("share", 6).alias("share"), "classification")


@query(f"""
WITH {ZH_SQL}, {_SENTENCE_ROWS}, {_STATS}, {_POINTS}, sh AS (SELECT doc_id, avg(CASE WHEN points >= 4 THEN 1.0 ELSE 0.0 END) AS share FROM p GROUP BY doc_id), lx AS (SELECT doc_id, {REPEATED} AS repeated FROM (SELECT doc_id, {UNITS(KEEP('text'))} AS u FROM zh)),
en AS (SELECT doc_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) END AS entropy FROM c GROUP BY doc_id)
SELECT zh.doc_id, [round(CAST(v AS DOUBLE), 6) FOR v IN [coalesce(sentence_count, 0), coalesce(mean_length, 0), coalesce(median_length, 0), coalesce(length_cv, 0), coalesce(surprisal_mean, 0), coalesce(surprisal_cv, 0), coalesce(reused / sentence_count, 0), coalesce(share, 0), repeated, coalesce(entropy, 0)]] AS features
FROM zh LEFT JOIN m USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN sh USING (doc_id) LEFT JOIN lx USING (doc_id) LEFT JOIN en USING (doc_id) WHERE language = 'zh'
""")
def feature_vector(spark, sf_dir):
    """The 11 features but for the zlib ratio, which SQL has no function for."""
    got = detector.analyze(zh_corpus(spark, sf_dir), compress=False).where("language = 'zh'")
    at = detector.FEATURES.index("compression")
    return got.select("doc_id", F.concat(F.slice(detector.feature_vector(), 1, at), F.slice(detector.feature_vector(), at + 2, len(detector.FEATURES))).alias("features"))


@query()
def doc_decision_full(spark, sf_dir):
    got = detector.analyze(zh_corpus(spark, sf_dir))
    return got.select("doc_id", "coverage", "points", "drivers", "families", "classification", "signal_strength", F.round("compression", 4).alias("compression"), F.round("entropy", 4).alias("entropy"))


@query("""
WITH t AS (SELECT doc_id, 'req ' || doc_id || ' Authorization: Bearer ' || md5(source) || ', x-api-key=' || source || '; api_key : ' || lang || ' ' || text AS s FROM documents)
SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(replace(s, 'src7', '[REDACTED]'), '(?i)(authorization\\s*[:=]\\s*(?:token|bearer)?\\s*)[^\\s,;]+', '\\1[REDACTED]', 'g'), '(?i)(x-api-key\\s*[:=]\\s*)[^\\s,;]+', '\\1[REDACTED]', 'g'), '(?i)(api[_-]?key\\s*[:=]\\s*)[^\\s,;]+', '\\1[REDACTED]', 'g'), 1000) AS redacted FROM t
""")
def redact_text(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text", "source", "lang")
    message = F.concat(F.lit("req "), F.col("doc_id").cast("string"), F.lit(" Authorization: Bearer "), F.md5("source"), F.lit(", x-api-key="), "source", F.lit("; api_key : "), "lang", F.lit(" "), "text")
    return d.select("doc_id", redact(message, ("src7",)).alias("redacted"))


#: (text, with its local paths masked)
PATHS = (
    ("can't read /home/ann/My.Docs/a.png: denied", "can't read [PATH]: denied"), ("see file:///tmp/x y", "see [PATH] y"), ("C:\\Users\\ann\\a.png is gone", "[PATH] is gone"), ("https://example.org/a/b stays", "https://example.org/a/b stays"),
    ("half 1/2 and and/or stay", "half 1/2 and and/or stay"), ("/a '/b/c' \"/d\"", "[PATH] '[PATH]' \"[PATH]\""), ("", ""),
)


@query(f"SELECT doc_id, left([{', '.join(quoted(x) for _, x in PATHS)}][doc_id % {len(PATHS)} + 1] || ' ' || text, 500) AS masked FROM documents WHERE NOT regexp_matches(text, '[/\\\\]')")
def redact_paths(spark, sf_dir):
    """Texts without a slash, after a reader's error with paths."""
    said = F.element_at(F.array(*[F.lit(x) for x, _ in PATHS]), (F.col("doc_id") % len(PATHS) + 1).cast("int"))
    d = documents(spark, sf_dir, "doc_id", "text").where(~F.rlike("text", F.lit(r"[/\\]")))
    return d.select("doc_id", paths_masked(F.concat(said, F.lit(" "), F.col("text"))).alias("masked"))
