"""Derived inputs for the queries, in Spark and as DuckDB SQL: a synthetic Chinese corpus, and a benchmark with predictions.

The tables hold no Chinese, so `zh_corpus` strings together phrases written for
this purpose, by arithmetic on doc_id: a narrow projection, no join. Labels and
predictions of `manifest` and `predictions` are arithmetic too and say nothing
about any detector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = (
    "今天早上我去菜市场买了两斤土豆和一把青菜。",
    "首先，我们需要明确目标；其次，要整理现有材料。",
    "这件事长期以来被许多人忽视，成为无法回避的事实。",
    "为什么大家都在谈这本书？",
    "为什么没有人早点说出来？",
    "专家普遍认为，这种方法具有深远影响。",
    "我们查阅了大量资料，研究表明结果并不简单。",
    "起初大家都很乐观，但情况很快有了变化。",
    "他写信，他写诗，他写下每天的天气。",
    "晚饭后带孩子去河边散步，风有点凉。\n",
    "不仅价格便宜，而且质量稳定，更适合日常使用。",
    "只有坚持长期投入，才能最终实现长期价值。",
    "由此可见，进一步分析是必要的。",
    "我真的没想到，他居然把钥匙落在了车里！",
    "“春天”、“夏天”、“秋天”和“冬天”，四季各有味道。",
    "可能他也许明天可能会来。",
    "原来，钥匙一直在外套口袋里。",
    "感谢大家的喜欢，这份温暖让人觉得幸福。",
    "这显然是一次必然的选择，绝对不会后悔。",
    "在2019年夏天，村口修好了一座新桥。",
    "公元 618 年的史料记载了这座城的名字。",
    "这个英雄的新皮肤今晚上线，双排的朋友记得来。",
    "历史课的作业还没有写完。",
    "#周末 #散步 天气不错",
    "请告诉我你的想法，希望这对您有帮助。",
    "充满活力的街区带来令人叹为观止的夜景。",
    "从根源上看，技术的限制意味着计划不可能提前。",
    "一方面要控制成本，另一方面要保证质量。",
    "没有掌声，更没有鲜花，只有一盏灯。",
    "综上所述，核心优势在于持续赋能与竞争格局。",
    "楼下的猫又胖了一圈；它每天准时等在门口。",
    "锅里的汤咕嘟咕嘟响，厨房里都是香味。",
    "即便下雨，我们也会按时出发，从而确保行程顺利。",
    "这意味着真实性需要重新审视。",
    "为何他总是迟到？没有人知道。",
    "爷爷修好了旧收音机，里面传来戏曲声。",
    "与此同时，值得注意的是天气正在转冷。",
    "排队的人很多，我等了四十分钟才轮到。",
    "天！我等了半天，原来他们已经下班了。",
    "晚安，明天见。\n",
    "窗外\u3000\u3000下着小雨\u00a0，我在家看书。",
    "第一行\u2028第二行\u3000@小明 也来了 😀！\n",
    "网址是 https://example.org/a ，#读书 @阿花 都在。",
)

_LITERAL = lambda s: "'" + s.replace("'", "''") + "'"
_DUCK = lambda s: " || chr(10) || ".join(_LITERAL(p) for p in s.split("\n"))

#: doc_id, language (zh, now and then en), text of 3 to 82 phrases, empty for each 97th.
ZH_SQL = f"""zh_phrases AS (SELECT [{", ".join(_DUCK(p) for p in PHRASES)}] AS p),
zh AS (
  SELECT doc_id, CASE WHEN doc_id % 11 = 10 THEN 'en' ELSE 'zh' END AS language,
         CASE WHEN doc_id % 97 = 96 THEN '' ELSE array_to_string(list_transform(range(0, CAST(3 + doc_id % 80 AS BIGINT)), lambda i: p[CAST((doc_id * 7 + i * (1 + doc_id % 3)) % {len(PHRASES)} AS BIGINT) + 1]), '') END AS text
  FROM documents, zh_phrases
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns, deal: bool = False) -> DataFrame:
    """Columns of documents; where the table has fewer files than there are cores, texts (or, with deal, any columns) are dealt over all cores."""
    d = table(spark, sf_dir, "documents")
    got = d.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return got.repartition(cores) if (deal or "text" in got.columns) and len(d.inputFiles()) < cores else got


def zh_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, language, text)."""
    d = documents(spark, sf_dir, "doc_id", deal=True)
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    at = lambda i: F.element_at(phrases, ((F.col("doc_id") * 7 + i * (1 + F.col("doc_id") % 3)) % len(PHRASES)).cast("int") + 1)
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), 2 + F.col("doc_id") % 80), at), "")
    return d.select("doc_id", F.when(F.col("doc_id") % 11 == 10, "en").otherwise("zh").alias("language"), F.when(F.col("doc_id") % 97 == 96, "").otherwise(text).alias("text"))


MANIFEST_SQL = """manifest AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'mixed' WHEN quality = 0 THEN 'ai' ELSE 'human' END AS gold_label, lang AS language,
         CASE d.doc_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'reddit' ELSE 'web' END AS platform, CASE WHEN d.doc_id % 2 = 0 THEN 'post' ELSE 'review' END AS genre,
         CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS length_bucket,
         CASE WHEN toxic = 1 OR quality = 0 THEN 'family' || CAST(d.doc_id % 3 AS VARCHAR) ELSE 'none' END AS model_family,
         CASE WHEN d.doc_id % 5 = 0 THEN 'edited' ELSE 'raw' END AS editorial_state, source AS group_id,
         CASE WHEN (d.doc_id // 20) % 2 = 0 THEN 'calibration' ELSE 'blind' END AS split, (d.doc_id // 20) % 2 = 1 AND d.doc_id % 41 <> 0 AS locked_blind,
         CASE WHEN toxic = 1 THEN CASE WHEN d.doc_id % 2 = 0 THEN ['human', 'ai', 'ai'] ELSE ['ai', 'human'] END WHEN d.doc_id % 13 = 0 THEN ['human'] END AS sentence_labels
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
predictions AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN n_chars % 7 = 0 THEN 'abstain' WHEN n_chars % 11 = 0 THEN 'mixed' WHEN n_chars % 5 < 2 THEN 'ai' WHEN n_chars % 101 = 0 THEN 'bot' ELSE 'human' END AS predicted_label,
         CASE WHEN n_chars % 3 = 0 THEN NULL WHEN n_chars % 17 = 0 THEN ['ai'] WHEN doc_id % 2 = 0 THEN ['human', 'ai', 'abstain'] ELSE ['ai', 'ai'] END AS sentence_predictions
  FROM documents WHERE doc_id % 29 <> 0
),
rated AS (SELECT m.*, p.predicted_label, p.sentence_predictions FROM manifest m JOIN predictions p USING (id) WHERE predicted_label <> 'bot' AND NOT coalesce(gold_label = 'mixed' AND len(sentence_labels) <> len(sentence_predictions), false))"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = documents(spark, sf_dir, "doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    toxic, poor = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False))
    blind = F.floor(k / 20) % 2 == 1
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return d.join(labels, "doc_id", "left").select(
        k.cast("string").alias("id"), F.when(toxic, "mixed").when(poor, "ai").otherwise("human").alias("gold_label"), F.col("lang").alias("language"),
        F.element_at(words("x", "reddit", "web"), (k % 3 + 1).cast("int")).alias("platform"), F.when(k % 2 == 0, "post").otherwise("review").alias("genre"),
        F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long").alias("length_bucket"),
        F.when(toxic | poor, F.concat(F.lit("family"), (k % 3).cast("string"))).otherwise("none").alias("model_family"),
        F.when(k % 5 == 0, "edited").otherwise("raw").alias("editorial_state"), F.col("source").alias("group_id"), F.when(blind, "blind").otherwise("calibration").alias("split"),
        (blind & (k % 41 != 0)).alias("locked_blind"),
        F.when(toxic, F.when(k % 2 == 0, words("human", "ai", "ai")).otherwise(words("ai", "human"))).when(k % 13 == 0, words("human")).alias("sentence_labels"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = documents(spark, sf_dir, "doc_id", "n_chars").where("doc_id % 29 <> 0"), F.col("n_chars")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    label = F.when(n % 7 == 0, "abstain").when(n % 11 == 0, "mixed").when(n % 5 < 2, "ai").when(n % 101 == 0, "bot").otherwise("human")
    sentence = F.when(n % 3 == 0, F.lit(None)).when(n % 17 == 0, words("ai")).when(F.col("doc_id") % 2 == 0, words("human", "ai", "abstain")).otherwise(words("ai", "ai"))
    return d.select(F.col("doc_id").cast("string").alias("id"), label.alias("predicted_label"), sentence.alias("sentence_predictions"))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows with valid predictions."""
    from ..operators.evaluation import joined

    rows = joined(manifest(spark, sf_dir), predictions(spark, sf_dir)).where(F.col("predicted_label") != "bot")
    return rows.where(~F.coalesce((F.col("gold_label") == "mixed") & (F.size("sentence_labels") != F.size("sentence_predictions")), F.lit(False)))
