"""Validation of cases and of reader-reaction records: every violation as a row, and the first one in rule order.

Where a record is rejected at the first fault elsewhere, here all faults come out
as (case_id, path, rule), so a corpus is checked in one pass.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_public_url, is_zoned_time, squeeze
from ..functions.typed import absent, at, is_object, items, items_or_none, keys, members, no_items, spread, string, strip, variant

# Enumerations of the contracts.
PLATFORMS = ("x", "reddit", "linkedin", "instagram", "tiktok", "threads", "web", "unknown")
LANGUAGES = ("en", "zh", "mixed", "other", "unknown")
PURPOSES = ("inform", "discuss", "persuade", "promote", "support", "unknown")
OBSERVATIONS = ("platform_ai_label", "author_disclosure", "other")
ASSERTIONS = ("confirmed", "denied", "quoted", "discussed", "uncertain")
PERSONAS = ("supporter", "neutral", "skeptic")
RISKS = ("low", "medium", "high", "unknown")
DIMENSIONS = (
    "specificity", "genericness", "emotional_fit", "reader_agency", "credibility_friction",
    "platform_fit", "commercial_pressure", "disclosure_expectation", "media_text_fit", "empathy",
)
METHOD = "stance_personas_v1"
BANNED_KEYS = (
    "rewrite", "rewritten_text", "suggested_copy", "improved_version", "replacement_post", "human_score", "human_likeness_score", "aversion_score",
    "protected_traits", "protected_attributes", "demographics", "diagnosis", "psychological_diagnosis", "detector_evasion", "evasion_advice", "humanization_advice",
)
BANNED_PARTS = ("bypass", "diagnos", "evasion", "humanize", "humanization", "protected_attribute", "protected_trait", "rewrite")
BANNED_STARTS = ("suggested_", "replacement_")
# Texts that a record must not hold.
PROHIBITED = {
    "author_attribute": r"(?i)\b(?:author|writer|poster|creator|user)\b.{0,20}\b(?:is|seems|appears|looks|must be|likely is|probably is)\b(?!\s*(?:unknown|unclear|not known|not visible|unavailable)\b)\s*.{1,80}|(?:作者|发帖者|创作者|用户).{0,12}(?:是|属于|看起来是|似乎是|很可能是)(?!(?:未知|不明|无法判断|不可见)).{1,40}",
    "protected_attribute": r"(?i)(?:infer|assume|suggests?|indicates?|likely|probably).{0,48}\b(?:race|ethnicity|nationality|religion|gender|sex|sexual orientation|age|disability)\b|\b(?:author|writer|poster|creator|user)(?:'s| is| appears)?[^.。]{0,32}\b(?:race|ethnicity|nationality|religion|gender|sex|sexual orientation|age|disabled|disability)\b|(?:推断|判断|猜测|说明|看出).{0,32}(?:种族|民族|国籍|宗教|性别|性取向|年龄|残障|残疾)|(?:作者|发帖者|创作者|用户).{0,24}(?:种族|民族|国籍|宗教|性别|性取向|年龄|残障|残疾)|(?i:\b(?:author|writer|poster|creator|user)\b.{0,32}\b(?:muslim|christian|jewish|hindu|buddhist|atheist|democrat|republican|conservative|liberal|left[- ]wing|right[- ]wing|gay|lesbian|bisexual|transgender|nonbinary)\b)|(?:作者|发帖者|创作者|用户).{0,24}(?:穆斯林|基督徒|犹太人|佛教徒|印度教徒|民主党|共和党|保守派|自由派|左翼|右翼|同性恋|双性恋|跨性别)",
    "diagnosis": r"(?i)\b(?:narcissist|psychopath|sociopath|depressed|bipolar|mentally ill)\b|(?:心理诊断|精神疾病|人格障碍|自恋型人格|反社会人格|抑郁症|躁郁症|双相障碍)",
    "rewrite_advice": r"(?i)\b(?:rewrite|replacement copy|replace (?:this|it) with|better version|change the tone|add (?:a|the)|delete (?:this|the)|remove (?:this|the))\b|\bshould (?:add|remove|delete|shorten|revise|change|replace)\b|(?:改写|重写|润色成|建议改成|可以改为|替换文案|删掉|删除这|增加一段|调整语气)|(?:应该|应当|可以)(?:增加|补充|删除|删去|缩短|修改|调整|替换)|(?i:\b(?:vary|personalize|shorten|lengthen|insert|include)\b.{0,50}\b(?:sentence|text|post|copy|anecdote|tone|syntax)\b)|(?i:\b(?:lower|reduce|minimi[sz]e)\b.{0,36}\b(?:automated )?(?:screening|detection) risk\b)|(?:调整|改变|加入|添加|插入|缩短|拉长).{0,30}(?:句子|句长|文本|帖子|故事|轶事|语气|句法).{0,30}(?:检测|筛查|识别)",
    "evasion_advice": r"(?i)(?:evade|bypass|fool|beat).{0,24}(?:ai )?detector|pass as human|avoid ai detection|humanize (?:the )?(?:text|post|copy)|(?:绕过|规避|骗过|避开).{0,18}(?:AI|人工智能)?检测|降低AI率|去AI味|伪装成人类",
}

CASE_SCHEMA = (
    "case_id string, schema_version string, source struct<url: string, platform: string, author: string, published_at: string, captured_at: string, public: boolean>, "
    "content struct<text: string, language: string, images: array<struct<id: string, path: string, source_url: string, alt_text: string>>>, "
    "observations array<struct<type: string, value: string, assertion: string, scope: string, source_url: string>>, declared_purpose string"
)
_CONCLUSION = "statement: string, excerpt: string, evidence: struct<kind: string, locator: string, detail: string>, reason: string, personas: array<string>"
RECEPTION_SCHEMA = (
    "method string, audience_assumptions array<string>, reader_views array<struct<persona: string, likely_reaction: string, aversion_risk: string, "
    f"friction_points: array<struct<dimension: string, excerpt: string, reason: string>>, positive_signals: array<struct<{_CONCLUSION}>>, uncertainty: string>>, "
    f"cross_reader_patterns array<struct<{_CONCLUSION}>>, uncertainties array<string>"
)
RECEPTION_FIELDS = ("method", "audience_assumptions", "reader_views", "cross_reader_patterns", "uncertainties")
CASE_FIELDS = ("schema_version", "source", "content", "observations", "declared_purpose")


def blank(c: Column) -> Column:
    return c.isNull() | (squeeze(c) == "")


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


_FAULTS = "array<struct<path:string,rule:string>>"


def _if(cond: Column, path: Column | str, rule: str) -> Column:
    """The fault if cond holds, else null."""
    return F.when(F.coalesce(cond, F.lit(False)), F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(rule).alias("rule")))


def _faults(*found: Column) -> Column:
    return F.array_compact(F.array(*found)) if found else F.array().cast(_FAULTS)


def _sub(path: Column | str, name: str) -> Column:
    return F.concat(F.lit(path) if isinstance(path, str) else path, F.lit(f".{name}"))


def _place(path: Column | str, i: Column) -> Column:
    return F.concat(F.lit(path) if isinstance(path, str) else path, F.lit("["), i.cast("string"), F.lit("]"))


def _each(found: Column, of) -> Column:
    """The faults of(element, index) of all elements, in order."""
    return F.flatten(F.transform(found, of))


def _spread(df: DataFrame, faults: Column) -> DataFrame:
    """(case_id, ord, path, rule): a row for each fault, in order."""
    return spread(df, ["case_id"], faults, "v", "ord").select("case_id", "ord", "v.*")


def as_json(cases: DataFrame) -> DataFrame:
    """(case_id, json) of cases with the columns of CASE_SCHEMA."""
    return cases.select("case_id", F.to_json(F.struct(*[c for c in CASE_FIELDS if c in cases.columns])).alias("json"))


def read_cases(records: DataFrame, json_col: str = "json") -> DataFrame:
    """The cases of CASE_SCHEMA among records (case_id, json) that break no rule. Only those are read with fixed types, so nothing is made into what it is not."""
    broken = case_violations(records, json_col).select("case_id").distinct()
    fields = ", ".join(x for x in CASE_SCHEMA.split(", ", 1)[1:])
    return records.join(broken, "case_id", "left_anti").select("case_id", F.from_json(json_col, fields).alias("c")).select("case_id", "c.*")


def case_violations(cases: DataFrame, json_col: str | None = None) -> DataFrame:
    """(case_id, ord, path, rule): every rule that a case breaks; the least ord is the fault that is met first.

    cases are rows of CASE_SCHEMA, or (case_id, json) with json_col. Types are part
    of the rules: a number where a string belongs, a string for a list, an
    absent list or an element that is no object are faults, and what lies below such a
    value is not looked at.
    """
    v = variant(json_col) if json_col else F.to_variant_object(F.struct(*[F.col(c) for c in CASE_FIELDS if c in cases.columns]))
    top = cases.select("case_id", v.alias("v")).select("case_id", "v", at(F.col("v"), "source").alias("source"), at(F.col("v"), "content").alias("content"))
    c = F.col
    read = top.select("case_id", "v", "source", "content", items(at(c("content"), "images")).alias("images"), items(at(c("v"), "observations")).alias("seen"), string(at(c("content"), "text")).alias("text"))
    images, seen, has_text = F.coalesce("images", no_items()), F.coalesce("seen", no_items()), ~blank(c("text"))
    read = read.withColumn("ids", F.transform(images, lambda i: _filled(string(at(i, "id")))))
    scopes = F.concat(F.array(F.lit("post")), F.when(has_text, F.array(F.lit("text"))).otherwise(F.array().cast("array<string>")), F.array_compact("ids"))
    url = lambda x: ~absent(x) & _no(is_public_url(string(x)) & string(x).isNotNull())
    time = lambda x: ~is_zoned_time(string(x))
    enum = lambda x, values: _no(string(x).isin(*values))
    typed = lambda x: ~absent(x) & string(x).isNull()

    def of_image(i: Column, k: Column) -> Column:
        here = _place("content.images", k)
        name, path = string(at(i, "id")), string(at(i, "path"))
        return F.when(~is_object(i), _faults(_if(F.lit(True), here, "object"))).otherwise(_faults(
            _if(blank(name), _sub(here, "id"), "blank"), _if(F.array_position(c("ids"), name) <= k, _sub(here, "id"), "duplicate"), _if(path.isNull(), _sub(here, "path"), "string"), _if(~path.startswith("/"), _sub(here, "path"), "not_absolute"),
            _if(url(at(i, "source_url")), _sub(here, "source_url"), "url"), _if(typed(at(i, "alt_text")), _sub(here, "alt_text"), "string"),
        ))

    def of_observation(o: Column, k: Column) -> Column:
        here = _place("observations", k)
        scope = string(at(o, "scope"))
        return F.when(~is_object(o), _faults(_if(F.lit(True), here, "object"))).otherwise(_faults(
            _if(enum(at(o, "type"), OBSERVATIONS), _sub(here, "type"), "enum"), _if(blank(string(at(o, "value"))), _sub(here, "value"), "blank"), _if(url(at(o, "source_url")), _sub(here, "source_url"), "url"),
            _if(~absent(at(o, "assertion")) & enum(at(o, "assertion"), ASSERTIONS), _sub(here, "assertion"), "enum"), _if(~absent(at(o, "scope")) & blank(scope), _sub(here, "scope"), "blank"), _if(~blank(scope) & ~F.array_contains(scopes, scope), _sub(here, "scope"), "unknown"),
        ))

    source, content = c("source"), c("content")
    within = lambda v, *found: F.when(is_object(v), _faults(*found)).otherwise(F.array().cast(_FAULTS))
    rules = F.concat(
        _faults(_if(_no(string(at(c("v"), "schema_version")) == "1.0"), "schema_version", "version"), _if(~is_object(source), "source", "object")),
        within(source,
            _if(_no((F.schema_of_variant(at(source, "public")) == "BOOLEAN") & F.try_variant_get(source, "$.public", "boolean")), "source.public", "not_public"), _if(enum(at(source, "platform"), PLATFORMS), "source.platform", "enum"), _if(url(at(source, "url")), "source.url", "url"),
            _if(time(at(source, "captured_at")), "source.captured_at", "time"), _if(~absent(at(source, "published_at")) & _no(string(at(source, "published_at")) == "") & time(at(source, "published_at")), "source.published_at", "time"), _if(typed(at(source, "author")), "source.author", "string")),
        _faults(_if(~is_object(content), "content", "object")),
        within(content, _if(typed(at(content, "text")), "content.text", "string"), _if(enum(at(content, "language"), LANGUAGES), "content.language", "enum"), _if(c("images").isNull(), "content.images", "list")),
        _each(images, of_image), _faults(_if(is_object(content) & ~has_text & (F.size(images) == 0), "content", "empty"), _if(c("seen").isNull(), "observations", "list")), _each(seen, of_observation),
        _faults(_if(enum(at(c("v"), "declared_purpose"), PURPOSES), "declared_purpose", "enum")),
    )
    return _spread(read, F.when(~is_object(c("v")) | c("v").isNull(), _faults(_if(F.lit(True), "case", "object"))).otherwise(rules))


def _filled(text: Column) -> Column:
    return F.when(~blank(text), text)


def first_violation(violations: DataFrame) -> DataFrame:
    """One row a case: its first violation in rule order, and how many it has."""
    return violations.groupBy("case_id").agg(F.min_by(F.struct("path", "rule"), F.struct("ord", "path")).alias("v"), F.count("*").alias("violations")).select("case_id", "v.*", "violations")


def source_list(cases: DataFrame) -> DataFrame:
    """(case_id, sources): distinct URLs of source, observations and images, in that order."""
    every = F.concat(F.array("source.url"), F.transform(F.coalesce("observations", F.array()), lambda o: o["source_url"]), F.transform(F.coalesce("content.images", F.array()), lambda i: i["source_url"]))
    return cases.select("case_id", F.array_distinct(F.filter(every, lambda u: u.isNotNull() & (u != ""))).alias("sources"))


def evidence_items(cases: DataFrame) -> DataFrame:
    """(case_id, pos, locator, text): what an excerpt may quote, in order."""
    images, seen = F.coalesce("content.images", F.array()), F.coalesce("observations", F.array())
    item = lambda locator, text: F.when(text.isNotNull() & (text != ""), F.struct(locator.alias("locator"), text.alias("text")))

    def of_image(i: Column) -> Column:
        at = F.concat(F.lit("content.images["), i["id"], F.lit("]"))
        return F.array(item(F.concat(at, F.lit(".id")), i["id"]), item(F.concat(at, F.lit(".alt_text")), i["alt_text"]))

    every = F.concat(F.array(item(F.lit("content.text"), F.col("content.text"))), F.flatten(F.transform(images, of_image)), F.transform(seen, lambda o, k: item(F.concat(F.lit("observations["), k.cast("string"), F.lit("].value")), o["value"])))
    return cases.select("case_id", F.posexplode(F.array_compact(every)).alias("pos", "e")).select("case_id", "pos", "e.*")


#: Excerpts of a case that one automaton holds.
BLOCK_EXCERPTS = 2000
_FOUND = T.ArrayType(T.StringType())


@F.pandas_udf(_FOUND)
def first_holders(excerpts: pd.Series, texts: pd.Series, locators: pd.Series) -> pd.Series:
    """For each excerpt of a row the locator of the first text that holds it, case folded, or null.

    One automaton holds all excerpts of the row and reads each text once, until all are found.
    """

    def of(wanted, among, names) -> list:
        folded = [x.casefold() for x in wanted]
        tree = ahocorasick.Automaton()
        for x in set(folded) - {""}:
            tree.add_word(x, x)
        found: dict[str, str] = {"": names[0]} if len(names) else {}
        if len(tree):
            tree.make_automaton()
            for text, name in zip(among, names):
                if len(found) > len(tree):
                    break
                for _, x in tree.iter(text.casefold()):
                    found.setdefault(x, name)
        return [found.get(x) for x in folded]

    return pd.Series([of(*row) for row in zip(excerpts, texts, locators)])


def ground(excerpts: DataFrame, items: DataFrame) -> DataFrame:
    """excerpts (case_id, path, excerpt) with locator: the first item of the case that holds the excerpt, case folded; null if none.

    A case's excerpts are dealt in blocks of about BLOCK_EXCERPTS, each of which meets the case's items (one row) once. Null excerpts get no row.
    """
    whole = items.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "locator"))).alias("i")).select("case_id", F.col("i.text").alias("texts"), F.col("i.locator").alias("locators"))
    wanted = excerpts.where("excerpt is not null").select("case_id", "path", "excerpt")
    many = wanted.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_EXCERPTS)
    block = F.pmod(F.xxhash64("path", "excerpt"), F.coalesce(F.ceil(F.col("n") / BLOCK_EXCERPTS), F.lit(1)))
    blocks = wanted.join(many, "case_id", "left").groupBy("case_id", block.alias("block")).agg(F.collect_list(F.struct("path", "excerpt")).alias("e"))
    none = F.array().cast("array<string>")
    met = blocks.join(whole, "case_id", "left").select("case_id", "e", first_holders(F.col("e.excerpt"), F.coalesce("texts", none), F.coalesce("locators", none)).alias("found"))
    return met.select("case_id", F.explode(F.arrays_zip("e", "found")).alias("x")).select("case_id", "x.e.path", "x.e.excerpt", F.col("x.found").alias("locator"))


def banned_keys(records: DataFrame, json_col: str = "json") -> DataFrame:
    """(case_id, path, key, rule) of prohibited keys at any depth."""
    named = spread(records.select("case_id", members(json_col).alias("m")), ["case_id"], F.col("m"), "m").select("case_id", "m.path", "m.key", F.lower("m.key").alias("_k"))
    part = F.lit(False)
    for p in BANNED_PARTS:
        part = part | F.contains("_k", F.lit(p))
    for p in BANNED_STARTS:
        part = part | F.startswith("_k", F.lit(p))
    return named.where(F.col("_k").isin(*BANNED_KEYS) | part).select("case_id", "path", "key", F.lit("banned_key").alias("rule"))


# The keys of each level of a record.
TOP_KEYS = ("method", "audience_assumptions", "reader_views", "cross_reader_patterns", "uncertainties")
VIEW_KEYS = ("persona", "likely_reaction", "aversion_risk", "friction_points", "positive_signals", "uncertainty")
FRICTION_KEYS = ("dimension", "excerpt", "reason")
CONCLUSION_KEYS = ("statement", "excerpt", "evidence", "reason", "personas")
EVIDENCE_KEYS = ("kind", "locator", "detail")


def prohibited_text(texts: DataFrame) -> DataFrame:
    """(case_id, path, rule) of texts (case_id, path, text) that hold a prohibited statement."""
    return spread(texts, ["case_id", "path"], F.array_compact(F.array(*[F.when(F.rlike("text", F.lit(rx)), F.lit(name)) for name, rx in PROHIBITED.items()])), "rule").drop("_place")


def _strange(v: Column, path: Column | str, known: tuple[str, ...]) -> Column:
    """Faults of an object's keys that its level does not know."""
    extra = F.array_except(F.coalesce(keys(v), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))
    at_top = isinstance(path, str) and not path
    return F.transform(extra, lambda k: F.struct((k if at_top else F.concat(F.lit(path) if isinstance(path, str) else path, F.lit("."), k)).alias("path"), F.lit("unknown_key").alias("rule")))


def _required(v: Column, path: Column, longest: int | None = None, rule: str = "") -> Column:
    """Faults of what must be a string with more than blanks, and no longer than told."""
    text = string(v)
    return _faults(_if(text.isNull(), path, "string"), _if(text.isNotNull() & blank(text), path, "blank"), *([_if(F.length(strip(text)) > longest, path, rule)] if longest else []))


def _string_list(v: Column, path: str) -> Column:
    return F.when(items(v).isNull(), _faults(_if(F.lit(True), path, "list"))).otherwise(_each(items_or_none(v), lambda x, i: _required(x, _place(path, i))))


def _conclusions(found: Column, path: Column | str, crossed: bool) -> Column:
    """Faults of a list of conclusions."""

    def of(x: Column, i: Column) -> Column:
        here = _place(path, i)
        excerpt, evidence, detail, who = at(x, "excerpt"), at(x, "evidence"), at(at(x, "evidence"), "detail"), at(x, "personas")
        none = F.array().cast(_FAULTS)
        cited = (
            F.when(~absent(excerpt), _required(excerpt, _sub(here, "excerpt"), 200, "excerpt_length"))
            .when(is_object(evidence), F.concat(
                _strange(evidence, _sub(here, "evidence"), EVIDENCE_KEYS), _required(at(evidence, "kind"), _sub(here, "evidence.kind")), _required(at(evidence, "locator"), _sub(here, "evidence.locator")), F.when(~absent(detail), _required(detail, _sub(here, "evidence.detail"))).otherwise(none)))
            .otherwise(_faults(_if(F.lit(True), here, "no_evidence")))
        )
        named = F.transform(items_or_none(who), string)
        wrong = F.exists(named, lambda p: p.isNull() | ~p.isin(*PERSONAS)) | (F.size(F.array_distinct(named)) < 2) | (F.size(F.array_distinct(named)) < F.size(named))
        people = _faults(_if(items(who).isNull(), _sub(here, "personas"), "list"), _if(items(who).isNotNull() & wrong, _sub(here, "personas"), "personas")) if crossed else _faults(_if(~absent(who), _sub(here, "personas"), "personas_not_allowed"))
        return F.when(~is_object(x), _faults(_if(F.lit(True), here, "object"))).otherwise(F.concat(_strange(x, here, CONCLUSION_KEYS), _required(at(x, "statement"), _sub(here, "statement")), _required(at(x, "reason"), _sub(here, "reason")), cited, people))

    where = F.lit(path) if isinstance(path, str) else path
    return F.when(items(found).isNull(), _faults(_if(F.lit(True), where, "list"))).otherwise(_each(items_or_none(found), of))


def _view(v: Column, i: Column) -> Column:
    """Faults of a reader's view."""
    here = _place("reader_views", i)
    points, risk = at(v, "friction_points"), string(at(v, "aversion_risk"))

    def of_point(f: Column, j: Column) -> Column:
        there = _place(_sub(here, "friction_points"), j)
        return F.when(~is_object(f), _faults(_if(F.lit(True), there, "object"))).otherwise(F.concat(
            _strange(f, there, FRICTION_KEYS), _faults(_if(_no(string(at(f, "dimension")).isin(*DIMENSIONS)), _sub(there, "dimension"), "enum")), _required(at(f, "excerpt"), _sub(there, "excerpt"), 200, "excerpt_length"), _required(at(f, "reason"), _sub(there, "reason"), 1000, "reason_length")))

    return F.when(~is_object(v), _faults(_if(F.lit(True), here, "object"))).otherwise(F.concat(
        _strange(v, here, VIEW_KEYS), _faults(_if(_no(string(at(v, "persona")).isin(*PERSONAS)), _sub(here, "persona"), "enum"), _if(_no(risk.isin(*RISKS)), _sub(here, "aversion_risk"), "enum"), _if(items(points).isNull(), _sub(here, "friction_points"), "list")),
        _each(items_or_none(points), of_point), _required(at(v, "likely_reaction"), _sub(here, "likely_reaction")), _required(at(v, "uncertainty"), _sub(here, "uncertainty")), _conclusions(at(v, "positive_signals"), _sub(here, "positive_signals"), False),
        _faults(_if((risk == "high") & (F.size(items_or_none(points)) < 2), _sub(here, "aversion_risk"), "high_needs_two")),
    ))


def record_faults(v: Column) -> Column:
    """Faults of a record (VARIANT) that show without its case: types, unknown keys, enumerations, lengths."""
    views = at(v, "reader_views")
    personas = F.transform(items_or_none(views), lambda x: string(at(x, "persona")))
    rules = F.concat(
        _strange(v, "", TOP_KEYS), _faults(_if(_no(string(at(v, "method")) == METHOD), "method", "method")), _string_list(at(v, "audience_assumptions"), "audience_assumptions"), _conclusions(at(v, "cross_reader_patterns"), "cross_reader_patterns", True),
        _string_list(at(v, "uncertainties"), "uncertainties"), _faults(_if(items(views).isNull() | (F.size(items_or_none(views)) != 3), "reader_views", "three_views")), _each(items_or_none(views), _view),
        _faults(_if(F.size(F.array_intersect(personas, F.array(*[F.lit(p) for p in PERSONAS]))) < 3, "reader_views", "personas")),
    )
    return F.when(v.isNull() | ~is_object(v), _faults(_if(F.lit(True), "record", "object"))).otherwise(rules)


def record_parts(records: DataFrame, json_col: str = "json") -> DataFrame:
    """(case_id, kind, path, value, personas): the texts of a record that must be checked, by what they are; bare strings in lists of conclusions too.

    kind: text, excerpt, locator, or conclusion, whose value is its JSON.
    """
    nobody = F.lit(None).cast("array<string>")
    part = lambda kind, path, value, who=nobody: F.struct(F.lit(kind).alias("kind"), path.alias("path"), value.alias("value"), who.alias("personas"))
    text = lambda v, path: part("text", path, strip(string(v)))

    def conclusions(found: Column, path: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            here = _place(path, i)
            quoted, evidence = ~absent(at(x, "excerpt")), at(x, "evidence")
            return F.array(
                text(x, here), text(at(x, "statement"), _sub(here, "statement")), text(at(x, "reason"), _sub(here, "reason")), part("excerpt", _sub(here, "excerpt"), strip(string(at(x, "excerpt")))),
                part("locator", _sub(here, "evidence.locator"), F.when(~quoted, strip(string(at(evidence, "locator"))))), part("text", _sub(here, "evidence.detail"), F.when(~quoted, strip(string(at(evidence, "detail"))))),
                part("conclusion", here, F.when(is_object(x), F.to_json(x)), F.transform(items(at(x, "personas")), string)),
            )

        return F.flatten(F.transform(items_or_none(found), of))

    def view(v: Column, i: Column) -> Column:
        here = _place("reader_views", i)

        def point(f: Column, j: Column) -> Column:
            there = _place(_sub(here, "friction_points"), j)
            return F.array(part("excerpt", _sub(there, "excerpt"), strip(string(at(f, "excerpt")))), text(at(f, "reason"), _sub(there, "reason")))

        own = F.array(text(at(v, "likely_reaction"), _sub(here, "likely_reaction")), text(at(v, "uncertainty"), _sub(here, "uncertainty")))
        return F.concat(own, F.flatten(F.transform(items_or_none(at(v, "friction_points")), point)), conclusions(at(v, "positive_signals"), _sub(here, "positive_signals")))

    v = F.col("v")
    listed = lambda name: F.transform(items_or_none(at(v, name)), lambda x, i: text(x, _place(name, i)))
    every = F.concat(listed("audience_assumptions"), listed("uncertainties"), F.flatten(F.transform(items_or_none(at(v, "reader_views")), view)), conclusions(at(v, "cross_reader_patterns"), F.lit("cross_reader_patterns")))
    return spread(records.select("case_id", variant(json_col).alias("v")), ["case_id"], F.filter(every, lambda p: p["value"].isNotNull()), "p").select("case_id", "p.*")


def reception_violations(records: DataFrame, cases: DataFrame, json_col: str = "json") -> DataFrame:
    """(case_id, path, rule): every rule that a reader-reaction record breaks against its case (rows of CASE_SCHEMA).

    Types are rules too, see case_violations: a list that is absent, null or none, a
    bare string for a conclusion or a number for a text is a fault and hides no other.
    """
    shape = _spread(records.select("case_id", variant(json_col).alias("v")), record_faults(F.col("v"))).select("case_id", "path", "rule")
    parts, given = record_parts(records, json_col), evidence_items(cases)
    quotes = parts.where("kind = 'excerpt'").select("case_id", "path", F.col("value").alias("excerpt")).where(F.col("excerpt") != "")
    lost = parts.where((F.col("kind") == "locator") & (F.col("value") != "")).select("case_id", "path", F.col("value").alias("locator")).join(given.select("case_id", "locator").distinct(), ["case_id", "locator"], "left_anti")
    named = lambda df, rule: df.select("case_id", "path", F.lit(rule).alias("rule"))
    return (
        shape.unionByName(banned_keys(records, json_col).select("case_id", "path", "rule")).unionByName(named(ground(quotes, given).where("locator is null"), "not_grounded")).unionByName(named(lost, "unknown_locator"))
        .unionByName(prohibited_text(parts.where("kind = 'text'").select("case_id", "path", F.col("value").alias("text"))))
    )


def evidence_index(records: DataFrame, cases: DataFrame, json_col: str = "json") -> DataFrame:
    """(case_id, path, statement, reason, kind, locator, excerpt, detail, personas) of each conclusion of the records that break no rule: what it rests on, details cut to 500 characters."""
    broken = reception_violations(records, cases, json_col).select("case_id").distinct()
    parts = record_parts(records.join(broken, "case_id", "left_anti"), json_col).where("kind = 'conclusion'")
    v = F.col("v")
    read = parts.select("case_id", "path", variant("value").alias("v"), "personas")
    text = lambda x: strip(string(x))
    each = read.select(
        "case_id", "path", text(at(v, "statement")).alias("statement"), text(at(v, "reason")).alias("reason"), text(at(v, "excerpt")).alias("excerpt"), text(at(at(v, "evidence"), "kind")).alias("kind"),
        text(at(at(v, "evidence"), "locator")).alias("locator"), F.left(text(at(at(v, "evidence"), "detail")), F.lit(500)).alias("detail"), "personas",
    )
    found = ground(each.select("case_id", "path", "excerpt"), evidence_items(cases)).select("case_id", "path", F.col("locator").alias("found"))
    quoted = F.col("excerpt").isNotNull()
    return each.join(found, ["case_id", "path"], "left").select(
        "case_id", "path", "statement", "reason", F.when(quoted, "excerpt").otherwise(F.col("kind")).alias("kind"), F.when(quoted, F.col("found")).otherwise(F.col("locator")).alias("locator"),
        "excerpt", F.when(~quoted, F.col("detail")).alias("detail"), F.when(~F.startswith("path", F.lit("reader_views")), F.col("personas")).alias("personas"),
    )


def read_records(records: DataFrame, json_col: str = "json") -> DataFrame:
    """(case_id, and the fields of RECEPTION_SCHEMA) of the records that break no rule which shows without their case; only those have the types that are read."""
    shaped = records.where(F.size(record_faults(variant(json_col))) == 0)
    return shaped.select("case_id", F.from_json(json_col, RECEPTION_SCHEMA).alias("r")).select("case_id", "r.*")


def ordered_views(records: DataFrame, json_col: str = "json") -> DataFrame:
    """(case_id, reader_views) with the views in the order supporter, neutral, skeptic; other stances last, what is no object left out."""
    views = F.filter(items_or_none(at(F.col("v"), "reader_views")), is_object)
    read = F.transform(views, lambda x: F.struct(string(at(x, "persona")).alias("persona"), F.to_json(x).alias("view")))
    place = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in PERSONAS]), x["persona"]), F.lit(0)), F.lit(len(PERSONAS) + 1))
    return records.select("case_id", variant(json_col).alias("v")).select("case_id", F.array_sort(read, lambda a, b: (place(a) - place(b)).cast("int")).alias("reader_views"))
