"""Provenance manifests, provider responses and media bytes: normalised from JSON and binary columns. Nothing is fetched."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import members, parsed

# Source types by category.
GENERATED = ("trainedalgorithmicmedia",)
GENERATIVE_EDIT = ("compositewithtrainedalgorithmicmedia", "compositedwithtrainedalgorithmicmedia")
NON_GENERATIVE = ("algorithmicallyenhanced", "algorithmicmedia")
ACTIONS = r"^c2paactions(v[0-9]+)?$"
METADATA = ("c2pametadata", "stdsiptcphotometadata")
#: Classes of a response that name no source.
NO_SOURCE = ("ai_generated", "not_ai_generated", "deepfake", "none", "inconclusive", "inconclusive_video")
ASSET_ID = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"
MAX_BYTES = 20 * 1024 * 1024

# Spelled out, as DDL can't be read where executors import this module.
_STATUSES = T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("explanation", T.StringType())]))
_SCORES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]))
_ACTION = "struct<digitalSourceType: string, digital_source_type: string>"
STORE = f"active_manifest string, manifests map<string, struct<claim_generator: string, assertions: array<struct<label: string, data: struct<actions: array<{_ACTION}>, digitalSourceType: string, digital_source_type: string>>>>>"


def source_token(value: Column) -> Column:
    """The last segment of an identifier, letters and digits only."""
    return F.regexp_replace(F.lower(F.element_at(F.split(F.trim(value), "[/#:]+"), -1)), "[^a-z0-9]", "")


def source_category(token: Column) -> Column:
    return F.when(token.isin(*GENERATED), "generated").when(token.isin(*GENERATIVE_EDIT), "generative_edit").when(token.isin(*NON_GENERATIVE), "non_generative_algorithmic").otherwise("unknown")


def objects(value, skip: str | None = None) -> Iterator[dict]:
    """Every object in a JSON value, parents first; lists under the key `skip` are not entered. A stack, so depth is no limit."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
            stack.extend(reversed([x for k, x in v.items() if not (k == skip and isinstance(x, list))]))
        elif isinstance(v, list):
            stack.extend(reversed(v))


@F.pandas_udf(_STATUSES)
def statuses(store: pd.Series) -> pd.Series:
    """The entries of all validation_status lists, at any depth; explanations cut to 300. No built-in looks at any depth."""
    entry = lambda x: {"code": str(x.get("code") or ""), "explanation": str(x.get("explanation") or "")[:300]}
    lists = lambda text: [o["validation_status"] for o in objects(parsed(text), "validation_status") if isinstance(o.get("validation_status"), list)]
    return store.map(lambda text: [entry(x) for found in lists(text) for x in found if isinstance(x, dict)])


@F.pandas_udf(_SCORES)
def class_scores(response: pd.Series) -> pd.Series:
    """Classes with a number as score (booleans are none), at any depth: lower-cased names as first met, each with its highest score, 0 at least."""

    def of(text):
        best: dict[str, float] = {}
        for o in objects(parsed(text)):
            name, score = o.get("class"), o.get("score")
            if isinstance(name, str) and isinstance(score, (int, float)) and not isinstance(score, bool):
                best[name.casefold()] = max(best.get(name.casefold(), 0.0), float(score))
        return [{"name": k, "score": v} for k, v in best.items()]

    return response.map(of)


def manifest_results(stores: DataFrame, json_col: str = "store") -> DataFrame:
    """stores with status (absent, invalid, verified), validation_status (code, explanation), valid, ai_generated, generative_involvement, categories.

    Only assertions of the active manifest with trusted labels count: actions and two metadata labels, never ingredients.
    """
    parsed = stores.withColumn("_s", F.from_json(json_col, STORE)).withColumn("_m", F.element_at(F.col("_s.manifests"), F.col("_s.active_manifest")))

    def values(a: Column) -> Column:
        label = F.regexp_replace(F.lower(F.coalesce(a["label"], F.lit(""))), "[^a-z0-9]", "")
        actions = F.flatten(F.transform(F.coalesce(a["data"]["actions"], F.array().cast(f"array<{_ACTION}>")), lambda x: F.array(x["digitalSourceType"], x["digital_source_type"])))
        direct = F.array(a["data"]["digitalSourceType"], a["data"]["digital_source_type"])
        return F.when(F.contains(label, F.lit("ingredient")), F.array().cast("array<string>")).when(F.rlike(label, F.lit(ACTIONS)), actions).when(label.isin(*METADATA), direct).otherwise(F.array().cast("array<string>"))

    found = F.flatten(F.transform(F.coalesce(F.col("_m.assertions"), F.array()), values))
    tokens = F.filter(F.transform(F.array_compact(found), source_token), lambda t: t != "")
    out = parsed.withColumns({"categories": F.coalesce(F.array_sort(F.array_distinct(F.transform(tokens, source_category))), F.array().cast("array<string>")), "validation_status": statuses(json_col)})
    present, clean = F.col("_m").isNotNull(), F.size("validation_status") == 0
    return out.withColumns({
        "status": F.when(~present, "absent").when(clean, "verified").otherwise("invalid"), "valid": present & clean,
        "ai_generated": present & clean & F.array_contains("categories", "generated"), "generative_involvement": present & clean & (F.array_contains("categories", "generated") | F.array_contains("categories", "generative_edit")),
        "claim_generator": F.left(F.nullif(F.col("_m.claim_generator"), F.lit("")), F.lit(300)),
    }).drop("_s", "_m")


RESPONSE = "status array<struct<response: struct<input: struct<model_version: string>>>>"


def provider_results(responses: DataFrame, id_col: str = "id", json_col: str = "response") -> DataFrame:
    """(id, error, scores, source class and score, model_version, c2pa_metadata_present): one row a response.

    error is null, or the first rule that the response breaks: json, model_version, classes, generation_classes, score_range.
    """
    read = responses.select(id_col, F.col(json_col).alias("_j"), F.from_json(json_col, RESPONSE).alias("_r"))
    rows = read.withColumns({"_c": class_scores("_j"), "model_version": F.col("_r.status")[0]["response"]["input"]["model_version"]})
    best = lambda name: F.array_max(F.transform(F.filter("_c", lambda c: c["name"] == name), lambda c: c["score"]))
    sources = F.filter("_c", lambda c: ~c["name"].isin(*NO_SOURCE))
    highest = F.array_max(F.transform(sources, lambda c: c["score"]))
    top = F.get(F.filter(sources, lambda c: c["score"] == highest), F.lit(0))  # ties: the first met
    out = rows.withColumns({"ai_generated_score": best("ai_generated"), "not_ai_generated_score": best("not_ai_generated"), "deepfake_score": best("deepfake"), "_top": top})
    outside = lambda c: F.coalesce(~F.col(c).between(0, 1), F.lit(False))
    error = (
        F.when(F.col("_r").isNull() | F.try_parse_json("_j").isNull(), "json").when(F.col("model_version").isNull() | (F.col("model_version") == "unknown"), "model_version").when(F.size("_c") == 0, "classes")
        .when(F.col("ai_generated_score").isNull() & F.col("not_ai_generated_score").isNull(), "generation_classes").when(outside("ai_generated_score") | outside("not_ai_generated_score"), "score_range")
    )
    present = F.exists(members("_j"), lambda m: F.contains(F.lower(m["key"]), F.lit("c2pa")) & ~m["empty"])
    return out.select(id_col, error.alias("error"), "model_version", "ai_generated_score", "not_ai_generated_score", "deepfake_score", F.col("_top.name").alias("source_class"), F.col("_top.score").alias("source_score"), present.alias("c2pa_metadata_present"))


def http_category(code: Column) -> Column:
    return F.when(code.isin(401, 403), "authentication").when(code == 429, "rate_limited").when(code >= 500, "service_unavailable").otherwise("request_rejected")


def media_type(content: Column) -> Column:
    """By magic bytes; null if none fits."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def asset_summaries(media: DataFrame, content_col: str = "content", id_col: str = "asset_id", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(asset_id, media_type, size_bytes, sha256, error); never a path. A missing id is made from the digest."""
    digest, size, kind = F.sha2(F.col(content_col), 256), F.octet_length(content_col).cast("long"), media_type(F.col(content_col))
    given = F.col(id_col)
    error = F.when(size == 0, "empty").when(size > max_bytes, "too_large").when(kind.isNull(), "signature").when(given.isNotNull() & ~F.rlike(given, F.lit(ASSET_ID)), "asset_id")
    return media.select(F.coalesce(given, F.concat(F.lit("asset-"), F.left(digest, F.lit(16)))).alias("asset_id"), kind.alias("media_type"), size.alias("size_bytes"), digest.alias("sha256"), error.alias("error"))


def valid_asset_id(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(ASSET_ID)), F.lit(False))


#: Media types of a summary.
MEDIA_TYPES = ("image/jpeg", "image/png", "image/gif", "image/webp")


def summary_violations(known: DataFrame) -> DataFrame:
    """(case_id, asset_id, rule) of asset summaries (case_id, asset_id, media_type, size_bytes, sha256) that a selection must not be made from; an id that a case has twice too."""
    held = {
        "invalid_asset_id": valid_asset_id(F.col("asset_id")), "media_type": F.col("media_type").isin(*MEDIA_TYPES), "size_bytes": F.col("size_bytes") >= 0, "sha256": F.rlike("sha256", F.lit(r"\A[0-9a-f]{64}\z")),
    }
    broken = known.select("case_id", "asset_id", F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in held.items()]))).alias("rule"))
    twice = known.where("asset_id is not null").groupBy("case_id", "asset_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", "asset_id", F.lit("repeated_asset").alias("rule"))
    return broken.unionByName(twice)


def selection_violations(selected: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, asset_id, rule) of selected assets whose id is invalid, unknown, or chosen twice."""
    invalid = selected.where(~valid_asset_id(F.col("asset_id"))).select("case_id", "asset_id", F.lit("invalid_asset_id").alias("rule"))
    selected = selected.where(valid_asset_id(F.col("asset_id")))
    unknown = selected.join(known, ["case_id", "asset_id"], "left_anti").select("case_id", "asset_id", F.lit("unknown_asset").alias("rule"))
    twice = selected.groupBy("case_id", "asset_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", "asset_id", F.lit("duplicate_asset").alias("rule"))
    return invalid.unionByName(unknown).unionByName(twice)


def selected_assets(selected: DataFrame, known: DataFrame) -> DataFrame:
    """The summaries (known: case_id, asset_id, media_type, size_bytes, sha256) of the selected assets (case_id, place, asset_id), with their place, of cases whose selection and summaries break no rule."""
    faulty = selection_violations(selected, known).select("case_id").unionByName(summary_violations(known).select("case_id")).distinct()
    return selected.join(faulty, "case_id", "left_anti").join(known.select("case_id", "asset_id", "media_type", "size_bytes", "sha256"), ["case_id", "asset_id"])
