"""JSON columns: lenient parsing, dotted paths, healing by mapping, comparing records."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrain import config
from tallygrain.functions.text import strip_fence

UNIT_KEY = r"(?i)unit[_\-\s]?price|price[_\-\s]?per[_\-\s]?unit|per[_\-\s]?unit|unit[_\-\s]?cost|\bppu\b"
UNIT_VALUE = r"(?i)\d[\d.,]*\s*[£€$]?\s*(?:GBP|EUR|USD)?\s*(?:/|\bper\b)\s*(?:kg|g|l|ltr|litre|ml|cl|100\s*g|100\s*ml|oz|lb|each|unit|item|sheet)"
PRICE_FIELDS = ("price", "list_price", "membership_price")


def lenient(text: Column) -> Column:
    """Variant of a reply: fence off, then the whole, else from the first brace to the last."""
    bare = strip_fence(F.coalesce(text, F.lit("")))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))))


def decision(text: Column) -> Column:
    """struct(match_idx, reason, parse_error) of a model's reply."""
    v = lenient(text)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    raw = F.try_variant_get(v, "$.match_idx", "string")
    idx = F.coalesce(raw.try_cast("int"), raw.try_cast("double").cast("int"))
    bad = v.isNull() | ~F.coalesce(is_object, F.lit(False)) | (raw.isNotNull() & idx.isNull())
    reason = F.coalesce(F.nullif(F.trim(F.try_variant_get(v, "$.reason", "string")), F.lit("")), F.lit("no reason given"))
    return F.struct(F.when(~bad, idx).alias("match_idx"), F.when(bad, "llm parse error").otherwise(reason).alias("reason"), bad.alias("parse_error"))


def token_usage(v: Column) -> Column:
    get = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "long") for p in paths])
    return F.struct(get("$.input_tokens", "$.prompt_tokens").alias("prompt"), get("$.output_tokens", "$.completion_tokens").alias("completion"), get("$.total_tokens").alias("total"))


def variant_path(path: str) -> str:
    """A dotted path with list positions as a variant path."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split(".") if p)


def lookup(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, variant_path(path), kind) if path else F.lit(None).cast(kind)


def walk(data, path: str):
    """A dotted path in plain data; a number is a position in a list and a key in an object."""
    at = data
    for p in path.split(".") if path else [None]:
        if isinstance(at, list) and p and p.isdigit() and int(p) < len(at):
            at = at[int(p)]
        elif isinstance(at, dict):
            at = at.get(p)
        else:
            return None
    return at


@F.pandas_udf(T.StringType())
def lookup_any(document: pd.Series, path: pd.Series) -> pd.Series:
    """The value at a dotted path that each row names, as JSON text."""

    def one(d, p):
        try:
            x = walk(json.loads(d), p)
        except (TypeError, ValueError):
            return None
        return x if x is None or isinstance(x, str) else json.dumps(x)

    return pd.Series([one(d, p) for d, p in zip(document, path)])


def is_unit_price(target: Column, path: Column, value: Column) -> Column:
    """Whether a price field would be fed from a rate."""
    return target.isin(*PRICE_FIELDS) & (F.coalesce(path.rlike(UNIT_KEY), F.lit(False)) | F.coalesce(value.rlike(UNIT_VALUE), F.lit(False)))


def missing_fields(errors: Column, fields: tuple[str, ...] = config.COMPARE_FIELDS) -> Column:
    """Fields that the error texts name, sorted. No lambda holds the errors, which it would work out anew for each field."""
    if not all(f and "\n" not in f for f in fields):
        raise ValueError("a field's name is one line of text")
    low, none = F.lower(F.array_join(errors, "\n")), F.array().cast("array<string>")
    return F.concat(none, *[F.when(F.contains(low, F.lit(f)), F.array(F.lit(f))).otherwise(none) for f in sorted(fields)])


def heal(df: DataFrame) -> DataFrame:
    """Rows (id, document, missing, mapping<target,path>) to id and healed, the values a proposed mapping gives for missing
    fields. One path that leads nowhere voids the whole mapping; unit rates are never taken for prices."""
    each = df.select("id", "document", "missing", F.explode_outer("mapping").alias("target", "path"))
    each = each.where(F.array_contains("missing", F.col("target")) | F.col("target").isNull())
    each = each.withColumn("value", lookup_any("document", "path"))
    ok = F.bool_and(F.col("value").isNotNull())
    taken = F.filter(F.collect_list(F.when(~is_unit_price(F.col("target"), F.col("path"), F.col("value")), F.struct("target", "value"))), lambda x: x.isNotNull())
    grouped = each.where("target is not null").groupBy("id").agg(ok.alias("ok"), F.map_from_entries(taken).alias("healed"))
    return df.select("id").distinct().join(grouped, "id", "left").select("id", F.when(F.col("ok"), F.col("healed")).alias("healed"))


def heal_cached(target: Column, document: Column, path: Column) -> Column:
    """A known mapping applied where the target is null."""
    return F.coalesce(target, lookup_any(document, path))


def kept_nulls(x: Column) -> Column:
    return F.to_json(x, {"ignoreNullFields": "false"})


def first_mismatch(expected: dict[str, Column], actual: dict[str, Column]) -> Column:
    """struct(field, expected, actual) of the first field that differs, or null."""
    each = [F.when(~expected[f].eqNullSafe(actual[f]), F.struct(F.lit(f).alias("field"), expected[f].alias("expected"), actual[f].alias("actual"))) for f in expected]
    return F.try_element_at(F.filter(F.array(*each), lambda x: x.isNotNull()), F.lit(1))


@F.pandas_udf(T.ArrayType(T.StringType()))
def key_summary(document: pd.Series) -> pd.Series:
    """'path: type' lines of a document's keys, three levels deep, at most 100."""

    def lines(node, path, depth, out):
        if depth > 3 or len(out) >= 100:
            return
        if isinstance(node, dict):
            for k, v in node.items():
                if len(out) < 100:
                    out.append(f"{path}{k}: {type(v).__name__}")
                    lines(v, f"{path}{k}.", depth + 1, out)
        elif isinstance(node, list) and node:
            lines(node[0], f"{path}0.", depth + 1, out)

    def one(d):
        out: list[str] = []
        try:
            lines(json.loads(d), "", 1, out)
        except (TypeError, ValueError):
            pass
        return out

    return document.map(one)


def json_lines(df: DataFrame, column: str = "body") -> DataFrame:
    """Records of bodies that hold a JSON array, one object, or JSON lines; lines that do not parse are left out."""
    body = F.trim(F.col(column))
    # parsing stops at the end of the first value, so what the first line holds tells lines from one document
    first = F.try_parse_json(F.substring_index(body, "\n", 1))
    lines = F.transform(F.split(body, "\n"), lambda x: F.try_parse_json(x))
    items = F.when(body.startswith("["), F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")).when(first.isNotNull(), lines).otherwise(F.array(F.try_parse_json(body)))
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(items).alias("pos", "record")).where("record is not null")


def unknown_keys(document: Column, known: list[str]) -> Column:
    """Keys of a JSON object that are not among the known ones, sorted."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")), F.array(*map(F.lit, known))))


def flattened(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON records as columns beside the others; fields that a record lacks are null."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.from_json(column, schema).alias("_record")).select(*rest, "_record.*")
