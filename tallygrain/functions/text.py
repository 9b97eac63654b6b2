"""Text columns: normalising, brands, small parsers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrain import config


def cell(x: Column) -> Column:
    """A workbook cell: trimmed, lower-cased, empty as null."""
    return F.nullif(F.lower(F.trim(F.nullif(x.cast("string"), F.lit("NaN")))), F.lit(""))


def fold(text: str) -> str:
    """Accents off, lower case, trimmed."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower().strip()


@F.pandas_udf(T.StringType())
def remove_accents(s: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)), na_action="ignore")


def normalize(x: Column) -> Column:
    """Accents off, lower case, trimmed; texts of ASCII only stay in the JVM."""
    return F.trim(F.lower(F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(remove_accents(x))))


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def product_key(x: Column) -> Column:
    return F.md5(F.lower(F.trim(x)).cast("binary"))


def contains_either(a: Column, b: Column) -> Column:
    """One text in the other, either way."""
    return F.contains(a, b) | F.contains(b, a)


def keyword_pattern(words: list[str]) -> str:
    """An alternation, longest first; blanks and hyphens inside a phrase stand for each other."""
    parts = {r"[\s-]+".join(re.escape(p) for p in re.split(r"[\s-]+", w.strip()) if p) for w in words if w.strip()}
    return "|".join(sorted(parts, key=lambda p: (-len(p), p))) or "(?!)"


def price_label(raw: Column) -> Column:
    """The last words before an amount, lower case, when they look like a label."""
    before = F.trim(F.regexp_extract(raw, r"(?s)^(.*?)[£€$]\s?\d", 1))
    words = F.filter(F.split(before, r"\s+"), lambda w: w != "")
    label = F.lower(F.array_join(F.when(F.size(words) > 3, F.slice(words, -3, 3)).otherwise(words), " "))
    noise = ((F.length(label) <= 2) & label.rlike(r"[^\x00-\x7f]")) | label.rlike(r"^[^\x00-\x7f ]+[^\x00-\x7f ]*$")
    known = F.exists(F.array(*[F.lit(w) for w in config.LABEL_WORDS]), lambda w: F.contains(label, w))
    return F.when(noise, "").when(known | (F.length(label) <= 40), label).otherwise("")


def title_core(title: Column) -> Column:
    """A page title without the shop's suffix."""
    out = title
    for mark in (" | ", " - ", " – "):
        out = F.substring_index(out, mark, 1)
    return F.trim(out)


def shorten(x: Column, limit: int = 180) -> Column:
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("…"))).otherwise(x)


def strip_fence(x: Column) -> Column:
    """JSON without a code fence around it."""
    return F.trim(F.regexp_replace(x, r"(?im)^```(?:json)?\s*|\s*```$", ""))


def excerpt(html: Column, limit: int) -> Column:
    """JSON-LD blocks first, then the head, then as much of the body as fits."""
    blocks = F.array_join(F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>.*?</script>'), F.lit(0)), "\n")
    head = F.regexp_extract(html, r"(?is)<head[^>]*>.*?</head>", 0)
    body = F.regexp_extract(html, r"(?is)<body[^>]*>.*", 0)
    return F.substring(F.concat_ws("\n", F.nullif(blocks, F.lit("")), F.nullif(head, F.lit("")), F.when(body == "", html).otherwise(body)), 1, limit)


def leading_token(text: Column) -> Column:
    """The first word as a one-element array, if it is in capitals, of two characters and more, and no number."""
    token = F.element_at(F.split(F.trim(text), r"\s+"), 1)
    ok = (F.upper(token) == token) & (F.lower(token) != token) & (F.length(token) >= 2) & ~token.rlike(r"^\d+$")
    return F.when(ok, F.array(token)).otherwise(F.array().cast("array<string>"))
