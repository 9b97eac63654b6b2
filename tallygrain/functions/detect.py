"""What a fetched page or record is: infrastructure failure, invalid target, product page."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrain import config

# Signs of a product page.
TITLE_SIGNS = [r"<h1[^>]*>[^<]+</h1>", r'data-test="product-title"', r'data-auto="pdp-product-title"', r'"name"\s*:\s*"[^"]{3,}"']
PRICE_SIGNS = [r"[£€$]\s*\d+[\d,.]*", r"\d+[\d,.]*\s*[£€$]", r'"price"\s*:\s*[\d.]+', r'data-test="product-price', r'data-auto="price-value']
CART_SIGNS = [r"add[- _]?to[- _]?(?:cart|bag|basket|trolley)", r"buy[- _]?now", r"in den (?:Einkaufs)?wagen", r"ajouter au panier"]
JSON_LD = re.compile(r"""<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.I | re.S)


def any_sign(html: Column, signs: list[str]) -> Column:
    return html.rlike("(?i)" + "|".join(f"(?:{s})" for s in signs))


@F.pandas_udf(T.BooleanType())
def _declares_product(html: pd.Series) -> pd.Series:
    def product(node) -> bool:
        return isinstance(node, dict) and (node.get("@type") == "Product" or any(isinstance(x, dict) and x.get("@type") == "Product" for x in node.get("@graph", [])))

    def one(text: str | None) -> bool:
        for block in JSON_LD.findall(text or ""):
            try:
                data = json.loads(block)
            except ValueError:
                continue
            if any(map(product, data if isinstance(data, list) else [data])):
                return True
        return False

    return html.map(one)


def has_product_schema(html: Column) -> Column:
    """A Product in the page's JSON-LD; pages that hold none of the words never leave the JVM."""
    return F.when(html.contains("ld+json") & html.contains("Product"), _declares_product(html)).otherwise(False)


def invalid_page(html: Column, status: Column, phrases: Column | None = None, settings: config.ScrapingConfig = config.ScrapingConfig()) -> Column:
    """struct(signal, detail) of an invalid target, or null: status, then length, then missing signs, then phrases; a
    declared product is always valid after its status."""
    missing = F.filter(
        F.array(
            F.when(~any_sign(html, TITLE_SIGNS), "title"), F.when(~any_sign(html, PRICE_SIGNS), "price"), F.when(~any_sign(html, CART_SIGNS), "add_to_cart")
        ),
        lambda x: x.isNotNull(),
    )
    low = F.lower(html)
    hit = F.try_element_at(F.filter(phrases, lambda p: F.contains(low, F.lower(p))), F.lit(1)) if phrases is not None else F.lit(None).cast("string")

    def signal(kind: str, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("signal"), detail.alias("detail"))

    return (
        F.when(status.isin(*config.INVALID_STATUS), signal("http_status", F.concat(F.lit("HTTP "), status.cast("string"))))
        .when(has_product_schema(html), None)
        .when(F.length(html) < settings.normal_page_length, signal("page_length", F.concat(F.length(html).cast("string"), F.lit(" chars"))))
        .when(F.size(missing) >= settings.absence_threshold, signal("multi_absence", F.array_join(missing, ", ")))
        .when(hit.isNotNull(), signal("keyword_match", hit))
    )


def poll_state(status: Column) -> Column:
    s = F.lower(F.trim(status))
    return F.when(s.isin(*config.PENDING_STATES), "pending").when(s.isin(*config.FAILED_STATES), "failed").otherwise("ready")


def infra_error(status: Column, body: Column, error_code: Column, expect_html: Column, settings: config.ScrapingConfig = config.ScrapingConfig()) -> Column:
    """The kind of an infrastructure failure, or null."""
    page, n = expect_html & (status == 200), F.length(F.coalesce(body, F.lit("")))
    code = F.coalesce(error_code, F.lit(""))
    marker = F.exists(F.array(*[F.lit(m) for m in config.UPSTREAM_MARKERS]), lambda m: F.contains(body, m))
    return (
        F.when(status.isin(*config.INFRA_STATUS), "http_status")
        .when((code != "") & ~(page & (n >= settings.infra_body_length)), "error_header")
        .when(page & (n < settings.infra_body_length), "near_empty_body")
        .when(page & (n < settings.normal_page_length) & marker, "upstream_page")
    )


def is_rate_limit(message: Column) -> Column:
    return message.rlike("(?i)ratelimit|rate limit|429|too many requests")


def search_error_kind(message: Column, budget_exhausted: Column) -> Column:
    low = F.lower(message)
    return F.when(budget_exhausted & low.contains("budget"), "BudgetExhausted").when(low.rlike("429|rate limit|ratelimit"), "RateLimit").otherwise("SearchProviderError")


def escalation_reason(stages: Column, rules: Column) -> Column:
    """Of a failed scrape's stages and rule names, in order."""
    last = F.try_element_at(stages, F.lit(-1))
    infra = F.forall(rules, lambda r: F.coalesce(r.isin("extraction_infra", "api_infra"), F.lit(False)))
    return F.when(F.coalesce(F.size(stages), F.lit(0)) <= 0, "parser_broken").when(infra, "infra_failure").when(last.isin("api_malformed", "api_fetch"), "api_malformed").otherwise("parser_broken")


def signature(site: Column, rule: Column, version: Column) -> Column:
    return F.concat_ws("|", site, F.coalesce(rule, F.lit("unknown")), F.coalesce(version, F.lit("none")))


def llm_route(model: Column) -> Column:
    """The route whose keyword, the longest one found in the model's name, wins; null without any."""
    hits = F.array(*[F.when(F.lower(model).contains(k.lower()), F.struct(F.lit(len(k)).alias("n"), F.lit(url).alias("url"))) for k, url in config.LLM_ROUTES.items()])
    return F.array_max(F.filter(hits, lambda h: h.isNotNull()))["url"]


def model_provider(model: Column) -> Column:
    """An explicit 'provider/model' prefix, else who lists the model, else the default."""
    prefix = F.substring_index(model, "/", 1)
    out = F.lit(config.DEFAULT_PROVIDER)
    for name, models in config.MODEL_PROVIDERS.items():
        out = F.when(model.isin(*models), name).otherwise(out)
    return F.when(model.contains("/") & prefix.isin(*config.MODEL_PROVIDERS), prefix).otherwise(out)


def page_policy(site: Column, page_type: Column, field: str) -> Column:
    """available or mandatory of a page type on a site; what no profile says is available, and as mandatory as by default."""
    i = {"available": 0, "mandatory": 1}[field]
    table = {f"{s}|{p}": v[i] for s, types in config.SITE_PROFILES.items() for p, v in types.items()}
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.concat_ws("|", site, page_type))
    if field == "available":
        return F.coalesce(own, F.lit(True))
    usual = F.try_element_at(F.create_map(*[F.lit(x) for kv in config.MANDATORY_PAGE_TYPES.items() for x in kv]), page_type)
    return F.coalesce(own, usual, F.lit(True))


def golden_min(site: Column, page_type: Column) -> Column:
    return F.when(page_policy(site, page_type, "mandatory"), 1).otherwise(0)


def membership_hints(site: str) -> set[str]:
    return set(config.MEMBERSHIP_HINTS.get(site, []))


def exit_code(status: Column) -> Column:
    return F.when(status.isin("completed", "ok", "success"), 0).when(status.isin("stopped", "aborted"), 2).otherwise(1)


def encoding_fault(content: Column) -> Column:
    """Of a file's bytes: bom, invalid, replacement or mojibake; null for sound and for binary files (a NUL in 8 KiB)."""
    text = F.try_validate_utf8(content.cast("string"))
    return (
        F.when(F.contains(F.substring(content, 1, 8192), F.lit(b"\x00")), None)
        .when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", "bom")
        .when(text.isNull() & content.isNotNull(), "invalid")
        .when(text.contains("�"), "replacement")
        .when(text.rlike("Ã[\x80-\xbf]|â€"), "mojibake")
    )


class ParserScan:
    """Faults of a user-supplied parser's source; the source is never run."""

    @staticmethod
    def fault(code: str | None) -> str | None:
        import ast

        try:
            tree = ast.parse(code or "")
        except SyntaxError as e:
            return f"syntax: {e.msg}"
        for node in ast.walk(tree):
            if isinstance(node, ast.Import | ast.ImportFrom):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""]
                for n in names:
                    if n.split(".")[0] not in config.PARSER_IMPORTS:
                        return f"import: {n}"
            elif isinstance(node, ast.Name) and node.id in config.FORBIDDEN_NAMES + config.FORBIDDEN_ROOTS:
                return f"name: {node.id}"
            elif isinstance(node, ast.Attribute) and node.attr in config.FORBIDDEN_DUNDERS:
                return f"attribute: {node.attr}"
        return None


@F.pandas_udf(T.StringType())
def parser_fault(code: pd.Series) -> pd.Series:
    return code.map(ParserScan.fault)
