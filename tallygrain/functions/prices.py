"""The price contract: gates, normaliser, page types, availability, payload mapping. All columns of plain functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain import config

DEC = "decimal(18,4)"
#: Gate-2 rules of single sites: site -> functions of the row's columns to a violation or null.
SITE_RULES: dict[str, list] = {}

LIST_TOO_LOW = "list_price must be greater than price"
MEMBER_TOO_HIGH = "membership_price must be lower than price"
MEMBER_NOT_POSITIVE = "membership_price must be positive"
PRICE_MISSING = "in stock but price is not positive"
NO_SIGNALS = "out of stock and neither image nor price"


def register_rule(site: str, rule) -> None:
    SITE_RULES.setdefault(site, []).append(rule)


def decimal_or_null(x: Column) -> Column:
    return x.try_cast(DEC)


def structural_violation(price: Column, list_price: Column, member: Column) -> Column:
    """The first structural fault, or null; orderings are judged only where there is a price."""
    return (
        F.when(price.isNotNull() & (list_price <= price), LIST_TOO_LOW)
        .when(price.isNotNull() & (member >= price), MEMBER_TOO_HIGH)
        .when(member <= 0, MEMBER_NOT_POSITIVE)
    )


def core_violation(in_stock: Column, price: Column) -> Column:
    return F.when(in_stock & (price.isNull() | (price <= 0)), PRICE_MISSING)


def stock_signal_violation(in_stock: Column, has_image: Column, *prices: Column) -> Column:
    return F.when(~in_stock & ~has_image & F.coalesce(*prices).isNull(), NO_SIGNALS)


def violations(df: DataFrame) -> Column:
    """Gate 2 of rows with website, price, list_price, membership_price, in_stock and image_urls: all violations in order."""
    c = F.col
    has_image = F.coalesce(F.size("image_urls") > 0, F.lit(False))
    rules = [
        structural_violation(c("price"), c("list_price"), c("membership_price")),
        core_violation(c("in_stock"), c("price")),
        stock_signal_violation(c("in_stock"), has_image, c("price"), c("list_price"), c("membership_price")),
    ]
    rules += [F.when(c("website") == site, rule(df)) for site, own in SITE_RULES.items() for rule in own]
    return F.filter(F.array(*rules), lambda v: v.isNotNull())


REQUIRED = {"url": "string", "website": "string", "scraped_at": "timestamp", "source_type": "string", "title": "string", "in_stock": "boolean"}
OPTIONAL = {"price": DEC, "list_price": DEC, "membership_price": DEC}


def gate1_errors(df: DataFrame) -> Column:
    """Gate 1 of rows of text columns: required fields that are missing or of another type, and prices that are no numbers."""
    faults = [F.when(F.col(f).isNull(), f"{f}: missing").when(F.col(f).try_cast(t).isNull(), f"{f}: not a {t}") for f, t in REQUIRED.items()]
    faults += [F.when(F.col(f).isNotNull() & F.col(f).try_cast(t).isNull(), f"{f}: not a number") for f, t in OPTIONAL.items()]
    return F.filter(F.array(*faults), lambda x: x.isNotNull())


def validate(df: DataFrame) -> DataFrame:
    """Both gates: adds errors; the second gate runs where the first finds nothing."""
    first = gate1_errors(df)
    typed = df.select("*", first.alias("_first")).select(*[c for c in df.columns if c not in {**REQUIRED, **OPTIONAL}], *[F.col(f).try_cast(t).alias(f) for f, t in {**REQUIRED, **OPTIONAL}.items()], "_first")
    return typed.withColumn("errors", F.when(F.size("_first") > 0, F.col("_first")).otherwise(violations(typed))).drop("_first")


def normalize_prices(price: Column, list_price: Column, member: Column) -> tuple[Column, Column, Column]:
    """(list price, membership price, what was dropped): fields that break the contract go."""
    bad_list = price.isNotNull() & (list_price <= price)
    low_member = member <= 0
    high_member = price.isNotNull() & (member >= price)

    def told(name: str, value: Column, relation: Column) -> Column:
        return F.concat(F.lit(f"{name}="), value.cast("string"), F.lit(" ("), relation, F.lit(")"))

    dropped = F.array(
        F.when(bad_list, told("list_price", list_price, F.when(list_price == price, "== price").otherwise("< price"))),
        F.when(low_member, told("membership_price", member, F.lit("<= 0"))).when(high_member, told("membership_price", member, F.when(member == price, "== price").otherwise("> price"))),
    )
    return (
        F.when(F.coalesce(bad_list, F.lit(False)), None).otherwise(list_price),
        F.when(F.coalesce(low_member | high_member, F.lit(False)), None).otherwise(member),
        F.filter(dropped, lambda x: x.isNotNull()),
    )


def page_type(in_stock: Column, price: Column, list_price: Column, member: Column, pack_qty: Column) -> Column:
    return (
        F.when(~in_stock, "out_of_stock")
        .when(member > 0, "membership")
        .when(list_price > price, "discounted")
        .when(pack_qty.try_cast("int") > 1, "multipack")
        .otherwise("standard")
    )


def availability(raw: Column, in_stock: Column) -> Column:
    """A short label stays; a schema.org token inside a blob is recovered; else the stock flag decides."""
    low = F.lower(raw)
    out = F.when((raw != "") & (F.length(raw) <= 80) & ~raw.contains("{") & ~raw.contains("@context"), raw)
    for token, label in config.AVAILABILITY.items():
        out = out.when(low.contains(token), label)
    return out.otherwise(F.when(in_stock, "In stock").otherwise("Out of stock"))


def success_path(order: Column) -> Column:
    return F.when(order <= 1, "fast").otherwise(F.concat(F.lit("backup_"), (order - 1).cast("string")))


def currency(text: Column) -> Column:
    up = F.upper(text)
    out = F.lit("")
    for symbol, code in (("$", "USD"), ("€", "EUR"), ("£", "GBP")):
        out = F.when(text.contains(symbol) | up.contains(code), code).otherwise(out)
    return out


def clean_amount(text: Column) -> Column:
    """The number of an amount as text, or ''."""
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, "[£€$]", "")), r"(?i)\s*(GBP|EUR|USD)\s*$", ""))
    bare = F.regexp_replace(bare, ",", "")
    return F.when(bare.try_cast("double").isNotNull(), bare).otherwise("")


def decimal_text(text: Column) -> Column:
    """Numeric text as it compares in golden exams: the digits as written, so 19.5 and 19.50 differ."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)\.", "$10.")).otherwise(text)


# ---- payloads -----------------------------------------------------------------------------------------------------


def _get(payload: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(payload, path, kind)


def _amount(payload: Column, path: str) -> Column:
    """A scalar, or the value of an object."""
    return decimal_or_null(F.coalesce(_get(payload, f"{path}.value"), F.when(_get(payload, f"{path}.value").isNull(), _get(payload, path))))


def _positive(*options: Column) -> Column:
    """The first that is neither null nor zero."""
    return F.coalesce(*[F.when(o != 0, o) for o in options])


def map_payload(payload: Column, url: Column, site: str) -> Column:
    """A site's API payload (variant) as a product struct; not_found tells a payload without a product."""
    if site == "amazon":
        title, error = _get(payload, "$.title"), _get(payload, "$.error")
        images = F.coalesce(F.nullif(F.try_variant_get(payload, "$.images", "array<string>"), F.array().cast("array<string>")), F.when(F.coalesce(_get(payload, "$.image_url"), _get(payload, "$.image")).isNotNull(), F.array(F.coalesce(_get(payload, "$.image_url"), _get(payload, "$.image")))), F.array().cast("array<string>"))
        member = _positive(*[decimal_or_null(_get(payload, f"$.buybox_prices.{k}")) for k in ("member_price", "prime_price", "loyalty_price")])
        fields = dict(url=F.coalesce(_get(payload, "$.url"), url), title=F.coalesce(title, F.lit("")), brand=_get(payload, "$.brand"), gtin=_get(payload, "$.upc"), image_urls=images, price=decimal_or_null(_get(payload, "$.final_price")), currency=_get(payload, "$.currency"), list_price=decimal_or_null(_get(payload, "$.initial_price")), membership_price=member, in_stock=F.coalesce(_get(payload, "$.is_available", "boolean"), F.lit(False)), availability_raw=_get(payload, "$.availability"), not_found=(F.coalesce(error, F.lit("")) != "") | (F.coalesce(title, F.lit("")) == ""))
    elif site in ("argos", "tesco"):
        name, now, was, image = ("product_title", "price", "list_price", "image_urls") if site == "argos" else ("product_name", "current_price", "original_price", "product_image")
        title = _get(payload, f"$.{name}")
        one = F.nullif(_get(payload, f"$.{image}"), F.lit(""))
        images = F.coalesce(F.try_variant_get(payload, f"$.{image}", "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
        member = _positive(*[decimal_or_null(_get(payload, f"$.{k}")) for k in ("member_price", "clubcard_price", "loyalty_price")]) if site == "tesco" else F.lit(None).cast(DEC)
        fields = dict(url=F.coalesce(_get(payload, "$.input.url"), url), title=F.coalesce(title, F.lit("")), brand=_get(payload, "$.brand") if site == "tesco" else F.lit(None).cast("string"), gtin=F.lit(None).cast("string"), image_urls=images, price=_amount(payload, f"$.{now}"), currency=F.coalesce(_get(payload, f"$.{now}.currency"), _get(payload, "$.currency")), list_price=_amount(payload, f"$.{was}"), membership_price=member, in_stock=F.coalesce(_get(payload, "$.in_stock", "boolean"), F.lit(False)), availability_raw=_get(payload, "$.availability") if site == "tesco" else F.lit(None).cast("string"), not_found=F.coalesce(title, F.lit("")) == "")
    else:
        raise ValueError(f"no mapping for {site}")
    return F.struct(F.lit(site).alias("website"), F.lit("api").alias("source_type"), *[v.alias(k) for k, v in fields.items()])


def capture_summary(present: dict[str, Column], in_stock: Column, price: Column) -> tuple[Column, Column, Column]:
    """(captured, missing required, missing optional) field names; an in-stock product needs a price."""
    required = {"title": F.lit(True), "in_stock": F.lit(True), "price": in_stock & (price.isNull() | (price == 0))}
    optional = ("brand", "gtin", "image_urls", "currency", "list_price", "membership_price", "availability_raw", "variant")
    none = F.array().cast("array<string>")
    ok = lambda f: F.coalesce(present[f], F.lit(False)) if f in present else F.lit(False)

    def told(names: dict[str, Column]) -> Column:
        return F.concat(*[F.when(on, F.array(F.lit(f))).otherwise(none) for f, on in names.items()])

    return (
        told({f: on & ok(f) for f, on in required.items()} | {f: ok(f) for f in optional}),
        told({f: on & ~ok(f) for f, on in required.items()}),
        told({f: ~ok(f) for f in optional}),
    )
