import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallygrain import config
from tallygrain.functions import detect, evidence, fuzzy, jsonx, prices, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def each(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


CLEAN = [
    ("https://www.tesco.com/products/313169581?srsltid=abc", "https://www.tesco.com/products/313169581"),
    ("https://www.argos.co.uk/product/123?utm_custom6=LIA&gStoreCode=5476", "https://www.argos.co.uk/product/123?gStoreCode=5476"),
    ("https://example.com/item?gclid=abc&keep=a%20b#details", "https://example.com/item?keep=a%20b#details"),
    ("https://www.amazon.nl/drukspuit-metaal?srsltid=x&k=drukspuit+metaal", "https://www.amazon.nl/drukspuit-metaal?k=drukspuit+metaal"),
    ("https://www.amazon.nl/b?node=16462610031", "https://www.amazon.nl/b?node=16462610031"),
    ("https://www.amazon.nl/dp/B09TRRYFMY?th=1&psc=1", "https://www.amazon.nl/dp/B09TRRYFMY?th=1&psc=1"),
    ("https://example.com/item?", "https://example.com/item"),
    ("not a url", "not a url"),
    ("http://e.com/?UTM%5Fsource=1&ref=2&refer=3", "http://e.com/?refer=3"),
    (None, None),
]


def test_clean_url_and_again(spark):
    got = each(spark, [(a,) for a, _ in CLEAN], "u string", urls.clean_url(F.col("u")))
    assert got == [b for _, b in CLEAN]
    assert each(spark, [(b,) for _, b in CLEAN], "u string", urls.clean_url(F.col("u"))) == got


def test_product_pages(spark):
    rows = [("tesco", "https://www.tesco.com/shop/en-GB/products/313169581", True), ("tesco", "https://www.tesco.com/shop/en-GB/search?q=tea", False), ("amazon.nl", "https://www.amazon.nl/dp/B09TRRYFMY", True), ("amazon.nl", "https://www.amazon.nl/drukspuit-metaal?s?k=drukspuit+metaal", False), ("amazon.nl", "https://www.amazon.nl/b?node=16462610031", False), ("unmapped", "https://example.com/anything", True)]
    assert each(spark, [r[:2] for r in rows], "w string, u string", urls.is_product_url(F.col("w"), F.col("u"))) == [r[2] for r in rows]


HOSTS = [("amazon.de", "amazon.", True), ("www.amazon.de", "amazon.", True), ("amazon.co.uk", "amazon.", True), ("www.amazon.co.uk", "amazon.", True), ("notamazon.de", "amazon.", False), ("amazon.de.evil.com", "amazon.", False), ("www.tesco.com", "amazon.", False), ("www.tesco.com", "tesco.com", True), ("tesco.com", "tesco.com", True), ("www.argos.co.uk", "argos.co.uk", True), ("faketesco.com", "tesco.com", False), ("tesco.com:443", "tesco.com", False)]


def test_hosts(spark):
    assert each(spark, [h[:2] for h in HOSTS], "h string, t string", urls.host_matches(F.col("h"), F.col("t"))) == [h[2] for h in HOSTS]


def test_query_builder(spark):
    q = lambda mode, name, site: one(spark, urls.build_queries(F.lit(name), F.lit(site), mode))
    assert q("keyword", "Tea  (40g)", "tesco") == ["Tea (40g) tesco", "Tea tesco"]
    assert q("sitename", "Tea", "tesco") == ["Tea site:tesco.com"]
    assert q("both", "Tea", "tesco") == ["Tea tesco", "Tea site:tesco.com"]
    assert q("sitename", "Tea", "unknown") == ["Tea unknown"]
    assert urls.query_mode("duckduckgo") == "both"


def test_small_url_columns(spark):
    assert one(spark, urls.resolve_site(F.lit("https://www.Tesco.com:443/x"))) == "tesco"
    assert one(spark, urls.resolve_site(F.lit("https://nowhere.org"))) is None
    assert one(spark, urls.guess_site(F.lit("https://a.shop.example/x"))) == "shop"
    assert one(spark, urls.product_id(F.lit("https://www.amazon.nl/dp/B09TRRYFMY?x"), F.lit("amazon"))) == "B09TRRYFMY"
    assert one(spark, urls.search_region(F.lit(" UK "))) == "uk-en" and one(spark, urls.search_region(F.lit("xx"))) == "xx-en" and one(spark, urls.search_region(F.lit("be-nl"))) == "be-nl"
    assert one(spark, urls.search_gl(F.lit("uk"))) == "gb"


def test_text(spark):
    assert one(spark, text.normalize(F.lit("  L'Oréal "))) == "l'oreal"
    assert each(spark, [(" Tesco ",), ("",), (None,), ("NaN",)], "x string", text.cell(F.col("x"))) == ["tesco", None, None, None]
    assert one(spark, text.strip_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, text.title_core(F.lit("Tea 40g | Shop - x"))) == "Tea 40g"
    assert each(spark, [("Was £3.00",), ("£2",), ("some very new price label £5",)], "x string", text.price_label(F.col("x"))) == ["was", "", "new price label"]


BRANDS = [(["Kopparberg"], ["Kopparberg"], "pass"), (["L'Oréal"], ["Loreal"], "pass"), (["Tetley", "Tropical"], ["Tetley"], "pass"), (["Coca-Cola"], ["Pepsi"], "fail"), ([], ["Kopparberg"], "unknown"), (["Kopparberg"], [], "unknown"), ([], [], "unknown"), ([" "], ["x"], "fail")]


def test_brand_verdicts(spark):
    rows = [(a, b) for a, b, _ in BRANDS]
    assert each(spark, rows, "a array<string>, b array<string>", fuzzy.compare_brands_exact_first(F.col("a"), F.col("b"))) == [v for *_, v in BRANDS]
    assert fuzzy.brands_verdict(["Coca-Cola", "Cole"], ["Cola"]) != "fail"
    assert fuzzy.weighted_ratio("abc", "abc") == 100 and fuzzy.weighted_ratio("", "a") == 0 and fuzzy.common("kitten", "sitting") == 4


def product(**x):
    base = dict(url="u", website="w", scraped_at="2024-01-01 00:00:00", source_type="html", title="t", in_stock="true", price="2", list_price=None, membership_price=None, image_urls=["i"])
    return base | x


CONTRACT = [
    (dict(), []),
    (dict(price=None), [prices.PRICE_MISSING]),
    (dict(price="0"), [prices.PRICE_MISSING]),
    (dict(list_price="2"), [prices.LIST_TOO_LOW]),
    (dict(list_price="3"), []),
    (dict(membership_price="2"), [prices.MEMBER_TOO_HIGH]),
    (dict(membership_price="1.5", list_price="3"), []),
    (dict(price=None, in_stock="false", membership_price="0"), [prices.MEMBER_NOT_POSITIVE]),
    (dict(price=None, in_stock="false", image_urls=[]), [prices.NO_SIGNALS]),
    (dict(price=None, in_stock="false"), []),
    (dict(title=None), ["title: missing"]),
    (dict(price="x"), ["price: not a number"]),
    (dict(in_stock="maybe"), ["in_stock: not a boolean"]),
]


def test_gates(spark):
    schema = "url string, website string, scraped_at string, source_type string, title string, in_stock string, price string, list_price string, membership_price string, image_urls array<string>, i int"
    df = spark.createDataFrame([tuple(product(**x).values()) + (i,) for i, (x, _) in enumerate(CONTRACT)], schema)
    assert [r.errors for r in prices.validate(df).orderBy("i").collect()] == [e for _, e in CONTRACT]
    prices.register_rule("w", lambda d: F.when(F.col("title") == "t", "site rule"))
    try:
        assert prices.validate(df.where("i = 0")).first().errors == ["site rule"]
    finally:
        prices.SITE_RULES.clear()


def test_page_types_and_prices(spark):
    rows = [(False, 1, 2, 1, None, "out_of_stock"), (True, 2, 3, 1, "4", "membership"), (True, 2, 3, None, "4", "discounted"), (True, 2, 2, None, None, "standard"), (True, 2, None, None, "4", "multipack"), (True, 2, None, 0, "x", "standard"), (True, 2, None, None, "1", "standard")]
    cols = [F.col(c) for c in "abcde"]
    assert each(spark, [r[:5] for r in rows], "a boolean, b int, c int, d int, e string", prices.page_type(*cols)) == [r[5] for r in rows]
    price, ls, m, drop = [], [], [], []
    for case, want in (((2, 2, None), (None, None, ["list_price=2 (== price)"])), ((2, 3, 3), (3, None, ["membership_price=3 (> price)"])), ((None, 1, 1), (1, 1, [])), ((2, None, 2), (None, None, ["membership_price=2 (== price)"])), ((2, None, 0), (None, None, ["membership_price=0 (<= 0)"]))):
        a, b, d = prices.normalize_prices(*[F.lit(x).cast("int") for x in case])
        r = spark.range(1).select(a.alias("a"), b.alias("b"), d.alias("d")).first()
        assert (r.a, r.b, r.d) == want
    got = each(spark, [("In 2 days", True), ("{\"x\":\"https://schema.org/OutOfStock\"}", True), ("@context x", False), (None, True), ("", False)], "r string, s boolean", prices.availability(F.col("r"), F.col("s")))
    assert got == ["In 2 days", "Out of stock", "Out of stock", "In stock", "Out of stock"]
    assert each(spark, [("£1,234.50",), ("19.99 GBP",), ("abc",)], "x string", prices.clean_amount(F.col("x"))) == ["1234.50", "19.99", ""]
    assert each(spark, [("£1",), ("2 EUR",), ("$3",), ("4",)], "x string", prices.currency(F.col("x"))) == ["GBP", "EUR", "USD", ""]
    assert each(spark, [("19.50",), ("19.5",), ("+1",), ("x",)], "x string", prices.decimal_text(F.col("x"))) == ["19.50", "19.5", "1", "x"]
    assert each(spark, [(1,), (2,), (3,)], "x int", prices.success_path(F.col("x"))) == ["fast", "backup_1", "backup_2"]


def test_payloads(spark):
    tesco = '{"product_name":"Tea","current_price":{"value":1.5,"currency":"GBP"},"original_price":2,"product_image":"i.jpg","in_stock":true,"clubcard_price":"1.25","input":{"url":"tu"}}'
    argos = '{"product_title":"","price":3,"image_urls":["a","b"],"currency":"GBP"}'
    amazon = '{"title":"Pen","final_price":4.5,"initial_price":5,"currency":"GBP","is_available":true,"upc":"1","image_url":"p","buybox_prices":{"prime_price":4}}'
    get = lambda j, s: one(spark, prices.map_payload(F.parse_json(F.lit(j)), F.lit("u"), s))
    t, a, z = get(tesco, "tesco"), get(argos, "argos"), get(amazon, "amazon")
    assert (t.url, str(t.price), t.currency, str(t.list_price), str(t.membership_price), t.image_urls, t.in_stock, t.not_found) == ("tu", "1.5000", "GBP", "2.0000", "1.2500", ["i.jpg"], True, False)
    assert (a.not_found, str(a.price), a.image_urls, a.in_stock, a.url) == (True, "3.0000", ["a", "b"], False, "u")
    assert (z.title, str(z.price), str(z.membership_price), z.image_urls, z.gtin, z.not_found) == ("Pen", "4.5000", "4.0000", ["p"], "1", False)


def test_detection(spark):
    page = "<h1>Tea</h1> £2.50 add to cart" + " " * 5000
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"Product"}]}</script>'
    rows = [(page, 200, None), (page, 404, "http_status"), ("short", 200, "page_length"), (ld, 200, None), ("x" * 6000, 200, "multi_absence"), (page + "no longer sold", 200, "keyword_match")]
    got = each(spark, [r[:2] for r in rows], "h string, s int", detect.invalid_page(F.col("h"), F.col("s"), F.array(F.lit("No longer SOLD")))["signal"])
    assert got == [r[2] for r in rows]
    infra = [(429, "x" * 2000, None, True, "http_status"), (200, "x" * 2000, "min_size", True, None), (200, "x", "min_size", False, "error_header"), (200, "x", None, True, "near_empty_body"), (200, "502 Bad Gateway" + "x" * 2000, None, True, "upstream_page"), (200, "{}", None, False, None)]
    assert each(spark, [r[:4] for r in infra], "s int, b string, e string, h boolean", detect.infra_error(F.col("s"), F.col("b"), F.col("e"), F.col("h"))) == [r[4] for r in infra]
    assert each(spark, [("Running ",), ("error",), ("ok",), (None,)], "s string", detect.poll_state(F.col("s"))) == ["pending", "failed", "ready", "ready"]
    assert one(spark, detect.llm_route(F.lit("my-DeepSeek-x"))) == config.LLM_ROUTES["deepseek"] and one(spark, detect.llm_route(F.lit("z"))) is None
    assert each(spark, [("deepseek/z",), ("deepseek-v4-pro",), ("other",)], "m string", detect.model_provider(F.col("m"))) == ["deepseek", "deepseek", "qwen"]
    assert each(spark, [("argos", "membership"), ("argos", "standard"), ("zz", "multipack")], "s string, p string", detect.page_policy(F.col("s"), F.col("p"), "mandatory")) == [False, True, False]
    assert one(spark, detect.escalation_reason(F.array(F.lit("x"), F.lit("api_fetch")), F.array(F.lit("r"), F.lit("q")))) == "api_malformed"
    assert one(spark, detect.escalation_reason(F.array(F.lit("x")), F.array(F.lit("api_infra")))) == "infra_failure"
    files = [(b"\xef\xbb\xbfa",), (b"a\x00b",), (b"\xff\xfe",), ("a�".encode(),), ("cafÃ©".encode(),), ("café".encode(),)]
    assert each(spark, files, "b binary", detect.encoding_fault(F.col("b"))) == ["bom", None, "invalid", "replacement", "mojibake", None]
    assert [detect.ParserScan.fault(c) for c in ("import re\nx = 1", "import os", "eval('1')", "().__class__", "def (")] == [None, "import: os", "name: eval", "attribute: __class__", "syntax: invalid syntax"]


def test_json(spark):
    rows = [('{"match_idx": 1, "reason": "same"}', (1, "same", False)), ('```json\n{"match_idx": null}\n```', (None, "no reason given", False)), ('sure: {"match_idx": "2"} ok', (2, "no reason given", False)), ("no json", (None, "llm parse error", True)), ('{"match_idx": "x"}', (None, "llm parse error", True)), (None, (None, "llm parse error", True)), ("[1]", (None, "llm parse error", True))]
    assert [tuple(x) for x in each(spark, [(r[0],) for r in rows], "t string", jsonx.decision(F.col("t")))] == [r[1] for r in rows]
    doc = '{"a": [{"b": 5}], "1": "x", "p": {"unit_price": "2"}, "q": "1.50/kg"}'
    paths = [("a.0.b", "5"), ("1", "x"), ("a.9", None), ("a.b", None), ("", None)]
    assert each(spark, [(doc, p) for p, _ in paths], "d string, p string", jsonx.lookup_any(F.col("d"), F.col("p"))) == [v for _, v in paths]
    heal = spark.createDataFrame([(1, doc, ["price", "title"], {"title": "1", "price": "p.unit_price"}), (2, doc, ["price", "title"], {"title": "1", "price": "none"}), (3, doc, ["title"], {"title": "a.0.b", "brand": "none"}), (4, doc, ["price"], {"price": "q"})], "id int, document string, missing array<string>, mapping map<string,string>")
    assert {r.id: r.healed for r in jsonx.heal(heal).collect()} == {1: {"title": "x"}, 2: None, 3: {"title": "5"}, 4: {}}
    assert one(spark, jsonx.missing_fields(F.array(F.lit("Title: missing"), F.lit("no price")))) == ["price", "title"]
    assert one(spark, jsonx.kept_nulls(F.struct(F.lit(None).cast("string").alias("a")))) == '{"a":null}'
    x = jsonx.first_mismatch({"a": F.lit("1"), "b": F.lit("2")}, {"a": F.lit("1"), "b": F.lit("3")})
    assert tuple(one(spark, x)) == ("b", "2", "3")
    df = spark.createDataFrame([(1, '{"a":1}\nbad\n{"a":2}'), (2, "[1,2]"), (3, '{"a":3}')], "id int, body string")
    assert sorted((r.id, r.j) for r in jsonx.json_lines(df).select("id", F.to_json("record").alias("j")).collect()) == [(1, '{"a":1}'), (1, '{"a":2}'), (2, "1"), (2, "2"), (3, '{"a":3}')]
    assert one(spark, jsonx.key_summary(F.lit('{"a": {"b": [{"c": 1}]}}')))[:2] == ["a: dict", "a.b: list"]


PAGES = [
    ("discount", '<html><h1>Tea</h1><div class="price-block"><span class="was">Was £3.00</span> <b>Now £2.50</b></div></html>', "discount", dict(current_price="2.50", reference_price="3.00")),
    ("member", '<h1>Tea</h1><div class="buy-box clubcard-price"><b>£2.00</b> Clubcard price <i>£2.50</i></div>', "membership", dict(member_price="2.00", regular_price="2.50")),
    ("nonmember", '<h1>Tea</h1><div class="buy-box non-clubcard"><b>£2.00</b> each</div>', None, dict(current_price="2.00")),
    ("plain", '<h1>Tea</h1><div class="price-block">£2.00 <small>£4.00/kg</small></div>', None, dict(current_price="2.00")),
]


@pytest.mark.parametrize(("name", "html", "kind", "some"), PAGES)
def test_promotions(name, html, kind, some):
    got = evidence.promotion(html, None)
    assert got["kind"] == kind and {k: got[k] for k in some} == some


def test_price_evidence(spark):
    html = (
        '<html><head><title>Tea 40g | Shop</title><meta name="description" content="regular price £2.50 today"></head><body><h1>Tea 40g</h1><p>Was <s>£3.00</s> now £2.50 (£6.00/kg)</p>'
        '<div class="guide-price">£0.00</div><div class="recommended"><h2>Other</h2>£9.99</div><script>var x = "£7";</script>'
        '<script type="application/ld+json">{"@type":"Product","name":"Tea 40g","sku":"77","offers":{"price":"2.50","priceCurrency":"GBP","sku":"77","shippingRate":{"price":1}}}</script></body></html>'
    )
    df = spark.createDataFrame([("u", html, "77"), ("v", None, None)], "url string, html string, pid string")
    rows = evidence.price_evidence(df, pid_col="pid").orderBy("pos").collect()
    told = [(r.source, r.value, r.struck, r.unit_price, r.anchored) for r in rows]
    assert told == [("dom_text", "3.00", True, False, False), ("dom_text", "2.50", False, False, True), ("dom_text", "6.00", False, True, False), ("meta", "2.50", False, False, True), ("json_ld", "2.50", False, False, True)]
    assert [r.label for r in rows if r.source == "meta"] == ["regular"]
    spec = [p["source_path"] for p in evidence.json_prices({"offers": {"priceSpecification": {"price": 3}, "priceCurrency": "GBP"}}, "", None)]
    assert spec == ["offers.priceSpecification.price", "offers.priceSpecification.price"] or len(spec) == 2
    assert one(spark, evidence.plain_context(F.lit(html)))["json_ld"][0].startswith('{"@type"')
    assert one(spark, evidence.distrusted(F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("ok"), F.lit("membership"))) == "missed_membership"
