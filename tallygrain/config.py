"""Dimensions and settings. They must be as they are for results to match."""

from __future__ import annotations

from dataclasses import dataclass

# Website -> host. A value that ends in a dot is a registrable name under any TLD.
DOMAIN_MAP = {"tesco": "tesco.com", "argos": "argos.co.uk", "amazon.co.uk": "amazon.co.uk", "amazon.nl": "amazon.nl"}
# Tracking parameters; a trailing * matches a prefix.
STRIP_QUERY_PARAMS = ["srsltid", "gclid", "gbraid", "wbraid", "dclid", "fbclid", "msclkid", "ttclid", "igshid", "mc_cid", "mc_eid", "utm_*", "ref", "ref_"]
# Website -> path of a product page.
PRODUCT_PATH = {
    "tesco": r"/products/\d+",
    "argos": r"/product/\d+",
    "amazon": r"/(dp|gp/product)/[A-Z0-9]{10}",
    "amazon.co.uk": r"/(dp|gp/product)/[A-Z0-9]{10}",
    "amazon.nl": r"/(dp|gp/product)/[A-Z0-9]{10}",
}
# Provider -> query construction.
QUERY_MODE = {"duckduckgo": "both", "serper": "keyword"}
QUERY_MODES = ("keyword", "sitename", "both")
PROVIDERS = ("duckduckgo", "serper")
SEARCH_K, STRIP_PARENS = 10, True
FUZZY_SAME, FUZZY_DIFFER = 88, 40
CONTINUOUS_TOLERANCE, AMBIGUITY_WINDOW = 0.10, 20

# Locale words of the quantity grammar.
DECIMAL_COMMA_COUNTRIES = ["de", "fr", "nl", "es", "it", "pt", "se", "pl", "br"]
PACK_AFTER = ["pack", "pk", "pcs", "count", "er pack", "stück", "stueck", "stk", "stuks", "stuk", "st"]
PACK_BEFORE = ["pack of", "pk of", "packung mit", "set mit", "doos van", "set van", "pak van", "lot de", "paquet de", "pack de", "boîte de", "boite de"]
INCH_WORDS = ["inch", "inches", "zoll", "pouces", "pouce"]
ABV_WORDS = ["abv", "vol", "vol.", "alc", "alc.", "alk", "alk.", "alcohol", "alkoholgehalt"]
NETWORK_GENERATIONS = [2, 3, 4, 5]
DEVICE_WORDS = ["phone", "smartphone", "mobile", "sim", "lte", "android", "galaxy", "iphone", "смартфон", "lens", "camera", "af-s", "nikkor", "dslr"]
# Unit -> factor to the attribute's base unit.
UNIT_CONVERSIONS = {
    "volume_ml": {"l": 1000, "litre": 1000, "litres": 1000, "ml": 1, "millilitre": 1, "millilitres": 1, "cubic centimetre": 1, "cl": 10, "centilitre": 10, "fluid ounce": 29.5735, "fl oz": 29.5735},
    "weight_g": {"kg": 1000, "kilogram": 1000, "kilograms": 1000, "g": 1, "gram": 1, "grams": 1, "mg": 0.001, "milligram": 0.001, "milligrams": 0.001, "ounce": 28.3495, "oz": 28.3495, "pound": 453.592, "pound-mass": 453.592, "lb": 453.592},
    "storage_gb": {"gb": 1, "gigabyte": 1, "gigabytes": 1, "tb": 1000, "terabyte": 1000, "terabytes": 1000, "mb": 0.001, "megabyte": 0.001, "megabytes": 0.001},
    "length_mm": {"mm": 1, "millimetre": 1, "millimetres": 1, "cm": 10, "centimetre": 10, "centimetres": 10, "m": 1000, "metre": 1000, "metres": 1000},
    "screen_inch": {"inch": 1},
    "power_w": {"watt": 1, "kilowatt": 1000},
    "voltage_v": {"volt": 1, "millivolt": 0.001},
    "charge_mah": {"milliampere-hour": 1, "ampere-hour": 1000},
}
UNIT_CONVERSIONS["ram_gb"] = dict(UNIT_CONVERSIONS["storage_gb"])
DISCRETE_ATTRS = ["storage_gb", "ram_gb", "count", "screen_inch", "voltage_v", "abv_percent", "power_w"]
AMBIGUITY_RULES = {
    "ram": "ram_gb", "memory": "ram_gb", "memory card": "storage_gb", "storage": "storage_gb", "rom": "storage_gb", "ssd": "storage_gb",
    "hdd": "storage_gb", "card": "storage_gb", "sd": "storage_gb", "microsd": "storage_gb", "flash drive": "storage_gb",
}

# Schema.org availability tokens, in the order they are sought.
AVAILABILITY = {
    "instock": "In stock", "outofstock": "Out of stock", "preorder": "Pre-order", "backorder": "On back order", "discontinued": "Discontinued",
    "soldout": "Sold out", "limitedavailability": "Limited availability", "instoreonly": "In store only", "onlineonly": "Online only",
}
PAGE_TYPES = ("standard", "discounted", "membership", "multipack", "out_of_stock")
OUTCOMES = ("success", "invalid_target", "scrape_failed", "infra_error")
# Host -> site.
HOSTS = {
    "tesco.com": "tesco", "www.tesco.com": "tesco", "argos.co.uk": "argos", "www.argos.co.uk": "argos", "amazon.co.uk": "amazon",
    "www.amazon.co.uk": "amazon", "amazon.de": "amazon", "www.amazon.de": "amazon", "amazon.fr": "amazon", "www.amazon.fr": "amazon",
}
# Site -> page type -> (available, needed at cold start); and words of its membership scheme.
SITE_PROFILES = {
    "argos": {"standard": (True, True), "discounted": (True, True), "out_of_stock": (True, False), "multipack": (True, False), "membership": (False, False)},
    "tesco": {"standard": (True, True), "discounted": (True, True), "out_of_stock": (True, True), "multipack": (True, False), "membership": (True, True)},
}
MEMBERSHIP_HINTS = {"tesco": ["clubcard"]}
MANDATORY_PAGE_TYPES = {"standard": True, "discounted": True, "out_of_stock": True, "membership": True, "multipack": False}
# Site -> path of the product id.
URL_PRODUCT_ID = {"argos": r"/product/([A-Za-z0-9]+)", "amazon": r"/dp/([A-Z0-9]{10})", "tesco": r"/(?:shop|groceries)/[^/]+/products/(\d+)"}
# Country -> search region, and -> two-letter parameter; names of countries.
DDG_REGION = {
    "uk": "uk-en", "gb": "uk-en", "de": "de-de", "fr": "fr-fr", "us": "us-en", "nl": "nl-nl", "jp": "jp-ja", "es": "es-es", "it": "it-it",
    "pt": "pt-pt", "se": "se-sv", "pl": "pl-pl", "br": "br-pt", "au": "au-en", "ca": "ca-en",
}
SERPER_GL = {c: c for c in DDG_REGION} | {"uk": "gb"}
COUNTRY_NAMES = {
    "uk": "United Kingdom", "gb": "United Kingdom", "de": "Germany", "fr": "France", "us": "United States", "nl": "Netherlands", "jp": "Japan",
    "es": "Spain", "it": "Italy", "pt": "Portugal", "se": "Sweden", "pl": "Poland", "br": "Brazil", "au": "Australia", "ca": "Canada",
}
# States of collection records; statuses and page texts of infrastructure failures.
PENDING_STATES = ("building", "pending", "running", "collecting", "queued", "scheduled", "started", "in_progress")
FAILED_STATES = ("failed", "error", "cancelled", "canceled", "aborted")
INFRA_STATUS = (407, 429, 500, 502, 503, 504)
UPSTREAM_MARKERS = ("500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "Gateway Time-out")
INVALID_STATUS = (404, 410, 403, 451)
# Keyword in a model's name -> route; provider -> its models.
LLM_ROUTES = {"qwen": "https://dashscope.aliyuncs.com/compatible-mode/v1", "deepseek": "https://api.deepseek.com/v1"}
MODEL_PROVIDERS = {"qwen": ("qwen3.7-plus", "qwen-3.7-plus", "qwen3.7-flash"), "deepseek": ("deepseek-v4-flash", "deepseek-v4-pro")}
DEFAULT_PROVIDER = "qwen"
# Words of price evidence.
LABEL_WORDS = ["was", "rrp", "save", "now", "from", "only", "regular", "clubcard", "prime", "member", "price", "offer"]
CROSS_SELL_WORDS = ["recommend", "related", "similar", "carousel", "also-bought", "alsobought", "alternatives", "essential-extras", "essentialextras", "product-card", "productcard", "sponsored", "rail", "you-may-also", "customers-also", "frequently-bought", "compare-with", "cross-sell", "crosssell", "upsell", "bundle"]
ZERO_DECOYS = ["basket-guide-price", "guide-price", "price-value", "widget-price", "basket-price"]
SHIPPING_KEYS = ["shippingrate", "shipping_rate", "shippingdetails"]
META_NAMES = ["description", "og:description", "twitter:description"]
CONTAINER_HINTS = ["value-bar", "promotion", "price-block", "buybox", "pricing", "product-price", "price-container", "offer-price", "price__", "buy-box", "pdp-buy-box", "pdp-buybox"]
MEMBER_HINTS = ["clubcard", "member", "loyalty", "prime", "member-price", "membership-price", "loyalty-price", "clubcard-price", "clubcard-promotion", "member-only", "members-only", "sign-in-to-save", "logged-in-price", "会员", "vip-price", "reward-price"]
GATING_PHRASES = ["only available with", "member price", "members price", "membership price", "loyalty price", "sign in to save", "logged in price", "exclusive price", "会员价"]
REFERENCE_HINTS = ["was", "rrp", "old", "before", "previous", "list", "reference", "original", "原价", "uvp", "prix-barré", "strike", "strikethrough", "line-through", "prev-price", "price-was", "price--was", "price-old", "compare-at", "compared-price"]
STRUCK_CLASSES = ["was", "strike", "strikethrough", "old", "line-through", "struckthrough", "price-was", "price--was", "rrp", "original-price", "prev-price"]
BADGE_HINTS = ["badge", "logo", "icon", "label", "tag", "pill", "chip"]
# What a user-supplied parser may import and must not touch.
PARSER_IMPORTS = ["bs4", "lxml", "re", "json"]
FORBIDDEN_NAMES = ["open", "eval", "exec", "compile", "__import__", "input", "exit", "quit", "breakpoint"]
FORBIDDEN_ROOTS = ["os", "sys", "socket", "subprocess", "shutil", "pathlib", "urllib", "http", "requests", "builtins", "importlib", "ctypes", "resource", "signal"]
FORBIDDEN_DUNDERS = ["__globals__", "__code__", "__class__", "__subclasses__", "__mro__", "__builtins__", "__bases__", "__dict__", "__getattribute__", "__reduce__"]
COMPARE_FIELDS = ("title", "brand", "gtin", "image_urls", "variant", "price", "currency", "list_price", "membership_price", "in_stock", "availability_raw")


@dataclass(frozen=True)
class ScrapingConfig:
    """Scraping knobs."""

    dedup_seconds: int = 3600
    surge_window_hours: int = 24
    surge_min_total: int = 5
    surge_ratio: float = 0.3
    surge_count: int = 20
    prune_window: int = 50
    parser_limit: int = 4
    golden_min: int = 1
    golden_max: int = 3
    absence_threshold: int = 2
    normal_page_length: int = 5000
    infra_body_length: int = 1000
    repair_models: tuple[str, ...] = ("deepseek-v4-flash", "deepseek-v4-pro")
    repair_temperatures: tuple[float, ...] = (0.1, 0.3)
