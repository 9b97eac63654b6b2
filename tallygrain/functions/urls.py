"""URL columns: parts, cleaning, product-page and host predicates, product ids."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrain import config

#: RFC 3986, appendix B; unlike parse_url it takes any text.
PARTS = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


#: Between the parts of a URL that one pass of the expression has cut; no URL holds it.
CUT = "\x01"


def part(url: Column, group: int) -> Column:
    """A part by its group. All parts come from one pass, which several parts of one URL share in a plan."""
    whole = F.split(F.regexp_replace(F.replace(url, F.lit(CUT), F.lit("")), PARTS, CUT.join(f"${i}" for i in range(1, 6))), CUT, -1)
    return F.element_at(whole, group)


def netloc(url: Column) -> Column:
    """Host with user and port, as written; read no further than that."""
    return F.regexp_extract(F.replace(url, F.lit(CUT), F.lit("")), r"^(?:[^:/?#]+:)?(?://([^/?#]*))?", 1)


def hostname(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.replace(url, F.lit(CUT), F.lit("")), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return part(url, 4)


def is_tracking(name: Column, patterns: list[str] | None = None) -> Column:
    """Whether a parameter's decoded name is one that only tracks."""
    patterns = [p.casefold() for p in (config.STRIP_QUERY_PARAMS if patterns is None else patterns)]
    exact, prefixes = [p for p in patterns if p[-1:] != "*"], [p[:-1] for p in patterns if p[-1:] == "*"]
    low = F.lower(name)
    return reduce(lambda a, p: a | low.startswith(p), prefixes, low.isin(exact))


#: Most URLs: a known scheme, a host, ASCII without escapes.
PLAIN = r"^https?://[^/?#\x01%\x80-\x{10ffff}][\x00\x02-\x24\x26-\x7f]*\z"


def clean_url(url: Column, patterns: list[str] | None = None) -> Column:
    """The URL without tracking parameters and without an empty query; the rest keeps its order and encoding."""
    patterns = config.STRIP_QUERY_PARAMS if patterns is None else patterns
    return F.when(url.rlike(PLAIN), clean_plain(url, patterns)).otherwise(clean_any(url, patterns))


def clean_plain(url: Column, patterns: list[str]) -> Column:
    """``clean_url`` of plain URLs, whose parts need no expression and whose parameters no decoding."""
    before = F.substring_index(url, "#", 1)
    base = F.substring_index(before, "?", 1)
    fragment = F.substring(url, F.length(before) + 1, F.length(url))
    asked = F.substring(before, F.length(base) + 2, F.length(before))
    names = "|".join(re.escape(p[:-1]) + "[^=&]*" if p[-1:] == "*" else re.escape(p) for p in patterns) or "(?!)"
    tracking = f"(?i:{names})(?:=[^&]*)?"
    # those in front with what parts them from the rest, then each with what parts it from the one before
    kept = F.regexp_replace(F.regexp_replace(asked, rf"^(?:{tracking}(?:&|\z))+", ""), rf"&{tracking}(?=&|\z)", "")
    return F.concat(
        base,
        F.when(asked == "", "").when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)),
        F.when(fragment == "#", "").otherwise(fragment),
    )


def clean_any(url: Column, patterns: list[str]) -> Column:
    """``clean_url`` of any URL."""

    def name(p: Column) -> Column:
        raw = F.substring_index(p, "=", 1)
        return F.coalesce(F.try_url_decode(raw), raw)

    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: ~is_tracking(name(p), patterns)), "&")
    scheme, host, fragment = part(url, 1), part(url, 2), part(url, 5)
    return F.concat(  # null of a null
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        part(url, 3),
        F.when((query(url) != "") & (kept != ""), F.concat(F.lit("?"), kept)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def is_product_url(website: Column, url: Column, paths: dict[str, str] | None = None) -> Column:
    """Whether the path is one of a product page; websites without a rule let everything pass."""
    paths = config.PRODUCT_PATH if paths is None else paths
    site = F.lower(website)
    out = F.lit(True)
    for pattern in dict.fromkeys(paths.values()):
        sites = [s for s, p in paths.items() if p == pattern]
        out = F.when(site.isin(sites), path(url).rlike("(?i)" + pattern)).otherwise(out)
    return out


def host_matches(host: Column, target: Column) -> Column:
    """Equal or a subdomain; a target that ends in a dot is a name that one or two labels of a TLD must follow."""
    h, t = (F.regexp_replace(F.lower(x), r"^\.+", "") for x in (host, target))
    labels = F.split(h, r"\.")
    at = F.array_position(labels, F.rtrim(t, F.lit(".")))
    after = F.size(labels) - at
    return F.when(t.endswith("."), (at > 0) & after.between(1, 2)).otherwise((h == t) | h.endswith(F.concat(F.lit("."), t)))


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """A small fixed table as a map literal."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, default)


def domain_for(website: Column) -> Column:
    return lookup(F.lower(website), config.DOMAIN_MAP)


def resolve_site(url: Column) -> Column:
    """The site of a URL's host, or null."""
    return lookup(hostname(url), config.HOSTS)


def guess_site(url: Column) -> Column:
    """A site by what the host contains, else its second-last label."""
    host = hostname(url)
    out = F.try_element_at(F.split(host, r"\."), F.lit(-2))
    for site in ("tesco", "argos", "amazon"):
        out = F.when(host.contains(site), F.lit(site)).otherwise(out)
    return out


def product_id(url: Column, site: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in config.URL_PRODUCT_ID.items():
        out = F.when(site == name, F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))).otherwise(out)
    return out


def search_region(country: Column) -> Column:
    """Country to region: known, already a region, or '<code>-en'."""
    code = F.trim(F.lower(country))
    return lookup(code, config.DDG_REGION, F.when(code.contains("-"), code).otherwise(F.concat(code, F.lit("-en"))))


def search_gl(country: Column) -> Column:
    code = F.trim(F.lower(country))
    return lookup(code, config.SERPER_GL, code)


def query_mode(provider: str) -> str:
    """How a provider's queries are built; an unknown mode is an error."""
    mode = config.QUERY_MODE.get(provider, "keyword")
    if mode not in config.QUERY_MODES:
        raise ValueError(f"query mode of {provider} must be one of {', '.join(config.QUERY_MODES)}")
    return mode


def build_queries(name: Column, website: Column, mode: str, strip_parens: bool = config.STRIP_PARENS) -> Column:
    """Search queries, blanks collapsed, no two that differ in case only, in order."""
    domain = domain_for(website)
    base = F.trim(name)
    variants = []
    for n in [base] + [F.regexp_replace(base, r"\([^)]*\)", "")] * strip_parens:
        keyword = F.concat_ws(" ", n, F.trim(website))
        site = F.concat(n, F.lit(" site:"), domain)
        variants.append(F.when(domain.isNull(), keyword) if mode == "sitename" else keyword)
        if mode in ("sitename", "both"):
            variants.append(F.when(domain.isNotNull(), site))
    flat = F.transform(F.array(*variants), lambda q: F.trim(F.regexp_replace(q, r"\s+", " ")))
    flat = F.filter(flat, lambda q: q.isNotNull() & (q != ""))
    first = F.aggregate(flat, F.array().cast("array<string>"), lambda acc, q: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(q)), acc).otherwise(F.array_append(acc, q)))
    return first

