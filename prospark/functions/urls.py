"""URL rules as Column expressions.

Parts are cut with the RFC 3986 pattern rather than a strict URL parser, so
odd but usable links keep their meaning.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospark import rules

_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _SPLIT, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return F.lower(_part(url, 2))


def full_path(url: Column) -> Column:
    return _part(url, 3)


def query_text(url: Column) -> Column:
    return _part(url, 4)


def path(url: Column) -> Column:
    """Path without the ;parameters of its last segment."""
    return F.regexp_replace(full_path(url), r";[^/]*$", "")


def domain(url: Column) -> Column:
    return F.split_part(netloc(url), F.lit(":"), F.lit(1))


def _quote_plus(text: Column) -> Column:
    """Form encoding that leaves letters, digits and _.-~ as they are."""
    coded = F.url_encode(text)
    return F.replace(F.replace(coded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _unquote_plus(text: Column) -> Column:
    """Form decoding in which a stray percent sign stands for itself."""
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(safe)


def clean_query(query: Column) -> Column:
    """Query text without tracking or blank parameters, repeated names side by side."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike(r"(?s)^[^=]*=."))
    cut = lambda p: F.struct(
        _unquote_plus(F.regexp_extract(p, r"(?s)^([^=]*)=(.*)$", 1)).alias("k"),
        _unquote_plus(F.regexp_extract(p, r"(?s)^([^=]*)=(.*)$", 2)).alias("v"),
    )
    kept = F.filter(F.transform(pairs, cut), lambda x: ~F.lower(x["k"]).isin(rules.TRACKING_PARAMS))

    def group(ps: Column) -> Column:
        names = F.array_distinct(F.transform(ps, lambda x: x["k"]))
        return F.flatten(F.transform(names, lambda n: F.filter(ps, lambda x: x["k"] == n)))

    grouped = let(kept, group)
    coded = F.transform(grouped, lambda x: F.concat(_quote_plus(x["k"]), F.lit("="), _quote_plus(x["v"])))
    return F.when(query == "", "").otherwise(F.array_join(coded, "&"))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a costly column that is computed exactly once per row.

    Behind the generator neither a later filter nor a later projection repeats it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def canonical(raw: Column) -> Column:
    """Normalized URL, or NULL for text that is not an http(s) URL."""
    lead = r"^([a-zA-Z][a-zA-Z0-9+.-]*):(?://)?"

    def cut(text: Column) -> Column:
        stated = F.lower(F.regexp_extract(text, lead, 1))
        url = F.concat(F.lit("//"), F.regexp_replace(text, lead, ""))
        return let(
            url,
            lambda u: F.struct(
                F.when(stated == "", "https").otherwise(stated).alias("scheme"),
                netloc(u).alias("host"),
                full_path(u).alias("path"),
                query_text(u).alias("query"),
            ),
        )

    def build(p: Column) -> Column:
        port = F.when(p["scheme"] == "http", ":80$").otherwise(":443$")
        way = F.regexp_replace(F.regexp_replace(p["path"], r";[^/]*$", ""), "/+", "/")
        way = F.regexp_replace(F.concat(way, F.lit("/")), "/+$", "")
        extra = F.regexp_extract(p["path"], r"(;[^/]+)$", 1)
        query = let(clean_query(p["query"]), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        full = F.concat(
            p["scheme"],
            F.lit("://"),
            F.regexp_replace(p["host"], port, F.lit("")),
            let(way, lambda w: F.when(w == "", "/").otherwise(w)),
            extra,
            query,
        )
        return F.when(p["scheme"].isin(rules.ALLOWED_SCHEMES) & (p["host"] != ""), full)

    text = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"[\t\r\n]", "")
    # Most stored links are in normal form already and skip the rewrite.
    normal = r"^https?://[a-z0-9._-]+(?:/|(?:/[^/?#;\s]+)+)$"
    return F.when(raw.rlike(normal), raw).otherwise(let(let(text, cut), build))


def _no_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def same_domain(url: Column, base: Column) -> Column:
    """The URL's host is the base domain, its www form or one of its subdomains."""
    host = domain(url)
    a, b = _no_www(host), _no_www(base)
    return (host == base) | (a == b) | a.endswith(F.concat(F.lit("."), b))


def _escaped(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def crawlable(url: Column) -> Column:
    """Not a file download and not an account, shop, legal or listing area."""
    way = F.lower(path(url))
    return ~way.rlike(f"(?:{_escaped(rules.DENIED_EXTENSIONS)})$|{_escaped(rules.DENIED_PATHS)}")


def priority(url: Column) -> Column:
    """Crawl priority 0..100: the root first, then the best known path word."""
    way = F.lower(F.regexp_replace(path(url), "^/+|/+$", ""))
    table = F.create_map(*[F.lit(x) for pair in rules.PATH_PRIORITY.items() for x in pair])
    score = lambda s: F.coalesce(
        F.try_element_at(table, F.split_part(s, F.lit("."), F.lit(1))), F.lit(rules.OTHER_PRIORITY)
    )
    return F.when(way == "", rules.ROOT_PRIORITY).otherwise(F.array_max(F.transform(F.split(way, "/"), score)))


def _ipv4_number(host: Column) -> Column:
    part = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    literal = F.when(host.rlike(rf"^{part}(?:\.{part}){{3}}$"), host)
    start = F.lit(0).cast("bigint")
    return F.aggregate(F.split(literal, r"\."), start, lambda acc, x: acc * 256 + x.try_cast("bigint"))


def _ip_value(text: str) -> int:
    return reduce(lambda acc, x: acc * 256 + int(x), text.split("."), 0)


def hostname(url: Column) -> Column:
    """Host without user info, port and the brackets of an IPv6 literal."""
    host = F.regexp_replace(netloc(url), r"^.*@", "")
    inside = F.regexp_extract(host, r"^\[([^\]]*)\]", 1)
    return F.when(host.startswith("["), inside).otherwise(F.split_part(host, F.lit(":"), F.lit(1)))


def _not_public(number: Column) -> Column:
    blocks = [number.between(_ip_value(a), _ip_value(b)) for a, b in rules.NON_PUBLIC_IPV4]
    return F.coalesce(reduce(or_, blocks), F.lit(False))


# IPv6 forms that are not public (unspecified, loopback, unique local, link local, multicast,
# documentation, discard).
_V6_NOT_PUBLIC = r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*|100::.*)$"


def safety(url: Column) -> Column:
    """'safe', or why the URL must not be fetched. Names are not resolved here."""

    def judge(host: Column) -> Column:
        local = host.isin(rules.LOCAL_HOSTS) | host.rlike(f"(?:{_escaped(rules.LOCAL_SUFFIXES)})$")
        # An IPv4 address may also come wrapped into an IPv6 literal.
        number = _ipv4_number(F.regexp_replace(host, r"^::ffff:(?=[0-9.]+$)", ""))
        closed = let(number, _not_public) | (host.contains(":") & host.rlike(_V6_NOT_PUBLIC))
        return (
            F.when(host == "", "missing hostname")
            .when(local, "local hostname")
            .when(closed, "private or reserved address")
            .otherwise("safe")
        )

    return let(hostname(url), judge)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page `base`."""
    root = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    here = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path(base) == "", F.concat(root, F.lit("/"))).otherwise(here), r"[^/]*$", "")
    joined = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(here, href))
        .otherwise(F.concat(folder, href))
    )
    return let(joined, _without_dots)


def _without_dots(url: Column) -> Column:
    start = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    return F.when(
        url.rlike(r"^[^:/?#]+://[^/?#]*[^?#]*/\.\.?(?:[/?#]|$)"),
        F.concat(start, let(full_path(url), _drop_dots), tail),
    ).otherwise(url)


def _drop_dots(way: Column) -> Column:
    """Path with its . and .. steps carried out."""
    steps = F.split(F.regexp_replace(way, "^/", ""), "/")
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        steps,
        empty,
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    closing = F.when(way.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(F.size(walked) == 0, "").otherwise(closing))
