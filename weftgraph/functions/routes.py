"""URLs, routes and contract ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def provider_path(path: Column) -> Column:
    """Query off, lower case, no trailing slashes, parameters as ``{param}``; the root stays."""
    s = F.regexp_replace(F.lower(F.substring_index(F.trim(path), "?", 1)), r"/+$", "")
    for pattern in (r":\w+", r"\{[^}]+\}", r"\[[^\]]+\]"):
        s = F.regexp_replace(s, pattern, "{param}")
    return F.when(s == "", "/").otherwise(s)


def consumer_path(url: Column) -> Column:
    """Like ``provider_path``, with the host off and numeric segments as ``{param}``."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(url, r"\$\{[^}]+\}", "{param}")), r"(?i)^https?://[^/?#]+", "")
    bare = F.regexp_replace(bare, "#.*$", "")
    normal = provider_path(F.when(bare == "", "/").otherwise(bare))
    parts = F.filter(F.split(normal, "/"), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda x: F.when(F.rlike(x, F.lit(r"^\d+$")), "{param}").otherwise(x)), "/"))


def contract_id(raw: Column) -> Column:
    """Canonical contract id: http (method upper, no trailing slash), grpc (package lower), topic and lib (lower)."""
    kind, rest = F.substring_index(raw, "::", 1), F.regexp_extract(raw, r"(?s)^.*?::(.*)$", 1)
    http = F.concat(F.lit("http::"), F.upper(F.substring_index(rest, "::", 1)), F.lit("::"), F.regexp_replace(F.regexp_extract(rest, r"(?s)^.*?::(.*)$", 1), r"/+$", ""))
    slash = F.instr(rest, "/")
    grpc = F.when(slash > 1, F.concat(F.lower(F.substring_index(rest, "/", 1)), F.regexp_extract(rest, r"(?s)^[^/]*(/.*)$", 1))).when(slash == 1, rest).otherwise(F.lower(rest))
    return (
        F.when(F.instr(raw, "::") == 0, raw)
        .when((kind == "http") & (F.instr(rest, "::") > 0), http)
        .when(kind == "grpc", F.concat(F.lit("grpc::"), grpc))
        .when(kind == "topic", F.concat(F.lit("topic::"), F.lower(F.trim(rest))))
        .when(kind == "lib", F.concat(F.lit("lib::"), F.lower(rest)))
        .otherwise(raw)
    )


def fetch_url(raw: Column) -> Column:
    """Path of a fetch call for matching; null when it is computed or not absolute."""
    s = F.regexp_replace(F.substring_index(raw, "?", 1), r"\$\{[^}]+\}", "[param]")
    s = F.regexp_replace(F.regexp_replace(s, "^`|`$", ""), r"\.(?:php|asp|aspx|jsp|cgi)$", "")
    return F.when(F.contains(s, F.lit("+")) | F.contains(s, F.lit("(")) | ~F.startswith(s, F.lit("/")), None).otherwise(s)


def file_route(path: Column) -> Column:
    """Route of an API file: app router (groups dropped), pages router, or PHP api folder; else null."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    app = F.regexp_replace(F.regexp_extract(p, r"app/(.+?)/route\.(?:ts|js|tsx|jsx)$", 1), r"\([^)]+\)/?", "")
    pages = F.regexp_replace(F.regexp_extract(p, r"pages/(api/.+?)\.(?:ts|js|tsx|jsx)$", 1), "/index$", "")
    php = F.regexp_extract(p, r"(?:^|/)(api/.+)\.php$", 1)
    return (
        F.when(F.startswith(app, F.lit("api/")) | (app == "api"), F.concat(F.lit("/"), app))
        .when(pages != "", F.concat(F.lit("/"), pages)).when(php != "", F.concat(F.lit("/"), php))
    )


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def route_fits(fetch: Column, route: Column) -> Column:
    """Segment by segment, with ``[x]`` on either side for any one segment and ``[...x]`` in the route for the rest."""
    f, r = segments(fetch), segments(route)
    rest = F.rlike(F.coalesce(F.try_element_at(r, F.lit(-1)), F.lit("")), F.lit(r"^\[\.\.\."))
    n = F.when(rest, F.size(r) - 1).otherwise(F.size(r))
    one = lambda a, b: (a == b) | F.rlike(a, F.lit(r"^\[.*\]$")) | F.rlike(b, F.lit(r"^\[.*\]$"))
    same = F.forall(F.zip_with(F.slice(f, F.lit(1), n), F.slice(r, F.lit(1), n), one), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(rest, F.size(f) >= n).otherwise(F.size(f) == n) & same


def tails(path: Column, least: int = 8) -> Column:
    """Endings of a path of at least ``least`` characters, parameters dropped, also without version segments."""
    segs = F.filter(F.split(F.lower(path), "/"), lambda s: (s != "") & ~F.startswith(s, F.lit("{")))
    bare = F.filter(segs, lambda s: ~F.rlike(s, F.lit(r"^v\d+$")))

    def ends(a: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda k: F.array_join(F.slice(a, k, F.greatest(F.size(a), F.lit(1))), "/"))
        return F.filter(whole, lambda t: F.length(t) >= least)

    return F.array_distinct(F.concat(ends(segs), ends(bare)))


def topic_prefixes(topic: Column) -> Column:
    """The topic itself and its prefixes that end before a ``.``, ``-`` or ``_``."""
    cuts = F.filter(F.sequence(F.lit(1), F.length(topic)), lambda k: F.substring(topic, k, F.lit(1)).isin(".", "-", "_"))
    return F.array_distinct(F.concat(F.array(topic), F.transform(cuts, lambda k: F.substring(topic, F.lit(1), k - 1))))


def path_prefixes(path: Column) -> Column:
    """Every folder above and including a path, shortest first."""
    parts = segments(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def in_scope(path: Column, scope: str) -> Column:
    """The path is the scope or below it."""
    return (path == scope) | F.startswith(path, F.lit(scope.rstrip("/") + "/"))


def resolve_placeholders(text: Column, config: Column) -> Column:
    """``${key:default}`` by a map column: exact, then case-insensitive key, then the default, then empty; one level."""
    parts = F.split(text, r"\$\{[^}]*\}", -1)
    marks = F.regexp_extract_all(text, F.lit(r"\$\{([^}]*)\}"), F.lit(1))
    low = F.transform_keys(config, lambda k, v: F.lower(k))

    def value(mark: Column) -> Column:
        key, default = F.substring_index(mark, ":", 1), F.regexp_extract(mark, r"^[^:]*:(.*)$", 1)
        return F.coalesce(F.try_element_at(config, key), F.try_element_at(low, F.lower(key)), default)

    filled = F.zip_with(parts, F.transform(marks, value), lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    return F.array_join(filled, "")
