"""URL algebra as Catalyst expressions: no expression here starts a Python worker.

Parsing follows RFC 3986, appendix B, with the leniency of common URL libraries: control characters and spaces before
the URL and tabs and line breaks inside it are dropped, a scheme needs a letter first, `;params` of the last segment aren't
part of the path. Nulls stay null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source"]
DENIED_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".bmp", ".tiff", ".zip", ".rar", ".exe", ".mp4", ".mp3",
    ".avi", ".mov", ".css", ".js", ".woff", ".woff2"
]
MEDIA_FOLDERS = ["/images/", "/media/", "/assets/"]
PICTURE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp"]
MAX_URL = 2000
BOOST = ["policy", "om-oss", "kontakt", "regler", "guide"]
PENALTY = ["nyheter", "arkiv", "blogg", "kalender", "202"]
#: Bases of the frontier score.
START, SITEMAP, LINK = 1, 5, 15

#: White space as Python sees it: Unicode's, and the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")


def parts(url: Column) -> dict[str, Column]:
    """scheme (lower case), authority, path (without params), whole (with params), query: '' where there is none."""
    clean = _clean(url)
    shape = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    scheme, authority, path, query = (F.regexp_extract(clean, shape, i) for i in range(1, 5))
    plain = F.regexp_replace(path, r"(?s);[^/]*\z", "")
    return {"scheme": F.lower(scheme), "authority": authority, "path": plain, "whole": path, "query": query}


def parts_struct(url: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in parts(url).items()))


def _fields(p: Column) -> dict[str, Column]:
    return {k: p[k] for k in ("scheme", "authority", "path", "whole", "query")}


def well_formed(authority: Column) -> Column:
    """False where the brackets of an IP literal don't pair."""
    return ~authority.rlike(r"[\[\]]") | authority.rlike(r"\A[^\[\]]*\[[0-9A-Fa-fvV:.%]+\](?::[^\[\]]*)?\z")


def _decoded(x: Column) -> Column:
    return F.url_decode(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normal_query(query: Column, ignored: list[str] = TRACKING) -> Column:
    """Parameters without the ignored ones, sorted by key and value, encoded anew."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_replace(p, r"(?s)\A[^=]*=", ""))).otherwise("").alias("v")
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(ignored)) if ignored else pairs
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def normalize_url(url: Column, ignored: list[str] = TRACKING, of: Column | None = None) -> Column:
    """One spelling for each page: lower-case scheme (http if none) and authority, no index file, closing slashes,
    tracking parameters, params or fragment; sorted parameters. What can't be parsed is only stripped.

    of: the stripped URL's parts_struct, where it is a column already.
    """
    bare = strip(url)
    p = parts(bare) if of is None else _fields(of)
    path = F.regexp_replace(F.when(p["path"] == "", "/").otherwise(p["path"]), r"(?i)/index\.(?:html|htm|php)\z", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/+\z", ""))
    query = normal_query(p["query"], ignored)
    whole = F.concat(
        F.when(p["scheme"] == "", "http").otherwise(p["scheme"]), F.lit("://"), F.lower(p["authority"]), path,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    )
    return F.when(well_formed(p["authority"]), whole).otherwise(bare)


def domain_core(authority: Column) -> Column:
    """Every "www." goes, wherever it stands."""
    return F.replace(F.lower(authority), F.lit("www."), F.lit(""))


def extension(path: Column) -> Column:
    """The last dot of the last segment and what follows; '' if there is none or only dots stand before it."""
    return F.regexp_extract(path, r"(?s)\A(?:.*/)?\.*[^./][^/]*(\.[^./]*)\z", 1)


def _any(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def keywords_pass(url: Column, exclude: Column, require: Column) -> Column:
    """exclude, require: array<string>. Any excluded one rejects (empty ones don't count); if some are required, one must be there."""
    low = F.lower(url)
    rejected = F.exists(F.coalesce(exclude, F.array().cast("array<string>")), lambda k: (k != "") & F.contains(low, k))
    needed = F.coalesce(require, F.array().cast("array<string>"))
    return ~rejected & ((F.size(needed) == 0) | F.exists(needed, lambda k: F.contains(low, k)))


def is_valid_url(
    url: Column, domain: Column | None = None, exclude: Column | None = None, require: Column | None = None,
    of: Column | None = None
) -> Column:
    """Whether a crawl of `domain` may take the URL, as it was found; domain None, or null: of any. Null is not valid.

    of: the URL's parts_struct, where it is a column already.
    """
    p = parts(url) if of is None else _fields(of)
    path = F.lower(p["path"])
    ok = (F.length(url) <= MAX_URL) & p["scheme"].isin("http", "https") & well_formed(p["authority"]) & ~extension(path).isin(DENIED_EXTENSIONS)
    ok = ok & ~(_any(path, MEDIA_FOLDERS) & _any(path, PICTURE_EXTENSIONS))
    if domain is not None:
        ok = ok & F.coalesce(domain_core(p["authority"]) == F.replace(domain, F.lit("www."), F.lit("")), domain.isNull())
    if exclude is not None or require is not None:
        none = F.array().cast("array<string>")
        ok = ok & keywords_pass(url, none if exclude is None else exclude, none if require is None else require)
    return F.coalesce(ok, F.lit(False))


def frontier_score(url: Column, base: Column | int = LINK, depth: Column | int = 0) -> Column:
    """Smaller comes first. url: normalised."""
    low = F.lower(url)
    number = lambda x: x if isinstance(x, Column) else F.lit(x)
    return (
        number(base) - F.when(_any(low, BOOST), 3).otherwise(0) + F.when(_any(low, PENALTY), 5).otherwise(0) + number(depth)
    ).cast("int")


def _without_dots(path: Column) -> Column:
    """RFC 3986, 5.2.4, over the segments; a closing dot segment leaves a closing slash."""
    segments = F.split(path, "/")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(
            s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        ).otherwise(F.concat(done, F.array(s))),
    )
    closed = F.array_join(
        F.concat(folded, F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))),
        "/"
    )
    return F.regexp_replace(closed, r"\A(?!/)", "/")


def reference_struct(href: Column, scheme: Column) -> Column:
    """What a reference, as seen from a base of that scheme, consists of: own (a scheme other than the base's), clean (without
    the base's scheme), path (with an authority, if there is one) and rest (query and fragment, without empty ones)."""
    clean = _clean(href)
    own = F.lower(F.regexp_extract(clean, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    bare = F.when(own == scheme, F.regexp_replace(clean, r"\A[A-Za-z][A-Za-z0-9+.\-]*:", "")).otherwise(clean)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"(?s)\A[^?#]*(.*)\z", 1), r"\A\?(?=#|\z)", ""), r"#\z", "")
    return F.struct(
        ((own != "") & (own != scheme)).alias("own"), F.regexp_extract(bare, r"(?s)\A([^?#]*)", 1).alias("path"),
        rest.alias("rest")
    )


def resolve_parts(base: Column, href: Column, b: Column, r: Column) -> Column:
    """href as seen from base, of which b is the parts_struct and r the reference_struct."""
    root = F.concat(b["scheme"], F.lit("://"), b["authority"])
    folder = F.regexp_extract(F.when(b["path"] == "", "/").otherwise(b["path"]), r"(?s)\A(.*/)[^/]*\z", 1)
    # between a base and a relative path, empty segments don't count
    merged = F.regexp_replace(F.concat(folder, r["path"]), "/{2,}", "/")
    same = F.concat(
        root, b["whole"],
        F.when(r["rest"].startswith("?"), r["rest"]).otherwise(
            F.concat(F.when(b["query"] == "", "").otherwise(F.concat(F.lit("?"), b["query"])), r["rest"])
        )
    )
    return (
        F.when(F.coalesce(href, F.lit("")) == "", base)
        .when(r["own"], href)
        .when(r["path"].startswith("//"), F.concat(b["scheme"], F.lit(":"), r["path"], r["rest"]))
        .when(r["path"] == "", same)
        .otherwise(F.concat(root, _without_dots(F.when(r["path"].startswith("/"), r["path"]).otherwise(merged)), r["rest"]))
    )


def resolve(base: Column, href: Column) -> Column:
    """href as seen from base (RFC 3986, 5.2, for bases with an authority), as one expression; see operators.extract.with_targets for many."""
    b = parts_struct(base)
    return resolve_parts(base, href, b, reference_struct(href, b["scheme"]))


def is_followed(href: Column) -> Column:
    """Anchors, scripts and mail addresses aren't links to pages."""
    return ~href.rlike(r"\A(?:#|javascript:|mailto:)")


def slugify(text: Column) -> Column:
    """Letters, digits, underscores and single hyphens, in lower case."""
    flat = F.translate(text, "åäöÅÄÖ", "aaoAAO")
    kept = F.regexp_replace(flat, r"(?U)[^\w\s\x1c-\x1f\-]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(kept, r"(?U)[\-\s\x1c-\x1f]+", "-"), r"\A-+|-+\z", ""))


def page_file_name(url: Column, content_hash: Column, ending: Column | str = "") -> Column:
    end = ending if isinstance(ending, Column) else F.lit(ending)
    return F.concat(F.substring(slugify(parts(url)["path"]), 1, 50), F.lit("_"), F.substring(content_hash, 1, 6), end)


def document_file_name(url: Column, disposition: Column) -> Column:
    """The name in the Content-Disposition header, else the URL's last segment, else dokument.pdf; made safe, with a part of the URL's hash."""
    given = F.regexp_extract(F.coalesce(disposition, F.lit("")), r'filename="?([^"]+)"?', 1)
    path = F.regexp_replace(parts(url)["path"], r"%(?![0-9A-Fa-f]{2})", "%25")
    last = F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"(?s)([^/]*)\z", 1)
    name = F.when(given != "", given).when(last != "", last).otherwise("dokument.pdf")
    end = F.lower(extension(name))
    stem = F.substring(slugify(F.substring_index(name, ".", 1)), 1, 50)
    return F.concat(stem, F.lit("_"), F.substring(F.md5(url), 1, 6), F.when(end == "", ".pdf").otherwise(end))
