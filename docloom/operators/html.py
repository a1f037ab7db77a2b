"""Web pages as text, titles and links, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character references that are decoded (fixed values); &amp; comes last.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def text(html: Column) -> Column:
    """Without scripts, styles, comments and tags; text nodes trimmed, one a line."""
    out = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</(script|style)>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", "\n"), "(?s)<[A-Za-z/!][^>]*>", "\n")
    lines = F.filter(F.transform(F.split(out, "\n"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")
    out = F.array_join(lines, "\n")
    for name, char in REFERENCES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    """Targets of links, without mail, scripts, phones and fragments. The attribute may stand anywhere in its tag, in either case, in either
    quotes or in none."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), F.lit(0))
    value = lambda tag: F.regexp_replace(tag, r"(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*", "")
    bare = lambda tag: F.trim(F.regexp_replace(value(tag), r"(?s)^([\"'])(.*)\1$", "$2"))
    return F.filter(F.transform(tags, bare), lambda u: (u != "") & ~u.rlike("^(?i:mailto:|javascript:|tel:|#)"))


def sitemap(xml: Column) -> Column:
    """The addresses that a sitemap lists."""
    return F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))


def _without_dots(path: Column) -> Column:
    """A path whose segments . and .. are resolved."""
    parts = F.split(path, "/")
    zero = F.array().cast("array<string>")
    up = lambda out: F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))
    step = lambda out, s: F.when(s == ".", out).when(s == "..", up(out)).otherwise(F.concat(out, F.array(s)))
    kept = F.array_join(F.aggregate(parts, zero, step), "/")
    folder = path.rlike(r"/\.\.?$") & ~kept.endswith("/")
    return F.when(~path.contains("/."), path).when(folder, F.concat(kept, F.lit("/"))).otherwise(kept)


def absolute(base: Column, link: Column) -> Column:
    """The link as seen from the page at base: whole, with the page's scheme, from its host's root, as its query or fragment, or from its
    folder; with . and .. in paths resolved."""
    host = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    scheme = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    page = F.regexp_replace(base, "[?#].*$", "")
    path = F.regexp_extract(page, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*/|/)?", 1)
    folder = F.when(path == "", "/").otherwise(path)
    rest = F.regexp_extract(link, "[?#].*$", 0)
    own = F.regexp_replace(link, "[?#].*$", "")
    rooted = F.concat(host, _without_dots(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))), rest)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link == "", base)
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(rooted)
    )
