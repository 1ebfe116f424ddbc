"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generic syntax of URLs, link attributes, and schemes that are no links.
PARTS = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
HREF = r"(?i)href=[\"']([^\"'>]+)[\"']"
NO_LINK = r"\A(javascript:|mailto:|tel:|#|data:)"


def part(url: Column, k: int) -> Column:
    """1: scheme, 2: authority, 3: path, 4: query."""
    return F.regexp_extract(url, PARTS, k)


def authority(url: Column) -> Column:
    """Host with port and user, as written."""
    return part(url, 2)


def same_domain(url: Column, other: Column) -> Column:
    return authority(url) == authority(other)


def normalize(url: Column) -> Column:
    """Without fragment, parameters of the last path segment, and slashes at the end."""
    path = F.regexp_replace(part(url, 3), r";[^/]*\z", "")
    query = part(url, 4)
    return F.regexp_replace(F.concat(F.lower(part(url, 1)), F.lit("://"), authority(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), r"/+\z", "")


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)).otherwise(F.concat(done, F.array(s))),
    )
    end = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(F.array_join(walked, "/"), end)


def join(base: Column, link: Column) -> Column:
    """The link resolved against the page's URL."""
    scheme, root = part(base, 1), F.concat(part(base, 1), F.lit("://"), authority(base))
    folder = F.regexp_replace(part(base, 3), r"[^/]*\z", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    path = F.regexp_extract(link, r"(?s)\A([^?#]*)", 1)
    rest = F.regexp_extract(link, r"(?s)\A[^?#]*(.*)\z", 1)
    return (
        F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, _without_dots(path), rest))
        .when(link.startswith("?"), F.concat(root, part(base, 3), link))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def links(html: Column, base: Column) -> Column:
    """Distinct normalized http links of a page, in order of their first place."""
    found = F.filter(F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda x: F.trim(x)), lambda x: ~x.rlike(NO_LINK))
    whole = F.filter(F.transform(found, lambda x: join(base, x)), lambda x: x.rlike(r"\Ahttps?://"))
    return F.array_distinct(F.transform(whole, normalize))
