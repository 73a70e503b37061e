"""Addresses: links resolved against their page, seeded image addresses, file and document names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import bound, canonical_url

_SITE, _SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "^[A-Za-z][A-Za-z0-9+.-]*:"
#: Steps upwards that a link may take; deeper ones stay in the path.
MOST_UP = 6
#: Where seeded pictures come from.
PICTURES, PICTURE_SIZE = "https://picsum.photos/seed/", "/1600/900"


def _without_dots(path: Column) -> Column:
    path = F.regexp_replace(path, r"/(?:\./)+", "/")
    for _ in range(MOST_UP):
        path = F.regexp_replace(path, r"^(/|/(?:[^/]+/)*?)(?:(?!\.\./)[^/]+/)\.\./", "$1")
    return F.regexp_replace(F.regexp_replace(path, r"^(?:/\.\.(?=/))+", ""), r"/\.$", "/")


def resolved(base: Column, link: Column) -> Column:
    """The link as seen from the page ``base``, canonical; null if either is null."""
    site, page = F.regexp_extract(base, _SITE, 0), F.regexp_replace(base, "[?#].*$", "")
    path = F.regexp_replace(page, _SITE, "")
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))

    def joined(x: Column) -> Column:
        own, tail = F.regexp_replace(x, "[?#].*$", ""), F.regexp_extract(x, "[?#].*$", 0)
        return (
            F.when(x == "", base).when(x.rlike(_SCHEME), x).when(x.startswith("//"), F.concat(F.regexp_extract(base, _SCHEME, 0), x))
            .when(x.startswith("/"), F.concat(site, _without_dots(own), tail)).when(x.startswith("#"), F.regexp_replace(base, "#.*$", "")).when(x.startswith("?"), F.concat(page, x))
            .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), tail))
        )

    return canonical_url(bound(F.trim(link), joined))


def quoted_plus(c: Column) -> Column:
    """Form encoding in which only letters, digits and ``_.-~`` stand for themselves and a space is a plus."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def picture_of(topic: Column, heading: Column) -> Column:
    return F.concat(F.lit(PICTURES), quoted_plus(F.concat_ws(" ", topic, heading, F.lit("editorial"))), F.lit(PICTURE_SIZE))


def is_table_name(name: Column) -> Column:
    """Whether a name is a plain identifier: a small letter, then small letters, digits and underscores, 63 at most."""
    return name.rlike("^[a-z][a-z0-9_]{0,62}$")


def document_id(given: Column, other: Column, source: Column, fallback: Column) -> Column:
    """The first that is filled of two ids, the file stem of the source, and a fallback."""
    stem = F.replace(F.regexp_extract(source, r"([^/\\]*)$", 1), F.lit(".txt"), F.lit(""))
    filled = [F.when(c != "", c) for c in (given, other, stem)]
    return F.coalesce(*filled, fallback)
