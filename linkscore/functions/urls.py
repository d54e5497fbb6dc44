"""URL expressions: splitting, domain and path words, URL tokens, href resolution.

``parse_url`` is not used: under ANSI it raises on illegal characters, and ``try_parse_url``
gives null for them, while links in the wild hold them all the time.
"""

from __future__ import annotations

import urllib.parse

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986, appendix B: 1 scheme, 2 authority, 3 path.
_RFC3986 = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"

# Removed from a domain wherever they occur, in this order.
DOMAIN_AFFIXES = ("www.", ".com", ".org")
# Path words that carry no meaning.
GENERIC_PATH_WORDS = ("index", "home", "page", "default")
# Schemes whose last path segment may carry ``;parameters``.
PARAMETER_SCHEMES = tuple(sorted(urllib.parse.uses_params))
# Characters that turn into / ? # @ or : under Unicode compatibility folding.
_FOLDS_TO_DELIMITER = (
    "\u2047\u2048\u2049\u2100\u2101\u2105\u2106\u2a74\ufe13\ufe16"
    "\ufe55\ufe56\ufe5f\ufe6b\uff03\uff0f\uff1a\uff1f\uff20"
)
# An address literal in brackets: IPv6 (hex groups with at least two colons) or IPvFuture.
_BRACKETED_HOST = r"\[(?:[0-9A-Fa-f]*:[0-9A-Fa-f]*:[0-9A-Fa-f:.]*(?:%[^\]]+)?|[vV][0-9A-Fa-f]+\..+)\]"


def _prepared(url: Column) -> Column:
    """Leading control characters and blanks, and tab/CR/LF anywhere, are not part of a URL."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_prepared(url), _RFC3986, 1))


def url_netloc(url: Column) -> Column:
    """Authority part, as written: user info and port stay."""
    return F.regexp_extract(_prepared(url), _RFC3986, 2)


def url_path(url: Column) -> Column:
    """Path part, without the ``;parameters`` of its last segment."""
    path = F.regexp_extract(_prepared(url), _RFC3986, 3)
    has_parameters = path.contains(";") & url_scheme(url).isin(*PARAMETER_SCHEMES)
    return F.when(has_parameters, F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)


def is_splittable(url: Column) -> Column:
    """False for URLs whose authority is malformed; such links are routed to the errors.

    One scan of the URL settles it for nearly all; only a suspicious one is taken apart.
    """
    netloc = url_netloc(url)
    bracketed = netloc.rlike(r"[\[\]]")
    well_formed = ~netloc.rlike("[" + _FOLDS_TO_DELIMITER + "]") & (
        ~bracketed | netloc.rlike(_BRACKETED_HOST)
    )
    return ~url.rlike(r"[\[\]" + _FOLDS_TO_DELIMITER + "]") | well_formed


def domain_component(url: Column) -> Column:
    """Lowercased authority without ``www.``, ``.com`` and ``.org``; null when nothing is left."""
    domain = F.lower(url_netloc(url))
    for affix in DOMAIN_AFFIXES:
        domain = F.replace(domain, F.lit(affix), F.lit(""))
    return F.nullif(domain, F.lit(""))


def meaningful_words(path: Column) -> Column:
    """Words of a path (split at ``/`` and ``-``) without the generic ones; case is kept."""
    parts = F.split(path, "[/-]")
    return F.filter(parts, lambda w: (w != "") & ~F.lower(w).isin(*GENERIC_PATH_WORDS))


def path_words(url: Column) -> Column:
    return meaningful_words(url_path(url))


def url_tokens(url: Column) -> Column:
    """Authority split at dots, then non-empty path segments; ``[url]`` when it cannot be split."""
    netloc = url_netloc(url)
    hosts = F.when(netloc != "", F.split(netloc, r"\.")).otherwise(F.array().cast("array<string>"))
    segments = F.array_remove(F.split(url_path(url), "/"), "")
    return F.when(is_splittable(url), F.concat(hosts, segments)).otherwise(F.array(url))


def resolve_href(source_url: Column, href: Column) -> Column:
    """``source_url + href`` unless ``http`` occurs anywhere in ``href``; plain concatenation."""
    return F.when(href.contains("http"), href).otherwise(F.concat(source_url, href))
