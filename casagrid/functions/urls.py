"""URL parts and page-kind tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casagrid.functions.numbers import col

MAX_URL = 2048


def url_path(c: Column | str) -> Column:
    """Lower-cased path without a trailing slash; empty when the text is not a URL."""
    return F.coalesce(F.rtrim(F.lower(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)), F.lit("/")), F.lit(""))


def url_tail(c: Column | str) -> Column:
    return F.btrim(F.element_at(F.split(url_path(c), "/"), -1))


def url_domain(c: Column | str) -> Column:
    host = F.lower(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def external_id(c: Column | str) -> Column:
    path = F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.rtrim(path, F.lit("/"))
    tail = F.element_at(F.split(path, "/"), -1)
    return F.when(tail != "", tail).otherwise(path)


# Shapes of listing pages, rental pages and listing indexes.
LISTING_URL = r"/inmuebles(?:-|$)|/inmuebles-[^/]+\.html$|/pagina-\d+|/ciudad/|/tipo-de-propiedad/"
RENTAL_URL = r"\balquiler\b|/alquiler-|/alquiler/|/alcl"
INDEX_URL = r"/inmuebles(?:-|$)|/inmuebles-[^/]+\.html$|/casas/?$|/venta/?$|/site/properties/sale/?$|/inmobiliaria/ciudad/|/inmobiliaria/tipo-de-propiedad/"


def is_listing_url(c: Column | str) -> Column:
    return url_path(c).rlike(LISTING_URL)


def is_rental_url(c: Column | str) -> Column:
    return url_path(c).rlike(RENTAL_URL)


def is_index_url(c: Column | str) -> Column:
    return url_path(c).rlike(INDEX_URL)


def mirror_key(c: Column | str) -> Column:
    """Last path part ending in two numbers, shared by mirrored adverts."""
    parts = F.filter(F.split(url_path(c), "/"), lambda p: p.rlike(r"-\d+-\d+$"))
    return F.coalesce(F.get(F.reverse(parts), F.lit(0)), F.lit(""))


def safe_https_url(c: Column | str) -> Column:
    """Normalised https URL, or empty for other schemes, credentials, bad ports and long texts."""
    u = F.btrim(F.coalesce(col(c), F.lit("")))
    pattern = r"^(?i)https://([^/?#@:]+)(?::(\d+))?(/[^?#]*)?(\?[^#]*)?(#.*)?$"
    host, port = F.lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)
    path, query = F.regexp_extract(u, pattern, 3), F.regexp_extract(u, pattern, 4)
    port_no = F.nullif(port, F.lit("")).try_cast("int")
    fine = u.rlike(pattern) & (F.length(u) <= MAX_URL) & ((port == "") | port_no.between(1, 65535))
    shown_port = F.when((port == "") | (port_no == 443), "").otherwise(F.concat(F.lit(":"), port_no.cast("string")))
    shown_query = F.when(query == "?", "").otherwise(query)
    return F.when(fine, F.concat(F.lit("https://"), host, shown_port, F.when(path == "", "/").otherwise(path), shown_query)).otherwise("")


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """Join a link to its page; fragments are dropped."""
    base, href = col(base), F.regexp_replace(F.btrim(col(href)), "#.*$", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    folder = F.when(F.length(folder) <= F.length(origin), F.concat(origin, F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href == "", page)
        .otherwise(F.concat(folder, href))
    )
