"""String functions of the serving layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and their media types; the default's spelling is part of the format.
MIME = {"html": "text/html", "js": "text/javascript", "css": "text/css", "gif": "image/gif", "jpg": "image/jpeg", "json": "application/json"}
MIME_DEFAULT = "test/plain"


def mime(path: Column) -> Column:
    """Media type by what follows the last dot."""
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.regexp_extract(path, r"\.([^.]*)$", 1)), F.lit(MIME_DEFAULT))


def log_path(checksum: Column) -> Column:
    return F.concat(F.lit("/record/"), F.substring(checksum, 1, 2), F.lit("/"), checksum)


def short_url(url: Column) -> Column:
    """The last two labels of the host."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1)
    return F.substring_index(host, ".", -2)


def lang_route(accept: Column) -> Column:
    return F.when(F.contains(accept, F.lit("zh")), F.lit("/cn.html")).otherwise(F.lit("/index.html"))


def param(text: Column, kind: str, default) -> Column:
    """A typed parameter; the default where it is absent or cannot be cast."""
    return F.coalesce(text.try_cast(kind), F.lit(default).cast(kind))


def page_ids(json: Column) -> Column:
    """The id list of a response."""
    return F.from_json(json, "page array<bigint>").getField("page")


def first_component(path: Column, id_: Column) -> Column:
    """The id behind the first component of a path."""
    return F.concat(F.regexp_extract(path, "^/?([^/]*)", 1), F.lit("/"), id_.cast("string"))
