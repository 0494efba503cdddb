"""What came of fetching pages, by rule over recorded responses; fetching itself is another job's."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_REDIRECTS, ROBOTS_BYTES, ROBOTS_MS = 5, 512 * 1024, 6000
TEXT_BYTES, TEXT_BYTES_HARD = 5 * 1024 * 1024, 50 * 1024 * 1024
READ = "struct<body: binary, error: string>"


def page_status(allowed: Column, public: Column, redirects: Column, status: Column, content_type: Column) -> Column:
    """ok, or the first thing that went wrong."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (
        F.when(~public, "blocked_address").when(~allowed, "blocked_robots").when(status.isNull(), "error").when(redirects > MOST_REDIRECTS, "too_many_redirects").when(status >= 400, "http_error")
        .when(~kind.isin("", "text/html", "application/xhtml+xml", "application/xml", "text/xml"), "not_html").otherwise("ok")
    )


def capped(body: Column, most: int) -> Column:
    """struct(body, truncated): a page is cut, not refused."""
    return F.struct(F.substring(body, 1, most).alias("body"), (F.octet_length(body) > most).alias("truncated"))


def unpack(body: bytes | None, content_type: str | None, most: int = TEXT_BYTES) -> tuple[bytes | None, str | None]:
    """A text file's bytes, unpacked if they are gzip; one that is too large is refused, and no more of it
    than that is unpacked."""
    most = min(most, TEXT_BYTES_HARD)
    if body is None:
        return None, "empty"
    kind = (content_type or "").partition(";")[0].strip().lower()
    packed = body[:2] == b"\x1f\x8b"
    if not packed and kind and not (kind.startswith("text/") or kind.endswith("xml") or kind in ("application/gzip", "application/x-gzip", "application/octet-stream")):
        return None, "not_text"
    if packed:
        stream = zlib.decompressobj(31)
        try:
            body = stream.decompress(body, most + 1)
        except zlib.error:
            return None, "broken"
    return (None, "too_large") if len(body) > most else (body, None)


def text_bodies(files: DataFrame, body_col: str = "body", type_col: str = "content_type", most: int = TEXT_BYTES) -> DataFrame:
    """``files`` with ``read``: the text's bytes, or why there are none."""

    @F.arrow_udf(READ)
    def run(bodies: pa.Array, kinds: pa.Array) -> pa.Array:
        found = [unpack(b, k, most) for b, k in zip(bodies.to_pylist(), kinds.to_pylist(), strict=True)]
        return pa.array([{"body": b, "error": e} for b, e in found], pa.struct([("body", pa.binary()), ("error", pa.string())]))

    return files.withColumn("read", run(F.col(body_col), F.col(type_col)))


def robots_files(fetches: DataFrame, most_bytes: int | None = ROBOTS_BYTES) -> DataFrame:
    """(host, status, text) for the rules: no status where there was no answer in time or too many hops;
    of the text the first ``most_bytes`` (None: all)."""
    came = (F.col("redirects") <= MOST_REDIRECTS) & (F.col("ms") <= ROBOTS_MS)
    return fetches.select("host", F.when(came, F.col("status")).alias("status"), (F.col("text") if most_bytes is None else F.substring("text", 1, most_bytes)).alias("text"))
