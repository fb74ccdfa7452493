"""Pages: by key, by position, and per group; and the cursor that names the place of a next page."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curriq.session import cut


def keyset_page(rows: DataFrame, keys: list[str], last: list | None, limit: int) -> DataFrame:
    """The rows after the key `last`, which must exist, in order of keys (ascending; negate numbers to descend)."""
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 rows")
    if last is not None:
        spot = F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, last, strict=True)])
        own = F.struct(*keys)
        if rows.where(own == spot).isEmpty():
            raise LookupError("the cursor's row is not among the results")
        rows = rows.where(own > spot)
    return rows.orderBy(*keys).limit(limit)


def numbered(rows: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """rows with their place (from 1) in order of keys: dealt by ranges of keys, numbered in each range, and moved up by what the
    ranges before hold. Written under folder, as a second reading could be dealt otherwise."""
    dealt = cut(rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), folder, "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return dealt.join(F.broadcast(starts), "__range").withColumn("place", (own + F.col("__start")).cast("long")).drop("__range", "__start")


def within_budget(rows: DataFrame, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The first rows whose running cost stays within the budget; the first that would exceed it ends the list.

    For lists that a request bounds already: the running sum is over one partition.
    """
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(cost).over(w).cast("long")).where(F.col("running") <= budget)


def encode_cursor(query_sha256: str, index_sha256: str, position: list) -> str:
    """Opaque text of a place in a result, bound to the query and to the index."""
    payload = {"index": index_sha256, "position": position, "query": query_sha256}
    body = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    wrapped = json.dumps({"payload": payload, "sha256": hashlib.sha256(body.encode()).hexdigest()}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(wrapped.encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str, query_sha256: str, index_sha256: str) -> list:
    """The position of a cursor; an error if it is damaged, not in its one canonical form, or of another query or index."""
    try:
        payload = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))["payload"]
        query, index, position = payload["query"], payload["index"], payload["position"]
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("not a cursor") from error
    if encode_cursor(query, index, position) != cursor:
        raise ValueError("the cursor is damaged")
    if query != query_sha256 or index != index_sha256:
        raise ValueError("the cursor belongs to another query or index")
    return position


def byte_window(text: str, start: int, limit: int) -> tuple[str, int]:
    """(part, next start) of at most limit bytes of UTF-8 from a byte offset; characters stay whole."""
    data = text.encode()
    if not 0 <= start <= len(data) or (start < len(data) and data[start] & 0xC0 == 0x80):
        raise ValueError("not the start of a character")
    end = min(len(data), start + limit)
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return data[start:end].decode(), end
