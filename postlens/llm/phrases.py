"""Words of benchmark items and documents, and items in groups of bounded size.

A word is a maximal run of characters outside ``SEPARATORS``, with A-Z in lower
case.  All separators are ASCII, so one byte table finds the same words in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import plain_text

#: Bytes that part words (fixed values): 0x00-0x2F, 0x3A-0x40, 0x5B-0x60, 0x7B-0x7F.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLD = bytes(0x20 if b in SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: Characters of item texts that are broadcast at once.
MOST_CHARS = 4_000_000


def folded(text: bytes | None) -> bytes:
    """The text in UTF-8 with each separator as a blank; ``split`` gives its words."""
    return (text or b"").translate(FOLD)


def item_groups(items: DataFrame, most_chars: int = MOST_CHARS) -> Iterator[tuple[dict[int, list[list[bytes]]], bool]]:
    """({item_id: [words of each text]}, last) of all items, group by group: a group holds
    about ``most_chars`` characters (one item at least), and only one group is on the
    driver at a time.  Repeated rows count once; different texts of one id are one
    item; rows with a null id take no part; null texts have no words."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), plain_text().alias("text")).filter("item_id IS NOT NULL").distinct()
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = max(1, -(-chars // most_chars))
    for g in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == g)
        out: dict[int, list[list[bytes]]] = {}
        for r in part.orderBy("item_id", "text").collect():
            out.setdefault(r["item_id"], []).append(folded(r["text"].encode()).split())
        yield out, g == n - 1
