"""Byte-level BPE encoding and decoding as a monoid tree reduction.

An element of the monoid is a stretch of a text with its ids.  Two neighbours are joined by encoding a window around
the cut once more.  The window grows to both sides until it reaches a place between a non-space and a white-space
character: there every match of the split pattern ends whatever follows or precedes (each alternative is white space
only, or at most one leading space and then characters of a single other kind), so the ids outside the window are those of
the whole text.  Where no such place exists the window grows to the whole stretch, which is always right.
Leaves are short stretches; a text is halved until it fits a leaf.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from claimloom.llm.common import SPACE, arrow_map, chosen, texts_of
from claimloom.llm.tokens import BytePairs, byte_pairs

LEAF_CHARS = 1024
_EDGE = re.compile(f"[^{SPACE}](?=[{SPACE}])")


def _edge_before(text: str, low: int, cut: int) -> int:
    """The last sure boundary in (low, cut], else low; looks back over doubling distances."""
    reach = 32
    while True:
        start = max(low, cut - reach)
        place = low
        for hit in _EDGE.finditer(text, start, min(cut + 1, len(text))):
            place = hit.end()
        if place > low or start == low:
            return place
        reach *= 2


def _edge_after(text: str, cut: int, high: int) -> int:
    """The first sure boundary in [cut, high), else high."""
    hit = _EDGE.search(text, cut - 1, high)
    return hit.end() if hit else high


def _drop_bytes(ids: list[int], size: int, bytes_of: list[bytes], step: int) -> int:
    """How many ids, from the front (step 1) or the back (step -1), make up ``size`` bytes."""
    count, place = 0, 0 if step == 1 else -1
    while size > 0:
        size -= len(bytes_of[ids[place]])
        place += step
        count += 1
    if size:
        raise ValueError("a sure boundary does not fall between two ids")
    return count


def encode_tree(text: str, pairs: BytePairs, leaf: int = LEAF_CHARS) -> list[int]:
    """Ids of a text, by halves."""

    def encoded(low: int, high: int) -> list[int]:
        if high - low <= leaf:
            return pairs.encode(text[low:high])
        cut = (low + high) // 2
        left, right = encoded(low, cut), encoded(cut, high)
        start, end = _edge_before(text, low, cut), _edge_after(text, cut, high)
        kept = len(left) - _drop_bytes(left, len(text[start:cut].encode()), pairs.bytes_of, -1)
        skipped = _drop_bytes(right, len(text[cut:end].encode()), pairs.bytes_of, 1)
        return left[:kept] + pairs.encode(text[start:end]) + right[skipped:]

    return encoded(0, len(text))


def decode_tree(ids: list[int], pairs: BytePairs, leaf: int = LEAF_CHARS) -> bytes:
    """Bytes of ids: halves are decoded and concatenated."""
    if len(ids) <= leaf:
        return b"".join(map(pairs.bytes_of.__getitem__, ids))
    half = len(ids) // 2
    return decode_tree(ids[:half], pairs, leaf) + decode_tree(ids[half:], pairs, leaf)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF_CHARS) -> DataFrame:
    """(id, ids binary): ids of each text as little-endian unsigned 32-bit integers.

    One row per input row, repeated rows and null ids included.  Null texts count as empty (no ids); texts of any length
    are encoded whole; an empty table gives an empty result; further columns are ignored.
    """
    def work(c):
        pairs = byte_pairs(rank_file, pattern)
        return {"doc_id": c["doc_id"], "ids": [np.array(encode_tree(t, pairs, leaf), dtype="<u4").tobytes() for t in texts_of(c["text"])]}

    return arrow_map(chosen(docs, doc_id=id_col, text=text_col), work, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids, bytes binary) of the rows of ``encode``; null ids give null bytes."""
    def work(c):
        pairs = byte_pairs(rank_file, pattern)
        texts = [None if ids is None else decode_tree(np.frombuffer(ids, dtype="<u4").tolist(), pairs, leaf) for ids in c["ids"].to_pylist()]
        return {"doc_id": c["doc_id"], "ids": c["ids"], "decoded": texts}

    return arrow_map(encoded, work, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")

