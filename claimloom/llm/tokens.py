"""Byte-level BPE from a rank file, loaded once per Python worker."""

from __future__ import annotations

import base64
import json

import numpy as np
import tiktoken

_loaded: dict[tuple[str, str, str | None], "BytePairs"] = {}


def byte_pairs(rank_file: str, pattern: str, vocabulary: str | None = None) -> "BytePairs":
    key = (rank_file, pattern, vocabulary)
    if key not in _loaded:
        _loaded[key] = BytePairs(rank_file, pattern, vocabulary)
    return _loaded[key]


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Texts and ids of the tokens that a vocabulary in the form of the tokenizers library adds to its merges.

    Only tokens that match wherever their text stands, and of which none begins another, mean the same to both libraries.
    """
    with open(vocabulary, encoding="utf-8") as file:
        whole = json.load(file)
    found = {t["content"]: t["id"] for t in whole["added_tokens"]}
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in whole["added_tokens"])
    if whole["normalizer"] or not plain or any(a != b and a.startswith(b) for a in found for b in found):
        raise ValueError(f"{vocabulary}: added tokens that depend on what is around them")
    return found


class BytePairs:
    """Ids of texts, and the bytes of each id.  Special tokens are text, except the added tokens of a ``vocabulary``."""

    def __init__(self, rank_file: str, pattern: str, vocabulary: str | None = None):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added = added_tokens(vocabulary) if vocabulary else {}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.encode = (lambda text: encoding.encode(text, allowed_special="all")) if added else encoding.encode_ordinary
        ranks |= {text.encode(): rank for text, rank in added.items()}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.array(self.encode(text), dtype="<u4").tobytes()
