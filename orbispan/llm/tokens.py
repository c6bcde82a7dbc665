"""Byte-level BPE ids of texts."""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np


def vocabulary_path(name: str, path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def added_tokens() -> dict[str, int]:
    """Tokens outside the merges, as the tokenizers file of the public vocabulary adds them."""
    with open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str | None = None, plain: bool = False):
    """The byte-level BPE as a tiktoken encoding; its ids equal those of the tokenizers file of the same vocabulary.

    plain: without the look-ahead for runs of white space, which makes the splitter a third faster. Only for texts in
    which no white space follows white space; there both split alike.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path("byte_bpe_50k.tiktoken", path), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN
    return tiktoken.Encoding("byte_bpe", pat_str=pattern.replace(r"\s+(?!\S)|", "") if plain else pattern, mergeable_ranks=ranks, special_tokens={} if path else added_tokens())


_WIDE_BLANK = re.compile(r"\s\s")
#: White space as the vocabulary's pattern means it, and how long a run of it the splitter is given: it backtracks over each
#: blank and would overflow its stack on some hundred thousands.
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_BLANK = 4096
_LONG_BLANK = re.compile(f"{_BLANK}{{{LONG_BLANK},}}")


def text_encoder(path: str | None = None):
    """A function from a text to its ids as little-endian unsigned 32-bit bytes; added tokens in a text count as such.

    A run of white space is one piece but for its last blank, which belongs to what follows; a very long run is cut off by
    that rule, so texts of any length and make can be encoded.
    """
    whole = byte_bpe(path)
    added = {t: whole.encode_single_token(t) for t in whole.special_tokens_set}
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    full, plain, piece = whole.encode_ordinary, byte_bpe(path, True).encode_ordinary, whole._encode_single_piece

    def encoded(text: str) -> list[int]:
        if not _WIDE_BLANK.search(text):
            return plain(text)
        if len(text) < LONG_BLANK or not _LONG_BLANK.search(text):
            return full(text)
        ids, at = [], 0
        for m in _LONG_BLANK.finditer(text):
            cut = m.end() - (m.end() < len(text))
            ids += full(text[at : m.start()])
            ids += piece(text[m.start() : cut])
            at = cut
        return ids + full(text[at:])

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if added and any(a in text for a in added):
            ids = [i for part in split.split(text) for i in ([added[part]] if part in added else encoded(part) if part else [])]
        else:
            ids = encoded(text)
        return np.array(ids, dtype="<u4").tobytes()

    return encode
