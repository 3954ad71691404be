"""Exact byte-level BPE ids of whole texts, by the public tokenizer files.

Most texts go through the rank file with a pattern that needs no look-ahead:
without two white-space characters in a row it splits as the full pattern
does.  Texts with characters outside the plain blocks below, where Unicode
versions of the libraries differ, are split into words by the tokenizers
library's own pre-tokenizer (``library_words``), and texts that hold a special
token's string go to that library whole.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

#: The public split pattern, and the same without its look-ahead.
FULL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SINGLE_SPACE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
#: Blocks whose letters, digits and spaces all libraries see alike.
PLAIN = r"\t\n\r\x20-\x7E¡-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ԧぁ-ゖァ-ヺ一-龥"
_NOT_PLAIN = re.compile(f"[^{PLAIN}]")
_SPACES = re.compile(r"\s\s")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranked(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(f"{path}{len(pattern)}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    """The strings of the special tokens, from the file itself: most tasks never need the library."""
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f).get("added_tokens", ()))


def is_special(text: str, json_path: str) -> bool:
    """Whether a text holds a special token's string."""
    return any(s in text for s in special_strings(json_path))


def is_plain(text: str) -> bool:
    return not _NOT_PLAIN.search(text)


def library_words(text: str, json_path: str) -> list[str]:
    """The words into which the library splits a text without special tokens; joined they are the text."""
    return [text[a:b] for _, (a, b) in library(json_path).pre_tokenizer.pre_tokenize_str(text)]


def encode(text: str, json_path: str, ranks_path: str) -> np.ndarray:
    """The library's ids of a whole text (add_special_tokens=False) as unsigned 32-bit values."""
    if not is_plain(text) or is_special(text, json_path):
        return np.array(library(json_path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    return ranked(ranks_path, FULL_PATTERN if _SPACES.search(text) else SINGLE_SPACE_PATTERN).encode_to_numpy(text).astype("<u4", copy=False)
