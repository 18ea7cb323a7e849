"""Splitting texts into pre-tokens exactly as the byte-level tokenizer files do, with a fast path."""

from __future__ import annotations

import functools
import re

#: Texts of these characters only (Latin-1 and common punctuation) take the fast path: for them
#: Python's classes and lower-casing agree with the library's. All others go through the library.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-\xff‐-‧€]*").fullmatch
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
# The two published split patterns, for Latin-1.
SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+").findall
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+").findall


@functools.cache
def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def lettered(unit: str) -> str:
    return unit.encode().decode("latin-1").translate(byte_letters())


@functools.cache
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
