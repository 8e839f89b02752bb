"""What a Python worker keeps between batches: bounded by bytes, and held for one operator at a time.

Spark hands a worker from stage to stage. So a cache that one operator filled would stay while another fills its own;
here the first use by another operator empties all caches of the one before.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import pyarrow as pa

#: Bounds of a token cache: entries (each of some 150 bytes at most, with its token), and characters of a token that is kept.
CACHED_TOKENS, CACHED_CHARS = 1 << 16, 48

_owner = ""
_kept: list[Callable[[], None]] = []


def keeps(clear: Callable[[], None]) -> None:
    """Registers how something that is kept between batches is let go."""
    _kept.append(clear)


def release() -> None:
    """Gives freed memory back to the system, as other workers and the executor need it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def claim(owner: str) -> None:
    """Says which operator runs now; what another one kept goes."""
    global _owner
    if owner != _owner:
        for clear in _kept:
            clear()
        release()
        _owner = owner


class TokenIds(dict):
    """Values of tokens, computed when first seen; starts anew when full. Long tokens are computed each time."""

    def __init__(self, make: Callable[[str], int]):
        self.make = make
        keeps(self.clear)

    def __missing__(self, token) -> int:
        value = self.make(token)
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[token] = value
        return value
