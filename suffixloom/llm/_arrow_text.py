"""Cutting Arrow batches of texts into ranges of bounded size."""

from __future__ import annotations

from collections.abc import Iterator


def batches(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, so that the lists of words of one range stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
