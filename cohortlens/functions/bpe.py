"""Applying a BPE merge table to one word (T8, re-aimed).

Standard BPE encoding: start from the word's characters and repeatedly merge
the adjacent pair with the best (lowest) rank in the merge table until no
ranked pair is left. Used on distinct words only (``operators.text``).
"""

from __future__ import annotations


def encode(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    parts = list(word)
    while len(parts) > 1:
        best, where = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get((parts[i], parts[i + 1]))
            if r is not None and (best is None or r < best):
                best, where = r, i
        if best is None:
            break
        a, b = parts[where], parts[where + 1]
        merged, i = [], 0
        while i < len(parts):
            if i < len(parts) - 1 and parts[i] == a and parts[i + 1] == b:
                merged.append(a + b)
                i += 2
            else:
                merged.append(parts[i])
                i += 1
        parts = merged
    return parts
