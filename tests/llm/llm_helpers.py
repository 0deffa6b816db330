"""Plain restatements used by the tests of the training-data operators."""

from __future__ import annotations

import random
import string


def union_smallest(ids, links):
    """Smallest id reachable from each id over the links."""
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("".join(rng.choice(string.ascii_lowercase[:8]) for _ in range(1 + (i * 7 + n) % 5 + 1))
                    if vocabulary == 0 else f"w{rng.randrange(vocabulary)}" for i in range(n))
