"""Edge rules of neighbourhoods: which cell stands for an index outside 0..n-1.

``symmetric``  d c b a | a b c d | d c b a
``reflect``    d c b | a b c d | c b a
``clamp``      a a a | a b c d | d d d
``none``       no cell
"""

from __future__ import annotations

MODES = ("symmetric", "reflect", "clamp", "none")


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"edge rule {mode!r}; known: {', '.join(MODES)}")


def source_of(i: int, n: int, mode: str) -> int | None:
    """The index in 0..n-1 that stands for ``i``, or None for ``none`` outside."""
    check_mode(mode)
    if mode == "clamp":
        return max(0, min(n - 1, i))
    if mode == "none":
        return i if 0 <= i < n else None
    if n == 1:
        return 0
    m = i % (2 * n if mode == "symmetric" else 2 * n - 2)
    return m if m < n else (2 * n - 1 if mode == "symmetric" else 2 * n - 2) - m


def sql_index(i: str, n: str, mode: str) -> str:
    """The same as SQL text, for oracles."""
    check_mode(mode)
    if mode == "clamp":
        return f"greatest(0, least({n} - 1, {i}))"
    if mode == "none":
        return f"CASE WHEN {i} BETWEEN 0 AND {n} - 1 THEN {i} END"
    p = f"2 * ({n})" if mode == "symmetric" else f"(2 * ({n}) - 2)"
    m = f"(((({i}) % ({p})) + ({p})) % ({p}))"
    last = f"{p} - 1" if mode == "symmetric" else p
    return f"CASE WHEN {m} >= {n} THEN {last} - {m} ELSE {m} END"
