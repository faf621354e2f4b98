"""SQL text that both engines share."""

from __future__ import annotations


def columns(select: str) -> list[str]:
    """The expressions of a select list, split at its outer commas, in Spark's spelling."""
    parts, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(select):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(select[start:i])
                start = i + 1
    return [p.strip().replace("VARCHAR", "STRING") for p in [*parts, select[start:]]]
