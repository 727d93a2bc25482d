"""Name rules (metadata only; they run on the driver over column names).

P1 turns column names into snake_case; S5 tidies a dataset name.
"""

from __future__ import annotations

import re

# The two snake_case rewrites (applied in this order, before
# lower-casing) and the set of characters removed afterwards.
_WORD_AFTER_ANY = re.compile(r"(.)([A-Z][a-z]+)")
_UPPER_AFTER_LOWER_OR_DIGIT = re.compile(r"([a-z0-9])([A-Z])")
_NOT_NAME_CHAR = re.compile(r"[^a-zA-Z0-9_]")


def normalize_name(name: str) -> str:
    """``First Name`` -> ``first_name``, ``userID`` -> ``user_id``,
    ``HTTPServer`` -> ``http_server``; other symbols are removed."""
    s = _WORD_AFTER_ANY.sub(r"\1_\2", name)
    s = _UPPER_AFTER_LOWER_OR_DIGIT.sub(r"\1_\2", s).lower()
    return _NOT_NAME_CHAR.sub("", s)


def normalize_names(names: list[str], on_collision: str = "raise") -> list[str]:
    """Normalise every name, then check the whole set before any work.

    ``on_collision='raise'`` rejects an empty result or two names equal
    ignoring case; ``'suffix'`` appends ``_2``, ``_3``... (and names an empty
    result ``column_<position>``).
    """
    if on_collision not in ("raise", "suffix"):
        raise ValueError("on_collision must be 'raise' or 'suffix'")
    out = [normalize_name(n) for n in names]
    if on_collision == "raise":
        empty = [names[i] for i, n in enumerate(out) if not n]
        if empty:
            raise ValueError(f"column name(s) {empty} normalise to an empty name")
        seen: dict[str, str] = {}
        for orig, new in zip(names, out):
            key = new.lower()
            if key in seen:
                raise ValueError(
                    f"columns {seen[key]!r} and {orig!r} both normalise to {new!r}")
            seen[key] = orig
        return out
    taken: set[str] = set()
    result = []
    for i, new in enumerate(out):
        base = new or f"column_{i}"
        cand, k = base, 2
        while cand.lower() in taken:
            cand, k = f"{base}_{k}", k + 1
        taken.add(cand.lower())
        result.append(cand)
    return result


def clean_dataset_name(name: str) -> str:
    """Keep letters, digits and ``_``; drop trailing spaces."""
    return "".join(ch for ch in name if ch.isalnum() or ch == "_").rstrip()
