"""Suggestions while typing: frequent words and title phrases."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .lexicon import complete

_WORD = re.compile("[a-z0-9]+")


def suggest(text: str, words: DataFrame, phrases: DataFrame, limit: int = 8) -> list[str]:
    """At most ``limit`` completions of the text. Each lookup returns at most ``limit`` keys to the driver."""
    typed = " ".join(_WORD.findall(text.lower()))
    if not typed:
        return []
    top = lambda keys, prefix: [r.key for r in complete(keys, prefix, limit).collect()]
    found: dict[str, None] = {}

    def add(candidates: list[str]) -> list[str]:
        found.update((c, None) for c in candidates if c != typed)
        return list(found)[:limit]

    parts = typed.split(" ") + ([""] if text[-1].isspace() else [])
    if len(parts) == 1:
        of_phrases = top(phrases, typed)
        return add(top(words, typed)[: limit - min(len(of_phrases), limit // 2)] + of_phrases)
    for size in (3, 2, 1):
        kept, context = parts[:-size], " ".join(parts[-size:])
        if size > len(parts) or not context.strip():
            continue
        add([" ".join([*kept, key]) for key in top(phrases, context)])
        if len(found) >= limit // 2:
            return list(found)[:limit]
    if parts[-1]:
        add([" ".join([*parts[:-1], key]) for key in top(words, parts[-1])])
    return list(found)[:limit]
