"""Text classes of item descriptions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_word_labels(words: Mapping[str, str]) -> list[str]:
    """The four class names of two labelled words."""
    first, second = words
    return [f"only_{first}", f"only_{second}", f"{first}_and_{second}",
            f"neither_{first}_nor_{second}"]


def two_word_class(text: Column, words: Mapping[str, str]) -> Column:
    """Which of two words the text holds: one, the other, both or neither (NULL: neither)."""
    only_first, only_second, both, neither = two_word_labels(words)
    has_first, has_second = (F.coalesce(text.contains(w), F.lit(False)) for w in words.values())
    return (
        F.when(has_first & has_second, both)
        .when(has_first, only_first)
        .when(has_second, only_second)
        .otherwise(neither)
    )


def single_word_class(text: Column, words: Mapping[str, str], many: str, none: str) -> Column:
    """Label of the only word found, ``many`` for several, ``none`` for no word or NULL text."""
    found = F.array_compact(
        F.array(*[F.when(text.contains(word), F.lit(label)) for label, word in words.items()])
    )
    return (
        F.when(F.size(found) == 0, none).when(F.size(found) == 1, F.get(found, F.lit(0)))
        .otherwise(many)
    )
