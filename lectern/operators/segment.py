"""Pluggable word segmentation: a registry of Column functions, with a longest-match lexicon as default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.operators.lookup import any_word

SEGMENTERS: dict[str, Callable[..., Column]] = {}


def register(name: str):
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        SEGMENTERS[name] = f
        return f

    return add


@register("lexicon")
def lexicon(text: Column, words: list[str]) -> Column:
    """Longest word of the lexicon at each place, else a run of letters or digits, else one character."""
    return F.regexp_extract_all(text, F.lit(f"({any_word(words)}|[A-Za-z]+|\\p{{Nd}}+|\\X)"), F.lit(1))


@register("spaces")
def spaces(text: Column, words: list[str] | None = None) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0d]+"), lambda t: t != "")


def segment(name: str, text: Column, **options) -> Column:
    if name not in SEGMENTERS:
        raise KeyError(name)
    return SEGMENTERS[name](text, **options)
