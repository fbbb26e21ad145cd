"""Tokenising, stop words and highlighting with built-in functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENGLISH = "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so such that the their them then there these they this to too us was we were what when which who will with you your"
_STOP: dict[str, str] = {
    "en": _ENGLISH,
    "de": "aber als am an auch auf aus bei bin bis das dem den der des die ein eine einem einen einer er es für hat ich im in ist ja mit nach nicht noch nur oder sie sind so um und uns von war was wie wir zu zum zur",
    "fr": "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous",
    "es": "a al algo como con de del desde donde el ella ellos en entre era es esta este ha hasta la las le les lo los más me mi muy no nos o para pero por que se sin sobre son su sus también te un una y ya",
}
_ANALYSERS: dict[str, Callable[[Column], Column]] = {}


def tokens(text: Column, pattern: str = r"[^\p{L}\p{N}']+") -> Column:
    """Lower-case tokens between runs of ``pattern``, none of them empty, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), pattern), lambda x: x != "")


def register_analyser(locale: str, analyser: Callable[[Column], Column]) -> None:
    """Use ``analyser`` (an array of tokens to an array of terms: a stemmer, say) for a locale."""
    _ANALYSERS[locale] = analyser


def stop_words(locale: str) -> list[str]:
    """Of a locale, or of its language where the locale with its region has none."""
    while locale and locale not in _STOP:
        locale = locale.rpartition("_")[0]
    return _STOP.get(locale, "").split()


def analyse(text: Column, locale: str = "en", stop: bool = False) -> Column:
    """Terms of a text: tokens, without stop words if asked, through the locale's analyser if there is one."""
    out = tokens(text)
    words = stop_words(locale) if stop else []
    if words:
        out = F.filter(out, lambda x: ~x.isin(*words))
    while locale and locale not in _ANALYSERS:
        locale = locale.rpartition("_")[0]
    return _ANALYSERS[locale](out) if locale else out


def log_terms(message: Column) -> Column:
    """Different lower-case terms of a log message; ``unknown`` if it has none."""
    t = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(message, F.lit(""))), r"[^a-z0-9']+"), lambda x: x != ""))
    return F.when(F.size(t) == 0, F.array(F.lit("unknown"))).otherwise(t)


def highlight(text: Column, terms: list[str], size: int = 100, most: int = 4, before: str = "<b>", after: str = "</b>") -> Column:
    """The fragments of ``size`` characters with most hits (at most ``most``, in their order), terms marked, joined by dots."""
    if not terms:
        return F.lit(None).cast("string")
    pattern = r"(?i)\b(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")\b"
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    scored = F.transform(parts, lambda x, i: F.struct((-F.size(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)))).alias("n"), i.alias("i"), x.alias("x")))
    best = F.slice(F.sort_array(F.filter(scored, lambda x: x["n"] < 0)), 1, most)
    ordered = F.sort_array(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x"))))
    marked = F.transform(ordered, lambda x: F.regexp_replace(x["x"], pattern, f"{before}$1{after}"))
    return F.when(F.size(best) > 0, F.array_join(marked, " ... "))
