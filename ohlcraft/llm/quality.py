"""Quality rules: a table of thresholds compiled into one Spark expression over the text, without user functions.

``measures`` counts words, symbols, stop words and lines of a text; ``RULES`` says which ratio of them must lie between
which bounds; ``verdict`` compiles both into one column, so that a filter or a projection evaluates every rule in a single
pass over the rows. Nothing moves between executors and no row meets another one.

Repeated windows are found inside the text: windows of equal hash are candidates, and only windows of equal words count.

Nulls: a null text has no words, fails the base and isn't kept; so does an empty or blank one. Very long texts are treated
whole; their arrays live in one task. Repeated rows get equal results. Columns of the input with the names of the results
don't clash: the report reads ``doc_id`` and ``text`` alone, and ``clean`` adds no column. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK

WORDS = f"[^{BLANK}]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: Base: the share of words in repeated windows, in percent.
MAX_REPEATED = 20
#: Marks that may surround a stop word.
EDGES = ".,;:!?\"'()[]#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it was with on by as be this are at from "
    "de la le et les des en un du une que est pour par qui dans pas sur au avec "
    "der die und den von zu das mit sich auf für ist nicht im dem ein eine als "
    "el y los se las del con por no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``part / whole`` of two measures must lie between ``low`` and ``high``; a text without the whole passes."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None

    def holds(self, measures: Column) -> Column:
        whole = measures[self.whole]
        ratio = measures[self.part] / whole
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (ratio >= self.low)
        if self.high is not None:
            ok = ok & (ratio <= self.high)
        return F.when(whole == 0, F.lit(True)).otherwise(ok)


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2, 15),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", low=0.05),
    Rule("repeated_line_share", "n_dup_lines", "n_lines", high=0.3),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", high=0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _beside(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The items of a sorted array that are the same as the one before or after them."""
    return F.filter(items, lambda x, i: F.coalesce(
        ((i > 0) & same(F.get(items, i - 1), x)) | ((i < F.size(items) - 1) & same(F.get(items, i + 1), x)), F.lit(False)))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows whose words occur twice or more in the array."""

    def covered(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        alike = let(tagged, lambda t: _beside(t, lambda a, b: a["h"] == b["h"]))
        spelled = F.sort_array(F.transform(alike, lambda x: F.struct(F.slice(words, x["i"] + 1, window).alias("w"), x["i"].alias("i"))))
        places = let(spelled, lambda s: F.sort_array(F.transform(_beside(s, lambda a, b: a["w"] == b["w"]), lambda x: x["i"])))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) > window, some).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of all counts of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{BLANK}]")))
    parts = F.struct(F.regexp_extract_all(text, F.lit(WORDS), 0).alias("words"), lines.alias("lines"))

    def count(items: Column, test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(items, test))

    def counts(p: Column) -> Column:
        words, lines = p["words"], p["lines"]
        found = {
            "n_words": F.size(words),
            "word_chars": F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")),
            "n_symbols": F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words),
            "n_stop_words": count(words, lambda w: F.lower(F.btrim(w, F.lit(EDGES))).isin(STOP_WORDS)),
            "n_bullet_lines": count(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "·")),
            "n_ellipsis_lines": count(lines, lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("…"))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in found.items()])

    return let(parts, counts)


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the measures, ``base_failed``, ``broken`` (names of the rules that don't hold) and ``kept``."""

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
        broken = F.array_compact(F.array(*[F.when(~r.holds(m), F.lit(r.name)) for r in rules], F.lit(None).cast("string")))
        return let(F.struct(failed.alias("base_failed"), broken.alias("broken")), lambda v: F.struct(
            m.alias("measures"), v["base_failed"].alias("base_failed"), v["broken"].alias("broken"),
            (~v["base_failed"] & (F.size(v["broken"]) == 0)).alias("kept")))

    return let(measures(text), judged)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, broken rules and verdict of every document."""
    judged = docs.select(F.col("doc_id"), verdict(F.col("text"), rules).alias("v"))
    return judged.select(
        "doc_id", *[F.col(f"v.measures.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("v.base_failed").alias("base_failed"), F.col("v.kept").alias("kept"), F.concat_ws(",", "v.broken").alias("broken"),
        *[F.col(f"v.measures.{k}").alias(k) for k in ("n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")])


def clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their columns."""
    return docs.filter(verdict(F.col("text"), rules)["kept"])
