"""String functions on columns: label folding, light stemming, term sets, relevance and display rules."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Plural forms that the general rule would fold wrongly.
PLURALS = {"shelves": "shelf", "boxes": "box"}
# Suffixes tried in order, and what replaces them, when at least 3 letters stay.
SUFFIXES = [("ies", "y"), ("ing", ""), ("es", ""), ("ed", ""), ("s", "")]
# Weights of a question term that equals or overlaps a name term, or a context term.
WEIGHTS = (3.0, 1.5, 1.0, 0.5)


def squashed(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed; null gives an empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def folded_query(c: Column) -> Column:
    return F.lower(F.trim(c))


def label_fold(c: Column) -> Column:
    """A label's clustering key: squashed, in the singular."""
    text = squashed(c)
    out = F.when((F.length(text) > 3) & text.endswith("s") & ~text.endswith("ss"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    for plural, singular in PLURALS.items():
        out = F.when(text == plural, F.lit(singular)).otherwise(out)
    return out


def stem(c: Column) -> Column:
    """A lower-case word without its first matching suffix; words in ss stay."""
    word = F.lower(c)
    out = word
    for suffix, instead in reversed(SUFFIXES):
        fits = word.endswith(suffix) & (F.length(word) - len(suffix) >= 3)
        out = F.when(fits, F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(instead))).otherwise(out)
    return F.when(word.endswith("ss"), word).otherwise(out)


def terms(c: Column, least: int = 3) -> Column:
    """The distinct stems of words of at least `least` letters, in order of appearance."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= least), stem))


def overlaps(a: Column, b: Column) -> Column:
    """Either string, if at least 4 long, lies within the other."""
    return ((F.length(a) >= 4) & b.contains(a)) | ((F.length(b) >= 4) & a.contains(b))


def relevance(question: Column, name: Column, context: Column) -> Column:
    """The sum over question terms of the weight of the first tier that matches: name, part of name, context, part of context."""

    def weight(q: Column) -> Column:
        exact, part, near, near_part = WEIGHTS
        return (
            F.when(F.array_contains(name, q), exact)
            .when(F.exists(name, lambda t: overlaps(q, t)), part)
            .when(F.array_contains(context, q), near)
            .when(F.exists(context, lambda t: overlaps(q, t)), near_part)
            .otherwise(0.0)
        )

    return F.aggregate(F.transform(question, weight), F.lit(0.0), lambda a, x: a + x)


def display_label(human: Column, query: Column) -> Column:
    """The human label if there is one, else the query, else 'object'."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(full(human), full(query), F.lit("object"))


def without_measures(c: Column) -> Column:
    """The trimmed text, or null if it states a number with a unit of length."""
    return F.when(~F.lower(c).rlike(r"\d\s*(mm|cm|km|m|metres?|meters?|inch(es)?|ft|feet)\b"), F.trim(c))


def extent_label(extent: Column, places: int = 2) -> Column:
    """'a × b × c', largest first."""
    return F.concat_ws(" × ", F.transform(F.sort_array(extent, False), lambda x: F.format_string(f"%.{places}f", x)))


def first_number(c: Column) -> Column:
    """The first number in a path's last part; null if there is none."""
    base = F.element_at(F.split(c, "/"), -1)
    return F.regexp_extract(base, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def safe_part(c: Column) -> Column:
    """A string as one path part: other characters than letters, digits, dot, dash and underscore become underscores."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def is_identifier(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def query_list(c: Column, most: int = 32) -> Column:
    """Trimmed distinct non-empty entries in order, at most `most`."""
    trimmed = F.filter(F.transform(c, lambda q: F.trim(q)), lambda q: F.length(q) > 0)
    return F.slice(F.array_distinct(trimmed), 1, most)


def candidates(*lists: Column, most: int = 8) -> Column:
    """Lists merged in order, the first of equal entries kept, at most `most`."""
    return F.slice(F.array_distinct(F.concat(*lists)), 1, most)


def plain_name(c: Column, most: int = 36) -> Column:
    """Lower case with anything but letters, digits, space and dash as spaces, squashed and cut."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", " "), r"\s+", " ")), F.lit(most))


def caption(title: Column, brand: Column, model: Column, category: Column, query: Column) -> Column:
    """Title, else brand and model, else category, else query; empty strings count as missing."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    made = F.nullif(F.trim(F.concat_ws(" ", full(brand), full(model))), F.lit(""))
    return F.coalesce(full(title), made, full(category), full(query))


def natural_key(c: Column) -> Column:
    """For sorting names by their first number, then by name."""
    return F.struct(F.regexp_extract(c, r"(\d+)", 1).try_cast("long").alias("number"), c.alias("name"))


def digest(c: Column, length: int = 64) -> Column:
    """The first hex digits of SHA-256; with a salt, pass F.concat(salt, value)."""
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(length))


def args_digest(args: Column) -> Column:
    """A digest of a map of arguments that doesn't depend on their order."""
    return digest(F.to_json(F.array_sort(F.map_entries(args))), 32)


def presented(result: dict, budget: int = 12_000) -> str:
    """A result as JSON of at most budget characters.

    If it is longer, whole items are cut from the end of its longest list, of equals the first, and a field _truncated tells of which, how
    many are shown and of how many. If no list is long enough, or the result is no object, an object that
    refuses it stands for it; that alone may pass a budget below its own length."""
    whole = json.dumps(result, default=str)
    if len(whole) <= budget:
        return whole
    lists = [(k, v) for k, v in result.items() if isinstance(v, list) and v] if isinstance(result, dict) else []
    if lists:
        name, items = max(lists, key=lambda kv: len(kv[1]))

        def cut(n: int) -> str:
            note = f"{n} of {len(items)} {name} are shown; the others exist. Ask for less, or for more at once, to see them."
            return json.dumps({**result, name: items[:n], "_truncated": {"field": name, "shown": n, "total": len(items), "note": note}}, default=str)

        low, high = 0, len(items)  # cut(low) fits, if any does; cut(high) doesn't count
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if len(cut(middle)) <= budget else (low, middle)
        if len(cut(low)) <= budget:
            return cut(low)
    return json.dumps({"error": "result_too_large", "note": "The result didn't fit and isn't shown in part. Ask for less; nothing follows from its absence.", "bytes": len(whole)})


def presented_results(results: Column, budget: int = 12_000) -> Column:
    """presented() of a column of JSON texts; what isn't JSON stays as it is if it fits, and is refused otherwise."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return presented(json.loads(text), budget)
            except ValueError:
                return text if len(text) <= budget else presented(text, budget)

        return texts.map(one)

    return run(results)
