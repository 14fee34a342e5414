"""Text normalisation as column expressions; exact Unicode folding as an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import CALENDAR_DAY

WORD_PATTERN = r"[\p{L}\p{N}]+"


def fold_name(value: str | None) -> str | None:
    """Strip, lower-case, decompose (NFKD) and drop combining marks; null stays null."""
    if value is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKD", value.strip().lower()) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    codes, uniques = pd.factorize(values)
    names = pd.array([*(fold_name(u) for u in uniques), None], dtype=object)
    return pd.Series(names[codes], dtype=object)


def category_name(column: Column) -> Column:
    """Exact folding of a label column; each distinct spelling of a batch is folded once."""
    return _folded(column.cast("string"))


def plain_text(value: str) -> str:
    """Lower-cased and decomposed (NFKD), combining marks dropped."""
    low = value.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def valid_date(column: Column) -> Column:
    """The date of a ``yyyy-MM-dd`` text that names a real day, else null; never throws."""
    return F.when(column.rlike(f"\\A{CALENDAR_DAY}\\z"), F.try_to_date(column, "yyyy-MM-dd"))


def letters_and_numbers(column: Column) -> Column:
    """Lower-cased, everything but letters and numbers removed; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+", "")


# Portuguese stop words. Token results depend on exactly this list.
STOP_WORDS = (
    "a à às ao aos aquela aquelas aquele aqueles aquilo as com como da das de dela delas dele deles depois do dos e é ela elas "
    "ele eles em entre era eram essa essas esse esses esta estas este estes estou eu foi foram há isso isto já lhe lhes mais mas "
    "me mesmo meu meus minha minhas muito na não nas nem no nos nós nossa nossas nosso nossos num numa o os ou para pela pelas "
    "pelo pelos por qual quando que quem são se seja sem ser será seu seus só sobre sua suas também te tem tém ter teu teus tu "
    "tua tuas um uma umas uns vocês você"
).split()
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
LETTERS_PATTERN = "^[a-zá-ú]{3,}$"
SPACE_PATTERN = r"(?U)\s+"


def squeezed(column: Column) -> Column:
    """Lower-cased, white space collapsed and stripped; null stays null."""
    return F.trim(F.regexp_replace(F.lower(column), SPACE_PATTERN, " "))


def tokens(column: Column, drop_stop_words: bool = True) -> Column:
    """Words in order, repeats kept; null gives an empty array."""
    found = F.coalesce(F.regexp_extract_all(F.lower(column), F.lit(TOKEN_PATTERN), F.lit(0)), F.array().cast("array<string>"))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS)) if drop_stop_words else found


def letter_tokens(column: Column) -> Column:
    """Words of at least three plain or accented letters, without stop words."""
    return F.filter(tokens(column), lambda t: t.rlike(LETTERS_PATTERN))


def stripped(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def title_and_text(title: Column, text: Column) -> Column:
    """Both parts stripped and joined with one blank; null and blank parts are left out, none gives ''."""
    return F.concat_ws(" ", F.nullif(stripped(title), F.lit("")), F.nullif(stripped(text), F.lit("")))


def first_words(column: Column, number: int) -> Column:
    """The text itself if it has at most ``number`` words, else these, single-spaced."""
    words = F.regexp_extract_all(column, F.lit(r"(?U)\S+"), F.lit(0))
    return F.when(F.size(words) <= number, column).otherwise(F.array_join(F.slice(words, 1, number), " "))


def first_class(answer: Column, classes: list[str]) -> Column:
    """The first term of letters and inner hyphens, folded, if it is one of the classes, else null."""
    term = category_name(F.regexp_extract(answer, r"\p{L}+(?:-\p{L}+)*", 0))
    return F.when(term.isin(classes), term)


def rendered(prompt: str, text: Column) -> Column:
    """A prompt with its ``{text}`` replaced, literally."""
    return F.replace(F.lit(prompt), F.lit("{text}"), text)


def shortened(column: Column, length: int = 160) -> Column:
    return F.when(F.length(column) > length, F.concat(F.substring(column, 1, length - 3), F.lit("..."))).otherwise(column)


def character_shingles(column: Column, width: int = 5) -> Column:
    """Distinct runs of ``width`` characters of a squeezed text; a shorter text is its own, an empty has none."""
    size = F.length(column)
    runs = F.transform(F.sequence(F.lit(1), size - width + 1), lambda i: F.substr(column, i, F.lit(width)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < width, F.array(column)).otherwise(F.array_distinct(runs))


def quarter(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
