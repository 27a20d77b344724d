"""Text risks and text keys as column expressions; Arrow functions where a rule looks at repeats of unknown length."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Labels after which a date's shape is judged too.
DATE_LABELS = ("dob", "date of birth", "birth date", "visit date", "service date", "reported date")
TOKEN = r"(?<![0-9])([0-9]{1,6})[./-]([0-9]{1,6})[./-]([0-9]{1,6})(?![0-9])"


def has_character_run(text: Column) -> Column:
    """A letter four times or more in a row, in either case."""
    return text.rlike(r"(?i)([a-z])\1{3,}")


def impossible_date(text: Column) -> Column:
    """A date-shaped token, year first or last, that is no day of the calendar with month and day either way round."""

    return F.exists(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _no_day)


def _no_day(x: Column) -> Column:
    pieces = F.split(x, "[./-]")
    n = [F.length(F.get(pieces, i)) for i in range(3)]
    v = [F.get(pieces, i).cast("int") for i in range(3)]
    year_last = F.when(n[2] == 2, 2000 + v[2]).otherwise(v[2])

    def day(y, m, d):
        month = F.greatest(F.least(m, F.lit(12)), F.lit(1))
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        longest = F.when(month.isin(4, 6, 9, 11), 30).when((month == 2) & leap, 29).when(month == 2, 28).otherwise(31)
        return (y >= 1) & m.between(1, 12) & d.between(1, longest)

    first = (n[0] == 4) & (n[1] <= 2) & (n[2] <= 2)
    last = (n[0] != 4) & (n[0] <= 2) & (n[1] <= 2) & n[2].isin(2, 4)
    return (first & ~day(v[0], v[1], v[2])) | (last & ~day(year_last, v[0], v[1]) & ~day(year_last, v[1], v[0]))


def letter_among_digits(text: Column) -> Column:
    """At least two numeric tokens, at least half of all, and a single letter next to a number."""
    tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    number = lambda t: t.rlike("^[0-9]+$")
    letter = lambda t: t.rlike(r"^\p{L}$")
    numbers = F.size(F.filter(tokens, number))
    pairs = F.arrays_zip(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("a"), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("b"))
    beside = F.exists(pairs, lambda p: (letter(p["a"]) & number(p["b"])) | (number(p["a"]) & letter(p["b"])))
    return (numbers >= 2) & (2 * numbers >= F.size(tokens)) & beside


def alnum_key(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "[^A-Za-z0-9]", ""))


def exceeds_capacity(text: Column, area: Column) -> Column:
    """More text than fits: twelve square pixels a character other than white space."""
    return F.length(F.regexp_replace(text, r"\s", "")) * 12 > area


@F.pandas_udf(StringType())
def folded(values: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space collapsed."""
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))


@F.pandas_udf(BooleanType())
def repeats_tail(values: pd.Series) -> pd.Series:
    """The text ends in a unit of at most 256 characters, not blank, eight times or more."""

    def one(t: str | None) -> bool | None:
        if t is None:
            return None
        for size in range(1, min(256, len(t) // 8) + 1):
            unit = t[-size:]
            if unit.strip() and t.endswith(unit * 8):
                return True
        return False

    return values.map(one)


@F.pandas_udf(BooleanType())
def repeats_suffix(values: pd.Series) -> pd.Series:
    """The last n characters, at least 30 and fewer than half of all, come twice at the end."""
    return values.map(lambda t: None if t is None else _long_suffix(t))


def _long_suffix(t: str) -> bool:
    # a doubled suffix of n characters starts where the last 30 occurred before
    end, at = t[-30:], len(t) - 30
    while (at := t.rfind(end, 0, at + 29)) >= 0:
        n = len(t) - 30 - at
        if 30 <= n < len(t) // 2 and t[-n:] == t[-2 * n : -n]:
            return True
    return False


@F.pandas_udf(BooleanType())
def repeats_phrase(values: pd.Series) -> pd.Series:
    """A phrase of 2 to 32 words, not all one word, three times in a row."""

    def one(t: str | None) -> bool | None:
        if t is None:
            return None
        places: dict[str, int] = {}
        w = np.array([places.setdefault(x, len(places)) for x in re.findall(r"\w+", t.lower())], np.int32)
        for n in range(2, min(32, len(w) // 3) + 1):
            # a stretch of 2n places that equal those n before them is a phrase that comes three times
            parted = np.flatnonzero(np.concatenate([[True], w[n:] != w[:-n], [True]]))
            for i in np.flatnonzero(np.diff(parted) > 2 * n):
                if len(set(w[parted[i] : parted[i] + n].tolist())) >= 2:
                    return True
        return False

    return values.map(one)
