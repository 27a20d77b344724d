"""Checks of identifiers, dates and amounts: each gives struct<value, problem>; a null value is one that failed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters read for digits, and what a value that was read so is told.
LOOKALIKE_FROM, LOOKALIKE_TO, REPAIRED = "OoQDIl|ZSB", "0000111258", "read a letter as a digit"
# Shapes of dates and of what may trail them.
ISO, NUMERIC, NAMED = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})", r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})"
TIME = r"(?i),?\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]\.?\s?m\.?)?\s*$"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
# Names of states and territories, and their codes.
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO",
    "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI",
    "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY",
    "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH",
    "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH",
    "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD",
    "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY", "Puerto Rico": "PR", "Guam": "GU", "Virgin Islands": "VI",
    "American Samoa": "AS", "Northern Mariana Islands": "MP",
}


def outcome(ok: Column, value: Column, problem: Column | str, note: Column | None = None) -> Column:
    """struct<value, problem>: a value that failed is null; one that holds may carry a note as its problem."""
    good = F.coalesce(ok, F.lit(False))
    why = F.lit(problem) if isinstance(problem, str) else problem
    return F.struct(F.when(good, value).alias("value"), F.when(~good, why).otherwise(F.lit(None).cast("string") if note is None else note).alias("problem"))


def _mended(raw: Column) -> Column:
    """Raw text where runs that hold a digit have their lookalike letters read as digits."""
    run = "[0-9OoQDIl|ZSB]+"
    pieces = F.regexp_extract_all(raw, F.lit(f"{run}|[^0-9OoQDIl|ZSB]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{run}$") & p.rlike("[0-9]"), F.translate(p, LOOKALIKE_FROM, LOOKALIKE_TO)).otherwise(p)), "")


def digits(raw: Column) -> Column:
    return F.regexp_replace(_mended(raw), "[^0-9]", "")


def _note(raw: Column) -> Column:
    return F.when(_mended(raw) != raw, REPAIRED)


def npi(raw: Column) -> Column:
    """Ten digits whose Luhn sum with the issuer prefix 80840 holds."""
    d = digits(raw)
    ten = F.coalesce(F.length(d) == 10, F.lit(False))
    holds = F.call_function("luhn_check", F.when(ten, F.concat(F.lit("80840"), d)).otherwise(F.lit("0")))
    return outcome(ten & holds, d, F.when(~ten, "NPI must be 10 digits").otherwise("NPI check digit fails"), _note(raw))


def tin(raw: Column) -> Column:
    d = digits(raw)
    return outcome(F.length(d) == 9, F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 7)), "TIN must be 9 digits", _note(raw))


def dea(raw: Column) -> Column:
    """Two letters and seven digits; the last digit is that of the first, third and fifth plus twice the others."""
    plain = F.upper(F.regexp_replace(raw, r"\s+", ""))
    v = F.concat(F.substring(plain, 1, 2), F.translate(F.substring(plain, 3, 1000), LOOKALIKE_FROM, LOOKALIKE_TO))
    shape = v.rlike("^[A-Z]{2}[0-9]{7}$")
    digit = lambda i: F.when(shape, F.substring(v, 2 + i, 1).cast("int"))
    total = digit(1) + digit(3) + digit(5) + 2 * (digit(2) + digit(4) + digit(6))
    return outcome(shape & (total % 10 == digit(7)), v, F.when(shape, "DEA check digit fails").otherwise("DEA must be 2 letters and 7 digits"), F.when(v != plain, REPAIRED))


def zip_code(raw: Column) -> Column:
    d = F.regexp_replace(raw, "[^0-9]", "")
    value = F.when(F.length(d) == 9, F.concat_ws("-", F.substring(d, 1, 5), F.substring(d, 6, 4))).otherwise(d)
    return outcome(F.length(d).isin(5, 9), value, "zip must be 5 or 9 digits")


def phone(raw: Column) -> Column:
    """Ten digits, a leading 1 dropped, an extension kept."""
    shape = r"(?i)\s*(?:x|ext\.?|extension)\s*(\d+)\s*$"
    extension = F.regexp_extract(raw, shape, 1)
    main = F.regexp_replace(F.regexp_replace(raw, shape, ""), "[^0-9]", "")
    d = F.when((F.length(main) == 11) & main.startswith("1"), F.substring(main, 2, 10)).otherwise(main)
    shown = F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4), F.when(extension != "", F.concat(F.lit(" x"), extension)).otherwise(F.lit("")))
    return outcome(F.length(d) == 10, shown, "phone must be 10 digits")


def state(raw: Column) -> Column:
    pairs = STATES.items()
    names = F.create_map(*[F.lit(v) for name, code in pairs for v in (name.lower(), code)])
    codes = [code for _, code in pairs]
    v = F.trim(raw)
    code = F.when(F.upper(v).isin(codes), F.upper(v)).otherwise(F.try_element_at(names, F.lower(v)))
    return outcome(code.isNotNull(), code, "unrecognized state")


def taxonomy(raw: Column) -> Column:
    plain = F.upper(F.regexp_replace(raw, r"\s+", ""))
    v = F.concat(F.translate(F.substring(plain, 1, 3), LOOKALIKE_FROM, LOOKALIKE_TO), F.substring(plain, 4, 1000))
    return outcome(v.rlike("^[0-9]{3}[A-Z0-9]{6}X$"), v, "invalid taxonomy code", F.when(v != plain, REPAIRED))


def yes_no(raw: Column) -> Column:
    v = F.lower(F.trim(raw))
    value = F.when(v.isin("yes", "y", "true", "checked", "x"), "Yes").when(v.isin("no", "n", "false", "unchecked"), "No")
    return outcome(value.isNotNull(), value, "unrecognized value")


def gender(raw: Column) -> Column:
    v = F.lower(F.trim(raw))
    value = F.when(v.isin("f", "female", "woman"), "F").when(v.isin("m", "male", "man"), "M").when(v.isin("x", "non-binary"), "X")
    return outcome(value.isNotNull(), value, "unrecognized gender")


def _day(y: Column, m: Column, d: Column) -> Column:
    whole = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when((y.try_cast("int") > 0) & m.isNotNull() & d.isNotNull(), F.date_format(F.try_to_date(whole, "yyyy-MM-dd"), "yyyy-MM-dd"))


def _parsed(text: Column, lead: str, tail: str) -> list[tuple[Column, Column]]:
    """(has the shape, day or null) for each shape of a date, in order."""
    months = MONTHS
    numbers = F.create_map(*[F.lit(x) for i, m in enumerate(months, 1) for n in dict.fromkeys((m.lower(), m[:3].lower())) for x in (n, str(i))])
    part = lambda shape, i: F.regexp_extract(text, lead + shape + tail, i)
    year = F.when(F.length(part(NUMERIC, 3)) == 2, F.concat(F.lit("20"), part(NUMERIC, 3))).otherwise(part(NUMERIC, 3))
    return [
        (text.rlike(lead + ISO + tail), _day(part(ISO, 1), part(ISO, 2), part(ISO, 3))),
        (text.rlike(lead + NUMERIC + tail), _day(year, part(NUMERIC, 1), part(NUMERIC, 2))),
        (text.rlike(lead + NAMED + tail), _day(part(NAMED, 3), F.try_element_at(numbers, F.lower(part(NAMED, 1))), part(NAMED, 2))),
    ]


def date(raw: Column) -> Column:
    """ISO, month/day/year and month-name dates as ISO; two-digit years are after 2000; a time may trail. A date inside other text is
    taken with a note. A day that the calendar lacks is impossible."""
    text = F.trim(F.regexp_replace(F.trim(raw), TIME, ""))
    whole, inside = _parsed(text, "^", "$"), _parsed(raw, r"(?<!\d)", r"(?!\d)")
    exact = F.coalesce(*[F.when(has, day) for has, day in whole])
    found = F.coalesce(exact, *[F.when(has, day) for has, day in inside])
    shaped = F.coalesce(whole[0][0] | whole[1][0], F.lit(False)) | F.coalesce(F.lower(F.regexp_extract(text, f"^{NAMED}$", 1)).isin([n for m in map(str.lower, MONTHS) for n in (m, m[:3])]), F.lit(False))
    return outcome(found.isNotNull(), found, F.when(shaped, "impossible date").otherwise("unrecognized date"), F.when(exact.isNull(), "text around the date ignored"))


def money(raw: Column) -> Column:
    """Amounts with separators and the words thousand, million, billion; whole amounts without decimals. Several dots, or one before three
    digits, are separators misread."""
    low = F.lower(F.trim(raw))
    factor = F.when(F.contains(low, F.lit("thousand")), 1e3).when(F.contains(low, F.lit("million")), 1e6).when(F.contains(low, F.lit("billion")), 1e9).otherwise(1.0)
    d = F.regexp_replace(low, "[^0-9.]", "")
    misread = (F.length(d) - F.length(F.replace(d, F.lit("."), F.lit(""))) > 1) | d.rlike(r"\.[0-9]{3}$")
    amount = F.when(misread, F.replace(d, F.lit("."), F.lit(""))).otherwise(d).try_cast("double") * factor
    shown = F.when(amount == F.floor(amount), amount.try_cast("decimal(38,0)").cast("string")).otherwise(F.format_string("%.2f", amount))
    return outcome(amount.isNotNull(), shown, "invalid amount", F.when(misread, "separator misread"))


def credential(raw: Column) -> Column:
    from pagelake.functions.regions import credential as known

    return known(raw)


#: The checks by name; each takes a text column and gives struct<value, problem>.
CHECKS = {"npi": npi, "tin": tin, "dea": dea, "date": date, "phone": phone, "zip": zip_code, "state": state, "taxonomy": taxonomy, "credential": credential, "gender": gender, "money": money, "yes_no": yes_no}
