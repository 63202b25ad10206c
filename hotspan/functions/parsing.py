"""Tolerant parsing of text columns. Every function here is a built-in column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that count as "no value" in an incident file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Names of the months, by number.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# A time of day: hour, minute, second, fraction, half of the day, zone.
_CLOCK = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d{1,9}))?)?\s*([AaPp][Mm])?"
_TIME = r"(?:(?:[Tt]|,?\s+)" + _CLOCK + r"\s*([Zz]|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?)?$"
# Separates the parts of a text that was recognised; no text that holds it is.
_SEP = "\x01"


def _rearranged(*groups: int) -> str:
    return _SEP.join([*[f"${g}" for g in groups], *[f"${g}" for g in range(4, 10)]])


# Families of layouts: how a text of the family begins, its pattern, and its groups in the order year, month, day. Months
# come before days where both are numbers.
DATE_FAMILIES = (
    (r"^\d{4}[-/.]", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME, _rearranged(1, 2, 3)),
    (r"^\d{1,2}[-/.]\d", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + _TIME, _rearranged(3, 1, 2)),
    (r"^[A-Za-z]", r"^([A-Za-z]{3,9})\.?[\s-]+(\d{1,2}),?[\s-]+(\d{4})" + _TIME, _rearranged(3, 1, 2)),
    (r"^\d{8}", r"^(\d{4})(\d{2})(\d{2})" + _TIME, _rearranged(1, 2, 3)),
    (r"^\d{1,2}", r"^(\d{1,2})[\s-]*([A-Za-z]{3,9})\.?,?[\s-]*(\d{4}|\d{2})" + _TIME, _rearranged(3, 2, 1)),
)
# Years of two digits below this one are in this century.
_CENTURY = 69


def blank_to_null(col: Column) -> Column:
    """Trimmed text, NULL where it is one of the missing-value tokens."""
    text = F.trim(col.cast("string"))
    return F.when(~text.isin(*MISSING_TOKENS), text)


def to_double(col: Column) -> Column:
    """Number or NULL. NaN and infinities become NULL because they poison distance arithmetic."""
    # No token for a missing value is a finite number, and NaN is not below infinity.
    text = F.trim(col.cast("string"))
    number = text.try_cast("double")
    # '1d' and '1f' are Java literals, not numbers a data file would hold.
    return F.when((F.abs(number) < F.lit(float("inf"))) & ~F.substring(text, -1, 1).isin("d", "f", "D", "F"), number)


def date_parts(col: Column) -> Column:
    """Year, month, day, hour, minute, second, fraction, half and zone of a date text, as texts; NULL when it is no date.

    The beginning of a text decides which family's pattern it has to match, so one pattern is matched per text; a text
    that does not match it comes back as a single part. No token for a missing value matches. Keep the result behind
    ``once`` where several columns are derived from it.
    """
    text = F.trim(col.cast("string"))
    found = F.when(text.contains(_SEP), None)
    for start, pattern, groups in DATE_FAMILIES:
        found = found.when(text.rlike(start), F.regexp_replace(text, F.lit(pattern), F.lit(groups)))
    return F.split(found, _SEP)


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _or_zero(text: Column) -> Column:
    return _number(F.when(text == "", F.lit("0")).otherwise(text))


def _hour_of_day(hour: Column, half: Column) -> Column:
    """Hour from 0 to 23; with AM or PM the hour has to be one of 1 to 12."""
    twelve = F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0))
    return F.when(half == "", F.when(hour.between(0, 23), hour)).otherwise(twelve)


def timestamp_of(parts: Column) -> Column:
    """Timestamp from the parts of a date text, NULL where there is no such day or time.

    Without a zone the text is local time of the session; with one it is that moment.
    """
    names = {name: i + 1 for i, full in enumerate(MONTHS) for name in (full, full[:3])} | {"sept": 9}
    by_name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    year, month = _number(F.get(parts, F.lit(0))), F.coalesce(_number(F.get(parts, F.lit(1))), F.try_element_at(by_name, F.lower(F.get(parts, F.lit(1)))))
    year = F.when(F.length(F.get(parts, F.lit(0))) > 2, year).otherwise(year + F.when(year < _CENTURY, 2000).otherwise(1900))
    second = F.when(_or_zero(F.get(parts, F.lit(5))) < 60, F.concat(
        F.when(F.get(parts, F.lit(5)) == "", "0").otherwise(F.get(parts, F.lit(5))), F.lit("."), F.substring(F.get(parts, F.lit(6)), 1, 6), F.lit("0")).try_cast("decimal(16,6)"))
    fields = dict(years=year, months=month, days=_number(F.get(parts, F.lit(2))), hours=_hour_of_day(_or_zero(F.get(parts, F.lit(3))), F.get(parts, F.lit(7))),
                  mins=_or_zero(F.get(parts, F.lit(4))), secs=second)
    zone = F.replace(F.get(parts, F.lit(8)), F.lit(":"), F.lit(""))
    minutes = _or_zero(F.substring(zone, 2, 2)) * 60 + _or_zero(F.substring(zone, 4, 2))
    offset = F.when(zone.rlike("^[+-]"), F.when(F.substring(zone, 1, 1) == "-", -minutes).otherwise(minutes)).otherwise(0)
    moment = F.try_make_timestamp(**fields, timezone=F.lit("UTC")) - F.make_dt_interval(mins=offset)
    return F.when(zone == "", F.try_make_timestamp(**fields)).otherwise(moment)


def to_timestamp_any(col: Column) -> Column:
    """Timestamp from a text of any known layout, else NULL. The text is parsed once, as the only element of an array."""
    return F.get(F.transform(F.array(date_parts(col)), timestamp_of), F.lit(0))


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """The table with further columns that are evaluated once per row, however often they are used afterwards.

    A projection would be merged into every filter and column above it, its expressions repeated there; the single
    element of an exploded array is not.
    """
    return df.select("*", F.explode(F.array(F.struct(*columns))).alias("_once")).select(*df.columns, "_once.*")


def parse_pct(col: Column) -> Column:
    """`85%` -> 85.0, NULL when it is not a number."""
    return to_double(F.regexp_replace(F.trim(col.cast("string")), "^%+|%+$", ""))


def hour_parts(col: Column) -> Column:
    """The parts of a time text: hour, minute, second, fraction and half; or those of a date text; NULL when it is neither."""
    text = F.trim(col.cast("string"))
    clock = F.split(F.regexp_replace(text, F.lit(f"^{_CLOCK}$"), F.lit(_SEP.join(f"${g}" for g in range(1, 6)))), _SEP)
    return F.when(text.rlike(r"^\d{1,2}:") & ~text.contains(_SEP), clock).otherwise(date_parts(col))


def hour_candidates(parts: Column) -> list[Column]:
    """Hour under each family of layouts: hours and minutes, with seconds, anything else."""
    hour, valid = _hour_of_day(_number(F.get(parts, F.lit(0))), F.get(parts, F.lit(4))), (_number(F.get(parts, F.lit(1))) < 60) & (_or_zero(F.get(parts, F.lit(2))) < 60)
    clock = (F.size(parts) == 5) & valid
    plain = clock & (F.get(parts, F.lit(4)) == "") & (F.get(parts, F.lit(3)) == "")
    return [F.when(plain & (F.get(parts, F.lit(2)) == ""), hour), F.when(plain & (F.get(parts, F.lit(2)) != ""), hour),
            F.when(clock & ~plain, hour).when(F.size(parts) == 9, F.hour(timestamp_of(parts)))]


def chosen_hour(candidates: list[Column], counts: Column) -> Column:
    """Hour under the first family that parses any row, given a struct with the counts f0, f1, ... of all but the last."""
    return reduce(
        lambda rest, i: F.when(counts[f"f{i}"] > 0, candidates[i]).otherwise(rest),
        reversed(range(len(candidates) - 1)),
        candidates[-1],
    )


def hour_counts(df: DataFrame, parts: Column) -> Column:
    """Rows that each family of time layouts parses, as a one-row scalar subquery."""
    families = hour_candidates(parts)[:-1]
    return df.select(F.struct(*[F.count(c).alias(f"f{i}") for i, c in enumerate(families)])).scalar()


def parse_hour(df: DataFrame, source: Column, policy: str = "column") -> Column:
    """Hour of day from a time text.

    ``policy='column'`` picks one layout for the whole column, the first that parses any row, with a
    one-row scalar subquery (so it costs one extra pass and no driver round trip).
    ``policy='row'`` tries every layout on each row.
    """
    if policy not in ("row", "column"):
        raise ValueError(f"unknown policy {policy!r}: use 'column' or 'row'")
    families = F.transform(F.array(hour_parts(source)), lambda parts: F.array(*hour_candidates(parts)))
    candidates = [F.get(F.get(families, F.lit(0)), F.lit(i)) for i in range(3)]
    if policy == "row":
        return F.coalesce(*candidates)
    return chosen_hour(candidates, hour_counts(once(df, hour_parts(source).alias("_hour_parts")), F.col("_hour_parts")))
