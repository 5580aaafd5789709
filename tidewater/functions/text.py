"""Text expressions: titles, years, dates, deadlines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, for Java patterns.
UNICODE_SPACE = r"(?U)\s+"
#: Punctuation that event identities ignore (fixed values).
IDENTITY_PUNCTUATION = "，。！？：；、（）()【】\\[\\]‘’“”\"'…·,.;:!?"


#: Characters that compatibility composition may change: all but ASCII, composed Latin letters, Han and some marks.
_COMPOSABLE = r"[^\x00-\x7F\u00C0-\u00FF\u3001\u3002\u3008-\u3011\u4E00-\u9FFF]"


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    out = s.copy()
    some = s.notna()
    out[some] = [unicodedata.normalize("NFKC", t) for t in s[some]]
    return out


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark has no function for; texts that it can't change stay in the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(_COMPOSABLE), text)), text)


def normalize_title(title: Column, exact: bool = True) -> Column:
    """Compatibility form, lower case, no white space. `exact=False` skips the composition and stays in the JVM."""
    text = F.coalesce(title, F.lit(""))
    return F.regexp_replace(F.lower(nfkc(text) if exact else text), UNICODE_SPACE, "")


def compact(value: Column, exact: bool = True) -> Column:
    return F.regexp_replace(normalize_title(value, exact), f"(?U)[{IDENTITY_PUNCTUATION}\\s]+", "")


def award_identity(value: Column, exact: bool = True) -> Column:
    """Compact name of an award without its year."""
    return F.regexp_replace(compact(value, exact), r"(?:19|20)[0-9]{2}(?:年度|年)?", "")


def first_year(*parts: Column) -> Column:
    found = F.regexp_extract(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]), r"(?:19|20)[0-9]{2}", 0)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def years_in(title: Column) -> Column:
    """All years 20xx that don't continue a number, as integers."""
    found = F.regexp_extract_all(title, F.lit(r"(?<![0-9])(20[0-9]{2})"), F.lit(1))
    return F.transform(found, lambda y: y.cast("int"))


def strict_date(value: Column) -> Column:
    """Only YYYY-MM-DD (or with slashes); everything else is null."""
    text = F.replace(F.coalesce(value, F.lit("")), F.lit("/"), F.lit("-"))
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def lenient_date(value: Column) -> Column:
    """A leading YYYY-M-D or YYYY/M/D as ISO text; '' if there is none or it is no date."""
    parts = [F.regexp_extract(F.trim(F.coalesce(value, F.lit(""))), r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})", i) for i in (1, 2, 3)]
    iso = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.coalesce(F.date_format(F.try_to_date(F.when(parts[0] != "", iso), "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(""))


def find_date(text: Column) -> Column:
    """The first date-like run of a text with separators turned into hyphens, digits as found."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"[0-9]{4}[-./年][0-9]{1,2}[-./月][0-9]{1,2}", 0)
    return F.regexp_replace(found, "[年月./]", "-")


def epoch_date(text: Column) -> Column:
    """Date of timeConvert('<ten digits>') in the session's time zone, or ''."""
    seconds = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"timeConvert\(['\"]?([0-9]{10})['\"]?\)", 1), F.lit(""))
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds.cast("long")), "yyyy-MM-dd"), F.lit(""))


#: How a deadline text writes a full date, and a month and day.
_FULL_DATE = r"((?:19|20)[0-9]{2})\s*[年/-]\s*([0-9]{1,2})\s*[月/-]\s*([0-9]{1,2})\s*日?"
_MONTH_DAY = r"([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日?"


def infer_deadline(text: Column, reference_year: Column) -> Column:
    """Last valid date that a deadline text names, or ''.

    A month and day stands for a date of the last full date's year, or of the
    reference year. Valid month-day dates win over full ones, each the later in
    the text over the earlier.
    """
    t = F.coalesce(text, F.lit(""))
    found = lambda pattern, groups: F.arrays_zip(*[F.regexp_extract_all(t, F.lit(pattern), F.lit(i + 1)).alias(name) for i, name in enumerate(groups)])
    full = found(_FULL_DATE, "ymd")
    year = F.coalesce(F.try_element_at(full, F.lit(-1))["y"], reference_year.cast("string"))
    date = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    dates = F.concat(F.transform(full, lambda p: date(p["y"], p["m"], p["d"])), F.transform(found(_MONTH_DAY, "md"), lambda p: date(year, p["m"], p["d"])))
    return F.coalesce(F.try_element_at(F.array_compact(dates), F.lit(-1)).cast("string"), F.lit(""))


def text_array(stored: Column) -> Column:
    """Texts of an array that is stored as JSON; what is null, blank, malformed or no array is an empty array."""
    value = F.try_parse_json(stored)
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(F.transform(items, variant_text), F.array().cast("array<string>"))


def variant_text(item: Column) -> Column:
    """An item of an array as text: strings as they are, others as they are written, a null as None."""
    kind = F.schema_of_variant(item)
    flag = F.when(F.try_variant_get(item, "$", "boolean"), "True").otherwise("False")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", flag).otherwise(F.try_variant_get(item, "$", "string"))


def array_problem(stored: Column) -> Column:
    """Whether a stored text that isn't blank fails to be a JSON array."""
    return (F.coalesce(stored, F.lit("")) != "") & F.try_variant_get(F.try_parse_json(stored), "$", "array<variant>").isNull()
