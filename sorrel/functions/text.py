"""Scalar functions over columns: parsing, normalising and formatting. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "\u2014"


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))


def title_of(raw: Column) -> Column:
    """The title before a trailing "(year)"; the whole string without one."""
    return F.when(raw.rlike(r"^.+\s+\(\d{4}\)$"), F.regexp_extract(raw, r"^(.+)\s+\(\d{4}\)$", 1)).otherwise(raw)


def year_of(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"^.+\s+\((\d{4})\)$", 1), F.lit("")).cast("int")


# The characters that count as white space, as a class and one by one.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A number: digits with single underscores between them, a fraction, an exponent; or infinity or no number, by name.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
NUMBER = rf"(?i)^[+-]?(?:inf(?:inity)?|nan|(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?)$"


def strip(raw: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(raw, F.lit(WHITES))


def number_of(raw: Column) -> Column:
    """The number that a text is, white space around it aside; null for anything else, such as "2d"."""
    bare = strip(raw)
    return F.when(bare.rlike(NUMBER), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def normal_code(raw: Column) -> Column:
    return F.upper(strip(raw))


def normal_description(raw: Column) -> Column:
    """Upper case, single blanks, no punctuation at the end; only punctuation stays as it is."""
    plain = F.upper(F.regexp_replace(strip(raw), f"[{WHITE}]+", " "))
    bare = strip(F.regexp_replace(plain, r"[.,;:!?]+$", ""))
    return F.when(bare == "", plain).otherwise(bare)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def fmt(x: Column, decimals: int = 4) -> Column:
    """A fixed number of decimals; a dash for what is no finite number."""
    return F.when(finite(x), F.format_string(f"%.{decimals}f", x.cast("double"))).otherwise(F.lit(DASH))


def format_percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x.cast("double") * 100)


def format_metric(x: Column) -> Column:
    return F.when(finite(x), F.format_string("%.4f", x.cast("double"))).otherwise(F.lit("n/a"))


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def escape_html(x: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(raw), F.lit(entity))
    return x


def describe_item(stock: Column, description: Column) -> Column:
    """CODE — DESCRIPTION; the code alone if nothing describes it."""
    return F.when(F.coalesce(description, F.lit("")) == "", stock).otherwise(F.concat(stock, F.lit(f" {DASH} "), description))


def format_itemset(items: Column, separator: str = ", ") -> Column:
    return F.when(F.size(items) == 0, F.lit("(empty)")).otherwise(F.array_join(items, separator))


def title_or_number(title: Column, id_: Column) -> Column:
    return F.coalesce(title, F.concat(F.lit("Movie #"), id_.cast("string")))


def rating_bucket(x: Column) -> Column:
    return F.when(x >= 4, "high").when(x <= 2, "low").otherwise("medium")


def node_radius(score: Column) -> Column:
    return F.when(score.isNull() | (score == 0) | (score == 0.1), F.lit(8.0)).otherwise(8 + score * 120)


def node_colour(score: Column) -> Column:
    heat = F.least(score * 10, F.lit(1.0))
    part = lambda x: F.floor(x).cast("string")
    rgb = F.concat(F.lit("rgb("), part(100 + heat * 155), F.lit(", "), part(100 + (1 - heat) * 155), F.lit(", "), part(200 - heat * 100), F.lit(")"))
    return F.when(score.isNull() | (score == 0) | (score == 0.1), F.lit("#ccc")).otherwise(rgb)


def because_you_liked(title: Column, recommended: Column) -> Column:
    """A sentence for a liked title and an array of recommended titles."""
    some = F.concat(F.lit('Because you liked "'), title, F.lit('", we recommend: '), F.array_join(recommended, ", "))
    none = F.concat(F.lit('No recommendations found for "'), title, F.lit('".'))
    return F.when(F.size(recommended) > 0, some).otherwise(none)
