"""Column expressions that turn messy numeric text into numbers and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters dropped before a number is read.
CURRENCY_CHARS = r"(?U)[₹$€£¥,\s\x1c-\x1f]"
PERCENT_CHARS = r"(?U)[%\s\x1c-\x1f]"
CHECK_CHARS = r"[₹,% ]"

# What counts as white space at the ends of a text, no-break and ideographic spaces included.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000")

PLAIN_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def trimmed_text(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def to_number(text: Column) -> Column:
    """Double, or NULL when the text is not a finite plain number."""
    trimmed = trimmed_text(text)
    return F.when(trimmed.rlike(PLAIN_NUMBER), trimmed.try_cast("double"))


def parse_price(text: Column) -> Column:
    return to_number(F.regexp_replace(text, CURRENCY_CHARS, ""))


def parse_percent(text: Column) -> Column:
    return to_number(F.regexp_replace(text, PERCENT_CHARS, ""))


def parse_rating(text: Column) -> Column:
    """First number in the text with a decimal comma read as a point; NULL outside [0, 5]."""
    found = F.regexp_extract(F.regexp_replace(text, ",", "."), r"([0-9]+[.]?[0-9]*)", 1)
    value = found.try_cast("double")
    return F.when(value.between(0.0, 5.0), value)


def parse_count(text: Column) -> Column:
    """Digits of the text as a number; a trailing ``.0`` left by a float rendering is dropped first."""
    digits = F.regexp_replace(F.regexp_replace(text, r"[.]0+$", ""), "[^0-9]", "")
    return F.when(digits != "", digits.try_cast("double"))


def checked_number(text: Column) -> Column:
    """The reading used by the data-quality rules."""
    return to_number(F.regexp_replace(text, CHECK_CHARS, ""))


def safe_number(text: Column, default: float = 0.0) -> Column:
    """Keep digits, dot and minus; anything unreadable becomes the default."""
    kept = F.regexp_replace(trimmed_text(text), r"[^0-9.-]", "")
    blank = F.lower(trimmed_text(text)).isin("nan", "none", "null")
    return F.coalesce(F.when(~blank, to_number(kept)), F.lit(float(default)))


def safe_text(text: Column, default: str = "") -> Column:
    trimmed = trimmed_text(text)
    return F.when(
        trimmed.isNull() | F.lower(trimmed).isin("nan", "none", "null"), F.lit(default)
    ).otherwise(trimmed)


def rounded(value: Column, digits: int) -> Column:
    """Round half to even on the scaled value, as array libraries do."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def price_text(value: Column, symbol: str = "₹") -> Column:
    return F.concat(F.lit(symbol), F.format_number(value, 0))


def discount_text(actual: Column, discounted: Column) -> Column:
    pct = F.rint(F.try_divide(actual - discounted, actual) * 100).cast("bigint")
    return F.when(actual <= 0, "0%").otherwise(F.concat(pct.cast("string"), F.lit("%")))


def shown_discount(actual: Column, price: Column) -> Column:
    """Percent off recomputed from the two prices; NULL unless it lies strictly between 0 and 100."""
    pct = F.floor(F.try_divide(actual - price, actual) * 100 + 0.5)
    return F.when((actual > price) & (pct > 0) & (pct < 100), pct)


def display_price(price: Column, actual: Column, last_resort: float = 999.0) -> Column:
    zero = F.lit(0.0)
    return F.coalesce(F.nullif(price, zero), F.nullif(actual, zero), F.lit(last_resort))
