"""Scalar rules as Column functions. None of them raises on any string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bengali digits; other scripts' digits match a pattern but give no number.
BENGALI, ASCII = "০১২৩৪৫৬৭৮৯", "0123456789"
#: Currency signs that a price may carry.
CURRENCY = ("৳", "Tk")
#: The references that escaping makes; the ampersand's is the last, so that nothing is decoded twice.
ESCAPES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#x27;": "'", "&#39;": "'", "&amp;": "&"}


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def unescaped(text: Column) -> Column:
    """With the references of ESCAPES decoded, and no others: one that is cut before its semicolon stays as it stands."""
    for reference, char in ESCAPES.items():
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


def ascii_digits(text: Column) -> Column:
    return F.translate(text, BENGALI, ASCII)


def _first(text: Column, pattern: str) -> Column:
    return ascii_digits(F.regexp_substr(text, F.lit(pattern)))


def parse_price(text: Column, currency: tuple[str, ...] = CURRENCY) -> Column:
    """The first number with thousands separators; 0.0 where there is none."""
    for sign in currency:
        text = F.replace(text, F.lit(sign), F.lit(""))
    return F.coalesce(F.replace(_first(text, r"[\p{Nd},]+\.?\p{Nd}*"), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def price(text: Column) -> Column:
    """As parse_price, but null for null."""
    return F.when(text.isNotNull(), parse_price(text))


def first_price(text: Column) -> Column:
    """The first number with thousands separators; null where the text has no digit."""
    return F.when(text.rlike(r"\p{Nd}"), parse_price(text))


def first_int(text: Column) -> Column:
    """The first run of digits; null where there is none."""
    return _first(text, r"\p{Nd}+").try_cast("int")


def whole_int(text: Column) -> Column:
    """The whole text as a number, else null."""
    return ascii_digits(strip(text)).try_cast("int")


def digits_and_dots(text: Column) -> Column:
    """What is left of a text without all but digits and dots, as a number; null if it is none."""
    return ascii_digits(F.regexp_replace(text, r"[^\p{Nd}.]", "")).try_cast("double")


def first_decimal(text: Column) -> Column:
    """The first run of digits and dots as a number; null if it is none."""
    return _first(text, r"[\p{Nd}.]+").try_cast("double")


def page_count(text: Column) -> Column:
    """The first run of digits, else the whole text, as a number."""
    return F.coalesce(first_int(text), whole_int(text))


def query_param(url: Column, name: str) -> Column:
    """The first non-empty value of a query parameter, decoded once."""
    raw = F.regexp_extract(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), rf"(?:^|&){name}=([^&]+)", 1)
    return F.when(raw != "", F.coalesce(F.try_url_decode(raw), raw))


def unquote(text: Column) -> Column:
    """Percent-decoded once more; a plus stays a plus, malformed escapes stay as they are."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def image_from_query(src: Column, prefix: str) -> Column:
    """The address in a resizer's url parameter, which is encoded twice."""
    return unquote(query_param(F.concat(F.lit(prefix), src), "url"))


def json_field(text: Column, name: str) -> Column:
    """A top-level field of a JSON text as a string; null for bad JSON."""
    return F.get_json_object(strip(text), f"$.{name}")


def base64_text(data: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def absolute_url(url: Column, base: str) -> Column:
    """https: before //..., the site's address before /..., null for an empty address."""
    return F.when(url.isNull() | (url == ""), None).when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def image_search_url(name: Column) -> Column:
    """An image search for a product's name."""
    return F.concat(F.lit("https://www.google.com/search?tbm=isch&q="), F.url_encode(F.coalesce(name, F.lit(""))))
