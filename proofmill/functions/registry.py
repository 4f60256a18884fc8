"""Facts that company-registry pages state, and listings of places (STR-16, STR-18, FLT-6, JSN-5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.functions.dates import absolute_date
from proofmill.functions.money import parse_inr

# Patterns of the facts, and of addresses in other countries.
CIN = r"\b([UL]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6})\b"
DATE = r"(\d{1,2}(?:st|nd|rd|th)?[\s-]+[A-Za-z]{3,9},?[\s-]+\d{4})"
INCORPORATED = rf"(?i)incorporated on {DATE}"
STATUS = (
    r"(?i)\b(?:status (?:of the company )?is|status:)\s*"
    r"(active|strike off|struck off|under process of striking off|dormant|amalgamated|dissolved|liquidated|under liquidation)\b"
)
MONEY = r"((?:₹|rs\.?|inr)\s?[\d,]{1,20}(?:\.\d{1,2})?)"
AUTHORISED = rf"(?i)authori[sz]ed (?:share )?capital (?:is|of)\s*{MONEY}"
PAID_UP = rf"(?i)paid[\s-]?up capital (?:is|of)\s*{MONEY}"
BUSINESS = r"(?i)main line of business is ([^.]{3,80})\."
AGM = rf"(?i)(?:annual general meeting|\bagm\b)[^.]{{0,40}}?(?:on|was held on)\s+{DATE}"
CITY = r"(?i)(?:registered office|located) in ([A-Z][A-Za-z ]{2,30}),"
BALANCE_SHEET = rf"(?i)balance sheet[^.]{{0,40}}?(?:on|dated|as on)\s+{DATE}"
ABROAD = r"\b[A-Z]{2} \d{5}(-\d{4})?\b|\b(USA|United States|United Kingdom|Canada|Australia|Singapore)\b"


def facts(text: Column) -> dict[str, Column]:
    """The nine facts; null where the text states none, or one that can't be read."""
    g = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return {
        "cin": g(CIN),
        "incorporated": absolute_date(g(INCORPORATED)),
        "status": F.lower(g(STATUS)),
        "authorised_paise": parse_inr(g(AUTHORISED)),
        "paid_up_paise": parse_inr(g(PAID_UP)),
        "business_line": F.trim(g(BUSINESS)),
        "last_agm": absolute_date(g(AGM)),
        "last_balance_sheet": absolute_date(g(BALANCE_SHEET)),
        "city": F.trim(g(CITY)),
    }


def at_home(address: Column) -> Column:
    """An address that doesn't plainly lie abroad (case counts)."""
    return ~F.coalesce(address, F.lit("")).rlike(ABROAD)


def city_area(address: Column) -> Column:
    """The last two parts of an address: area and city, never a door number."""
    parts = F.transform(F.split(address, ","), lambda x: F.trim(x))
    return F.when(F.coalesce(address, F.lit("")) == "", "").otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ", "))


def place_type(kind: Column) -> Column:
    """A list of types as JSON joined, anything else as it is."""
    return F.when(F.ltrim(kind).startswith("["), F.array_join(F.from_json(kind, "array<string>"), ", ")).otherwise(F.coalesce(kind, F.lit("")))
