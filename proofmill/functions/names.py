"""Company names for matching (STR-8 to STR-11, MTH-8)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of legal forms.
LEGAL = ["pvt", "private", "ltd", "limited", "llp", "opc", "the"]
# Characters besides ASCII that NFKC and case folding leave alone.
STABLE = "₹–—‘’“”"


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts if texts.isna().all() else texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _folded(texts: pd.Series) -> pd.Series:
    return texts if texts.isna().all() else texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def strange(text: Column) -> Column:
    """Whether NFKC or case folding may change a text otherwise than by lower case. Told by lengths and plain replacements,
    as a class of many ranges costs more than the rest of a text's cleaning."""
    left = text
    for c in STABLE:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.octet_length(text) != F.length(text)) & left.rlike(r"[^\x00-\x7F]")


def nfkc(text: Column) -> Column:
    """NFKC; texts without a strange character, which it leaves alone, don't go to Python."""
    return F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(strange(text), text)), text)


def folded(text: Column) -> Column:
    """NFKC and case folding; texts without a strange character don't go to Python."""
    return F.coalesce(F.pandas_udf(_folded, "string")(F.when(strange(text), text)), F.lower(text))


def _initials(tokens: Column) -> Column:
    """The tokens with spaces between them, but for runs of single letters, which become one token."""
    return F.regexp_replace(F.array_join(tokens, " "), r"(?<=\b[a-z]) (?=[a-z]\b)", "")


def normalize_company(name: Column, ascii_only: bool = False) -> Column:
    """Lower case without legal forms, marks and the prefix M/s; initials joined. ``ascii_only`` skips NFKC."""
    text = F.lower(name if ascii_only else nfkc(name))
    text = F.replace(F.regexp_replace(text, r"^\s*m\s*/\s*s\.?\s*", ""), F.lit("&"), F.lit(" and "))
    tokens = F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ")
    return _initials(F.filter(tokens, lambda t: (t != "") & ~t.isin(*LEGAL)))


def registry_core(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)\b(private|pvt\.?|limited|ltd\.?|llp)\b\.?", " "), r"\s+", " "))


def has_company_form(name: Column) -> Column:
    return name.rlike(r"(?i)\b(private limited|pvt\.? ltd|limited|ltd|llp|opc)\b")


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


_PLAIN_MARKS = ("–—‘’“”", "--''\"\"")
_SPACES = re.compile(r"[\t\n\x0b\f\r][ \t\n\x0b\f\r]*| [ \t\n\x0b\f\r]+")


def normed(text: str) -> str:
    """``norm`` of a text that is in Python already."""
    plain = (text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).casefold()
    for mark, to in () if plain.isascii() else zip(*_PLAIN_MARKS, strict=True):
        plain = plain.replace(mark, to)
    return _SPACES.sub(" ", plain).strip(" ")


def norm(text: Column) -> Column:
    """For grounding: folded case, plain dashes and quotes, single spaces."""
    plain = F.translate(folded(text), *_PLAIN_MARKS)
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & places.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def _places(texts: list[str], width: int) -> np.ndarray:
    """Codes of ASCII texts, a row each, padded with 0."""
    return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("ascii"), np.uint8).reshape(len(texts), width)


def _lcs_many(xs: list[str], ys: list[str]) -> np.ndarray:
    """_lcs of many pairs at once; texts are ASCII, those of xs hold 64 letters at most."""
    a, b = (_places(t, max(map(len, t), default=0)) for t in (xs, ys))
    n, row = len(xs), np.arange(len(xs))
    places = np.zeros((n, 128), np.uint64)
    for i in range(a.shape[1]):
        places[row, a[:, i]] |= np.uint64(1 << i)
    places[:, 0] = 0  # padding matches nothing
    s = np.full(n, ~np.uint64(0))
    for j in range(b.shape[1]):
        u = s & places[row, b[:, j]]
        s = (s + u) | (s - u)
    return np.bitwise_count(~s).astype(np.int64)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 LCS / (length + length) of names whose tokens are sorted; 0 if either is empty."""
    out = np.zeros(len(a))
    xs, ys = a.fillna("").tolist(), b.fillna("").tolist()
    full = [i for i, (x, y) in enumerate(zip(xs, ys, strict=True)) if x and y]
    short = [i for i in full if len(xs[i]) <= 64 and xs[i].isascii() and ys[i].isascii()]
    if short:
        out[short] = _lcs_many([xs[i] for i in short], [ys[i] for i in short])
    for i in set(full).difference(short):
        out[i] = _lcs(xs[i], ys[i])
    for i in full:
        out[i] = 2 * out[i] / (len(xs[i]) + len(ys[i]))
    return pd.Series(out)


def match_key(name: Column) -> Column:
    """The normalized name, its tokens sorted: what ``similarity`` compares."""
    return F.array_join(F.array_sort(F.split(normalize_company(name), " ")), " ")


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two match keys."""
    return F.pandas_udf(_ratio, "double")(a, b)


def similarity(a: Column, b: Column) -> Column:
    return ratio(match_key(a), match_key(b))
