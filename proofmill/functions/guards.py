"""Text guards (STR-1 to STR-7, STR-12, STR-20, AGG-13): cleaning, masks, and counts of named patterns."""

from __future__ import annotations
from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.functions.names import nfkc, strange

# Patterns of the guards, by rule.
UNSAFE = r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b\[[0-?]*[ -/]*[@-~]|[\x00-\x08\x0b-\x1f\x7f-\x{9f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{200b}-\x{200d}\x{feff}]"
# Unsafe characters of ASCII, one by one: Java looks these up in a table, ranges it tries one after another.
UNSAFE_ASCII = "[" + "".join(rf"\x{c:02x}" for c in [*range(9), *range(11, 32), 127]) + "]"
AADHAAR = r"(?<!\d)[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}(?!\d)"
MASKS = {
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "phone": r"(?<![\d+])(?:\+91[ -]?|0)?[6-9]\d{4}[ -]?\d{5}(?!\d)",
    "email": r"(?i)\b[A-Za-z0-9._%+-]{1,64}@(?:gmail|yahoo|hotmail|outlook|rediffmail|ymail|icloud|protonmail|proton)\.(?:com|in|co\.in|me)\b",
    "house no.": r"(?i)\b(?:flat|house|h\.?\s?no\.?|plot|door)(?:\s{0,3}no\.?)?\s{0,3}[:#]?\s{0,3}[\w/-]{0,20}\d[\w/-]{0,20}",
}
# What a text needs for a mask to match, asked for first: the patterns themselves look around at each of its places.
NEEDED = {"aadhaar": r"[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}", "pan": r"[A-Z]{5}[0-9]{4}[A-Z]", "phone": r"[6-9]\d{4}[ -]?\d{5}", "email": "@"}
INJECTION = {
    "ignore_previous": r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above|earlier|your|these|those|my)\s+(?:instructions?|rules?|prompts?|messages?|guidelines?)\b",
    "role_switch": r"(?i)\byou\s+are\s+now\b|\bdeveloper\s+mode\b|\bjailbreak\b|\bact\s+as\s+(?:an?\s+)?(?:ai|assistant|chatbot|dan|evil|unrestricted|system)\b",
    "prompt_probe": r"(?i)\bsystem\s+prompt\b",
    "verdict_steer": r"(?i)\bmark\s+(?:all|every)\s+(?:checks?|claims?)\s+(?:as\s+)?(?:consistent|verified|true|clean)\b|\bdo\s+not\s+(?:flag|report|mention)\b",
    "role_tags": r"(?i)</?\s*(?:system|assistant|user|tool)\s*>|\[/?INST\]|\bBEGIN\s+(?:SYSTEM|INSTRUCTIONS)\b",
    "output_steer": r"(?i)\brespond\s+only\s+with\b",
    "tool_strings": r"(?i)\b(?:tool_call|function_call)\b",
    "encoded_blob": r"[A-Za-z0-9+/]{200,}={0,2}",
}
ADVICE = (
    r"(?i)\bshould\s+i\s+(?:buy|apply|sell|invest|subscribe|hold|exit)\b|\b(?:target|fair)\s+price\b"
    r"|\bwill\s+(?:it|this|the\s+(?:stock|share|ipo))\s+(?:go\s+up|rise|fall|list\s+(?:high|at\s+a\s+premium))\b"
    r"|\bmultibagger\b|\blisting\s+gains?\b|\bkya\s+(?:main|mai|mein)\s+(?:apply|invest|kharid)\w*|\b(?:kharidu|kharidun|bechu|bechun)\b"
)
BANNED = [
    "fraud", "fraudulent", "scam", "scamster", "fake", "cheat", "ponzi", "buy", "sell", "avoid", "invest now", "multibagger",
    "sure shot", "guaranteed", "target price", "dhokha", "ghotala", "farzi", "nakli", "kharido", "becho",
]
BANNED_PATTERN = rf"(?i)\b(?:{'|'.join(t.replace(' ', r'[\s-]+') for t in BANNED)})\b"
ADVERSE = r"(?i)\b(sebi|probe|investigat\w*|complaint|halt\w*|defer\w*|barred|ban(?:s|ned)?|penalt\w*|diver\w+|misuse|refund|show[- ]cause|raid\w*|arrest\w*)\b"
PROMO = r"(?i)\b(gmp|apply|ipo review|should you|subscribe|allotment|listing)\b"
BEARER, API_KEY = r"(?i)bearer\s+\S+", r"(?i)([?&]api_key=)[^&\s\"'#]+"
STOP = [
    "the", "and", "for", "this", "that", "with", "what", "does", "did", "was", "are", "is", "its", "it's", "about", "there",
    "any", "how", "who", "which", "from", "have", "has", "ipo", "company", "card", "line", "lines", "tell", "show", "me", "please",
]


def clean_text(text: Column) -> Column:
    """Struct of the text without escape codes, controls and invisible marks (then NFKC), and how many were removed."""
    return F.struct(nfkc(bare(text)).alias("text"), F.regexp_count(text, F.lit(UNSAFE)).alias("removed"))


def bare(text: Column) -> Column:
    """The text without escape codes, controls and invisible marks; most texts have no character that one begins with."""
    return F.when(text.rlike(UNSAFE_ASCII) | strange(text), F.regexp_replace(text, UNSAFE, "")).otherwise(text)


def _d(a: int, b: int) -> int:
    """Product in the dihedral group of order ten."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


def _p(times: int, digit: int) -> int:
    """A permutation of the digits, applied ``times`` times: its first step sends 0..9 to 1576283094."""
    for _ in range(times % 8):
        digit = int("1576283094"[digit])
    return digit


def verhoeff(digits: str) -> int:
    """0 if the number's last digit is its check digit."""
    c = 0
    for i, ch in enumerate(reversed(digits)):
        c = _d(c, _p(i, int(ch)))
    return c


def check_digit(digits: str) -> int:
    return next(d for d in range(10) if verhoeff(f"{digits}{d}") == 0)


def is_checked(number: Column) -> Column:
    """Whether a number's last digit is its check digit, in expressions alone."""
    group = F.array(*[F.lit(_d(a, b)) for a in range(10) for b in range(10)])
    steps = F.array(*[F.lit(_p(i, d)) for i in range(8) for d in range(10)])
    digits = F.reverse(F.split(F.regexp_replace(number, r"\D", ""), ""))
    placed = F.transform(digits, lambda x, i: F.get(steps, i % 8 * 10 + x.cast("int")))
    return F.aggregate(placed, F.lit(0), lambda c, p: F.get(group, c * 10 + p)) == 0


def mask_aadhaar(text: Column) -> Column:
    """Only numbers whose check digit holds are masked; in expressions, so that no text goes to Python, whose batches are as
    large as their texts."""

    def masked(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(AADHAAR), F.lit(0)), lambda m: F.when(is_checked(m), "[aadhaar]").otherwise(m))
        # What stands between the numbers is one part more than they are.
        between = F.split(t, AADHAAR)
        return F.array_join(F.flatten(F.zip_with(between, found, lambda b, m: F.array(b, F.coalesce(m, F.lit(""))))), "")

    # In an array, so that the text is made once for both readings of it.
    return F.get(F.transform(F.array(text), lambda t: F.when(t.rlike(NEEDED["aadhaar"]) & t.rlike(AADHAAR), masked(t)).otherwise(t)), F.lit(0))


def _masked(text: Column, rule: str, pattern: str) -> Column:
    # In an array, so that the text is made once for the question and the mask.
    return F.get(F.transform(F.array(text), lambda t: F.when(t.rlike(NEEDED[rule]), F.regexp_replace(t, pattern, f"[{rule}]")).otherwise(t)), F.lit(0))


def mask_pii(text: Column, aadhaar: bool = True) -> Column:
    """The text with personal identifiers masked, in the order of the rules."""
    out = mask_aadhaar(text) if aadhaar else text
    for rule, pattern in MASKS.items():
        out = _masked(out, rule, pattern) if rule in NEEDED else F.regexp_replace(out, pattern, f"[{rule}]")
    return out


def hits(text: Column, rules: dict[str, str]) -> Column:
    """Array of (rule, count) of the rules that match."""
    return F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), F.regexp_count(text, F.lit(p)).alias("count")) for r, p in rules.items()]), lambda h: h["count"] > 0)


def banned_terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(BANNED_PATTERN), F.lit(0)), F.lower))


def redact(text: Column) -> Column:
    """Keys in URLs and bearer tokens."""
    return F.regexp_replace(F.regexp_replace(text, API_KEY, "$1[redacted]"), BEARER, "[redacted]")


def words(text: Column) -> Column:
    """Distinct words of three or more characters that aren't stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP)))


def plain(text: Column) -> Column:
    """Without citation tags, in single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"</?co[^>]*>", ""), r"\s+", " "))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def on_host(url: Column, domains: list[str]) -> Column:
    """The URL's host is one of the domains or below one."""
    h = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.exists(F.array(*map(F.lit, domains)), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d))), F.lit(False))


def is_blank(text: Column) -> Column:
    return F.lower(F.btrim(F.btrim(text), F.lit("."))).isin("", "nil", "na", "n/a", "none", "-")


def canonical_json(pairs: Column) -> Column:
    """JSON of a map, keys sorted, without spaces."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def stable_id(pairs: Column, n: int = 16) -> Column:
    return F.left(F.sha2(canonical_json(pairs), 256), F.lit(n))
