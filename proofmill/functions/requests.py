"""Requests to search engines: what may be asked, what is kept of answers (FLT-15 to FLT-19, SET-4, JSN-1, JSN-2, JSN-4, STR-19, STR-28, SRC-4)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.functions import guards

# Parameters, those of which one is needed, and defaults of each engine; sites; patterns; fields of reviews.
ENGINES = {
    "google": (["q", "location", "gl", "hl", "num", "start", "tbs", "safe", "filter"], ["q"], {"gl": "in", "hl": "en"}),
    "google_news": (["q", "gl", "hl"], ["q"], {"gl": "in", "hl": "en"}),
    "google_maps": (["q", "ll", "type", "hl", "start"], ["q"], {"hl": "en"}),
    "google_maps_reviews": (["data_id", "place_id", "hl", "sort_by", "next_page_token"], ["data_id", "place_id"], {"hl": "en"}),
    "youtube": (["search_query", "gl", "hl", "sp"], ["search_query"], {"gl": "IN"}),
    "google_trends": (["q", "geo", "date", "data_type", "hl", "tz"], ["q"], {"geo": "IN", "hl": "en"}),
    "google_finance": (["q", "hl", "window"], ["q"], {"hl": "en"}),
    "google_jobs": (["q", "location", "gl", "hl"], ["q"], {"gl": "in", "hl": "en"}),
    "google_patents": (["q", "num", "page", "country", "assignee"], ["q"], {}),
    "google_lens": (["url", "hl", "country", "type"], ["url"], {"hl": "en"}),
    "duckduckgo": (["q", "kl"], ["q"], {"kl": "in-en"}),
}
SITES = ["sebi.gov.in", "indiankanoon.org", "ibbi.gov.in", "nclt.gov.in", "instafinancials.com", "zaubacorp.com", "tofler.in", "chittorgarh.com"]
SITE = r"(?i)\bsite:([a-z0-9.-]+)"
SECRETISH = r"(?i)api_key|apikey|bearer\s"
CONTROL = r"[\x00-\x1f\x7f]"
SAFE_URL = r"(?i)^https://[a-z0-9.-]+(?::\d{2,5})?/\S{0,1900}$"
LONGEST = 512
LINE_CHARS = 230
REVIEW_FIELDS = ["rating", "date", "iso_date", "iso_date_of_last_edit"]
REVIEW_LISTS = ["reviews", "user_reviews"]
PUBLIC_ID = r"^[a-z0-9-]{1,64}$"


def _of(engine: Column, part: int) -> Column:
    """A part of ENGINES for the engine of each row; null for an unknown one."""
    kind = "map<string,string>" if part == 2 else "array<string>"
    value = lambda v: F.create_map(*[F.lit(x) for kv in v.items() for x in kv]).cast(kind) if part == 2 else F.array(*map(F.lit, v))
    out = F.lit(None).cast(kind)
    for name, row in ENGINES.items():
        out = F.when(engine == name, value(row[part])).otherwise(out)
    return out


def refused(engine: Column, params: Column) -> Column:
    """The first rule that refuses a request (engine, map of parameters); null if none does."""
    given = F.map_keys(params)
    values = F.map_values(params)
    asked = F.exists(_of(engine, 1), lambda n: F.coalesce(params[n], F.lit("")) != "")
    sites = F.transform(F.regexp_extract_all(F.coalesce(params["q"], F.lit("")), F.lit(SITE), F.lit(1)), F.lower)
    wrong = lambda test: F.exists(values, lambda v: F.coalesce(test(v), F.lit(False)))
    first = F.get(F.filter(F.map_entries(params), lambda e: (F.length(e["value"]) > LONGEST) | e["value"].rlike(CONTROL) | e["value"].rlike(SECRETISH) | ((e["key"] == "url") & ~e["value"].rlike(SAFE_URL))), F.lit(0))
    of_value = F.when(F.length(first["value"]) > LONGEST, "length").when(first["value"].rlike(CONTROL), "control").when(first["value"].rlike(SECRETISH), "secret").otherwise("url")
    return (
        F.when(_of(engine, 0).isNull(), "engine")
        .when(F.size(unknown(engine, params)) > 0, "param")
        .when(~asked, "required")
        .when(wrong(lambda v: v.isNotNull()) & first.isNotNull(), of_value)
        .when(F.size(F.array_except(sites, F.array(*map(F.lit, SITES)))) > 0, "site")
        .when((F.size(sites) > 0) & F.array_contains(given, "tbs"), "site_tbs")
    )


def unknown(engine: Column, params: Column) -> Column:
    """Given parameters that the engine doesn't take, sorted (SET-4)."""
    return F.array_sort(F.array_except(F.map_keys(params), _of(engine, 0)))


def merged(engine: Column, params: Column) -> Column:
    """Parameters with the defaults of those that aren't given (JSN-4)."""
    return F.map_concat(F.map_filter(_of(engine, 2), lambda k, _: ~F.array_contains(F.map_keys(params), k)), params)


def public_url(url: Column, refused_hosts: list[str]) -> Column:
    """https, without credentials, and on no refused host (SRC-4)."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    fine = (F.lower(part("PROTOCOL")) == "https") & part("USERINFO").isNull() & part("HOST").isNotNull()
    return F.coalesce(fine & ~guards.on_host(url, refused_hosts), F.lit(False))


def public_id(name: Column) -> Column:
    """A name that may stand in a path (FLT-18)."""
    return F.coalesce(name.rlike(PUBLIC_ID), F.lit(False))


def accepted(kind: Column, url: Column, registry: list[str], legal: list[str]) -> Column:
    """Registry and legal tools keep their own hosts, others everything (FLT-15)."""
    return F.when(kind == "registry", guards.on_host(url, registry)).when(kind == "legal", guards.on_host(url, legal)).otherwise(F.lit(True))


def result_list(value: Column, item: str) -> Column:
    """An object as a list of one, a list's objects, else an empty list (FLT-19). ``item``: the struct's schema."""
    first = F.left(F.ltrim(value), F.lit(1))
    empty = F.array().cast(f"array<{item}>")
    objects = F.transform(F.filter(F.from_json(value, "array<string>"), lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, item))
    return F.when(first == "{", F.array(F.from_json(value, item))).when(first == "[", objects).otherwise(empty)


def outcome(status: Column, error: Column) -> Column:
    """What an answer's HTTP status and error text mean (STR-28)."""
    text = F.lower(F.coalesce(error, F.lit("")))
    has = lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))
    return (
        F.when((status == 401) | has("invalid api key"), "bad_key")
        .when((status == 429) | has("run out of searches", "hourly searches"), "quota")
        .when(status >= 500, "transient")
        .when(has("hasn't returned any results", "no results"), "empty")
        .when((status >= 400) | (text != ""), "invalid")
        .otherwise("ok")
    )


def query_text(kind: Column, terms: Column, registry: str, legal: str) -> Column:
    """The text that a tool searches for (STR-19)."""
    quoted = F.concat(F.lit('"'), terms, F.lit('" '))
    return F.when(kind == "registry", F.concat(quoted, F.lit(registry))).when(kind == "legal", F.concat(quoted, F.lit(legal))).otherwise(terms)


def described(number: Column, kind: Column, item: dict[str, Column]) -> Column:
    """A found item in one line of LINE_CHARS at most (STR-19): title, host with date, snippet; a place's type, address and
    hours instead. ``item``: title, link, date, snippet, type, address, open_state; empty ones count as missing. Texts are
    masked before they are cut."""
    some = lambda n: F.nullif(item[n], F.lit(""))
    safe = lambda c, n: F.left(guards.mask_pii(guards.clean_text(c)["text"]), F.lit(n))
    title = safe(F.coalesce(item["title"], F.lit("")), 90)
    place = F.concat_ws(" | ", *[safe(some(n), 70) for n in ("type", "address", "open_state")])
    when = F.coalesce(F.concat(F.lit(" ("), some("date"), F.lit(")")), F.lit(""))
    page = F.concat(F.coalesce(guards.host(item["link"]), F.lit("")), when, F.lit(" | "), safe(F.coalesce(item["snippet"], F.lit("")), 150))
    return F.left(F.concat(number.cast("string"), F.lit(". "), title, F.lit(" | "), F.when(kind == "maps", place).otherwise(page)), F.lit(LINE_CHARS))


def _walk(value, leaf: Callable):
    if isinstance(value, dict):
        return {k: _walk(v, leaf) for k, v in value.items()}
    return [_walk(v, leaf) for v in value] if isinstance(value, list) else leaf(value)


def _keyless(value):
    if isinstance(value, dict):
        return {k: _keyless(v) for k, v in value.items() if k.lower() != "api_key"}
    return [_keyless(v) for v in value] if isinstance(value, list) else value


def _pruned(value, inside: bool = False):
    """Reviews with their dates and ratings alone."""
    if isinstance(value, dict):
        return {k: _pruned(v, inside or k in REVIEW_LISTS) for k, v in value.items()}
    if isinstance(value, list) and inside:
        return [{k: v for k, v in x.items() if k in REVIEW_FIELDS} if isinstance(x, dict) else x for x in value]
    return value


def sanitized(engine: Column, body: Column) -> Column:
    """A stored answer (JSON text) without keys, and without reviewers where it comes from maps (FLT-17). Null where the
    text is no object. Its keys' order stays."""

    def run(engines: pd.Series, bodies: pd.Series) -> pd.Series:
        pattern = re.compile(guards.API_KEY)
        plain = lambda v: pattern.sub(r"\1[redacted]", v) if isinstance(v, str) else v

        def one(name: str | None, text: str | None) -> str | None:
            try:
                value = json.loads(text) if text else None
            except ValueError:
                return None
            if not isinstance(value, dict):
                return None
            value = _walk(_keyless(value), plain)
            return json.dumps(_pruned(value) if (name or "").startswith("google_maps") else value, ensure_ascii=False, separators=(",", ":"))

        return pd.Series([one(*x) for x in zip(engines, bodies, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(engine, body)


def scrub(line: Column) -> Column:
    """A journal's line with escape codes, keys and personal identifiers gone, or null if it is no JSON any more (JSN-2, SNK-8)."""
    safe = guards.mask_pii(guards.redact(guards.clean_text(line)["text"]))
    # In an array, so that a line is scrubbed once, not for the test and again for the result.
    return F.get(F.filter(F.array(safe), lambda s: F.try_parse_json(s).isNotNull()), F.lit(0))


def scrub_values(line: Column) -> Column:
    """A line of JSON with each string value scrubbed by itself, however deep it lies (JSN-1); keys, numbers and the order
    stay. Null if the line is no JSON.

    The line is cut at its strings; one with a colon behind it is a key. A value is decoded, scrubbed and encoded again, so
    a pattern neither sees escapes nor reaches into the next string. (Escaped backslashes and quotes are held as control
    characters meanwhile, which can't stand in JSON as they are.)
    """
    bare = lambda x: F.replace(F.replace(x, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    held = F.replace(F.replace(line, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    pieces = F.regexp_extract_all(held, F.lit(r'"[^"]*+"(?:\s*+:)?+|[^"]++'), F.lit(0))

    def piece(x: Column) -> Column:
        text = F.from_json(F.concat(F.lit("["), bare(x), F.lit("]")), "array<string>")[0]
        safe = guards.mask_pii(guards.redact(text))
        return F.when(x.startswith('"') & ~x.endswith(":"), F.regexp_extract(F.to_json(F.array(safe)), r"(?s)^\[(.*)\]$", 1)).otherwise(bare(x))

    return F.when(F.try_parse_json(line).isNotNull(), F.array_join(F.transform(pieces, piece), ""))
