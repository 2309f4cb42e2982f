"""What a search result yields: handles, sites, contacts, keys and a name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import PROFILE_HOST, host_of, norm_handle, trimmed


# The blanks that end a word.
SPACE = "\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_blob(title: str = "title", snippet: str = "snippet", url: str = "url") -> Column:
    return F.concat_ws("\n", _text(title), _text(snippet), _text(url))


def handles(blob: str = "blob", url: str = "url", profile_host: str = PROFILE_HOST) -> Column:
    """Handles in profile addresses, then of the address itself, then the first ``(@handle)``; distinct."""
    host = re.escape(profile_host)
    found = F.regexp_extract_all(F.col(blob), F.lit(f"(?i){host}/([A-Za-z0-9._]+)"), 1)
    own = F.when(_text(url).rlike(f"(?i){host}"), norm_handle(url, profile_host))
    named = norm_handle(F.nullif(F.regexp_extract(blob, "\\(@([A-Za-z0-9._]{2,30})\\)", 1), F.lit("")), profile_host)
    all_of = F.concat(F.transform(found, lambda h: norm_handle(h, profile_host)), F.array(own, named))
    return F.array_distinct(F.filter(F.array_compact(all_of), lambda h: ~h.isin(*lx.BLOCKED_HANDLES)))


def websites(blob: str = "blob", profile_host: str = PROFILE_HOST) -> Column:
    """Addresses in a text that are no social page, without closing stops and commas."""
    social = "(?i)" + "|".join(re.escape(h) for h in (profile_host, *lx.SOCIAL))
    found = F.regexp_extract_all(F.col(blob), F.lit(f"(?i)(https?://[^{SPACE})]+)"), 1)
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, "[.,]+\\z", "")), lambda u: ~u.rlike(social))


def _first(*found: Column) -> Column:
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def telegram(blob: str = "blob") -> Column:
    return _first(
        F.regexp_extract(blob, "(?i)((?:t\\.me/|telegram\\.me/)[A-Za-z0-9_]{3,})", 1),
        F.regexp_extract(blob, f"(تلگرام[:{SPACE}]+@?[A-Za-z0-9_]{{3,}})", 1))


def whatsapp(blob: str = "blob") -> Column:
    return F.coalesce(_first(F.regexp_extract(blob, f"(?i)((?:wa\\.me/|whatsapp)[^{SPACE}]*)", 1)), F.when(F.contains(F.col(blob), F.lit("واتساپ")), F.lit("whatsapp")))


def name_in_title(title: str = "title") -> Column:
    """The title up to the first bar, hyphen or dash."""
    return F.nullif(trimmed(F.regexp_replace(_text(title), f"[{SPACE}]*[|\\-\\x{{2013}}].*\\z", "")), F.lit(""))


def candidate_keys(handles_of: str = "handles", websites_of: str = "websites", url: str = "url") -> Column:
    """What a result is grouped by: its handles, else the hosts of its sites, else its address."""
    by_site = F.array_distinct(F.transform(F.col(websites_of), lambda w: F.concat(F.lit("web:"), F.coalesce(host_of(w), w))))
    by_url = F.array(F.concat(F.lit("url:"), _text(url)))
    return F.when(F.size(handles_of) > 0, F.col(handles_of)).when(F.size(websites_of) > 0, by_site).otherwise(by_url)


def site_of(websites_of: str = "websites", url: str = "url", profile_host: str = PROFILE_HOST) -> Column:
    """The first site in the text, else the result's own address unless it is a profile."""
    own = F.when(host_of(url).isNotNull() & ~F.col(url).rlike(f"(?i){re.escape(profile_host)}"), F.col(url))
    return F.coalesce(F.try_element_at(websites_of, F.lit(1)), own)
