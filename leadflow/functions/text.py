"""Column functions on names, handles, addresses and texts. All stay inside whole-stage codegen."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

PROFILE_HOST = "instagram.com"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trimmed(value: Column | str) -> Column:
    """Without white space at the ends, Unicode blanks included."""
    return F.regexp_replace(_col(value), "(?U)^\\s+|\\s+\\z", "")


def norm_handle(value: Column | str, profile_host: str = PROFILE_HOST) -> Column:
    """The handle in a handle or profile address; null if nothing is left or it is no handle."""
    host = re.escape(profile_host)
    text = F.regexp_replace(F.lower(trimmed(value)), "^@+|/+\\z", "")
    # One pattern for both forms: a group that takes no part in the match stands for nothing.
    cut = F.regexp_replace(text, f"(?s)^(?:.*?{host}/([a-z0-9._]+).*|([^?/]*).*)\\z", "$1$2")
    bare = F.regexp_replace(cut, "[^a-z0-9._]", "")
    return F.nullif(F.regexp_replace(bare, f"^(?:{'|'.join(lx.NO_HANDLE)})\\z", ""), F.lit(""))


def profile_url(value: Column | str, profile_host: str = PROFILE_HOST) -> Column:
    return F.concat(F.lit(f"https://www.{profile_host}/"), norm_handle(value, profile_host))


def business_key(name: Column | str) -> Column:
    """Letters and digits of a name, lower case, single spaces; null if there are none."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(_col(name)), "[^\\p{L}\\p{N}]+", " ")), F.lit(""))


def host_of(url: Column | str) -> Column:
    """The host as a browser reads it, without ``www.``; null for what is no address.

    A text that does not start with ``http`` (in lower case) gets a scheme first, whatever it holds.
    """
    full = F.regexp_replace(F.regexp_replace(_col(url), "[\\t\\r\\n]", ""), "^(?!http)", "https://")
    # Credentials, www. and a port are passed over; a host with a letter that no host may hold fails.
    host = "[^/?#\\\\\\x00-\\x20:<>@\\[\\]^|%\\x7f]*"
    found = F.regexp_extract(full, f"^https?:[/\\\\]*(?:[^/?#\\\\]*@)?(?i:www\\.)?({host})(?::[0-9]*)?(?=[/?#\\\\]|\\z)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def source_id(url: Column | str) -> Column:
    return F.coalesce(host_of(url), F.lit("unknown"))


def canonical_url(url: Column | str) -> Column:
    """Key of an address: nothing from ``?`` on, no closing slashes, lower case; a fragment stays."""
    return F.lower(F.regexp_replace(F.substring_index(_col(url), "?", 1), "/+\\z", ""))


def mentions_any(text: Column | str, words: list[str] | tuple[str, ...]) -> Column:
    """Whether the lowered text contains one of the words.

    The text is lowered once, as the only element of an array; searching bytes for each word beats
    one pattern of all of them by far, which tries every word at every letter.
    """
    return F.exists(F.array(F.lower(_col(text))), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words]))


def mentions_city(text: Column | str) -> Column:
    return mentions_any(text, lx.CITIES)


def mentions_abroad(text: Column | str) -> Column:
    return mentions_any(text, lx.ABROAD)


def has_phone(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "[\\s\\u00a0-]", "").rlike(lx.PHONE)


def has_currency(text: Column | str) -> Column:
    return _col(text).rlike(lx.CURRENCY)


def has_persian(text: Column | str) -> Column:
    return _col(text).rlike("[\\u0600-\\u06FF]")


def mentions(text: Column | str, word: Column | str) -> Column:
    """Whether a text names ``word``, in any case; false for an empty or missing word."""
    return F.coalesce((_col(word) != "") & F.contains(F.lower(_col(text)), F.lower(_col(word))), F.lit(False))


def redacted(message: Column | str) -> Column:
    return F.substring(F.regexp_replace(_col(message), "sk-[a-zA-Z0-9]+", "[redacted]"), 1, 300)


def is_private_host(host: Column | str) -> Column:
    """Hosts that must not be fetched: local names and private addresses."""
    return _col(host).isin("localhost", "metadata.google.internal") | _col(host).rlike(
        "\\.local\\z|^(?:::1\\z|127\\.|10\\.|192\\.168\\.|169\\.254\\.|172\\.(?:1[6-9]|2\\d|3[01])\\.)")


def is_fetchable(url: Column | str) -> Column:
    """An http(s) address whose host is neither local nor private. Names are not resolved."""
    return _col(url).rlike("(?i)^https?://") & ~F.coalesce(is_private_host(host_of(F.lower(_col(url)))), F.lit(True))
