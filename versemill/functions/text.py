"""Text, url, key and format functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "no value"; limits of names and credits.
MISSING = ("", "na", "n/a", "nan", "none", "null")
NAME_CHARS = 40
ARTIST_CHARS = 40
# A word is a run of letters; Latin letters with marks are read as the letter below the mark.
LETTERS = r"\p{L}+"
_WITHOUT_MARK = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xE0, 0x180)) if c.islower()}
_WITHOUT_MARK = {c: x for c, x in _WITHOUT_MARK.items() if "a" <= x <= "z"}
# Latin letters that are no letter and mark, and what they are read as.
_WITHOUT_MARK |= {"ß": "s", "æ": "a", "œ": "o", "ø": "o", "đ": "d", "ħ": "h", "ı": "i", "ł": "l", "ŧ": "t"}
MARKED, UNMARKED = "".join(_WITHOUT_MARK), "".join(_WITHOUT_MARK.values())
# The named character references of HTML that credits use, "&amp;" last.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def letter_words(c: Column) -> Column:
    """All words of a text in order, in lower case and without marks."""
    return F.regexp_extract_all(F.translate(F.lower(c), MARKED, UNMARKED), F.lit(LETTERS), F.lit(0))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING)


def blank_missing(c: Column) -> Column:
    return F.when(is_missing(c), "").otherwise(c)


def clean_cell(c: Column) -> Column:
    """No byte-order mark, one line, no ASCII comma, trimmed."""
    flat = F.regexp_replace(F.regexp_replace(c, "﻿", ""), "\r\n|\r|\n", " ")
    return F.trim(F.translate(flat, ",", "、"))


def strip_html(c: Column) -> Column:
    text = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, ch in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cut_with_ellipsis(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 1)), F.lit("…"))).otherwise(c)


def credit_from_metadata(meta: Column, via: str, artist_chars: int = ARTIST_CHARS) -> Column:
    """Credit line from a metadata JSON string; empty where attribution is not required."""
    artist = cut_with_ellipsis(
        strip_html(F.coalesce(F.get_json_object(meta, "$.Artist.value"), F.lit(""))), artist_chars
    )
    license_name = strip_html(F.coalesce(F.get_json_object(meta, "$.LicenseShortName.value"), F.lit("")))
    required = (
        F.lower(F.coalesce(F.get_json_object(meta, "$.AttributionRequired.value"), F.lit("true")))
        != "false"
    )
    blank = lambda c: F.when(c != "", c)
    return F.when(required, F.concat_ws(", ", blank(artist), blank(license_name), F.lit(via))).otherwise("")


def credit_line(app: Column, synth: Column, song: Column, display: Column, notice: Column) -> Column:
    """Standing credit: application, synthesis, then the original song and its notice."""
    part = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    original = F.concat_ws(" — ", part(song), F.coalesce(part(display), part(notice)))
    shown = F.when(part(song).isNotNull(), F.concat(F.lit("Original: "), original)).otherwise(original)
    return F.concat_ws(" / ", app, part(synth), F.when(original != "", shown))


def escape_subtitle(c: Column) -> Column:
    return F.translate(c, "{}\n", "() ")


def safe_name(c: Column, limit: int = NAME_CHARS) -> Column:
    joined = F.regexp_replace(c, r'[\\/:*?"<>|\s]+', "_")
    return F.left(F.regexp_replace(joined, "^_+|_+$", ""), F.lit(limit))


def display_value(c: Column) -> Column:
    """A hyphen between two non-ASCII characters is shown as a middle dot."""
    return F.regexp_replace(c, r"(?<=[^\x00-\x7f])-(?=[^\x00-\x7f])", "・")


def subtitle_color(hex_color: Column) -> Column:
    """``#rrggbb`` or ``#rrggbbaa`` as inverted alpha, blue, green, red."""
    byte = lambda i: F.upper(F.substring(hex_color, i, 2))
    alpha = F.when(
        F.length(hex_color) == 9, F.lit(255) - F.conv(F.substring(hex_color, 8, 2), 16, 10).cast("int")
    ).otherwise(F.lit(0))
    return F.concat(F.lit("&H"), F.format_string("%02X", alpha), byte(6), byte(4), byte(2))


def srt_time(ms: Column) -> Column:
    ms = F.greatest(F.lit(0).cast("bigint"), ms.cast("bigint"))
    second = F.floor(ms / 1000)
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(second / 3600), F.floor(second % 3600 / 60), second % 60, ms % 1000
    )


def subtitle_time(ms: Column) -> Column:
    """H:MM:SS.cc, centiseconds rounded half to even."""
    cs = F.bround(F.greatest(F.lit(0).cast("bigint"), ms.cast("bigint")) / 10).cast("bigint")
    second = F.floor(cs / 100)
    return F.format_string(
        "%d:%02d:%02d.%02d", F.floor(second / 3600), F.floor(second % 3600 / 60), second % 60, cs % 100
    )


def duration_label(seconds: Column) -> Column:
    minute, sec = F.bround(seconds / 60).cast("bigint"), F.bround(seconds).cast("bigint")
    return F.when(seconds < 60, F.concat(F.lit("約"), sec.cast("string"), F.lit("秒"))).otherwise(
        F.concat(F.lit("約"), minute.cast("string"), F.lit("分"))
    )


def page_title(url: Column, marker: str) -> Column:
    """Decoded file title behind ``marker`` in a url, without its query."""
    tail = F.regexp_extract(url, marker + r"([^?]*)", 1)
    name = F.trim(F.try_url_decode(tail))
    return F.when(name != "", F.concat(F.lit("File:"), name))


def cache_busted(url: Column, **values: Column) -> Column:
    """Url with query parameters added, in place of earlier ones of the same name."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*values),
    )
    added = F.array(*[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in values.items()])
    return F.concat(base, F.lit("?"), F.array_join(F.concat(kept, added), "&"), fragment)


def looks_like_svg(content: Column) -> Column:
    """Sniffed from the head of the content, as declared types are unreliable."""
    head = F.ltrim(F.left(content, F.lit(1024)))
    xml = head.startswith("<?xml") | head.startswith("<!--") | head.startswith("<!DOCTYPE")
    return head.startswith("<svg") | (xml & F.left(content, F.lit(4096)).contains("<svg"))


def canonical_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def valid_issuer(c: Column, domain: str) -> Column:
    """An https host below ``domain``, labels of at most 63 characters, 253 in all."""
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    host = F.regexp_replace(c, "^https://", "")
    return c.rlike(rf"^https://(?:{label}\.)*{label}\.{domain.replace('.', chr(92) + '.')}$") & (
        F.length(host) <= 253
    )


def valid_session_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{16}$"), F.lit(False))


def url_key(url: Column) -> Column:
    return F.left(F.sha1(url), F.lit(16))


def composite_key(*parts: Column) -> Column:
    """Key of a request from its parts; the separator cannot occur in JSON-escaped text."""
    return F.left(F.sha1(F.concat_ws("\u001f", *parts)), F.lit(24))
