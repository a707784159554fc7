"""Scalars over captured pages and exports: links, encodings, dates, titles, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import host

# fixed values: shortening services, marks of wrongly decoded UTF-8, titles of pages without content
SHORTENERS = ["t.co", "bit.ly", "tinyurl.com", "goo.gl", "ow.ly", "buff.ly", "youtu.be", "redd.it", "fb.me", "t.me", "lnkd.in", "dlvr.it", "trib.al", "rb.gy", "is.gd", "cutt.ly", "shorturl.at"]
SHORT_LABELS = ["vt", "vm"]
MISREAD = ["Ã©", "Ã¨", "Ã¢", "Ã®", "Ã´", "Ã»", "Ã§", "Ã¤", "Ã¶", "Ã¼", "Ã±", "â€™", "â€œ", "â€\x9d", "â€“", "â€”", "â€¦", "â‚¬", "Â"]
EMPTY_TITLES = {"empty-title": "", "just-a-moment": r"just\s+a\s+moment\.{0,3}", "loading": r"loading\.{0,3}", "please-wait": r"please\s+wait\.{0,3}", "untitled": r"untitled(?:\s+document)?", "plain-404": r"404(?:\s+(?:not\s+found|error))?", "plain-error": r"(?:error|server\s+error|access\s+denied)"}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def short_link(url: Column) -> Column:
    """Whether a URL looks like an opaque short link: by its host, or one path segment of at most 16 characters without a dot. Null is not."""
    at = host(F.trim(url))
    path = F.regexp_replace(F.regexp_extract(F.trim(url), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    known = at.isin(SHORTENERS) | F.regexp_extract(at, r"([^.]+\.[^.]+)$", 1).isin(SHORTENERS) | F.split_part(at, F.lit("."), F.lit(1)).isin(SHORT_LABELS)
    return F.coalesce((at != "") & (known | path.rlike(r"\A[^/.]{1,16}\z")), F.lit(False))


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read anew; a text whose bytes give no UTF-8 stays."""
    raw = F.when(text.rlike(r"\A[\x{0}-\x{FF}]*\z"), F.encode(text, "ISO-8859-1"))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), text)


def misread_marks(text: Column, least: int = 3) -> Column:
    """The distinct marks of wrongly decoded UTF-8 in a text, if it has `least` of them; else null."""
    found = F.filter(F.array(*map(F.lit, MISREAD)), lambda mark: F.contains(text, mark))
    return F.when(F.size(found) >= least, found)


def empty_title(title: Column) -> Column:
    """The name of the pattern that a title without content has, null for other titles; a null title is empty."""
    bare = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(EMPTY_TITLES.items()):
        out = F.when(bare.rlike(rf"(?i)\A{pattern}\z"), F.lit(name)).otherwise(out)
    return out


def _month(name: Column) -> Column:
    """Two digits of an English month, by its first three letters; null if there is none."""
    at = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.substring(name, 1, 3))
    return F.when(at > 0, F.lpad(at.cast("string"), 2, "0"))


def separator_date(line: Column) -> Column:
    """ISO time of the date that ends a mailbox's `From sender date` line, with its offset if it names one; null if it has none."""
    shape = r"^\S+\s+\S+\s+(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{1,2}:\d{2}:\d{2})(?:\s+([+-]\d{4}))?\s+(\d{4})\s*$"
    part = lambda i: F.regexp_extract(line, shape, i)
    day = F.concat(part(5), F.lit("-"), _month(part(1)), F.lit("-"), F.lpad(part(2), 2, "0"))
    clock = F.lpad(part(3), 8, "0")
    sound = line.rlike(shape) & F.try_to_timestamp(F.concat(day, F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    return F.when(sound, F.concat(day, F.lit("T"), clock, part(4)))


def long_form_timestamp(raw: Column) -> Column:
    """`Weekday, Month d, yyyy at h:mm:ss AM UTC`, with any blanks, as yyyy-MM-ddTHH:mm:ssZ; other texts stay as they are."""
    shape = r"(?U)^\s*[A-Za-z]+,\s+([A-Za-z]+)\s+([0-9]{1,2}),\s+([0-9]{4})\s+at\s+([0-9]{1,2}):([0-9]{2}):([0-9]{2})\s+(AM|PM)\s+UTC\s*$"
    part = lambda i: F.regexp_extract(raw, shape, i)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), part(1))
    hour = F.expr("0") + F.pmod(part(4).try_cast("int"), F.lit(12)) + F.when(part(7) == "PM", 12).otherwise(0)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    iso = F.concat(part(3), F.lit("-"), two(number), F.lit("-"), two(part(2)), F.lit("T"), two(hour), F.lit(":"), part(5), F.lit(":"), part(6), F.lit("Z"))
    return F.when(raw.rlike(shape) & (number > 0), iso).otherwise(raw)


def stampfree_digest(html: Column) -> Column:
    """sha256 of a page's bytes without the meta tags `corpus-*` that capture wrote, wherever they stand."""
    chars = F.decode(F.encode(html, "UTF-8"), "ISO-8859-1")  # a character a byte
    return F.sha2(F.encode(F.regexp_replace(chars, r'(?i)<meta\s+name="corpus-[^"]*"\s+content="[^"]*"\s*/?>', ""), "ISO-8859-1"), 256)


def cut_signal(spans: Column, most: int = 20, least_median: float = 2.0) -> Column:
    """What makes a list of {start, end} useless: `no-boundaries` up to one span, `over-segmented` from `most` spans with a shorter median; else null."""
    lengths = F.array_sort(F.transform(spans, lambda s: (s["end"] - s["start"]).cast("double")))
    n = F.size(lengths)
    median = (F.get(lengths, F.floor((n - 1) / 2).cast("int")) + F.get(lengths, F.floor(n / 2).cast("int"))) / 2
    return F.when(F.coalesce(n, F.lit(0)) <= 1, F.lit("no-boundaries")).when((n >= most) & (median < least_median), F.lit("over-segmented"))
