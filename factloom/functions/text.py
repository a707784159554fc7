"""String scalars as Column expressions; entities and SimHash alone take Arrow UDFs."""

from __future__ import annotations

import hashlib
import html as entities
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def tokens(c: Column) -> Column:
    """Runs of [a-z0-9] of the lower-case text."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def normalized(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def slug(c: Column) -> Column:
    return F.array_join(tokens(c), "-")


def glob_regex(pattern: str) -> str:
    """Regular expression of a whole-string glob: *, ?, sets such as [ax], [a-c] and [!a]; line ends are characters too."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        end = pattern.find("]", i + 1 + (pattern[i : i + 1] == "!")) if c == "[" else -1
        if end > 0:
            body, i = pattern[i:end], end + 1
            no = body.startswith("!")
            inside = "".join(f"\\{x}" if x in "\\[]^&" else x for x in body[no:])
            out += f"[{'^' * no}{inside}]"
        else:
            out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c == "_" or ord(c) > 127 else f"\\{c}")
    return rf"(?s)\A{out}\z"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))


def apex(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def _recoded(c: Column, safe: str, space: str = "%20") -> Column:
    """Percent codes decoded and encoded anew, in capitals, but for unreserved characters and `safe`."""
    again = F.url_encode(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))
    again = F.replace(F.replace(again, F.lit("+"), F.lit(space)), F.lit("%7E"), F.lit("~"))
    again = F.when(F.lit("*" not in safe), F.replace(again, F.lit("*"), F.lit("%2A"))).otherwise(again)
    for x in safe:
        again = F.replace(again, F.lit(f"%{ord(x):02X}"), F.lit(x))
    return F.coalesce(again, c)


def normalized_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, sorted query pairs, no plain fragment, a bare / path dropped, percent codes alike.

    Name and password stay as they are; empty values and repeats stay in the query.
    """
    url = F.trim(url)
    head = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    place = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    name = F.regexp_extract(place, r"^(.*@)", 1)
    host_port = F.regexp_replace(F.lower(F.regexp_replace(place, r"^.*@", "")), F.when(head == "https", r":443$").when(head == "http", r":80$").otherwise(r":$"), F.lit(""))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    parts = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, "^([^=]*)", 1).alias("k"), F.regexp_extract(x, "=(.*)$", 1).alias("v")))
    coded = F.transform(parts, lambda p: F.struct(F.url_encode(F.coalesce(F.try_url_decode(p["k"]), p["k"])).alias("k"), F.url_encode(F.coalesce(F.try_url_decode(p["v"]), p["v"])).alias("v")))
    query = F.array_join(F.transform(F.array_sort(coded), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    fragment = F.regexp_extract(url, r"#([/!].*)$", 1)
    whole = F.concat(F.when(head != "", F.concat(head, F.lit(":"))).otherwise(F.lit("")), F.when(place != "", F.concat(F.lit("//"), name, host_port)).otherwise(F.lit("")))
    whole = F.concat(whole, F.when(path == "/", F.lit("")).otherwise(_recoded(path, "/:@!$&'()*+,;=")))
    return F.concat(whole, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))


def identity_key(url: Column, drop_query: bool = False, rules: list[tuple[str, str]] = (), rewrite: list[tuple[str, str]] = ()) -> Column:
    """Key under which urls of one resource are equal: rewritten, normalized, by the host's rules, without a last slash below the root."""
    for pattern, by in rewrite:
        url = F.regexp_replace(url, pattern, by)
    key = normalized_url(url)
    if drop_query:
        key = F.regexp_replace(key, r"\?[^#]*", "")
    for pattern, by in rules:
        key = F.regexp_replace(key, pattern, by)
    key = F.regexp_replace(F.regexp_replace(key, r"\?&+", "?"), r"[?&]+(#|$)", "$1")
    return F.regexp_replace(key, r"^([^/]*//[^/?#]+/[^?#]*?)/+(\?|#|$)", "$1$2")


def same_site(one: Column, two: Column, subdomains: bool = False) -> Column:
    """Hosts are equal but for www., or the first lies below the second."""
    a, b = apex(one), apex(two)
    equal = (a == b) & (a != "")
    return equal | ((b != "") & a.endswith(F.concat(F.lit("."), b))) if subdomains else equal


def crawlable(href: Column) -> Column:
    """Links a crawler may follow: no script, mail, phone or data link, no bare anchor."""
    return F.coalesce(~F.trim(href).rlike(r"(?i)^(?:$|#|javascript:|mailto:|tel:|data:)"), F.lit(False))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(entities.unescape, na_action="ignore")


# fixed values: elements that separate words
_BREAKS = r"(?i)</?(?:td|th|tr|br|p|li|div|table|tbody|thead|h[1-6]|ul|ol)\b[^>]*>"


def plain(c: Column, strip_markup: bool = True) -> Column:
    """Comparison form: entities decoded, quotes folded, links unwrapped, markup out, white space folded, none before punctuation."""
    c = _unescaped(c)
    c = F.regexp_replace(F.regexp_replace(c, "[‘’‚‛]", "'"), "[“”„‟]", '"')
    if strip_markup:
        c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
        c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[*`]", ""), _BREAKS, " "), r"</?[a-zA-Z][^>]*>", "")
        c = F.replace(c, F.lit("|"), F.lit(" "))
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"[\s\xa0]+", " ")), r"\s+(['.,;:!?])", "$1")


def squashed(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\xa0\-‐‑–—]+", "")


def token_estimate(c: Column) -> Column:
    return F.ceil(F.char_length(c) / 4)


def image_tokens(width: Column, height: Column) -> Column:
    return F.ceil(F.least(width * height, F.lit(1_150_000)) / 750)


def timecode_seconds(c: Column) -> Column:
    """Seconds of H:MM:SS or MM:SS; null if it isn't one."""
    parts = F.split(c, ":")
    ok = c.rlike(r"^(\d+:)?\d{1,2}:\d{2}(\.\d+)?$")
    value = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + F.try_to_number(x, F.lit("999999.999")).cast("double"))
    return F.when(ok, value)


def quote_found(quote: Column, text: Column, strip_markup: bool = True) -> Column:
    """All fragments of the quote (split at ..., the ellipsis and |) stand in the text in this order, as they are or without blanks and hyphens."""
    parts = F.filter(F.split(quote, r"\.\.\.|…|\|"), lambda x: F.trim(x) != "")
    # one pass of the decoder for all fragments: they are joined by a character that texts don't hold
    joined = F.split(plain(F.array_join(parts, "␞"), strip_markup), " ?␞ ?")
    hay = plain(text, strip_markup)

    def scan(hay: Column, shape) -> Column:
        # the text goes along in the state, as a lambda cannot name a column of the decoder
        begin = F.struct(F.lit(1).alias("at"), hay.alias("hay"))
        step = lambda s, x: F.struct(F.when(s["at"] == 0, F.lit(0)).otherwise(_after(s["hay"], shape(x), s["at"])).alias("at"), s["hay"].alias("hay"))
        return F.aggregate(joined, begin, step)["at"] > 0

    return (F.size(parts) == 0) | scan(hay, lambda x: x) | scan(squashed(hay), squashed)


def _after(hay: Column, needle: Column, at: Column) -> Column:
    found = F.call_function("locate", needle, hay, at)
    return F.when(found == 0, F.lit(0)).otherwise(found + F.char_length(needle))


def functional_uri(uri: Column) -> Column:
    """{hash, params: [{k, v}], fragment, canonical} of corpus://hash?k=v&flag#fragment, null if malformed.

    Parameters keep their order; values are kept decoded (%25, %26 and %23 alone)
    and encoded again in the canonical form.
    """
    name = F.lower(F.regexp_extract(uri, r"^(?i:corpus)://([^/?#]*)", 1))
    ok = name.rlike("^[0-9a-f]{64}$") & uri.rlike(r"^(?i:corpus)://[^/?#]*(?:[?#]|$)")
    chunks = F.filter(F.split(F.regexp_extract(uri, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    decoded = lambda v: F.replace(F.replace(F.replace(v, F.lit("%23"), F.lit("#")), F.lit("%26"), F.lit("&")), F.lit("%25"), F.lit("%"))
    coded = lambda v: F.replace(F.replace(F.replace(v, F.lit("%"), F.lit("%25")), F.lit("&"), F.lit("%26")), F.lit("#"), F.lit("%23"))
    params = F.transform(chunks, lambda x: F.struct(F.regexp_extract(x, "^([^=]*)", 1).alias("k"), F.when(x.contains("="), decoded(F.regexp_extract(x, "=(?s:(.*))$", 1))).alias("v")))
    fragment = F.regexp_extract(uri, r"#(.*)$", 1)
    shown = F.array_join(F.transform(params, lambda p: F.when(p["v"].isNull(), p["k"]).otherwise(F.concat(p["k"], F.lit("="), coded(p["v"])))), "&")
    whole = F.concat(F.lit("corpus://"), name, F.when(shown != "", F.concat(F.lit("?"), shown)).otherwise(F.lit("")), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))
    return F.when(ok, F.struct(name.alias("hash"), params.alias("params"), fragment.alias("fragment"), whole.alias("canonical")))


def hash_tag(c: Column) -> Column:
    """{tag, hex} of tag:hex, split at the first colon."""
    return F.when(c.contains(":"), F.struct(F.substring_index(c, ":", 1).alias("tag"), F.regexp_extract(c, "^[^:]*:(?s:(.*))$", 1).alias("hex")))


def region(c: Column) -> Column:
    """[x, y, w, h] of a region inside the unit square, else null."""
    parts = F.transform(F.split(c, ","), lambda x: F.when(F.trim(x).rlike(r"^[0-9.]+$"), F.trim(x).cast("double")))
    sound = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull() & (x >= 0) & (x <= 1))
    x, y, w, h = (F.get(parts, F.lit(i)) for i in range(4))
    return F.when(sound & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1), parts)


def frames(c: Column) -> Column:
    """{lo, hi} of N or N-M with 1 <= N <= M, else null."""
    lo, hi = F.regexp_extract(c, r"^(\d{1,9})(?:-\d{1,9})?$", 1), F.regexp_extract(c, r"^\d{1,9}-(\d{1,9})$", 1)
    first, last = F.nullif(lo, F.lit("")).cast("int"), F.coalesce(F.nullif(hi, F.lit("")), F.nullif(lo, F.lit(""))).cast("int")
    return F.when((first >= 1) & (last >= first), F.struct(first.alias("lo"), last.alias("hi")))


def timecode(seconds: Column) -> Column:
    """H:MM:SS, with tenths where they are not zero."""
    whole = F.floor(seconds)
    tenths = F.round((seconds - whole) * 10).cast("int")
    return F.concat(F.floor(whole / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(whole / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"), F.when(tenths > 0, F.concat(F.lit("."), tenths.cast("string"))).otherwise(F.lit("")))


def wikilinks(c: Column) -> Column:
    """Distinct targets of [[target]] and [[target|label]]."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), F.trim))


def entity_refs(json_text: Column) -> Column:
    """Distinct ids of {"entity": id} anywhere in JSON text, in order."""
    return F.array_distinct(F.regexp_extract_all(json_text, F.lit(r'"entity"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1)))


def checkpoints(transcript: Column) -> Column:
    """[{speaker, at, text}] of blocks that begin with [speaker] (H:MM:SS)."""
    head = r"\[([^\]\n]+)\] \((\d+:\d{2}:\d{2}(?:\.\d+)?)\)"
    blocks = F.filter(F.split(F.regexp_replace(transcript, rf"(?m)^{head}", "␞$0"), "␞"), lambda x: x.rlike(rf"\A{head}"))
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, head, 1).alias("speaker"), timecode_seconds(F.regexp_extract(b, head, 2)).alias("at"), F.trim(F.regexp_replace(F.regexp_replace(b, rf"\A{head}", ""), r"\s+", " ")).alias("text")))


def markdown_row(*cells: Column) -> Column:
    """A row of a table: pipes are escaped, line ends are blanks, null is empty."""
    shown = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def filled(template: str, fields: dict[str, Column]) -> Column:
    """A template's {field}, {list[0]} and {first|second}; null if a place finds no value."""
    out, last = [], 0
    for m in re.finditer(r"\{([^{}]+)\}", template):
        out.append(F.lit(template[last : m.start()]))
        last, found = m.end(), []
        for name in m[1].split("|"):
            at = re.fullmatch(r"(\w+)\[(\d+)\]", name)
            column = fields.get(at[1] if at else name)
            if column is not None:
                found.append(F.nullif(F.get(column, F.lit(int(at[2]))) if at else column.cast("string"), F.lit("")))
        out.append(F.coalesce(*found) if found else F.lit(None).cast("string"))
    return F.concat(*out, F.lit(template[last:]))


def quoted_history_trimmed(body: Column) -> Column:
    """The text before the first mark of a quoted message."""
    return F.regexp_replace(body, r"(?ms)\s*^(?:On .{1,200} wrote:|-{2,} ?(?:Original Message|Forwarded message) ?-{2,}|_{10,}|From: .+\n(?:Sent|Date): ).*\z", "")


def token_coverage(have: Column, got: Column) -> Column:
    """{share, missing}: part of the distinct words of `have` that `got` holds, and the others."""
    mine, theirs = F.array_distinct(tokens(have)), F.array_distinct(tokens(got))
    missing = F.array_sort(F.array_except(mine, theirs))
    return F.struct(F.round(1 - F.size(missing) / F.greatest(F.size(mine), F.lit(1)), 3).alias("share"), missing.alias("missing"))


def sniffed_mime(head: Column, name: Column) -> Column:
    """Media type by the first bytes, else by the name."""
    # fixed values: magic numbers and extensions of common types
    magic = [("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("25504446", "application/pdf"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("53514C69746520666F726D6174203300", "application/vnd.sqlite3"), ("4F676753", "audio/ogg"), ("664C6143", "audio/flac"), ("494433", "audio/mpeg")]
    kinds = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json", "eml": "message/rfc822", "mbox": "application/mbox", "vcf": "text/vcard", "epub": "application/epub+zip", "xml": "application/xml"}
    digits, extension = F.hex(head), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.lit(None).cast("string")
    for end, kind in kinds.items():
        by_name = F.when(extension == end, F.lit(kind)).otherwise(by_name)
    by_magic = F.lit(None).cast("string")
    for start, kind in magic:
        by_magic = F.when(digits.startswith(start), F.lit(kind)).otherwise(by_magic)
    refined = F.when((by_magic == "application/zip") & (by_name == "application/epub+zip"), by_name).otherwise(by_magic)
    return F.coalesce(refined, by_name, F.lit("application/octet-stream"))


@F.pandas_udf(StringType())
def simhash64(texts: pd.Series) -> pd.Series:
    """simhash:16 hex digits of the weighted words (NFKC, lower case), null without words."""

    def one(text: str | None) -> str | None:
        counts = Counter(re.findall(r"\w+", unicodedata.normalize("NFKC", text or "").lower()))
        if not counts:
            return None
        bits = np.unpackbits(np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in counts), np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
        votes = np.array(list(counts.values())) @ (2 * bits - 1)
        return f"simhash:{np.packbits(votes > 0).tobytes().hex()}"

    return texts.map(one)
