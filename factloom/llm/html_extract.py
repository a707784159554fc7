"""Main text of web pages by differencing with the page of the nearest URL.

Pages are sorted by host and URL path; each is paired with the neighbour of its
host that shares the longer beginning of the path (at a tie the one before).
The lines of text of both are aligned by longest common subsequence and shared
lines are deleted, for they are the site's and not the page's.  If a page has an
`article` or `main` element, only its lines count, and one of them is deleted only
if the neighbour on the other side shares it as well: a sentence that two articles
have in common by chance is no notice of the site.  Lines in navigation, headers
and footers of the page, asides, forms, scripts, styles, adverts, notices and
comments never count.  A page that shares four fifths of the text that counts is a
version of this one and has no vote.

Cases: null or empty html gives empty text; markup may be unclosed or broken;
a null URL is a host of its own; equal pages keep each its text; other columns
are not looked at.  A first pass sorts the urls alone and cuts them into
stretches; only the first and last of each come to the driver.  The pages go to
the task of their stretch, and those at its borders to the next one too, so a hot
host is split and every page sees both its neighbours.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import lean

# fixed values: elements of HTML
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object svg math canvas audio video nav footer aside form button select textarea dialog menu".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|disqus|respond|replies|related|recommended|share|sharing|social|widget|toolbar|pagination|pager|skip-link)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")


def _boilerplate(name: str, attributes: str, in_main: bool) -> bool:
    if name in HIDDEN:
        return True
    if name == "header" and not in_main:
        return True
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"):
            return True
        if key in ("class", "id") and name not in ("body", "html", "article", "main") and NAMES.search(value):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """Blocks of text in page order: (text, inside article or main, boilerplate by structure)."""
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, main, boilerplate

    def flush() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append((text, stack[-1][1] if stack else False, stack[-1][2] if stack else False))

    at, raw = 0, None
    while at < len(page):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}\s*>?", re.I).search(page, at)
            if not (stack and stack[-1][2]):
                held.append(entities.unescape(page[at : end.start() if end else len(page)]))
            at, raw = (end.start() if end else len(page)), None
            continue
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            held.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            held.append(m[1])
        if m[3] is None:
            continue
        name = m[3].lower()
        if name == "br":
            held.append(" ")
        if name in BLOCKS or name in HIDDEN:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and name not in BLOCKS:
                    break
        elif name not in VOID and not m[4].rstrip().endswith("/") or name in RAW:
            while stack and (stack[-1][0], name) in _CLOSES:
                stack.pop()
            main, boiler = stack[-1][1:] if stack else (False, False)
            stack.append((name, main or name in ("article", "main"), boiler or _boilerplate(name, m[4], main)))
            if name in RAW:
                raw = name
    flush()
    return out


#: An element whose start closes an open one.
_CLOSES = {("p", x) for x in BLOCKS - {"body", "html", "head", "title", "option", "optgroup", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "summary"}} | {("li", "li"), ("dd", "dt"), ("dt", "dd"), ("dt", "dt"), ("dd", "dd"), ("option", "option"), ("tr", "tr"), ("td", "td"), ("td", "th"), ("th", "td"), ("th", "th"), ("td", "tr"), ("th", "tr"), ("head", "body")}


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b, in bit vectors of the length of a."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    known = set(b)
    match: dict[str, int] = {}
    for i, x in enumerate(a):
        if x in known:
            match[x] = match.get(x, 0) | 1 << i
    b = [x for x in b if x in match]
    if not b:
        return out
    full = (1 << len(a)) - 1
    rows = [full]
    for x in b:
        v = rows[-1]
        u = v & match[x]
        rows.append(((v + u) | (v - u)) & full)
    i, j = len(a) - 1, len(b)
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:
            i -= 1
        elif not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.add(head + i)
            i, j = i - 1, j - 1
    return out


def main_text(own: list[tuple[str, bool, bool]], others: list[list[tuple[str, bool, bool]]]) -> str:
    """The lines that count less those shared with the others, the nearest page first.

    Structure speaks for a line inside article or main, so two pages must share it;
    any other line goes if the nearest page has it.
    """
    only_main = any(main and not boiler for _, main, boiler in own)
    counts = [i for i, (_, main, boiler) in enumerate(own) if not boiler and (main or not only_main)]
    size = sum(len(own[i][0]) for i in counts)
    votes: list[set[int]] = []
    for other in others:
        gone = common_lines([x[0] for x in own], [x[0] for x in other])
        if 5 * sum(len(own[i][0]) for i in counts if i in gone) < 4 * size:
            votes.append(gone)
    need = 2 if only_main else 1
    if len(votes) >= need:
        counts = [i for i in counts if not all(i in gone for gone in votes[:need])]
    return "\n\n".join(own[i][0] for i in counts)


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


_ORDER = ("host", "path", "id", "h")


def _keys(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Sort keys of the rows, in an order that is Spark's: nulls first, text by its bytes."""
    for host, path, name, h in zip(*(batch.column(c).to_pylist() for c in _ORDER), strict=True):
        yield host, path, name is not None, name or 0, h


def _borders(rows: DataFrame, parts: int) -> tuple[list[tuple], list[tuple]]:
    """First and last key of about `parts` stretches of the sorted pages, all that comes to the driver."""
    size = max(64, -(-rows.count() // parts))
    kind = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("c", pa.bool_()), ("d", pa.int64()), ("e", pa.int64())]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[tuple] = []
        n, last = 0, None
        for batch in batches:
            for key in _keys(batch):
                if last is None or n >= size and key != last:
                    ends += [key] if last is None else [last, key]
                    n = 0
                n, last = n + 1, key
        if last is not None:
            ends.append(last)
        yield pa.record_batch({"ends": pa.array([[dict(zip("abcde", k, strict=True)) for k in ends]], kind)})

    light = rows.select(*_ORDER).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    found = light.mapInArrow(lean(walk), "ends array<struct<a:string,b:string,c:boolean,d:long,e:long>>").collect()
    pairs = sorted((tuple(r["ends"][i]), tuple(r["ends"][i + 1])) for r in found for i in range(0, len(r["ends"]), 2))
    return [a for a, _ in pairs], [b for _, b in pairs]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text for each page."""
    site = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.regexp_replace(site, r"^(www|m)\.", "").alias("host"), path.alias("path"), F.xxhash64(html_col).alias("h"))
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts, ends = _borders(rows, 4 * tasks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, part, guest = [], [], []
            for i, key in enumerate(_keys(batch)):
                at = max(0, bisect_right(starts, key) - 1)
                row.append(i), part.append(at), guest.append(False)
                for other, edge, next_to in ((at - 1, starts, ends), (at + 1, ends, starts)):
                    if 0 <= other < len(starts) and key == edge[at] and next_to[other][0] == key[0]:
                        row.append(i), part.append(other), guest.append(True)
            yield batch.take(pa.array(row, pa.int64())).append_column("part", pa.array(part, pa.int64())).append_column("guest", pa.array(guest, pa.bool_()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("id", "url", "host", "path", "part", "guest", "html")), strict=True)

        done: list[tuple] = []
        before = here = None
        for row in _with_end(walk()):
            ahead = None if row is None else (*row[:6], lines_of(row[6] or ""))
            if here is not None and not here[5]:
                near = [x for x in (before, ahead) if x is not None and x[2] == here[2] and x[4] == here[4]]
                near.sort(key=lambda x: -_shared(x[3], here[3]))
                done.append((here[0], here[1], main_text(here[6], [x[6] for x in near])))
                if len(done) >= 500:
                    yield _batch(done)
                    done = []
            before, here = here, ahead
        if done:
            yield _batch(done)

    dealt = rows.mapInArrow(lean(deal), "id long, url string, html string, host string, path string, h long, part long, guest boolean")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", *_ORDER).drop("h").mapInArrow(lean(read), "id long, url string, text string")


def _with_end(rows):
    yield from rows
    yield None


def _batch(done: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({"id": pa.array([d[0] for d in done], pa.int64()), "url": pa.array([d[1] for d in done], pa.string()), "text": pa.array([d[2] for d in done], pa.string())})
