"""Files of many kinds as rows: archives, mail, cards, books, tables, lines, records and their digests.

Files are listed and read by Spark (`binaryFile`, `text`, `csv`, `json`), so any
store works; parsers run on Arrow batches.  A file that cannot be parsed gives a
row in which only `error` stands beside its path.  One file is one cell and must
fit in memory.
"""

from __future__ import annotations

import csv
import email
import email.policy
import hashlib
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _parsed(files: DataFrame, parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """path, the columns of the schema, error; parse yields the rows of one file."""
    full = StructType.fromDDL(f"path string, {schema}, error string")
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [{"path": path, **r} for r in parse(path, content or b"")]
                except Exception as fault:  # whatever a broken file makes a parser say
                    rows = [{"path": path, "error": f"{type(fault).__name__}: {fault}"}]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("path", "content").mapInArrow(run, full)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, mtime, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def digests(found: DataFrame, rungs: tuple[int, ...] = (4096, 65536, 1048576)) -> DataFrame:
    """(path, recipe, param, value): md5, sha256 and the digests of the first bytes a file reaches, in the JVM."""
    rows = [F.struct(F.lit("md5").alias("recipe"), F.lit("").alias("param"), F.md5("content").alias("value")), F.struct(F.lit("sha256").alias("recipe"), F.lit("").alias("param"), F.sha2("content", 256).alias("value"))]
    rows += [F.when(F.octet_length("content") >= r, F.struct(F.lit("prefix").alias("recipe"), F.lit(str(r)).alias("param"), F.sha2(F.substring("content", 1, r), 256).alias("value"))) for r in rungs]
    return found.select("path", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("h")).select("path", "h.*")


def members(found: DataFrame) -> DataFrame:
    """path, ord, name, size, sha256, content of the files in zip, tar and tgz archives, in archive order."""

    def parse(path: str, content: bytes) -> Iterator[dict]:
        if content[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                every = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                every = [(i.name, t.extractfile(i).read()) for i in t if i.isfile()]
        for n, (name, data) in enumerate(every):
            yield {"ord": n, "name": name, "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "content": data}

    return _parsed(found, parse, "ord int, name string, size long, sha256 string, content binary")


def _message(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    parts = []
    for n, part in enumerate(p for p in m.walk() if not p.is_multipart()):
        data = part.get_payload(decode=True) or b""
        parts.append({"ord": n, "media_type": part.get_content_type(), "filename": part.get_filename(), "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
    body = m.get_body(("plain", "html"))
    head = {k: str(v) for k, v in m.items()}
    named = {k.lower(): v for k, v in head.items()}
    return {"message_id": named.get("message-id"), "from_addr": named.get("from"), "subject": named.get("subject"), "date_raw": named.get("date"), "headers": head, "body": body.get_content() if body is not None else None, "parts": parts}


MESSAGE = "message_id string, from_addr string, subject string, date_raw string, headers map<string,string>, body string, parts array<struct<ord:int,media_type:string,filename:string,size:long,sha256:string>>"


def mail(found: DataFrame) -> DataFrame:
    """One row a message file: headers unfolded and decoded, body text, the parts in pre-order."""
    return _parsed(found, lambda path, raw: iter([_message(raw)]), MESSAGE)


def mailbox(found: DataFrame, strip: tuple[str, ...] = ()) -> DataFrame:
    """One row a message of mailbox files: ordinal, date of the separator line, digest without the headers to be stripped, and MESSAGE."""
    dropped = {s.lower() for s in strip}

    def parse(path: str, content: bytes) -> Iterator[dict]:
        marks = [m.start() for m in re.finditer(rb"(?:\A|(?<=\n))From [^\n]*\n", content)]
        for n, (a, b) in enumerate(zip(marks, [*marks[1:], len(content)], strict=True)):
            first, _, raw = content[a:b].partition(b"\n")
            head, gap, body = re.split(rb"(\r?\n\r?\n)", raw, maxsplit=1) if re.search(rb"\r?\n\r?\n", raw) else (raw, b"", b"")
            kept = [h for h in re.split(rb"\r?\n(?![ \t])", head) if h.split(b":", 1)[0].strip().lower().decode("ascii", "replace") not in dropped]
            sep = re.match(rb"From \S+ +(.+?)\s*$", first)
            yield {"ord": n, "sep_date": sep[1].decode("ascii", "replace") if sep else None, "content_hash": hashlib.sha256(b"\n".join(kept) + b"\n\n" + body.rstrip(b"\r\n")).hexdigest(), **_message(raw)}

    return _parsed(found, parse, f"ord int, sep_date string, content_hash string, {MESSAGE}")


def cards(found: DataFrame) -> DataFrame:
    """One row a property of contact cards: card, ord, group, name, params, value; folded lines joined."""

    def parse(path: str, content: bytes) -> Iterator[dict]:
        card, ord_ = -1, 0
        for line in re.sub(r"\r?\n[ \t]", "", content.decode("utf-8", "replace")).splitlines():
            m = re.match(r"(?:([\w-]+)\.)?([\w-]+)((?:;(?:[^:\";]|\"[^\"]*\")*)*):(.*)$", line)
            if not m:
                continue
            name = m[2].upper()
            if name == "BEGIN":
                card, ord_ = card + 1, 0
            elif name != "END":
                text = re.sub(r"\\([nN,;\\])", lambda x: "\n" if x[1] in "nN" else x[1], m[4])
                yield {"card": card, "ord": ord_, "group": m[1], "name": name, "params": m[3].lstrip(";") or None, "value": text}
                ord_ += 1

    return _parsed(found, parse, "card int, ord int, `group` string, name string, params string, value string")


def books(found: DataFrame) -> DataFrame:
    """One row an item of an EPUB's spine: ord, href, media_type, title of the book, text without markup."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]

    def parse(path: str, content: bytes) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            box = ElementTree.fromstring(z.read("META-INF/container.xml"))
            opf = next(e.get("full-path") for e in box.iter() if tag(e) == "rootfile")
            package = ElementTree.fromstring(z.read(opf))
            title = next((e.text for e in package.iter() if tag(e) == "title"), None)
            items = {e.get("id"): e for e in package.iter() if tag(e) == "item"}
            base = opf.rpartition("/")[0]
            for n, ref in enumerate(e for e in package.iter() if tag(e) == "itemref"):
                item = items[ref.get("idref")]
                name = f"{base}/{item.get('href')}".lstrip("/")
                markup = re.sub(r"(?is)<(script|style|head)\b.*?</\1>", " ", z.read(name).decode("utf-8", "replace"))
                yield {"ord": n, "href": name, "media_type": item.get("media-type"), "title": title, "text": " ".join(re.sub(r"<[^>]*>", " ", markup).split())}

    return _parsed(found, parse, "ord int, href string, media_type string, title string, text string")


def table_rows(found: DataFrame, delimiter: str = ",", quote: str = '"', header: bool = True) -> DataFrame:
    """One row a logical row of delimited files: ord from 1, fields by the header's names (c1, c2, ... without one)."""

    def parse(path: str, content: bytes) -> Iterator[dict]:
        rows = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""), delimiter=delimiter, quotechar=quote)
        names = next(rows, []) if header else None
        for n, row in enumerate(rows, 1):
            yield {"ord": n, "fields": list(zip(names or [f"c{i}" for i in range(1, len(row) + 1)], row, strict=False))}

    return _parsed(found, parse, "ord int, fields map<string,string>")


def sheets(found: DataFrame) -> DataFrame:
    """One row a row of the visible sheets of xlsx files: sheet, row, cells as text."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]

    def parse(path: str, content: bytes) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            shared = ["".join(t.text or "" for t in e.iter() if tag(t) == "t") for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(e) == "si"] if "xl/sharedStrings.xml" in names else []
            targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
                if tag(e) != "sheet" or e.get("state") in ("hidden", "veryHidden"):
                    continue
                target = next(targets[v] for k, v in e.attrib.items() if k.endswith("}id"))
                for row in ElementTree.fromstring(z.read("xl/" + target.removeprefix("/xl/"))).iter():
                    if tag(row) == "row":
                        cells = []
                        for c in (c for c in row if tag(c) == "c"):
                            text = "".join(v.text or "" for v in c.iter() if tag(v) in ("v", "t"))
                            cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
                        yield {"sheet": e.get("name"), "row": int(row.get("r") or 0), "cells": cells}

    return _parsed(found, parse, "sheet string, `row` int, cells array<string>")


def boxes(found: DataFrame) -> DataFrame:
    """One row a box of ISO media files, in pre-order: depth, kind, start, size; and the handler of a track."""
    nested = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"moof", b"traf", b"dinf"}

    def walk(data: bytes, a: int, b: int, depth: int) -> Iterator[dict]:
        while a + 8 <= b:
            size, kind, head = int.from_bytes(data[a : a + 4], "big"), data[a + 4 : a + 8], 8
            if size == 1:
                size, head = int.from_bytes(data[a + 8 : a + 16], "big"), 16
            size = size or b - a
            if size < head or a + size > b:
                raise ValueError(f"box at {a} leaves its container")
            handler = data[a + 16 : a + 20].decode("latin-1") if kind == b"hdlr" else None
            yield {"depth": depth, "kind": kind.decode("latin-1"), "start": a, "size": size, "handler": handler}
            if kind in nested:
                yield from walk(data, a + head, a + size, depth + 1)
            a += size

    return _parsed(found, lambda path, data: walk(data, 0, len(data), 0), "depth int, kind string, start long, size long, handler string")


def json_objects(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """path, object (JSON text), error of all JSON files below a folder; an error stands where a file isn't JSON."""

    def parse(name: str, content: bytes) -> Iterator[dict]:
        yield {"object": json.dumps(json.loads(content.decode()), ensure_ascii=False)}

    return _parsed(files(spark, path, glob), parse, "object string")


def lineage(objects: DataFrame) -> DataFrame:
    """(old_id, to_id, reason, grain) of lineage maps {old: {to, reason}} or {old: to}; ids with # are claims."""
    pairs = objects.select(F.explode(F.from_json("object", "map<string,string>")).alias("old_id", "v"))
    nested = F.ltrim("v").startswith("{")
    to = F.when(nested, F.get_json_object("v", "$.to")).otherwise(F.col("v"))
    return pairs.select("old_id", to.alias("to_id"), F.when(nested, F.get_json_object("v", "$.reason")).alias("reason"), F.when(F.col("old_id").contains("#"), "claim").otherwise("file").alias("grain"))


def ledger(objects: DataFrame) -> dict[str, DataFrame]:
    """facts, claims, evidence, roster and participants of fact objects {id, type, name, claims: [{evidence: []}], artifacts, participants}."""
    claim = "struct<id:string,predicate:string,value:string,object:string,status:string,period:string,qualifiers:map<string,string>,evidence:array<struct<source:string,quote:string,element:int>>>"
    fact = F.from_json("object", f"struct<id:string,type:string,name:string,period:string,subject:string,participants:array<string>,claims:array<{claim}>,artifacts:array<struct<uri:string,role:string>>>")
    rows = objects.where("error is null").select("path", fact.alias("f")).where("f.id is not null")
    claims = rows.select(F.col("f.id").alias("fact_id"), F.posexplode("f.claims").alias("ord", "c"))
    return {
        "facts": rows.select(F.col("f.id").alias("fact_id"), "f.type", "f.name", "f.period", "f.subject", "path"),
        "claims": claims.select("fact_id", "ord", F.concat("fact_id", F.lit("#"), "c.id").alias("claim_id"), "c.predicate", "c.value", "c.object", "c.status", "c.period", "c.qualifiers"),
        "evidence": claims.select(F.concat("fact_id", F.lit("#"), "c.id").alias("claim_id"), F.posexplode("c.evidence").alias("ord", "e")).select("claim_id", "ord", "e.*"),
        "roster": rows.select(F.col("f.id").alias("fact_id"), F.posexplode("f.artifacts").alias("ord", "a")).select("fact_id", "ord", "a.*"),
        "participants": rows.select(F.col("f.id").alias("edge_id"), F.explode("f.participants").alias("fact_id")),
    }


def front_matter(texts: DataFrame) -> DataFrame:
    """record_id, fields (top-level key: text lines of the head between --- lines), body of record texts (record_id, text)."""
    whole = F.regexp_extract("text", r"\A---\r?\n((?s).*?)\r?\n---\r?(?:\n|\z)", 1)
    lines = F.filter(F.split(whole, r"\r?\n(?=[A-Za-z_][\w.-]*:)"), lambda x: x.rlike(r"^[A-Za-z_][\w.-]*:"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_][\w.-]*):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"""^(["'])(.*)\1$""", "$2").alias("v"))
    return texts.select("record_id", F.map_from_entries(F.transform(lines, entry)).alias("fields"), F.regexp_replace("text", r"\A---\r?\n(?s).*?\r?\n---\r?(?:\n|\z)", "").alias("body"))


def by_reference(records: DataFrame, target: str) -> DataFrame:
    """The record of a whole id or of a prefix of it; more than one is an error that names how many."""
    hits = records.where(F.col("record_id").startswith(target))
    exact = hits.where(F.col("record_id") == target)
    n = hits.limit(1001).count()
    if n > 1 and exact.isEmpty():
        raise ValueError(f"{target!r} names {n if n <= 1000 else 'over 1000'} records")
    return exact if n > 1 else hits


def triples(claims: DataFrame, base: str = "urn:fact:") -> DataFrame:
    """Sorted lines of N-Triples: one a claim with an object or value; text is escaped."""
    escaped = F.replace(F.replace(F.replace(F.col("value"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    iri = lambda c: F.concat(F.lit(f"<{base}"), c, F.lit(">"))
    target = F.coalesce(iri(F.col("object")), F.concat(F.lit('"'), escaped, F.lit('"')))
    return claims.where(target.isNotNull()).select(F.concat(iri(F.col("fact_id")), F.lit(" "), iri(F.col("predicate")), F.lit(" "), target, F.lit(" .")).alias("line")).distinct().orderBy("line")
