"""Files written here and read back; streams started, fed and compared with a batch."""

import datetime as dt
import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.operators import records, relations, rules
from factloom.sources import files
from factloom.streaming import jobs


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries:
            z.writestr(k, v)
    return out.getvalue()


def test_archives_and_digests(spark, tmp_path):
    put(tmp_path, "a.zip", zipped([("x/1.txt", "one"), ("2.txt", "")]))
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("t.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    put(tmp_path, "b.tgz", tar.getvalue())
    put(tmp_path, "broken.zip", b"PKnot")
    got = files.members(files.files(spark, str(tmp_path))).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.name, r.size) for r in got if not r.error) == [("a.zip", "2.txt", 0), ("a.zip", "x/1.txt", 3), ("b.tgz", "t.txt", 3)]
    assert [r.path.rsplit("/", 1)[1] for r in got if r.error] == ["broken.zip"]
    put(tmp_path, "big.bin", b"q" * 5000)
    assert sorted((r.recipe, r.param) for r in files.digests(files.files(spark, str(tmp_path), "big.bin")).collect()) == [("md5", ""), ("prefix", "4096"), ("sha256", "")]


def test_mail(spark, tmp_path):
    raw = "Message-ID: <1@x>\r\nFrom: A <a@x>\r\nSubject: long\r\n subject\r\nX-Y: 1\r\n\r\nhello\r\n"
    put(tmp_path, "m.eml", raw)
    r = files.mail(files.files(spark, str(tmp_path), "*.eml")).first()
    assert (r.message_id, r.subject, r.body.strip(), r.parts[0].media_type) == ("<1@x>", "long subject", "hello", "text/plain")
    put(tmp_path, "b.mbox", f"From a@x Mon Jan  1 00:00:00 2024\n{raw}\nFrom b@x Tue Jan  2 00:00:00 2024\n{raw.replace('X-Y: 1', 'X-Y: 2')}\n")
    rows = files.mailbox(files.files(spark, str(tmp_path), "*.mbox"), strip=("x-y",)).orderBy("ord").collect()
    assert [x.sep_date for x in rows] == ["Mon Jan  1 00:00:00 2024", "Tue Jan  2 00:00:00 2024"] and rows[0].content_hash == rows[1].content_hash
    other = files.mailbox(files.files(spark, str(tmp_path), "*.mbox")).select("content_hash").distinct().count()
    assert other == 2


def test_cards_tables_books_sheets_boxes(spark, tmp_path):
    put(tmp_path, "c.vcf", "BEGIN:VCARD\r\nFN:A\\, B\r\nitem1.TEL;TYPE=\"a:b\":1\r\n 2\r\nEND:VCARD\r\nBEGIN:VCARD\r\nFN:C\r\nEND:VCARD\r\n")
    got = [(r.card, r.ord, r.group, r.name, r.value) for r in files.cards(files.files(spark, str(tmp_path), "*.vcf")).collect()]
    assert got == [(0, 0, None, "FN", "A, B"), (0, 1, "item1", "TEL", "12"), (1, 0, None, "FN", "C")]
    put(tmp_path, "t.csv", 'a,b\n1,"x\ny"\n2,"q""q"\n')
    assert [(r.ord, r.fields) for r in files.table_rows(files.files(spark, str(tmp_path), "*.csv")).collect()] == [(1, {"a": "1", "b": "x\ny"}), (2, {"a": "2", "b": 'q"q'})]
    opf = '<package><metadata><title>T</title></metadata><manifest><item id="i" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="i"/></spine></package>'
    put(tmp_path, "b.epub", zipped([("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'), ("O/p.opf", opf), ("O/c.xhtml", "<html><head><title>x</title></head><p>Some <b>text</b></p></html>")]))
    r = files.books(files.files(spark, str(tmp_path), "*.epub")).first()
    assert (r.title, r.href, r.text) == ("T", "O/c.xhtml", "Some text")
    book = '<workbook xmlns:r="u"><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r2"/></sheets></workbook>'
    sheet = '<worksheet><sheetData><row r="2"><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>'
    put(tmp_path, "s.xlsx", zipped([("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", '<R><x Id="r1" Target="s1.xml"/><x Id="r2" Target="s1.xml"/></R>'), ("xl/sharedStrings.xml", "<sst><si><t>hi</t></si></sst>"), ("xl/s1.xml", sheet)]))
    assert [(r.sheet, r.row, r.cells) for r in files.sheets(files.files(spark, str(tmp_path), "*.xlsx")).collect()] == [("S", 2, ["hi", "5"])]
    box = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    put(tmp_path, "v.mp4", box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"hdlr", b"\0" * 8 + b"soun")))))
    got = [(r.depth, r.kind, r.handler) for r in files.boxes(files.files(spark, str(tmp_path), "*.mp4")).collect()]
    assert got == [(0, "ftyp", None), (0, "moov", None), (1, "trak", None), (2, "mdia", None), (3, "hdlr", "soun")]


def test_ledger_files(spark, tmp_path):
    fact = {"id": "f1", "type": "song", "name": "N", "claims": [{"id": "c", "predicate": "genre", "value": 'a "b"', "evidence": [{"source": "s", "quote": "q"}]}], "artifacts": [{"uri": "corpus://x", "role": "copy"}], "participants": ["p"]}
    put(tmp_path, "f1.json", json.dumps(fact))
    put(tmp_path, "bad.json", "{")
    objects = files.json_objects(spark, str(tmp_path))
    assert objects.where("error is not null").count() == 1
    t = files.ledger(objects)
    assert t["claims"].first().claim_id == "f1#c" and t["evidence"].first().quote == "q" and t["roster"].first().role == "copy" and t["participants"].first().fact_id == "p"
    assert files.triples(t["claims"]).first().line == '<urn:fact:f1> <urn:fact:genre> "a \\"b\\"" .'
    moved = spark.createDataFrame([('{"a": {"to": "b", "reason": "r"}, "a#1": "b#1"}',)], "object string")
    assert sorted(map(tuple, files.lineage(moved).collect())) == [("a", "b", "r", "file"), ("a#1", "b#1", None, "claim")]


def test_records(spark):
    texts = spark.createDataFrame([("ab1", "---\ntitle: 'T: x'\ntags:\n  - a\n---\nbody\n"), ("ab2", "no head"), ("c", None)], "record_id string, text string")
    got = {r.record_id: r for r in files.front_matter(texts).collect()}
    assert got["ab1"].fields["title"] == "T: x" and got["ab1"].body == "body\n" and got["ab2"].fields == {} and got["ab2"].body == "no head"
    assert files.by_reference(texts, "c").count() == 1 and files.by_reference(texts, "ab1").count() == 1 and files.by_reference(texts, "zz").count() == 0
    with pytest.raises(ValueError):
        files.by_reference(texts, "ab")


def stream(spark, schema, tmp_path, batches, build, mode, name):
    folder = tmp_path / name
    folder.mkdir()
    query = build(spark.readStream.schema(schema).json(str(folder))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        for n, rows in enumerate(batches):
            (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
            query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_queue_stream(spark, tmp_path):
    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    events = [{"record_id": f"r{rng.randrange(4)}", "at": (start + dt.timedelta(seconds=300 * i)).isoformat(), "kind": rng.choice(["request", "claim", "result"]), "hint": rng.choice([None, "a", "b"])} for i in range(60)]
    got = stream(spark, "record_id string, at timestamp, kind string, hint string", tmp_path, [events[:25], events[25:40], events[40:]], jobs.queue_stream, "update", "queue")
    last = {}
    for r in got:
        if r.record_id not in last or r.changes > last[r.record_id].changes:
            last[r.record_id] = r
    for name in {e["record_id"] for e in events}:
        want = jobs.advanced(None, [(dt.datetime.fromisoformat(e["at"]), e["kind"], e["hint"]) for e in events if e["record_id"] == name])
        assert (last[name].state, last[name].hint, last[name].changes) == (want[0], want[3], want[4])


def test_late_rows_and_first_sights(spark, tmp_path):
    rows = [[{"at": f"2024-01-{d:02}T01:00:00", "k": "x"} for d in (1, 20)], [{"at": "2024-01-02T00:00:00", "k": "late"}, {"at": "2024-02-20T00:00:00", "k": "x"}], [{"at": "2024-03-20T00:00:00", "k": "x"}]]
    build = lambda s: jobs.period_counts(s, "at", F.date_format("at", "yyyy-MM"), "k", "7 days")
    got = stream(spark, "at timestamp, k string", tmp_path, rows, build, "append", "periods")
    assert sorted((r.period, r.k, r.n) for r in got) == [("2024-01", "x", 1), ("2024-01", "x", 1), ("2024-02", "x", 1)]
    seen = [[{"path": "a", "size": 1, "mtime": 1, "at": "2024-01-01T00:00:00"}], [{"path": "a", "size": 1, "mtime": 1, "at": "2024-01-01T00:10:00"}, {"path": "a", "size": 2, "mtime": 1, "at": "2024-01-01T00:10:00"}]]
    assert sorted(r.size for r in stream(spark, "path string, size long, mtime long, at timestamp", tmp_path, seen, jobs.attest_stream, "append", "sights")) == [1, 2]


def test_queue_batches(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    queue = spark.createDataFrame([("a", "requested", at(2), None, "h"), ("b", "requested", at(1), None, None), ("c", "claimed", at(1), at(9, 1), None), ("d", "result", at(1), at(1), None), ("e", "claimed", at(1), dt.datetime(2024, 1, 9, 23, 50), None)], "record_id string, state string, requested_at timestamp, claimed_at timestamp, hint string")
    got = {r.record_id: r.state for r in records.drained(queue, now, 1).collect()}
    assert got == {"a": "requested", "b": "claimed", "c": "requested", "e": "claimed"}
    asked = spark.createDataFrame([("a", "x"), ("a", "x"), ("d", "y"), ("e", "z"), ("n", None)], "record_id string, hint string")
    got = {r.record_id: (r.state, r.hint) for r in records.enqueued(queue, asked, now).collect()}
    assert got == {"a": ("requested", "h; x"), "b": ("requested", None), "c": ("claimed", None), "d": ("requested", "y"), "e": ("claimed", None), "n": ("requested", "")}


def test_manifest_and_dates(spark):
    before = spark.createDataFrame([("p", 1, 10, 5, 7, "h1"), ("q", 1, 11, 6, 8, "h2")], "path string, dev int, ino int, size int, mtime int, hash string")
    after = spark.createDataFrame([("moved", 1, 10, 5, 7), ("q", 1, 99, 6, 8), ("new", 1, 12, 1, 1), ("p", 1, 50, 5, 9)], "path string, dev int, ino int, size int, mtime int")
    assert {r.path: (r.hash, r.how) for r in records.carried_inodes(before, after).collect()} == {"moved": ("h1", "unchanged"), "q": ("h2", "migrated"), "new": (None, "hash"), "p": (None, "hash")}
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, records.upserted(table, spark.createDataFrame([("b", 3), ("c", 4), ("b", 5)], "k string, v int"), ["k"]).collect())) == [("a", 1), ("b", 5), ("c", 4)]
    assert sorted(map(tuple, records.seeded(table, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 4)]
    axis = spark.createDataFrame([(v,) for v in ("0", "-1", "true", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "9999999999999", None)], "v string").select(records.date_axis(F.col("v"), "Europe/Berlin").cast("string").alias("t"))
    assert [r.t for r in axis.collect()] == ["1970-01-01 00:00:00", None, None, "2024-01-01 00:00:00", "2023-12-31 23:00:00", None, None]


def test_shapes(spark):
    a = spark.createDataFrame([("1", "ab"), ("2", "ab"), ("3", "x"), ("4", "x"), ("v", "x")], "address string, content string")
    b = spark.createDataFrame([("1", "ab"), ("2", "abc"), ("3", "y")], "address string, content string")
    assert {r.address: r.state for r in records.continuity(a, b, F.col("address") == "v").collect()} == {"1": "IDENTICAL", "2": "CONTAINED", "3": "DIVERGED", "4": "ABSENT", "v": "VOLATILE"}
    rows = spark.createDataFrame([("d", p, 0.1 + p * 0.0005, 0.2) for p in range(4)] + [("d", 1, 0.5, 0.6), ("e", 1, 0.1, 0.2), ("e", 2, 0.1, 0.2)], "doc string, page int, top double, bottom double")
    assert [(r.doc, r.pages) for r in records.chrome_rows(rows).collect()] == [("d", 4)]
    j = spark.createDataFrame([('{"a":[1,{"b":"x"}],"c":null}', '{"a":[1,{"b":"y"}],"c":null}')], "x string, y string")
    assert j.select(records.json_leaves(F.col("x")).alias("m")).first().m == {"a[]": ["1"], "a[].b": ["x"], "c": ["null"]}
    assert j.select(records.json_changes(F.col("x"), F.col("y")).alias("m")).first().m == ["a[].b"]
    p = spark.createDataFrame([("1.10",), ("1.9",), ("1",)], "p string").orderBy(records.path_order(F.col("p")))
    assert [r.p for r in p.collect()] == ["1", "1.9", "1.10"]
    spans = spark.createDataFrame([(1, i, dt.date(2020, 1, 1) + dt.timedelta(days=40 * i), dt.date(9999, 12, 31) if i % 3 == 0 else dt.date(2020, 1, 1) + dt.timedelta(days=40 * i + 50)) for i in range(9)], "k int, i int, f date, l date")
    got = {(r.one, r.two) for r in relations.bucketed_overlaps(spans, "k", "i", "f", "l").collect()}
    each = [(r.i, r.f, r.l) for r in spans.collect()]
    assert got == {(x[0], y[0]) for x in each for y in each if x[0] < y[0] and x[1] <= y[2] and y[1] <= x[2]}
    old = spark.createDataFrame([("f", "p", "v")], "fact_id string, predicate string, value string")
    auto = spark.createDataFrame([("f", "p", "v", ["r"]), ("f", "p", "w", ["r"])], "fact_id string, predicate string, value string, evidence array<string>")
    assert sorted((r.value, r.provenance) for r in rules.asserted_first(old, auto).collect()) == [("v", "asserted"), ("w", "auto")]
