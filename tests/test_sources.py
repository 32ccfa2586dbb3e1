"""Scans, sinks, OCR documents, corpus builds and streams."""

import gzip
import json
import random
import time

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from corvina.functions.providers import CharacterEmbedder
from corvina.operators import corpus, ocr
from corvina.plans import build
from corvina.sources import readers, segments, writers
from corvina.streaming import events

TECH = [
    ("A220-ATA52-door-page_0001.pdf", "# RH Passenger Door\nInspection of RH passenger door near frame 20/21 in the right forward fuselage zone.", "ATA 52", "RH Passenger Door; Door Frame 20/21"),
    ("A220-ATA52-door-page_0002.pdf", "Door frame 20/21 repair limits and RH installation references for ATA 52.", "ATA 52", "Door Frame 20/21"),
]


def tech_tsv(path):
    lines = ["\t".join(readers.TECH_COLUMNS)]
    for doc, chunk, ata, parts in TECH:
        lines.append("\t".join([doc, "", f"{doc}.json", '"' + chunk.replace('"', '\\"') + '"', "12x", f"{doc} 0", ata, parts, "procedure"]))
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")


def test_tech_tsv(spark, tmp_path):
    tech_tsv(tmp_path / "a.tsv.gz")
    got = corpus.tech_records(readers.read_tech_docs(spark, str(tmp_path / "a.tsv.gz"))).orderBy("doc").collect()
    assert [(r.doc, r.content, r.length) for r in got] == [(d, c, 12) for d, c, _, _ in TECH]
    assert got[0].source_path == TECH[0][0] + ".json" and got[0].metadata["parts"] == TECH[0][3]


def test_event_rows(spark, tmp_path):
    (tmp_path / "e.tsv").write_text('ATA-52-demo\tATA-52-demo-000-2026\t"##ATA 52 - 000\nRelated parts: A220-52-1001, A220-52-2002."\nshort\tx\nd\tc\t  \n')
    got = corpus.event_records(readers.read_events(spark, str(tmp_path / "e.tsv"))).collect()
    assert [(r.doc, r.metadata) for r in got] == [("ATA-52-demo", {"task_kind": "000", "ATA_code": "ATA-52"})]
    twice = spark.createDataFrame([("a", "c", "one"), ("b", "c", "two")], "doc string, chunk_id string, chunk string")
    assert corpus.event_records(twice).count() == 2 and corpus.event_records(twice, dedupe=True).first().content == "one"


def plain_records(text):
    """(index, fields, raw) of every record, a character at a time."""
    out, row, field, inside, escaped, start = [], [], "", False, False, 0

    def emit(stop):
        nonlocal row, field
        row.append(field)
        if text[start:stop] != "":
            out.append((len(out), row, text[start:stop]))
        row, field = [], ""

    for i, c in enumerate(text):
        if escaped:
            field, escaped = field + c, False
        elif inside and c in '\\"':
            escaped, inside = c == "\\", c == "\\"
        elif inside:
            field += c
        elif c == '"':
            inside = True
        elif c == "\t":
            row.append(field)
            field = ""
        elif c == "\n":
            emit(i)
            start = i + 1
        elif c != "\r":
            field += c
    if inside:
        raise readers.tsv.UnterminatedQuote
    if start < len(text):
        emit(len(text))
    return out


def test_raw_records(spark, tmp_path):
    text = 'h1\th2\r\n"a\nb"\tx"y"z\n\n""\n"q\\"t"\t1'
    want = [(0, ["h1", "h2"], "h1\th2\r"), (1, ["a\nb", "xyz"], '"a\nb"\tx"y"z'), (2, [""], '""'), (3, ['q"t', "1"], '"q\\"t"\t1')]
    assert plain_records(text) == want
    (tmp_path / "r.tsv").write_text(text, newline="")
    assert sorted((r.row_idx, r.fields, r.raw) for r in readers.read_raw_tsv(spark, str(tmp_path / "r.tsv")).collect()) == want
    (tmp_path / "bad.tsv").write_text('a\n"b\nc\n')
    with pytest.raises(readers.tsv.UnterminatedQuote):
        readers.read_raw_tsv(spark, str(tmp_path / "bad.tsv"))


@pytest.fixture
def small_splits(spark):
    """Every file is cut into blocks of some forty bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_random_files_in_many_blocks(spark, tmp_path, small_splits):
    rng = random.Random(11)
    want = {}
    for n in range(12):
        while True:
            text = "".join(rng.choice('ab"\\\t\n\n\ré "') for _ in range(rng.choice([0, 30, 400, 900])))
            text = text + '"' * (n == 5) + "x" * 300 * (n == 6) + "\n" * (n % 3)
            try:
                want[f"f{n}.tsv"] = plain_records(text)
                break
            except readers.tsv.UnterminatedQuote:
                continue
        (tmp_path / f"f{n}.tsv").write_text(text, newline="")
    got = {name: [] for name in want}
    for r in readers.read_raw_tsv(spark, str(tmp_path)).collect():
        got[r.path.rsplit("/", 1)[1]].append((r.row_idx, r.fields, r.raw))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_one_long_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    record = '"line one\nline two \\" still"\tb"in"side\t\n'
    (tmp_path / "long.tsv").write_text(record * 200)
    lines = readers.tsv._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 100
    rows = readers.read_tsv(spark, str(tmp_path), ("a", "b", "c"), False)
    assert {tuple(r) for r in rows.collect()} == {('line one\nline two " still', "binside", "", None)} and rows.count() == 200


def test_widths_and_empty_fields(spark, tmp_path):
    (tmp_path / "w.tsv").write_text('h\ti\n""\t\na\n""\n\r\nb\tc\td\n')
    got = readers.read_tsv(spark, str(tmp_path), ("x", "y"), True).collect()
    assert [tuple(r) for r in got] == [("", "", None), ("a", None, "a"), ("b", "c", "b\tc\td")]


def test_canonical_text_is_kept_to_the_byte(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "OFFSET_ROWS", 7)
    path, rng = str(tmp_path / "c"), random.Random(2)
    raws = ["".join(rng.choice("a\tb\r\né") for _ in range(rng.randrange(12))) for _ in range(60)] + ["same", "same", "", "x\r"]
    rows = spark.createDataFrame(list(enumerate(raws)), "order long, raw string").repartition(5)
    text = "".join(r + "\n" for r in raws)
    audit = writers.write_canonical(rows, path)
    assert audit["exact"] and (audit["rows"], audit["n_bytes"], audit["n_lines"]) == (64, len(text.encode()), text.count("\n"))
    files = sorted(p for p in (tmp_path / "c").iterdir() if p.name.startswith("part-"))
    assert b"".join(gzip.decompress(p.read_bytes()) for p in files).decode() == text
    swap = F.when(F.col("order") == 3, 62).when(F.col("order") == 62, 3).otherwise(F.col("order"))
    assert not writers.audit_text(rows.withColumn("order", swap), path)["exact"]
    assert not writers.audit_text(rows.withColumn("raw", F.rtrim("raw", F.lit("\r"))), path)["exact"]
    assert writers.write_canonical(rows.filter("false"), path)["exact"]  # takes the place of what was there


def test_trees(spark, tmp_path):
    for name, content in (("md/a b.md", "# A"), ("md/x/b.md", "# B"), ("js/ATA-52-1.json", '{"k": {"n": 1}}'), ("js/ATA-99-2.json", "{}"), ("js/bad.json", "{"), ("pdf/b.PDF", "x"), ("pdf/a.pdf", "x"), ("pdf/c.txt", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    assert {(r.doc, r.chunk_id, r.content) for r in readers.read_markdown(spark, str(tmp_path / "md")).collect()} == {("a b.md", "a b", "# A"), ("b.md", "b", "# B")}
    ata = spark.createDataFrame([("52", "Doors")], "ATA_code string, ATA_category string")
    assert {(r.nc_event_id, r.ATA_category) for r in readers.read_json_objects(spark, str(tmp_path / "js"), ata).collect()} == {("ATA-52-1", "Doors"), ("ATA-99-2", "Unknown")}
    assert [r.doc for r in readers.list_pages(spark, str(tmp_path / "pdf")).collect()] == ["a.pdf", "b.PDF"]
    files, totals = writers.bundle_manifest(spark, str(tmp_path / "md"))
    assert totals.first().n_files == 2 and totals.first().n_bytes == 6 and files.count() == 2


def test_parsers(spark):
    text = spark.createDataFrame([("intro\nNC-2024-001 Door leak\nbody 1\nNC-2024-002: Tank\nbody 2\n",)], "value string")
    got = readers.parse_scenarios(text).orderBy("pos").collect()
    assert [(r.case_ref, r.title, r.body, r.status) for r in got] == [(None, "", "", "unparsed"), ("NC-2024-001", "Door leak", "body 1", "parsed"), ("NC-2024-002", "Tank", "body 2", "parsed")]
    double = spark.createDataFrame([("a", '{"x":1}'), ("b", json.dumps('{"x":2}')), ("c", "{")], "id string, v string")
    assert {(r.id, r.json, r.ok) for r in readers.parse_double_json(double, "id", "v").collect()} == {("a", '{"x":1}', True), ("b", '{"x":2}', True), ("c", None, False)}
    labels = spark.createDataFrame([('[{"doc":"a","label":"ambiguous"},{"doc":"b","label":"odd"}]',), ('{"c":"nano_sufficient"}',)], "v string")
    assert {tuple(r) for r in readers.parse_labels(labels, "v", ["ambiguous", "nano_sufficient"]).collect()} == {("a", "ambiguous"), ("c", "nano_sufficient")}
    names = spark.createDataFrame([("a.md",), ("../a",), ("/x",), ("x/y",)], "n string")
    assert [r.n for r in names.filter(readers.is_safe_name(F.col("n"))).collect()] == ["a.md"]


def test_tsv_writer(spark, tmp_path):
    rows = [("plain", 'q"t'), ("tab\there", "back\\slash"), ("line\nend", "")]
    writers.write_tsv(spark.createDataFrame(rows, "a string, b string").coalesce(1), str(tmp_path / "t"), ["a", "b"])
    back = readers.read_tsv(spark, str(tmp_path / "t"), ("a", "b"), False)
    assert {(r.a, r.b) for r in back.collect()} == set(rows)


def test_tsv_header_is_written_without_python_workers(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('r\t', id) AS a", "if(id % 2 = 0, '', 'x\ny') AS b").repartition(3)
    for name, df in (("t", rows), ("none", rows.filter("a = ''")), ("few", rows.filter("a = 'r\t7'").repartition(4, "a"))):
        plans, path = [], str(tmp_path / name)
        written = DataFrameWriter.text
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(DataFrameWriter, "text", lambda w, *a, **k: plans.append(w._df._jdf.queryExecution().optimizedPlan().toString()) or written(w, *a, **k))
            writers.write_tsv(df, path, ["a", "b"], header=True, gz=True)
        assert plans and not any("MapIn" in p for p in plans)
        found = [gzip.open(f, "rt", newline="").read() for f in (tmp_path / name).glob("*.gz")]
        held = [t for t in found if t]
        assert held and all(t.startswith("a\tb\n") and t.count("a\tb\n") == 1 for t in held)
        assert len(held) == {"t": 3}.get(name, 1)
        back = readers.read_tsv(spark, path, ("a", "b"), True)
        assert sorted(tuple(r)[:2] for r in back.collect()) == sorted(map(tuple, df.collect()))


def test_replace_and_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        writers.replace_table(spark.range(n), path)
    assert spark.read.parquet(path).count() == 5
    m = writers.manifest(spark, {"rows": spark.range(4)}, spark.createDataFrame([("f",)], "fingerprint string"))
    assert writers.mismatches(m, {"fingerprint": "g", "rows_count": 4}).first().reasons == ["fingerprint-mismatch"]


def test_canonical(spark):
    rows = [(0, "kept", "c1"), (1, "gone", "c1"), (2, "kept", "c1"), (3, "long-1", "c2"), (4, "short-1", "c3"), (5, "", "c4")]
    df = spark.createDataFrame(rows, "row_idx int, doc string, chunk_id string")
    pages = spark.createDataFrame([("kept",), ("long-1",), ("short-1",)], "doc string")
    alias = F.when(F.col("doc").startswith("long-"), F.replace("doc", F.lit("long"), F.lit("short")))
    got = {r.row_idx: r.drop_reason for r in corpus.drop_reasons(df, pages, alias, F.col("doc") == "").collect()}
    assert got == {0: None, 1: "missing_page", 2: "duplicate_chunk", 3: "alias", 4: None, 5: "malformed"}


def test_fingerprint_changes(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "i long, t string")
    mark = lambda d: corpus.fingerprint(d, ["t"], "i", width=7).first().fingerprint
    assert mark(df) == mark(df.repartition(5)) != mark(df.filter("i < 29"))


def test_ocr_rows(spark):
    image = {"id": "i", "imageBase64": "QUJD", "top_left_x": 0, "bottom_right_x": 980}
    docs = [
        ("m_page_7.pdf", {"pages": [{"markdown": "Bleed ![x](i.png) system", "images": [image], "dimensions": {"width": 1000}}]}), ("m_page_8.pdf", {"ocrResponse": {"pages": [{"markdown": "cover"}]}}),
        ("m_page_9.pdf", {"pages": [{"markdown": "# ATA 36\n![x](y)", "images": [image], "dimensions": {"width": 1000}}]}), ("m_page_10.pdf", {"pages": [{"markdown": " "}]}),
    ]
    rows = spark.createDataFrame([(d, json.dumps(v)) for d, v in docs], "doc string, v string")
    parsed = ocr.parse_documents(rows, "doc", "v")
    assert bytes(parsed.filter("doc = 'm_page_7.pdf'").select(ocr.decoded(F.get("images", F.lit(0))).alias("b")).first().b) == b"ABC"
    said = [("m_page_7.pdf", {"page_category": "technical_diagram", "page_category_confidence": 1.7, "short_summary": " Valve  view "}), ("m_page_8.pdf", [{"page_category": "cover_page", "page_category_confidence": 0.92}])]
    caps = ocr.captions(spark.createDataFrame([(d, json.dumps(v)) for d, v in said], "doc string, v string"), "doc", "v")
    assert {(r.doc, r.page_category_confidence, r.is_non_content_page, r.retrieval_action) for r in caps.collect()} == {("m_page_7.pdf", 1.0, False, "index"), ("m_page_8.pdf", 0.92, True, "exclude")}
    got = ocr.prepared(parsed, caps).collect()
    assert [(r.chunk_id, r.chunk, r.action) for r in got] == [("m_page_7.pdf 0", "Bleed > Image description: Valve view system", "index")]


def test_build(spark, tmp_path):
    records = spark.createDataFrame([(i, d, f"{d} 0", c, a, p) for i, (d, c, a, p) in enumerate(TECH)], "row_idx long, doc string, chunk_id string, content string, ata string, parts string")
    found = spark.createDataFrame([("ATA-52-demo", "ATA-52-demo-000-2026", "near frame 20/21: A220-52-1001, A220-52-2002.")], "doc string, chunk_id string, content string")
    m = build.build(records, found, str(tmp_path), CharacterEmbedder()).first()
    assert (m.vectors_count, m.parts_count, m.occurrences_count, m.wiki_count) == (2, 2, 1, 2)
    page = spark.read.parquet(str(tmp_path / "wiki")).filter("slug = 'door-frame-20-21'").first().markdown
    assert page.startswith("# Door Frame 20/21\n") and "- ATA: ATA-52" in page and "- [A220-ATA52-door-page_0002.pdf](../../pages/A220-ATA52-door-page_0002.pdf)" in page
    assert segments.read_index(spark, str(tmp_path / "index")).postings.filter("term = 'door'").count() == 2


def test_stale_artefacts_say_why(spark, tmp_path):
    records = spark.createDataFrame([(i, d, f"{d} 0", c, a, p) for i, (d, c, a, p) in enumerate(TECH)], "row_idx long, doc string, chunk_id string, content string, ata string, parts string")
    none, path, facts = records.limit(0).select("doc", "chunk_id", "content"), str(tmp_path), {"corpus": "tech", "model": "m1"}
    lost = ["vectors-missing", "index-missing"]
    tables = [f"{n}-missing" for n in build.KNOWLEDGE]
    assert build.inspect(spark, path, facts) == ["manifest-missing", "version-mismatch", "corpus-mismatch", "model-mismatch", *lost, *tables]
    m = build.build(records, none, path, CharacterEmbedder(), knowledge_only=True, facts=facts)
    assert "vectors_count" not in m.columns and m.first().parts_count == 2
    assert build.inspect(spark, path, facts | {"records": 2}) == ["knowledge-only", *lost]
    assert build.ensure(records, none, path, CharacterEmbedder(), "one", facts=facts) == "built"
    assert build.inspect(spark, path, facts | {"records": 2, "built_of": "one"}) == []
    assert build.inspect(spark, path, {"records": 3, "corpus": "other", "model": "m2"}) == ["records-mismatch", "corpus-mismatch", "model-mismatch"]
    segments.update_index(records.filter("row_idx = 0"), f"{path}/index", "row_idx", build.WEIGHTS)
    (tmp_path / "wiki").rename(tmp_path / "moved")
    assert build.inspect(spark, path, facts) == ["index_rows-mismatch", "wiki-missing"]
    assert build.ensure(records, none, path, CharacterEmbedder(), "one", facts=facts) == "built"
    assert build.ensure(None, none, path, CharacterEmbedder(), "one", facts=facts) == "fresh"


# ---- streams


def run_stream(spark, tmp_path, batches, schema, make, mode="update", name="out"):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        import os

        os.utime(source / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    end = time.time() + 90
    try:  # a query with timeouts of processing time does not end by itself
        while query.isActive and time.time() < end and sum(p["numInputRows"] for p in query.recentProgress) < sum(map(len, batches)):
            time.sleep(0.3)
        assert query.exception() is None
    finally:
        query.stop()
    return spark.table(name).collect()


def test_accumulate_stream(spark, tmp_path):
    b1 = [{"request_id": "r", "seq": 2, "event": "delta", "delta": "lo"}, {"request_id": "r", "seq": 1, "event": "delta", "delta": "hel"}, {"request_id": "s", "seq": 1, "event": "delta", "delta": "x"}]
    b2 = [{"request_id": "r", "seq": 3, "event": "delta", "delta": "!"}, {"request_id": "r", "seq": 4, "event": "done"}]
    got = run_stream(spark, tmp_path, [b1, b2], "request_id string, seq int, event string, delta string", events.accumulate_stream, name="acc")
    assert ("r", "hello!", 3, True) in {tuple(r) for r in got} and ("s", "x", 1, False) in {tuple(r) for r in got}


def test_session_stream(spark, tmp_path):
    turn = lambda t: {"session_id": 1, "turn": t, "role": "user", "text": f"t{t}"}
    got = run_stream(spark, tmp_path, [[turn(t) for t in (1, 2, 3)], [turn(t) for t in (4, 5, 6)]], "session_id long, turn long, role string, text string", events.session_stream, name="ses")
    assert (1, 4, 3, 6, "user: t3\nuser: t4\nuser: t5\nuser: t6") in {tuple(r) for r in got}


def test_frame_stream(spark, tmp_path):
    piece = lambda i, t: {"request_id": "a", "seq": i, "text": t}
    batches = [[piece(0, "event: x\nda"), piece(1, "ta: 1\n")], [piece(2, "\ndata: 2\r\n\r\nda"), piece(3, "ta: 3\n\ndata: 4")]]
    got = run_stream(spark, tmp_path, batches, "request_id string, seq long, text string", events.frame_stream, name="frames", mode="append")
    assert sorted((r.n, r.block) for r in got) == [(0, "event: x\ndata: 1"), (1, "data: 2"), (2, "data: 3")]


def test_framed_pieces_flush_the_last_block(spark):
    rows = spark.createDataFrame([(1, 2, "ta: 3"), (1, 0, "data: 1\n"), (1, 1, "\nda"), (2, 0, None)], "k int, s int, t string")
    assert [(r.k, r.seq, r.data) for r in events.framed(rows, "k", "s", "t").orderBy("seq").collect()] == [(1, 0, "1"), (1, 1, "3")]


def test_window_stream(spark, tmp_path):
    row = lambda h, v: {"ts": f"2024-01-01T{h:02}:00:00", "event_type": "a", "value": v}
    got = run_stream(spark, tmp_path, [[row(1, 1.0), row(2, 2.0)], [row(3, 4.0)]], "ts timestamp, event_type string, value double", events.event_windows, name="win")
    assert max(r.n_events for r in got) == 3


def test_upsert_sink(spark, tmp_path):
    path = str(tmp_path / "t")
    write = events.upsert_sink(path, "k", "at", buckets=4)
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    write(first, 0)
    bucket = {r.k: r.bucket for r in spark.read.parquet(f"{path}/rows").collect()}
    files = lambda k: sorted(p.name for p in (tmp_path / "t" / "rows" / f"bucket={bucket[k]}").iterdir())
    before = files("b")
    write(spark.createDataFrame([("a", 2, "z")], first.schema), 1)
    write(spark.createDataFrame([("a", 9, "replayed")], first.schema), 1)
    write(first.limit(0), 2)
    assert {(r.k, r.at, r.v, r.first_seen) for r in events.read_upserted(spark, path).collect()} == {("a", 2, "z", 1), ("b", 1, "y", 1)}
    assert bucket["a"] == bucket["b"] or files("b") == before


def test_replace_table_survives_a_crash(spark, tmp_path):
    from corvina.sources import writers

    path = str(tmp_path / "t")
    read = lambda: {r.id for r in spark.read.parquet(path).collect()}
    writers.replace_table(spark.range(3), path)
    writers.replace_table(spark.range(5), path)
    assert read() == set(range(5)) and not (tmp_path / "t.old").exists()
    (tmp_path / "t").rename(tmp_path / "t.old")  # between the two moves
    writers.recover(spark, path)
    assert read() == set(range(5))
    writers.write_meta(spark, str(tmp_path), {"a": "1", "b": "2"})
    writers.write_meta(spark, str(tmp_path), {"b": "3"})
    assert writers.read_meta(spark, str(tmp_path)) == {"a": "1", "b": "3"} and writers.read_meta(spark, path) == {}


def test_fingerprint_folds(spark):
    import hashlib

    from corvina.operators import corpus

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [-7, 0, 3, 10**6, 10**6 + 1, 5 * 10**12]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string")
    level = [(i, sha(f"{i}\nt{i}")) for i in ids]
    least, most = min(ids), max(ids)
    while True:
        runs = {}
        for o, h in sorted(level):
            runs.setdefault(o // 10, []).append(h)
        level = [(o, sha("".join(h))) for o, h in runs.items()]
        least, most = least // 10, most // 10
        if most - least < 10:
            break
    got = corpus.fingerprint(df, ["id", "t"], "id", 10).first()
    assert (got.fingerprint, got.n_rows) == (sha("".join(h for _, h in sorted(level))), 6)
    odd = df.unionByName(spark.createDataFrame([(None, "x"), (None, "y")], df.schema))
    assert corpus.fingerprint(odd, ["id", "t"], "id").first().n_rows == 8
    assert corpus.fingerprint(odd.repartition(3), ["id", "t"], "id").first() == corpus.fingerprint(odd, ["id", "t"], "id").first()
    assert corpus.fingerprint(df.limit(0), ["id", "t"], "id").first().n_rows == 0


def test_blocks(spark):
    df = spark.createDataFrame([(1, "event: status\ndata: a\ndata: b\n\ndata: {}\n\nevent: none\n\n")], "id int, t string")
    assert [(r.seq, r.event, r.data) for r in events.parse_blocks(df, "t").orderBy("seq").collect()] == [(0, "status", "a\nb"), (1, "message", "{}")]
