import io
import json
import random
import zipfile
from decimal import Decimal as D

import pytest
import statements
from pyspark.sql import functions as F

from statemill.operators import audit, geometry, ledger, matching, raster, ui
from statemill.plans.statement import process
from statemill.sources import pdf, sinks, tables

ENTRY = "doc_id int, idx int, date string, description string, amount decimal(28,2), balance decimal(28,2), check_number string, page int, is_balance_forward boolean"


def spec_segments(entries):
    """A plain reading of the rules: [(opening, [entries])]."""
    out, now, opening, running = [], [], None, None
    for e in entries:
        if e[8]:
            if now and running is not None and e[5] is not None:
                if abs(running - e[5]) > D("0.01"):
                    out.append((opening, now))
                    now, opening = [], e[5]
                running = e[5]
            else:
                opening = e[5] if opening is None else opening
                running = running if e[5] is None else e[5]
        else:
            now.append(e)
            if e[4] is not None:
                running = e[4] if running is None else running + e[4]
    return out + ([(opening, now)] if now or opening is not None else [])


def test_segments_against_a_plain_version(spark):
    rng, rows = random.Random(9), []
    money = lambda: D(rng.randrange(-300, 300)) / 100
    for doc in range(120):
        total = D(0)
        for i in range(rng.randrange(0, 12)):
            mark = rng.random() < 0.3
            amount = None if mark or rng.random() < 0.1 else money()
            total += amount or 0
            balance = rng.choice([None, total, total, money()]) if mark else None
            rows.append((doc, i, "d", "x", amount, balance, None, i, mark))
    df = spark.createDataFrame(rows, ENTRY)
    got = {(r.doc_id, r.idx): (r.segment, r.seg_opening) for r in ledger.segments(df).collect()}
    counts = {r.doc_id: r.n_segments for r in ledger.segment_counts(df).collect()}
    for doc in {r[0] for r in rows}:
        want = spec_segments([r for r in rows if r[0] == doc])
        assert counts[doc] == len(want)
        assert {(e[0], e[1]): (k, o) for k, (o, es) in enumerate(want) for e in es} == {k: v for k, v in got.items() if k[0] == doc}


def test_running_balance_and_categories(spark):
    rows = [(1, 0, "d", "Deposit", D("100.00"), D("600.00"), None, 0, False), (1, 1, "d", "Check", D("-50.00"), D("555.00"), "77", 0, False), (1, 2, "d", "Wire fee", D("-5.00"), D("550.00"), None, 0, False)]
    heads = spark.createDataFrame([(1, "BANK_ACCOUNT", D("500.00"), D("545.00"))], "doc_id int, statement_type string, opening decimal(28,2), closing decimal(28,2)")
    r = ledger.reconcile(spark.createDataFrame(rows, ENTRY), heads).first()
    assert (r.status, r.running_balance_breaks, r.difference) == ("BALANCED", 2, D("0.00"))
    assert r.components == {"deposits_credits": D("100.00"), "withdrawals_debits": D("5.00"), "checks_paid": D("50.00")}
    assert [m.idx for m in r.mismatches] == [1, 2]


def test_service_reconcile(spark):
    rows = spark.createDataFrame([(1, 1000.0, "credit"), (1, 250.0, "debit")], "doc_id int, amount double, type string")
    heads = spark.createDataFrame([(1, 1000.0, 1750.0)], "doc_id int, opening double, closing double")
    r = ledger.api_reconcile(rows, heads).first()
    assert r.reconciled and r.calculated_closing == 1750.0 and ledger.client_reconcile(rows, heads).first().difference == 0.0


def test_continuity(spark):
    rows = [(1, 0, "d", "x", D("10.00"), None, None, 0, False), (1, 1, "d", "x", D("5.00"), None, None, 1, False)]
    marks = [(1, 9, "d", "b/f", None, D("11.00"), None, 1, True), (1, 10, "d", "b/f", None, D("16.00"), None, 2, True)]
    got = ledger.verify_continuity(spark.createDataFrame(rows, ENTRY), ledger.checkpoints(spark.createDataFrame(marks, ENTRY))).collect()
    assert [(r.page, r.expected, r.carried_forward) for r in got] == [(1, D("10.00"), D("11.00"))]


TXN = "doc_id string, idx int, page int, description string, amount decimal(28,2), check_number string, type string"
CHECK = "doc_id string, check_ord int, page int, check_number string, amount decimal(28,2), payee_name string, confidence double"


def spec_checks(checks, txns):
    """A plain reading of the rules for one document: {idx: (check_number, payee, flag)} of rows that have any."""
    work = [[t[2], t[4], t[5] or None, t[6] or "", None, None] for t in txns]
    for c in checks:
        if c[4] is None:
            continue
        best = None
        for k, w in enumerate(work):
            if w[0] == c[2] and w[1] is not None and w[1] < 0 and not w[2] and w[3].lower() in ("debit", "unknown", ""):
                diff = abs(abs(w[1]) - abs(c[4]))
                if diff <= D("0.50") and (best is None or diff < best[0]):
                    best = diff, k
        if best:
            w = work[best[1]]
            w[2], w[4] = c[3] or w[2], c[5]
        else:
            work.append([c[2], -abs(c[4]), c[3], "debit", c[5], "manual_review"])
    return sorted((str(w[0]), w[1], w[2], w[4], w[5]) for w in work if w[2] or w[4] or w[5])


def test_checks(spark):
    txn = [("a", 0, 0, "x", D("-100.00"), None, "debit"), ("a", 1, 0, "y", D("-100.30"), None, "debit"), ("a", 2, 1, "z", D("-100.00"), None, "debit")]
    checks = [("a", 0, 0, "11", D("100.20"), "P", 0.9), ("a", 1, 0, "12", D("100.25"), "Q", 0.9), ("a", 2, 0, "13", D("100.00"), "R", 0.9), ("a", 3, 0, "14", None, "S", 0.9), ("a", 4, 0, None, D("7.00"), "T", 0.9), ("a", 5, 0, "15", D("7.10"), "U", 0.9), ("a", 6, 3, None, D("1.00"), None, 0.9)]
    got = {r.idx: (r.check_number, r.review_flag, r.source, r.payee_name) for r in matching.match_checks(spark.createDataFrame(checks, CHECK), spark.createDataFrame(txn, TXN)).collect()}
    assert got == {0: ("12", None, "check_ocr", "Q"), 1: ("11", None, "check_ocr", "P"), 2: (None, None, None, None), 3: ("13", "manual_review", "check_ocr", "R"), 4: ("15", "manual_review", "check_ocr", "U"), 5: (None, "manual_review", "check_ocr", None)}


def test_checks_against_a_plain_version(spark):
    rng, txns, checks = random.Random(3), {}, {}
    for doc in range(40):
        money = lambda: D(rng.randrange(9900, 10200)) / 100
        txns[doc] = [(str(doc), i, rng.randrange(2), "x", -money() if rng.random() < 0.8 else money(), rng.choice([None, None, "", "9"]), rng.choice(["debit", None, "unknown", "note"])) for i in range(6)]
        checks[doc] = [(str(doc), i, rng.randrange(2), rng.choice([None, "", f"n{i}"]), rng.choice([None, money(), money(), money()]), rng.choice([None, f"p{i}"]), 0.9) for i in range(6)]
    out = matching.match_checks(spark.createDataFrame(sum(checks.values(), []), CHECK), spark.createDataFrame(sum(txns.values(), []), TXN)).collect()
    for doc in txns:
        own = [r for r in out if r.doc_id == str(doc)]
        got = sorted(((str(r.page), r.amount, r.check_number or None, r.payee_name, r.review_flag) for r in own if r.check_number or r.payee_name or r.review_flag), key=repr)
        assert got == sorted(((p, a, n or None, y, f) for p, a, n, y, f in spec_checks(checks[doc], txns[doc])), key=repr)


def test_console_totals(spark):
    rows = spark.createDataFrame([(1, D("5.00")), (1, D("-2.00")), (2, D("5.00")), (3, D("1.00"))], "doc_id int, amount decimal(28,2)")
    told = spark.createDataFrame([(1, {"deposits_credits": D("9.00"), "fees_charged": D("1.00")}), (2, {"deposits_credits": D("0.00")}), (3, None)], "doc_id int, components map<string,decimal(28,2)>")
    assert [tuple(r) for r in ui.console_totals(rows, told).orderBy("doc_id").collect()] == [(1, 9.0, 1.0, 2), (2, 5.0, 0.0, 1), (3, 1.0, 0.0, 1)]


def test_snip_fields(spark):
    rows = [("all", "2024-01-05", 5.0, " x "), ("date", None, 5.0, "x"), ("amount", None, 5.0, ""), ("balance", "d", 5.0, "x"), (None, "d", 5.0, "x"), ("description", None, None, " ")]
    df = spark.createDataFrame(rows, "h string, d string, a double, c string").select(ui.snip_fields(F.col("h"), F.col("d"), F.col("a"), F.col("c")).alias("m"))
    assert [r.m for r in df.collect()] == [{"date": "2024-01-05", "amount": "5.0", "description": "x"}, {}, {"amount": "5.0"}, {}, {}, {}]


@pytest.fixture(scope="module")
def done(spark):
    tokens = spark.createDataFrame(statements.bank_statement() + statements.card_statement(), geometry.TOKEN_SCHEMA).cache()
    return process(tokens)


def test_whole_statement(done):
    s = {r.doc_id: r for r in done.summaries.collect()}["bank"]
    assert (s.opening, s.closing) == (D("5000.00"), D("8000.00")) and s.account_number == "12-3456-789"
    r = {r.doc_id: r for r in done.reconciliation.collect()}
    assert r["bank"].status == "UNBALANCED" and r["bank"].difference == D("-1000.25")
    assert {t.doc_id: t.statement_type for t in done.types.collect()} == {"bank": "BANK_ACCOUNT", "card": "CREDIT_CARD"}
    payload = {r.doc_id: json.loads(r.json) for r in done.payload().collect()}["bank"]
    assert payload["reconciliation"]["status"] == "UNBALANCED" and len(payload["transactions"]) == 5
    book = zipfile.ZipFile(io.BytesIO(sinks.ledger_workbook(payload, "f.pdf")))
    assert "Source: f.pdf | Page: 1 | Mode: DIGITAL" in book.read("xl/comments1.xml").decode() and "OFFICE SUPPLIES" in book.read("xl/worksheets/sheet1.xml").decode()


def test_exports():
    statement = {"opening_balance": 1000.0, "closing_balance": 1500.0, "reconciled": True, "transactions": [{"date": "2024-01-05", "description": "=x", "amount": 500.0, "type": "credit", "balance": None, "page": 1}]}
    assert json.loads(sinks.export(statement, "json"))["opening_balance"] == 1000.0
    book = zipfile.ZipFile(io.BytesIO(sinks.export(statement, "xlsx")))
    assert all(n in book.read("xl/workbook.xml").decode() for n in ("Transactions", "Reconciliation Summary"))
    assert "'=x" in book.read("xl/worksheets/sheet1.xml").decode()
    with pytest.raises(ValueError):
        sinks.export(statement, "csv")


def test_audit_log(spark, tmp_path):
    log = audit.AuditLog(spark, str(tmp_path / "log"))
    schema = "session_id string, transaction_index int, field_name string, old_value string, new_value string, page int, bbox string, source string, confidence double"
    rows = [("s", 0, "date", "", "2024-01-05", 0, "[]", "manual_snip", 0.9), ("s", 1, "amount", "5", "6", 0, "[]", "auto", 0.9), ("s", 1, "note", "5", "6", 0, "[]", "auto", 0.9)]
    df = spark.createDataFrame(rows, schema)
    assert log.append(df, dry_run=True).count() == 2 and log.read().count() == 0
    log.append(df)
    log.append(df)
    got = log.read().orderBy("id").collect()
    assert [r.id for r in got] == [1, 2, 3, 4] and [r.status for r in got][:2] == ["DIFFERENT", "CONFLICT"]
    assert log.read().columns == ["id", "timestamp", "session_id", "transaction_index", "field_name", "old_value", "new_value", "page", "bbox", "source", "status", "confidence"]
    with pytest.raises(ValueError):
        log.append(df.withColumn("source", F.lit("robot")))
    base = spark.createDataFrame([("s", 0, None, "x", 1.0, "debit"), ("s", 1, "d", "y", 5.0, "debit")], "session_id string, idx int, date string, description string, amount double, type string")
    assert [(r.date, r.amount) for r in audit.apply_corrections(base, log.read()).orderBy("idx").collect()] == [("2024-01-05", 1.0), ("d", 6.0)]


def pdf_bytes(lines):
    body = b"BT /F1 12 Tf " + b" ".join(b"1 0 0 1 50 %d Tm (%s) Tj" % (770 - 20 * k, t.encode()) for k, t in enumerate(lines)) + b" ET"
    return b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n3 0 obj <</Type /Page /MediaBox [0 0 595 842] /Contents 4 0 R>> endobj\n4 0 obj <</Length " + str(len(body)).encode() + b">>\nstream\n" + body + b"\nendstream endobj\n%%EOF"


def test_pdf_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_bytes(["Opening \\(first\\) Balance", "two words"]))
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    spans = pdf.read_spans(spark, str(tmp_path)).orderBy("doc_id", "span").collect()
    assert [s.text for s in spans] == ["Opening (first) Balance", "two words", None] and spans[2].error.startswith("ValueError")
    assert [r.doc_id.rsplit("/", 1)[1] for r in pdf.failed_files(spark, str(tmp_path)).collect()] == ["b.pdf"]
    words = pdf.read_pdf_tokens(spark, str(tmp_path)).orderBy("ord").collect()
    assert [w.text for w in words] == ["Opening", "(first)", "Balance", "two", "words"]
    assert words[0].x0 == 50.0 and abs(words[1].x0 - (50 + 8 * 6)) < 1e-9 and words[0].y1 == 842 - 770


def test_sessions_and_payloads(spark, tmp_path):
    store = tables.Sessions(spark, str(tmp_path / "s"))
    store.put(spark.createDataFrame([("one", 1), ("two", 2)], "session_id string, v int"))
    assert [r.v for r in store.get("two").collect()] == [2] and store.get("three").count() == 0
    assert tables.payload_from_json(spark, str(tmp_path / "none")) is None


class Fake:
    def recognize(self, image):
        return f"w{image.shape[1] // 10}", 0.123456


def test_raster():
    import numpy as np

    page = np.full((400, 600), 255, np.uint8)
    for x, y in ((50, 60), (200, 62), (50, 200)):
        page[y : y + 24, x : x + 60] = 0
    boxes = raster.word_boxes(page)
    assert len(boxes) == 3 and [len(x) for x in raster.group_lines(boxes)] == [2, 1]
    assert raster.merge_boxes([(0, 0, 10, 20), (11, 0, 20, 20), (50, 0, 60, 20)]) == [(0, 0, 20, 20), (50, 0, 60, 20)]
    assert [len(p) for p in raster.chunk_line([(0, 0, 50, 10), (60, 0, 75, 10), (90, 0, 120, 10)])] == [2, 1]
    assert raster.spread_text("aa bb cc", [(0, 0, 10, 5), (20, 0, 30, 5)]) == [("aa bb", (0, 0, 10, 5)), ("cc", (20, 0, 30, 5))]
    assert abs(raster.estimate_skew(raster.rotate(page, 4.0)) + 4.0) <= 1.0
    assert raster.working_dpi(90) == 175.0 and raster.working_dpi(160) == 160 and raster.native_dpi([(0.2, 80.0), (0.9, 600.0)]) == 400.0
    tokens = raster.page_tokens(page, Fake(), 200)
    assert len(tokens) == 3 and tokens[0][5] == 0.1235
    assert raster.mean_confidence([0.5, 0.0, 1.0]) == 0.75 and abs(raster.sequence_confidence([0.25, 1.0]) - 0.5) < 1e-9
    assert raster.check_regions([(0, 700, 500, 850), (0, 100, 500, 300)], 1000, 1000) == [(0, 700, 500, 850)]


def test_editor_views(spark):
    rows = spark.createDataFrame([(1, None, None, 0), (1, -5.0, None, 1), (1, 5.0, "checkpoint", 2)], "doc_id int, amount double, type string, page int")
    assert [(r.amount, r.type, r.page) for r in ui.ui_rows(rows).collect()] == [(0.0, "credit", 1), (-5.0, "debit", 2), (5.0, "credit", 3)]
    box = spark.range(1).select(ui.pixels(F.array(*map(F.lit, (72.0, 0.0, 144.0, 36.0)))).alias("b"), ui.pixels(F.array(F.lit(1.0))).alias("z")).first()
    assert tuple(box.b) == (300.0, 0.0, 300.0, 150.0) and tuple(box.z) == (0.0,) * 4
    crop = spark.range(1).select(ui.crop(F.struct(F.lit(-5.0).alias("x"), F.lit(2.0).alias("y"), F.lit(50.0).alias("w"), F.lit(0.0).alias("h")), F.lit(20), F.lit(20)).alias("c")).first().c
    assert (crop.x0, crop.y0, crop.x1, crop.y1, crop.blank) == (0, 2, 10, 12, True)


def test_row_edits(spark):
    rows = spark.createDataFrame([("a", 0, "credit"), ("a", 1, "debit"), ("a", 2, "debit")], "doc_id string, idx int, type string")
    gone = audit.delete_rows(rows, spark.createDataFrame([("a", 1)], "doc_id string, idx int"))
    assert [(r.idx, r.type) for r in gone.orderBy("idx").collect()] == [(0, "credit"), (1, "debit")]
    assert audit.append_rows(rows, rows.limit(1)).agg(F.max("idx")).first()[0] == 3
    assert [r.type for r in audit.toggle_type(rows, F.col("idx") == 0).orderBy("idx").collect()] == ["debit", "debit", "debit"]


def test_stream(spark, tmp_path):
    from statemill.streaming.ingest import ingest, stream_tokens

    spark.createDataFrame(statements.bank_statement("one"), geometry.TOKEN_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest(stream_tokens(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/transactions")).count() == 5
