"""Sinks: JSON, spreadsheets and the console.

A workbook holds one statement, so it is written from that statement's rows; the JSON sinks are distributed writes.
"""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Sheet names, headers and metrics of the two workbooks.
TRANSACTION_HEADERS = ("#", "Date", "Description", "Debit", "Credit", "Balance", "Page")
METRICS = ("File Name", "Statement Type", "Opening Balance", "Total Credits", "Total Debits", "Calculated Closing", "Reported Closing", "Difference", "Reconciled", "Transactions")
BANK_HEADERS = ("Date", "Description", "Check Number", "Withdrawals/Debits", "Deposits/Credits", "Balance")
CARD_HEADERS = ("Trans Date", "Post Date", "Description", "Category/Reference", "Amount (Charge/Credit)", "Running Balance")


def write_json(payloads: DataFrame, path: str) -> None:
    """One JSON document a line, from (doc_id, json)."""
    payloads.select("json").write.mode("overwrite").text(path)


def json_bytes(payload: dict) -> bytes:
    return json.dumps(payload, indent=2, ensure_ascii=False, default=str).encode()


def safe(value):
    """Text that a spreadsheet cannot take for a formula."""
    return "'" + value if isinstance(value, str) and value[:1] in ("=", "+", "-", "@") else value


def _column(n: int) -> str:
    return chr(65 + n) if n < 26 else chr(64 + n // 26) + chr(65 + n % 26)


def _sheet(rows: list, commented: bool) -> str:
    out = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(row):
            ref = f"{_column(c)}{r}"
            if value is None:
                continue
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                cells.append(f'<c r="{ref}" t="inlineStr" s="{1 if r == 1 else 0}"><is><t xml:space="preserve">{escape(str(safe(value)))}</t></is></c>')
            else:
                cells.append(f'<c r="{ref}" s="{2 if isinstance(value, float) else 0}"><v>{value!r}</v></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    tail = '<legacyDrawing r:id="rId1"/>' if commented else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheetData>{"".join(out)}</sheetData>{tail}</worksheet>'


def _notes(notes: dict[tuple[int, int], str]) -> tuple[str, str]:
    """The comments of a sheet and the shapes that show them."""
    listed = "".join(f'<comment ref="{_column(c)}{r}" authorId="0"><text><r><t>{escape(t)}</t></r></text></comment>' for (r, c), t in sorted(notes.items()))
    shapes = "".join(f'<v:shape id="n{k}" type="#_x0000_t202" style="position:absolute;width:200pt;height:40pt;visibility:hidden"><x:ClientData ObjectType="Note"><x:Row>{r - 1}</x:Row><x:Column>{c}</x:Column></x:ClientData></v:shape>' for k, (r, c) in enumerate(sorted(notes)))
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><comments xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><authors><author>statemill</author></authors><commentList>{listed}</commentList></comments>',
        f'<xml xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:x="urn:schemas-microsoft-com:office:excel"><v:shapetype id="_x0000_t202" coordsize="21600,21600" path="m,l,21600r21600,l21600,xe"/>{shapes}</xml>',
    )


def workbook(sheets: list[tuple[str, list]], notes: dict[int, dict[tuple[int, int], str]] | None = None) -> bytes:
    """An xlsx file of named sheets (rows of values; the first row is the header); notes: sheet place -> {(row, column): text}."""
    notes = {k: n for k, n in (notes or {}).items() if n}
    kind, rel = "application/vnd.openxmlformats-officedocument.spreadsheetml.", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}worksheet+xml"/>' for k in range(1, len(sheets) + 1))
    types += "".join(f'<Override PartName="/xl/comments{k + 1}.xml" ContentType="{kind}comments+xml"/>' for k in notes)
    names = "".join(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, (name, _) in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="vml" ContentType="application/vnd.openxmlformats-officedocument.vmlDrawing"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}styles+xml"/>{types}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}<Relationship Id="rIdS" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="4" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    for k, (_, rows) in enumerate(sheets):
        parts[f"xl/worksheets/sheet{k + 1}.xml"] = _sheet(rows, k in notes)
        if k in notes:
            parts[f"xl/comments{k + 1}.xml"], parts[f"xl/drawings/notes{k + 1}.vml"] = _notes(notes[k])
            parts[f"xl/worksheets/_rels/sheet{k + 1}.xml.rels"] = f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/vmlDrawing" Target="../drawings/notes{k + 1}.vml"/><Relationship Id="rId2" Type="{rel}/comments" Target="../comments{k + 1}.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def editor_workbook(statement: dict) -> bytes:
    """Sheets "Transactions" and "Reconciliation Summary" of one edited statement."""
    rows = [TRANSACTION_HEADERS]
    for k, t in enumerate(statement["transactions"], 1):
        amount = abs(float(t["amount"]))
        debit = t.get("type") == "debit"
        rows.append((k, t.get("date"), t.get("description"), amount if debit else None, None if debit else amount, None if t.get("balance") is None else float(t["balance"]), t.get("page")))
    credits = sum(abs(float(t["amount"])) for t in statement["transactions"] if t.get("type") == "credit")
    debits = sum(abs(float(t["amount"])) for t in statement["transactions"] if t.get("type") != "credit")
    opening, closing = float(statement.get("opening_balance") or 0), float(statement.get("closing_balance") or 0)
    reached = round(opening + credits - debits, 2)
    values = (statement.get("file_name", ""), statement.get("statement_type", ""), opening, round(credits, 2), round(debits, 2), reached, closing, round(reached - closing, 2), "Yes" if abs(reached - closing) <= 0.01 else "No", len(statement["transactions"]))
    return workbook([("Transactions", rows), ("Reconciliation Summary", [("Metric", "Value"), *zip(METRICS, values, strict=True)])])


def audit_note(provenance: dict | None, file_name: str) -> str | None:
    if not provenance:
        return None
    page = provenance.get("page")
    box = ", ".join(f"{float(v):.0f}" for v in provenance.get("bbox") or (0, 0, 0, 0))
    return f"Source: {file_name} | Page: {page + 1 if isinstance(page, int) else 0} | Mode: {provenance.get('mode') or 'UNKNOWN'} | BBox: [{box}]"


def ledger_workbook(payload: dict, file_name: str) -> bytes:
    """Sheets "Transaction Ledger" (bank or card columns, a note on each cell that was read) and "Summary & Reconciliation"."""
    card = payload.get("statement_type") == "CREDIT_CARD"
    fields = ("date", "post_date", "description", "categories", "amount", "balance") if card else ("date", "description", "check_number", "debit", "credit", "balance")
    rows, notes = [CARD_HEADERS if card else BANK_HEADERS], {}
    for r, t in enumerate(payload.get("transactions") or [], 2):
        amount, source = t.get("amount"), t.get("provenance") or {}
        value = {"debit": -amount if amount is not None and amount < 0 else None, "credit": amount if amount is not None and amount > 0 else None, "categories": (source.get("categories") or {}).get("text")}
        rows.append(tuple(value.get(f, t.get(f)) for f in fields))
        for c, f in enumerate(fields):
            if note := audit_note(source.get(f) or (source.get("amount") if f in ("debit", "credit") and value[f] is not None else None), file_name):
                notes[r, c] = note
    recon = payload.get("reconciliation") or {}
    facts = [("Statement Type", payload.get("statement_type")), ("Account Number", payload.get("account_number")), ("Statement Period", payload.get("statement_period")), ("Opening Balance", payload.get("opening_balance")), ("Closing Balance", payload.get("closing_balance")), ("Status", recon.get("status")), ("Difference", recon.get("difference")), *(recon.get("components") or {}).items()]
    return workbook([("Transaction Ledger", rows), ("Summary & Reconciliation", [("Metric", "Value"), *facts])], {0: notes})


def export(payload: dict, fmt: str, file_name: str = "statement") -> bytes:
    """``json`` or ``xlsx``; anything else is an error."""
    if fmt == "json":
        return json_bytes(payload)
    if fmt == "xlsx":
        return editor_workbook(payload)
    raise ValueError(f"unknown format {fmt!r}")


def console_summary(payload: dict) -> str:
    recon = payload.get("reconciliation") or {}
    lines = [f"Statement type : {payload.get('statement_type')}", f"Opening balance: {payload.get('opening_balance')}", f"Closing balance: {payload.get('closing_balance')}", f"Transactions   : {len(payload.get('transactions') or [])}", f"Status         : {recon.get('status')}"]
    return "\n".join(lines)
