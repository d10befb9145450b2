"""Token fixtures: statements written as lines of (x, word) on baselines."""

X = {"date": 50.0, "description": 130.0, "amount": 330.0, "balance": 430.0}


def line(page, y, cells, height=10.0):
    """Words of each cell side by side, five points a character."""
    out = []
    for column, text in cells:
        x = X[column]
        for word in text.split():
            out.append((page, word, x, float(y), x + 5.0 * len(word), y + height))
            x += 5.0 * len(word) + 5.0
    return out


def tokens(doc_id, lines, mode="DIGITAL"):
    return [(doc_id, p, i, w, x0, y0, x1, y1, mode, 1.0, 12.0) for i, (p, w, x0, y0, x1, y1) in enumerate(sum(lines, []))]


def bank_statement(doc_id="bank"):
    rows = [("2024-01-05", "DEPOSIT CLIENT PAYMENT", "2500.00", "7500.00"), ("2024-01-12", "OFFICE SUPPLIES STORE", "-150.00", "7350.00"), ("2024-01-20", "UTILITIES ELECTRICITY", "-350.00", "7000.00"), ("2024-01-28", "CONSULTING REVENUE", "1000.00", "8000.00")]
    lines = [line(0, 40, [("date", "Acme Bank statement")]), line(0, 70, [("date", "Account Number: 12-3456-789")]), line(0, 90, [("date", "Opening Balance"), ("amount", "$5,000.00")])]
    lines.append(line(0, 120, [("date", "Date"), ("description", "Description"), ("amount", "Amount"), ("balance", "Balance")]))
    y = 140
    for k, (d, text, a, b) in enumerate(rows):
        lines.append(line(0, y, [("date", d), ("description", text), ("amount", a), ("balance", b)]))
        if k == 1:
            lines.append(line(0, y + 12, [("description", "INVOICE 77 PAPER")]))
        y += 40
    lines.append(line(0, y + 40, [("date", "Closing Balance"), ("amount", "$8,000.00")]))
    lines.append(line(1, 60, [("date", "2024-02-02"), ("description", "RENT"), ("amount", "(1,000.25)"), ("balance", "6,999.75")]))
    return tokens(doc_id, lines)


def card_statement(doc_id="card"):
    lines = [line(0, 20, [("date", "Your credit card")]), line(0, 40, [("date", "Date"), ("description", "Description"), ("amount", "Amount")])]
    lines += [line(0, 60, [("date", "Payments & credits")]), line(0, 80, [("date", "Payments")]), line(0, 100, [("date", "JUN 24 JUN 25"), ("description", "P AYPAL"), ("amount", "120.00")])]
    lines += [line(0, 140, [("date", "Your new purchases")]), line(0, 160, [("date", "JUN 26"), ("description", "BOOKS AND MORE"), ("amount", "45.50")]), line(0, 200, [("date", "Total"), ("amount", "165.50")])]
    return tokens(doc_id, lines)
