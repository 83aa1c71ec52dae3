"""Three small exports with the dirty cells real ones have, written by rule."""

import csv
from datetime import datetime, timedelta

START = datetime(2025, 1, 1)
NAMES = ["Acme", "Globex", "Initech", "Umbrella", "Hooli"]


def _moment(i):
    return START + timedelta(hours=13 * i, minutes=7 * i)


def transactions(rows=1000):
    header = "id,customer_id,customer_name,amount,currency,status,created_at,plan_name,country".split(",")
    for i in range(rows):
        row = [
            f"tx{i:07d}",
            f"c{i % 500:06d}",
            NAMES[i % 5],
            f"{5 + (i * 37) % 4995}.{i % 100:02d}",
            ["USD", "GBP", "EUR"][i % 3],
            ["succeeded", "failed", "succeeded", "refunded", "succeeded"][i % 5],
            _moment(i).strftime("%Y-%m-%dT%H:%M:%SZ"),
            "" if i % 7 == 1 else ["starter", "pro", "enterprise"][i % 3],
            ["US", "GB", "DE", "FR", "CA", "AU"][i % 6],
        ]
        if i == 3:
            row[3] = "N/A"
        if i == 7:
            row[3] = "$1,234.56"
        if i == 11:
            row[1] = "0001234"
        if i == 19:
            row[2] = 'North, "Nine" Ltd\nfirst floor'
        yield header, row


# Columns and places of the awkward cells are those of FIXTURES.md.
def customers(rows=1000):
    header = "id,name,email,plan,status,created_at,canceled_at,mrr,country".split(",")
    for i in range(rows):
        row = [
            f"c{i:06d}",
            NAMES[i % 5],
            f"user{i}@example.com",
            ["starter", "pro", "enterprise"][i % 3],
            ["active", "churned", "paused"][i % 3],
            _moment(i).strftime("%Y-%m-%d %H:%M:%S"),
            _moment(i + 5).strftime("%Y-%m-%d %H:%M:%S") if i % 3 == 1 else "",
            f"{(i * 13) % 2000}.00",
            "US",
        ]
        if i == 4:
            row[7] = "N/A"
        if i == 8:
            row[7] = "$1,234.56"
        if i == 20:
            row[5] = "2026-03-08 02:30:00"
        if i == 24:
            row[6] = "2026-11-01 01:30:00"
        if i == 28:
            row[1] = 'Twin, "Elm" GmbH\nrear'
        yield header, row


def events(rows=1000):
    header = "event_id,user_id,event_type,timestamp,session_id,metadata_json".split(",")
    for i in range(rows):
        form = "%Y-%m-%dT%H:%M:%SZ" if i % 2 else "%Y-%m-%d %H:%M:%S"
        row = [
            f"e{i:08d}",
            f"u{i % 200:06d}",
            ["page_view", "signup", "login"][i % 3],
            _moment(i).strftime(form),
            "" if i % 7 == 5 else f"s{i}",
            "" if i % 5 < 2 else f'{{"page": {i}}}',
        ]
        if i == 13:
            row[3] = "2026-03-08 02:30:00"
        if i == 17:
            row[3] = "2026-11-01 01:30:00"
        if i == 21:
            row[5] = '{"note": "a, b",\n"q": "x"}'
        yield header, row


def write_csv(path, rows):
    with open(path, "w", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        for i, (header, row) in enumerate(rows):
            if i == 0:
                writer.writerow(header)
            writer.writerow(row)
    return str(path)
