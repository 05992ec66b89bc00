"""Base spans against Python's ``re``; contexts on a crafted corpus."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from concordia.llm.personal_data import op5_pii, personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")),
            "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return [(kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if ok(kind, m[0])]


def base(spark, scratch, documents, texts):
    rows = personal_data(documents(texts), scratch).collect()
    kinds = list(PLAIN)
    return {r["doc_id"]: [(kinds[x["k"]], x["start"], x["end"]) for x in r["base"]] for r in rows}


EDGES = [
    None, "", "a@b.c+x@d.e", "a@b.c._x@y.z q", "a@b.c.d..e", "@a.b", "x@y", "é.a@b.cd, 😀 1.2.3.4",
    "1.2.3.4.5.6.7.8", "1.2.3.256 001.02.3.0004 999.1.1.1.1", "4041894974608795", "4041 8949-7460 8795 1",
    "4041  8949", "+1 (456) 555-2186 +1 +22", "+1 456 555 2186 4041894974608795", "x" * 3000 + "@a.b",
    "1 " * 5000, "a.b@" + "c." * 4000 + "d", "a@b.c " * 700 + "\n1.2.3.4 " * 300, "+" * 2000 + "1 234 567 890",
]


def test_base_spans_of_edges(spark, scratch, documents):
    got = base(spark, scratch, documents, EDGES)
    for i, t in enumerate(EDGES):
        assert got[i] == brute(t), (i, (t or "")[:60])


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab1234567890@.+- ()_%é😀\n,", max_size=60), min_size=40, max_size=80))
def test_base_spans_of_any_text(spark, scratch, documents, texts):
    got = base(spark, scratch, documents, texts)
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_query_on_landed_documents(spark, landed, documents):
    import duckdb
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in op5_pii(spark, landed(documents=documents(rows))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        spans = brute(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert set(text.split(",")) <= set(got[i]["spans"].split(",")) or not spans


def test_patterns_find_unseen_identifiers(spark, landed, documents):
    texts = [f"please write to user{i}@mail{i}.example.com for more" for i in range(12)]
    texts += [f"your order code AB{i}77X{i} is ready" for i in range(12)]
    texts += ["please write to admin42@localhost for more", "look at admin42@localhost here", "his code AB99X77 write"]
    got = {r["doc_id"]: r["spans"] for r in op5_pii(spark, landed(documents=documents(texts))).collect()}
    assert got[24] == "email:16:33"
    assert got[12] == got[25] == got[26] == ""


def test_patterns_find_grouped_numbers(spark, landed, documents):
    """Contexts learned from international numbers find local ones, whole."""
    texts = [f"you can call me at +1 212 555 01{i:02} any time" for i in range(12)]
    unseen = ["555 123 4567", "(555) 123-4567", "030 12 34 56", "212-555-0199", "555.123.4567"]
    texts += [f"you can call me at {x} any time" for x in unseen] + ["we sold 555 123 4567 of them", "call me at 12 34 any time"]
    got = {r["doc_id"]: r["spans"] for r in op5_pii(spark, landed(documents=documents(texts))).collect()}
    assert [got[12 + k] for k in range(len(unseen))] == [f"phone:19:{19 + len(x)}" for x in unseen]
    assert got[17] == got[18] == ""


def test_empty_and_repeated_rows(spark, scratch, documents):
    assert personal_data(documents([]), scratch).count() == 0
    rows = personal_data(documents([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd")]), scratch).collect()
    assert len(rows) == 3 and all(len(r["base"]) == 1 for r in rows)
