import hashlib
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub(r"\D", "", text)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in text.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


ODD = [
    None, "", "no data", "a@b.co_m@x.org c@d e@f.g. h@-.-", "x@y.com.z@q.org", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 0000000000255.1.1.1 1.1.1.99999999999999999999",
    "4041894974608795 4041-8949-7460-8795 4041 8949 7460 8795 4041  8949 40418949746087951234567 1 4041894974608795 4041894974608796", "+1 (269) 555-3296 +1-2 +12345678901234567 ++49 30 1234567- +4 9.9.9.9.9.9.9.9 ",
    "é😀 me@x.io é 10.0.0.1", "5500005555555559-", "a" * 60_000 + "@" + "b" * 60_000, "1" * 20_000 + " " + "1." * 2_000, "q@w.e " * 400,
]


def test_base_spans(spark):
    texts = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()] + [(-1 - i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, spans string, base int")
    finder = pii.fit(spark)
    got = {r.doc_id: r.spans_ for r in finder.find(df).collect()}
    added = 0
    for i, text in texts:
        assert [(s.kind, s.start, s.end) for s in got[i] if s.base] == base(text), (i, text and text[:200])
        assert [(pii.KINDS.index(s.kind), s.start) for s in got[i]] == sorted((pii.KINDS.index(s.kind), s.start) for s in got[i])
        added += sum(not s.base for s in got[i] if i >= 0)
    assert added <= 5
    assert finder.find(df.limit(0)).count() == 0


def test_added_spans(spark):
    finder = pii.fit(spark)
    more = [("write to anna (at) mail (dot) org now", "email"), ("call (269) 555-3296 today", "phone"), ("host 10[.]0[.]0[.]7 is up", "ip"), ("we met at noon. Then we left", None), ("order 1234-5678-9012 shipped", None), ("in 1999 2003 2004 2011 and", None)]
    got = finder.find(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(more)], "id long, text string")).orderBy("id").collect()
    assert [r.spans[0].kind if r.spans else None for r in got] == [k for _, k in more]
    held = [(i, b + v + a, k, len(b), y) for i, (k, v, b, a, y) in enumerate(pii.examples(2_000, 77))]
    rows = finder.find(spark.createDataFrame(held, "id long, text string, kind string, at int, label int")).withColumn("hit", F.expr("exists(spans, s -> s.kind = kind AND s.start <= at + 1 AND NOT s.base)")).collect()
    hits = [r for r in rows if r.hit]
    assert sum(r.label for r in hits) / len(hits) > 0.95 and len(hits) > 0.6 * 1000


def test_query(spark):
    rows = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    for r in pii.op7_pii(spark, "/root/testdata/sf0.001").collect():
        expected = base(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in expected).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in expected) for x in pii.KINDS)
