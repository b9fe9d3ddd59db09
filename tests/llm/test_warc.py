"""Archives: types, round trip of payloads, odd rows."""

import hashlib

from sunloom.llm import warc


def run(spark, rows, folder):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string")
    warc.write(warc.records(pages, f"{folder}/work"), f"{folder}/archives")
    return warc.read(spark, f"{folder}/archives")


def expected(rows):
    groups = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= warc.MIN_BYTES and i is not None:
            groups[html] = min(groups.get(html, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = groups.get(html) if len(data) >= warc.MIN_BYTES else None
        again = first is not None and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_types_and_round_trip(spark, tmp_path, monkeypatch):
    hot = "<p>" + "same page " * 30 + "</p>"
    rows = [(100 + i * 7 % 50, f"http://a/{i}", hot) for i in range(50)]
    rows += [(1, "http://b", "short"), (2, "http://b", "short"), (3, None, None), (4, "http://c\r\nWARC-Type: x", ""), (5, "é", "é" * 50),
             (6, "é", "é" * 50), (7, "q", "é" * 49), (8, "q", "é" * 49), (9, "t", "a\r\n\r\nWARC/1.1\r\n\r\n\r\n" * 20), (None, "n", hot),
             (None, "m", "only without id " * 20), (None, "m", "only without id " * 20), (10, "z", "y" * 200_000), (11, "z", "y" * 200_000),
             (12, "twice", "t" * 300), (12, "twice", "t" * 300)]
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 7)
    for limit in (32 << 20, 0):
        monkeypatch.setattr(warc, "BROADCAST_BYTES", limit)
        found = run(spark, rows, str(tmp_path / str(limit)))
        got = [tuple(r) for r in warc.resolved(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
        assert sorted(got, key=key) == sorted(expected(rows), key=key)
        parsed = found.collect()
        texts = {r.page_id: bytes(r.payload).decode() for r in parsed if r.type == "response" and r.page_id is not None}
        assert all(texts[i] == (h or "") for i, _, h in rows if i in texts)
        assert next(r.target_uri for r in parsed if r.page_id == 4) == "http://c%0D%0AWARC-Type: x"
        assert {r.payload_digest for r in parsed if r.type == "revisit"} <= {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows}
        assert all(bytes(r.payload) == b"" for r in parsed if r.type == "revisit")


def test_empty(spark, tmp_path):
    assert warc.resolved(run(spark, [], str(tmp_path))).count() == 0
