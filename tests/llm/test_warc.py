import hashlib

import pytest
from pyspark.sql import functions as F

from tidelane.llm import warc
from tidelane.llm.common import Stage


def brute(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        own = first.get(h or "")
        again = len(raw) >= 100 and p != own
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", own if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "", None), (6, "http://ü/ x\n", "<p>é</p>\r\n\r\n" * 20), (9, "z", "<p>é</p>\r\n\r\n" * 20), (None, "n", "only null" * 30), (None, "n", "x" * 100), (7, "big", "y" * 3_000_000)]


def test_edge_cases(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("n", F.lit(1))
    archive = warc.write(df, Stage(spark))
    got = sorted((tuple(r)[:5] for r in warc.read(archive).collect()), key=str)
    assert got == brute(ROWS)
    assert archive.payloads.count() == len({h or "" for _, _, h in ROWS})
    assert warc.read(warc.write(df.limit(0), Stage(spark))).count() == 0


def test_hot_payload_and_saved_archive(spark, tmp_path):
    rows = [(i, f"u{i}", "hot" * 50 if i % 2 else f"own {i} " * 20) for i in range(5000)]
    warc.save(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), Stage(spark)), str(tmp_path / "archive"))
    archive = warc.open_archive(spark, str(tmp_path / "archive"))
    assert archive.payloads.count() == 2501
    assert sorted((tuple(r)[:5] for r in warc.read(archive).collect()), key=str) == brute(rows)
    fields, payload = warc.parse(bytes(warc.rebuild(archive).filter("page_id = 0").first().record))
    assert payload == b"own 0 " * 20 and fields["warc-target-uri"] == "u0" and fields["warc-date"] == warc.DATE


def test_ids_are_spelt_out_in_the_records(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), 123456789, None]
    found = spark.createDataFrame([(i,) for i in ids], "page_id long").select(warc._record_id(F.col("page_id")).alias("r")).collect()
    assert [warc.page_of(r.r) for r in found] == ids and len({r.r for r in found}) == len(ids)
    with pytest.raises(warc.CorruptRecord):
        warc.page_of("<urn:uuid:00000000-0000-4000-8000-000000000000>")


def test_damage_is_found(spark):
    record = bytes(warc.rebuild(warc.write(spark.createDataFrame(ROWS[:1], "page_id long, url string, html string"), Stage(spark))).first().record)
    warc.parse(record)
    for bad in (record[:-1], record.replace(b"xxx", b"xyx", 1), record[3:]):
        with pytest.raises(warc.CorruptRecord):
            warc.parse(bad)
