from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelane.llm import licenses


def test_variants_of_a_license_match(spark):
    mit = licenses.LICENSES["MIT"]
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;")), (3, "The MIT Licence\n" + mit), (4, None), (5, ""),
        (6, mit.replace(" ", "\n\t ")), (7, "text\nreleased under the MIT licence\nLicensed under CC BY-NC 4.0\nLicensed under CC BY-NC 4.0."), (None, mit), (6, "All rights reserved.\n(c) 2020 me\n© 2019, you"),
        (8, licenses.LICENSES["BSD-2-Clause"].replace("holders", "owners").replace("HOLDERS", "OWNERS")), (9, "word " * 50_000 + "\n" + licenses.NOTICES["Apache-2.0"]),
        (10, "BSD 3-Clause License\n\nCopyright Jane Doe, 2020\n" + licenses.LICENSES["BSD-3-Clause"]), (11, "copyright holders be liable"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license_id", F.lit("x")).withColumn("plain", F.lit(1))
    got = sorted(((r.doc_id, r.license_id, r.notices) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(1, "MIT", ""), (2, "MIT", ""), (3, "MIT", ""), (4, None, ""), (5, None, ""), (6, "MIT", ""), (7, None, "CC-BY-NC-4.0,MIT"), (None, "MIT", ""), (6, None, ""), (8, "BSD-2-Clause", ""), (9, None, "Apache-2.0"), (10, "BSD-3-Clause", ""), (11, None, "")], key=str)
    for r in licenses.scan(df).collect():
        assert r.canonical_sha256 in {licenses.digest(t or "") for _, t in rows}
    assert licenses.scan(df.limit(0)).count() == 0
    none = spark.createDataFrame([], "canonical_sha256 string, license_id string")
    assert {r.license_id for r in licenses.scan(df, none).collect()} == {None}


def test_two_licenses_with_one_digest_and_other_tables(spark):
    texts = [f"own license number {i}" for i in range(300)]
    known = spark.createDataFrame([(licenses.digest(t), name) for i, t in enumerate(texts) for name in (f"L{i:03}", "Z")] + [(None, "x"), (licenses.digest("q"), None)], "canonical_sha256 string, license_id string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, "\n".join(texts)), (901, "q")], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a table too large to send
    try:
        got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(docs, known).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: (f"L{i:03}", f"L{i:03}") for i in range(300)} | {900: (None, ",".join(f"L{i:03}" for i in range(300))), 901: (None, "")}


@pytest.mark.skipif(not Path("/usr/share/common-licenses").exists(), reason="no published texts here")
def test_published_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    texts = {name: Path("/usr/share/common-licenses", f).read_text() for name, f in files.items()}
    rows = [(i, name, change(t)) for name, t in texts.items() for i, change in enumerate((str, str.upper, lambda t: "Copyright (C) 2031 Someone Else\n" + t.replace("license", "licence"), lambda t: t.replace("\n", "\r\n")))]
    docs = spark.createDataFrame([(i, n, t) for i, (_, n, t) in enumerate(rows)], "doc_id long, name string, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan(docs).collect()} == {i: n for i, (_, n, _) in enumerate(rows)}
    assert licenses.scan(docs.withColumn("text", F.expr("substring(text, 100)"))).filter("license_id is not null").count() == 0
