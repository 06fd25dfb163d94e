"""op9 and its SQL on documents in which all weak parts occur, near each other and apart, short and long."""

from __future__ import annotations

import random

import duckdb

from entitylens.llm import secret_scan
from tests.compare import same


def test_linked_parts_equal_the_sql(spark, tmp_path):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    run = lambda n: "".join(rng.choice(letters) for _ in range(n))
    parts = [
        lambda: "AKIA" + run(16).upper(),
        lambda: "ASIA" + run(rng.choice([8, 300])).upper(),
        lambda: run(rng.choice([32, 40, 700])),
        lambda: "https://" + run(rng.choice([8, 500])) + ".example/x",
        lambda: "password = " + run(12),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(30)),
    ]
    texts = [None, "", "é" * 500]
    for _ in range(150):
        some = [rng.choice(parts)() for _ in range(rng.randrange(2, 7))]
        texts.append("".join(x + " " + "w " * rng.choice([0, 3, 100, 198, 199, 200, 201, 400]) for x in some))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = secret_scan.op9(spark, str(tmp_path))
    same(found, con, secret_scan.OP9_SQL)
    linked = found.where("spans like '%part_secret%'").count()
    assert 10 < linked < 140
