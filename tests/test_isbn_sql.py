"""The SQL of ISBN scans against the scan itself, on texts with numbers of their own."""

import duckdb
from pyspark.sql import functions as F

from shelfspark.catalog_queries import ORACLES
from shelfspark.functions import words as W
from shelfspark.scalar_queries import isbns_sql

TEXTS = [
    "card 9807915762804490 and 0306406152 here", "ISBN 0-306-40615-2, 0306406153; 080442957x", "LCCN: 0306406152 and 0306406152", "lccn.loc.gov/0306406152 978-0-306-40615-7",
    "0306406152é 03064061520 é0306406152", "1 0306406152", "97803064061570 9780306406157 9780306406157", "LCCN 0306406 152 0804429570 080442957X", "", "no number",
]


def test_sql_states_the_rule_of_the_scan(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "n int, t string")
    con = duckdb.connect()
    for checksum in (True, False):
        got = [r.f for r in df.select("n", F.array_join(W.scan_isbns(F.col("t"), checksum), "|").alias("f")).orderBy("n").collect()]
        values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TEXTS))
        want = [f for _, f in sorted(con.sql(f"SELECT n, {isbns_sql('t', checksum)} AS f FROM (VALUES {values}) x(n, t)").fetchall())]
        assert got == want, (checksum, list(zip(got, want, strict=True)))
        assert any(f.count("|") for f in got)


def test_queries_are_compared_with_the_texts():
    assert all("regexp_extract_all" in ORACLES[n] for n in ("isbn_scan", "isbn_scan_all"))
