"""Path segments of list entries keep their case."""

from datetime import date

import duckdb

from talkloom.llm import queries, url_filters

from ..oracle import plain, rows_of


def test_op1_capital_segment(spark):
    day = date(2024, 1, 1)
    urls = ["https://x.org/Login", "https://X.org/login", "https://a.x.org/Login/y", "https://x.org/"]
    df = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, fetched date")
    rows = url_filters.filter_captures(df, spark.createDataFrame([("X.org/Login", "block", day)], "key string, action string, since date")).collect()
    assert {r.page_id: r.list_key for r in rows} == {0: "x.org/Login", 1: None, 2: "x.org/Login", 3: None}


def test_op1_capital_segments_equal_sql(spark, tmp_path):
    urls = [(i, f"https://{h}.Example{i % 7}.org/{s}/z") for i, (h, s) in enumerate((h, s) for h in ("a", "B", "c.d") for s in ("Login", "login", "News", "ABC", "Ab", "p") for _ in range(20))]
    spark.createDataFrame(urls, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    df = queries.op1_url_filters(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = c.execute(queries.OP1_SQL)
    names = [d[0] for d in found.description]
    cols, mine = rows_of(df)
    want = sorted(repr(plain(tuple(r[names.index(x)] for x in cols))) for r in found.fetchall())
    assert mine == want
    assert any("/Login" in r for r in want)
