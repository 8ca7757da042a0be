"""Compares a registered query with its SQL, as unordered rows of sorted columns."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


def same(spark, query, sql, folder="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = query(spark, folder).toArrow().to_pandas(), con.sql(sql).to_arrow_table().to_pandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
