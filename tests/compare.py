"""Compare a registry query with its SQL on the same files."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings records mutations deliveries index_entries nodes doc_labels mix_targets".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canon(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(canon(r[n]) for n in names) for r in df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(canon(r[i]) for i in order) for r in got.fetchall())
