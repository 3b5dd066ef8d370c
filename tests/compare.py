"""Comparison of a query's rows with those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}" if abs(value) > 1e-9 else "0"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(shown, value)) + "]"
    return str(value)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def same(df, sf_dir, sql):
    names = sorted(df.columns)
    theirs, rows = duck(sf_dir, sql)
    assert sorted(theirs) == names
    at = [theirs.index(n) for n in names]
    ours = sorted(tuple(shown(r[n]) for n in names) for r in df.collect())
    assert ours == sorted(tuple(shown(r[i]) for i in at) for r in rows)
