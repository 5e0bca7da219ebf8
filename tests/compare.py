import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


def normal(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    one = lambda v: repr(round(v, 6)) if isinstance(v, float) else v
    return sorted((tuple(one(r[k]) for k in order) for r in rows), key=str)


def same(spark_df, sql: str, sf_dir: str) -> None:
    names, rows = duck(sql, sf_dir)
    assert sorted(spark_df.columns) == sorted(names)
    mine, other = normal(spark_df.columns, spark_df.collect()), normal(names, rows)
    assert len(mine) == len(other)
    assert mine == other
