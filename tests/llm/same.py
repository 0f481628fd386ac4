"""A query's rows against its SQL in DuckDB, on a table or on rows given here."""

import duckdb


def by_sql(sql: str, name: str, path: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def by_spark(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
