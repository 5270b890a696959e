"""Spark results beside DuckDB results, whatever the order of rows and columns."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def run_sql(sql, sf_dir):
    with duckdb.connect() as db:
        for table in TABLES:
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        result = db.sql(sql)
        return result.columns, [str(t) for t in result.types], result.fetchall()


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(r[i] for i in places) for r in rows]
    return sorted(columns), sorted(picked, key=repr)


def compare(df, sql, sf_dir):
    columns, types, rows = run_sql(sql, sf_dir)
    expected = ordered(columns, rows)
    actual = ordered(df.columns, [tuple(r) for r in df.collect()])
    assert actual[0] == expected[0]
    assert len(actual[1]) == len(expected[1]), (len(actual[1]), len(expected[1]))
    for a, e in zip(actual[1], expected[1]):
        assert a == e, (a, e)
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    kinds = dict(zip(columns, types))
    for name, kind in df.dtypes:
        assert kinds[name] == names[kind], (name, kind, kinds[name])
    return len(actual[1])
