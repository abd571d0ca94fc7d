"""Runs a registered query and its SQL twin over the same tables and compares the rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def sql_tables(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    columns = sorted(names)
    places = [names.index(c) for c in columns]
    return columns, sorted((tuple(_plain(r[i]) for i in places) for r in cursor.fetchall()), key=repr)


def difference(spark_rows, sql_rows):
    """None when equal, else a short text."""
    (left_columns, left), (right_columns, right) = spark_rows, sql_rows
    if left_columns != right_columns:
        return f"columns {left_columns} / {right_columns}"
    if len(left) != len(right):
        return f"{len(left)} / {len(right)} rows"
    for mine, other in zip(left, right):
        if mine != other or [type(x) for x in mine] != [type(x) for x in other]:
            return f"{left_columns}\n  {mine}\n  {other}"
    return None
