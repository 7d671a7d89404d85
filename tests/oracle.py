"""Runs registered queries next to their SQL counterparts and compares names, types and values."""

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _key(value):
    return (value is not None, str(type(value)), value if value is not None else 0)


def compare(df, db, sql):
    """None when equal, else a short description of the first difference."""
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    types = [str(c[1]) for c in cursor.description]
    expected = cursor.fetchall()
    columns = sorted(df.columns)
    if columns != sorted(names):
        return f"columns {columns} != {sorted(names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
             "boolean": "BOOLEAN", "date": "DATE"}
    have = {c: kinds.get(t, t) for c, t in df.dtypes}
    want = dict(zip(names, types))
    if have != want:
        return f"types {[(c, have[c], want[c]) for c in columns if have[c] != want[c]]}"
    order = [names.index(c) for c in columns]
    mine = sorted((tuple(r) for r in df.select(columns).collect()), key=lambda r: [_key(v) for v in r])
    theirs = sorted((tuple(r[i] for i in order) for r in expected), key=lambda r: [_key(v) for v in r])
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{columns}: {a} != {b}"
    return None
