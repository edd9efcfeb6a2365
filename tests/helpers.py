"""Small streams for tests, and comparison of query results with DuckDB."""

import decimal
import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def stream(spark, data, column="v", stream_id="s"):
    if len(data) and isinstance(data[0], complex):
        return spark.createDataFrame([(stream_id, i, float(x.real), float(x.imag)) for i, x in enumerate(data)], "stream_id string, pos long, re double, im double")
    kind = {"v": "double", "bit": "tinyint", "b": "smallint"}[column]
    return spark.createDataFrame([(stream_id, i, float(x) if kind == "double" else int(x)) for i, x in enumerate(data)], f"stream_id string, pos long, {column} {kind}")


def values(df, *columns, order="pos"):
    rows = df.orderBy(order).collect()
    if columns == ("re", "im"):
        return [complex(r.re, r.im) for r in rows]
    return [r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns) for r in rows]


def close(a, b, tolerance=1e-3):
    return len(a) == len(b) and np.allclose(a, b, atol=tolerance)


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float, decimal.Decimal)):
        return str(v)
    return f"{float(v):.9g}"


def same(df, con, sql):
    """Rows as sorted tuples of Spark and DuckDB, by sorted column names."""
    columns = sorted(df.columns)
    mine = sorted([tuple(map(normal, (r[c] for c in columns))) for r in df.collect()], key=str)
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    theirs = sorted([tuple(normal(r[p]) for p in place) for r in got.fetchall()], key=str)
    return mine, theirs


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con
