"""Comparison of a Spark result with a DuckDB one, without regard to the order of rows."""

import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


def bag(rows):
    return sorted(tuple(map(plain, r)) for r in rows)


def compare(df, duck, sql):
    cols = sorted(df.columns)
    got = duck.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert sorted(c[0] for c in duck.execute(f"DESCRIBE SELECT * FROM ({sql})").fetchall()) == cols
    assert bag(df.select(*cols).collect()) == bag(got)
