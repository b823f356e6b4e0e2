"""Rows of a Spark query against those of its SQL, without regard to order."""

import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if type(v).__name__ == "datetime":
        return v.replace(tzinfo=None).isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr(tuple(plain(r[k]) for k in order)) for r in rows)


def same(df, con, sql):
    got = con.execute(sql)
    want = table([c[0] for c in got.description], got.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want
