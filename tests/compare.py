"""Rows of a query against those of its SQL, order aside."""

import math


def canonical(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


def same(df, con, sql):
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = canonical([[r[names.index(c)] for c in columns] for r in cursor.fetchall()])
    got = canonical([[r[c] for c in columns] for r in df.collect()])
    assert got == want
