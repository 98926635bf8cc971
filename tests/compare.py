"""Spark rows against DuckDB rows, order aside."""


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5)
    return v if isinstance(v, (bool, int, str)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def same(df, con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if isinstance(x, float) and not isinstance(y, bool) and isinstance(y, (int, float)):
                assert abs(x - y) < 2e-4, (a, b)
            else:
                assert str(x) == str(y), (a, b)
