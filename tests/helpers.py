"""Order-free comparison of result tables: floats exactly but for the last digits of a sum's order, all else exactly."""


def _cell(x):
    if x is None or x != x if not hasattr(x, "__len__") else False:
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.12g}"
    return str(list(x)) if hasattr(x, "__len__") and not isinstance(x, (str, bytes)) else str(x)


def table(frame):
    """Sorted rows of a pandas frame as text, with columns in order of name."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, row)) for row in frame.astype(object).itertuples(index=False, name=None))


def rows_of(df):
    """A Spark result as pandas, with nullable numbers kept whole: pandas would make floats of them."""
    import pandas as pd

    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def sql_rows(con, sql):
    """The same for a DuckDB query."""
    import pandas as pd

    found = con.execute(sql)
    return pd.DataFrame(found.fetchall(), columns=[c[0] for c in found.description], dtype=object)


def assert_same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
