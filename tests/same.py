"""Order-insensitive comparison of a Spark result with DuckDB's."""

import math


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if v is None or v is not v or str(v) == "NaT" or str(v) == "<NA>":
        return None
    return v.item() if hasattr(v, "item") else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(plain(v) for v in r)) for r in df[cols].astype(object).itertuples(index=False))


def assert_same(spark_df, duck_rel):
    a, b = rows(spark_df.toPandas()), rows(duck_rel.df())
    assert a[0] == b[0]
    assert a[1] == b[1]
