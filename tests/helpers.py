"""Helpers of the tests."""


def rows(df, *columns):
    """Sorted tuples of a frame."""
    d = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in d.collect()), key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))
