def rows(df, *cols):
    """Sorted tuples of some columns."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
