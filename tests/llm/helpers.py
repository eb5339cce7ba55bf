import pandas as pd


def rows(df, *order):
    """Rows of a DataFrame as sorted tuples."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: [(x is not None, x) for x in r]) if not order else [tuple(r) for r in df.orderBy(*order).collect()]


def frame(spark, table):
    return table.where(pd.notna(table), None)


ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one two three four"), (6, "one two three four"), (6, "one two three four"),
    (7, "ÀÉ ß 😀 \x00 ▁ x"), (8, "word " * 30_000), (9, "a\nb\na\nb"), (None, "no id"), (10, " lead  and   trail "),
]


def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    data = [(i, t, "en", None if i == 4 else "src", len(t or ""), "x", 1) for i, t in ODD]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id int")


def empty(spark):
    return odd(spark).limit(0)
