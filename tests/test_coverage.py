from factloom.operators.coverage import field_coverage


def test_filled_and_empty_fields(spark):
    rows = [(["a", None], [], None), ([], ["x"], None), (None, ["y", "z"], None)]
    df = spark.createDataFrame(rows, "`a-b` array<string>, c array<string>, d array<string>")
    got = {r.field: tuple(r)[1:] for r in field_coverage(df, ["a-b", "c", "d"]).collect()}
    assert got == {"a-b": (1, 2, 2), "c": (2, 1, 3), "d": (0, 3, 0)}
    none = field_coverage(df.limit(0), ["c"]).collect()
    assert [tuple(r) for r in none] == [("c", 0, 0, 0)]
