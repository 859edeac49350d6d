from peakloom.plans import catalog


def test_sixth_rounds_as_the_sql_does(spark):
    # A half in millionths but for the last bit: the product is a whole half, the decimal digits are below it.
    values = [1.5358654999999999, 0.1, 2.0, 1.2345674, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "error double").select(catalog.sixth("error")).collect()
    assert [r.error for r in rows] == [1.535866, 0.1, 2.0, 1.234567, float("inf")]
