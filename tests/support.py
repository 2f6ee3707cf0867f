"""Names that tests share."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def one_col(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
