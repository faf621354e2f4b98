"""Edge rows that every operator on documents must stand."""

LONG = "lorem ipsum dolor " * 20_000
EDGES = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, LONG), (6, "same text here twice over"), (6, "same text here twice over"), (7, "same text here twice over"), (8, "çédille ß 漢字 😀 é"), (None, "no identifier")]
SCHEMA = "doc_id bigint, text string"


def frame(spark, rows=EDGES, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def tables(spark, path, **frames):
    """A folder of tables; those not given are empty where operators need them."""
    for name, df in frames.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
