from pyspark.sql import functions as F

from molframe.operators import tags


def test_implied_tags(spark):
    assert tags.implied([("M", 4)], "ACGT", [10, 20, 30, 40], "ACTT") == (1, "2T1", 30)
    assert tags.implied([("S", 1), ("M", 2), ("I", 1), ("M", 1), ("D", 2), ("M", 2)], "NACTGAA", [1] * 7, "ACGTTAC") == (4, "3^TT1C0", 1)
    df = spark.createDataFrame([([("M", 3)], "ACG", [5, 6, 7], "AAG"), ([], "ACG", [5, 6, 7], None)], "ops array<struct<op:string,len:int>>, seq string, qual array<int>, ref_slice string")
    assert [(r.nm, r.md, r.uq) for r in tags.alignment_tags(df).collect()] == [(1, "1A1", 6), (None, None, None)]


def test_restore_and_mask(spark):
    df = spark.createDataFrame([("TTAA", "CTGA", 0, "f"), ("TTAA", "CTGA", 0, "r"), ("TTAA", "CTGA", 16, "f"), ("TTAA", "CTGA", 0, None)], "seq string, ref string, flag int, yd string")
    got = [r[0] for r in df.select(tags.restore_unconverted(F.col("seq"), F.col("ref"), F.col("flag"), F.col("yd"))).collect()]
    assert got == ["CTAA", "TTGA", "TTGA", "TTAA"]
    df = spark.createDataFrame([("ACGT", [9] * 4, "ACGT", [0, 3, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 2, 0]), ("ACGT", [9] * 4, "ACGT", [0, 3, 0, 0], [0, 1, 0, 0], [0, 0, 2, 0], [0, 0, 0, 0])], "seq string, qual array<int>, ref string, au array<int>, at array<int>, bu array<int>, bt array<int>")
    got = [(r.seq, r.qual, r.newly) for r in tags.mask_strand_methylation(df).collect()]
    assert got == [("ANNT", [9, 2, 2, 9], 2), ("ACGT", [9] * 4, 0)]
