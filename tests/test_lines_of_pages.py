from pyspark.sql import functions as F

from siftstone.operators import datasets


def test_lines_keep_their_digits_and_lose_their_blanks(spark):
    # A line's place once was taken for the letters to trim: the second line lost its ones, the first its zeros.
    text = F.lit("0997 and so on\n  148.9.179.169 is one  \n12\n2 of them")
    got = spark.range(1).select(datasets.line_blocks(text, 100).alias("b")).first().b
    assert got == ["0997 and so on 148.9.179.169 is one 2 of them"]
