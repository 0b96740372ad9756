import random

from pyspark.sql import functions as F

from riskloom.functions.numbers import fixed_digits, percent_text, round_even, short_text
from riskloom.functions.text import WHITE_SPACE, strip, word_count


def test_renderings_follow_the_binary_value(spark):
    random.seed(5)
    xs = [2.675, 0.125, 0.375, 1.005, 0.00005, 0.00015, -0.00005, 0.5, 1.5, 2.5, 0.3275, 0.0, 1.0]
    xs += [random.random() for _ in range(300)] + [random.randrange(0, 40001) / 2000 for _ in range(2000)]
    c = F.col("x")
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", round_even(c, 3), round_even(c, 8), fixed_digits(c, 4), percent_text(c, 0), percent_text(c, 1), short_text(c)
    )
    for x, *found in (tuple(r) for r in df.collect()):
        assert found == [round(x, 3) + 0.0, round(x, 8), f"{x:.4f}", f"{x:.0%}", f"{x:.1%}", str(round(x, 4))]


def test_strip_and_words_know_every_space(spark):
    texts = [f"{w}a{w}b{w}" for w in WHITE_SPACE] + ["", "   ", "one", " one  two\n\nthree "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")), word_count(F.col("t")))
    for t, stripped, words in (tuple(r) for r in df.collect()):
        assert stripped == t.strip() and words == len(t.split())
