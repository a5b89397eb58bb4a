import pytest
from pyspark.sql import functions as F

from cuelake.functions import numbers
from cuelake.functions import text as T

# Each line is a rule: the same quantity said in two ways, or nothing that is one.
SAME = [
    ("They shipped 340 crates.", "他们运了340箱。"),
    ("thirty-one steps", "三十一级台阶"),
    ("4,500 metres up", "海拔四千五百米"),
    ("1.75 million tonnes", "一百七十五万吨"),
    ("six hundred and twelve", "612"),
    ("7 thousand", "七千"),
    ("ninety percent", "百分之九十"),
    ("up 3.5 %", "上升百分之三点五"),
    ("it fell to -8 degrees", "降到 -8度"),
    ("rooms 14, 15 and 16", "16、14、15号房间"),
    ("a thousand lamps", "一千盏灯"),
    ("an hour later they left", "后来他们走了"),
    ("Everyone sang along.", "大家一起唱。"),
    ("An entirely ordinary place.", "这里十分平常。"),
    ("eleven hundred and", "1100"),
    ("２ or two?", "２ or 2?"),
    ("", "no number here"),
]
OTHER = [
    ("thirty-one steps", "三十级台阶"),
    ("1.75 million tonnes", "一百七十五吨"),
    ("ninety percent", "90"),
    ("-8 degrees", "8度"),
    ("14 and 14", "14"),
    ("a thousand lamps", "一万盏灯"),
    ("30-million", "30 million"),  # a hyphen after digits joins no scale
]


@pytest.mark.parametrize("differ, pairs", [(False, SAME), (True, OTHER)])
def test_numbers_differ(spark, differ, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", numbers.numbers_differ(numbers.quantities("a"), numbers.quantities("b")).alias("d")).collect()
    assert [r for r in got if r.d != differ] == []


def test_null_text_has_no_quantities(spark):
    assert spark.createDataFrame([(None,)], "a string").select(numbers.quantities("a")).first()[0] == []


def test_samples_of_times(spark):
    rows = spark.createDataFrame([(0, 16000), (1, 16000), (1999, 44100), (-5, 8000)], "ms long, rate int")
    assert [r[0] for r in rows.select(T.ms_to_samples(F.col("ms"), F.col("rate"))).collect()] == [0, 16, 88155, 0]
