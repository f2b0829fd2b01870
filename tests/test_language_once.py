"""Language detection reads the words of a text once."""

from pyspark.sql import functions as F

from tidewell.functions import scalar as S


def test_words_once(spark):
    texts = {"the cat": "en", "el gato de la casa que": "es", "le chat et la de": "fr", "der Hund die das": "de", "o gato a de": "pt", "xthe they": "und", "": "und", "中文字 abc": "zh", "中文 the": "en", "de": "es", "THE, (and)": "en", "x" * 9997 + " the": "und", "x" * 9996 + " the": "en", "x " * 4998 + "the": "en", "че, the": "en", "чет the": "ru"}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", S.detect_language(F.col("t")).alias("lang"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1
    assert {r.t: r.lang for r in df.collect()} == {**texts, None: "und"}
