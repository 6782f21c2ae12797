"""Language ID where the sample's share would leave a language out."""

from pyspark.sql import functions as F

from quern.llm import language_id


def test_a_language_of_a_few_long_texts_is_learned(spark):
    en, de = "the house and the garden with a long path ", "das haus und der garten mit einem langen weg "
    rows = [(i, en, "en") for i in range(200)] + [(1000 + i, de * 400, "de") for i in range(3)] + [(2000 + i, "12 34 " * 500, "xx") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    share = 500 / (3 * 400 * len(de))
    assert not df.filter("lang = 'de'").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).count()  # none by the share alone
    say = language_id.fit(df, sample_chars=500)
    got = {(r["lang"], r["said"]["lang_pred"]) for r in df.select("lang", say("text").alias("said")).collect()}
    assert got == {("en", "en"), ("de", "de"), ("xx", "und")}
