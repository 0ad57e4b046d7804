from furrow.functions import text


def values(spark, fn, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, c string")
    return [r[1] for r in df.select("i", fn("c").alias("v")).orderBy("i").collect()]


def test_title_case_at_every_word(spark):
    got = values(spark, text.title_words, "income/expenditure", "natural-resource protection", "farmer's MARKET", "", None, "état d'été")
    assert got == ["Income/Expenditure", "Natural-Resource Protection", "Farmer's Market", "", None, "État D'été"]


def test_first_match_only(spark):
    got = values(spark, lambda c: text.replace_first(c, "a,", "a"), "a, a,", "x\na, y", None)
    assert got == ["a a,", "x\na y", None]


def test_cut_and_strip(spark):
    assert values(spark, lambda c: text.before(c, "#"), "ab#c#d", "ab", "#x") == ["ab", "ab", ""]
    assert values(spark, lambda c: text.strip_literal(c, "Abstract: "), "Abstract: a Abstract: b") == ["a b"]
    assert values(spark, text.trim_all, "\t a b \n") == ["a b"]
    assert values(spark, lambda c: text.remove_all(c, "Primary|Data"), "Primary Data x Primary") == ["  x "]
    assert values(spark, text.leading_words, "crop livestock_1", "1a") == ["crop livestock", ""]


def test_split_keeps_empty(spark):
    assert values(spark, text.split_values, "a,,b,", "", None) == [["a", "", "b", ""], [""], None]
    assert values(spark, lambda c: text.split_values(c, "|"), "a|b") == [["a", "b"]]


def test_wrap(spark):
    got = values(spark, lambda c: text.wrap(c, 16), "Natural Resource Protection", "abcdefghijklmnopqrstu v", "a", "")
    assert got == ["Natural Resource\nProtection", "abcdefghijklmnopqrstu\nv", "a", ""]


def test_to_int(spark):
    got = values(spark, text.to_int, "12", "3.7", "-3.7", "abc", "", None, "1e3", "3d", "99999999999")
    assert got == [12, 3, -3, None, None, None, 1000, None, None]


def test_paste(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(text.paste("x", "y")).first()[0] == "a NA"
    assert df.select(text.paste("x", "y", na="null")).first()[0] is None


def test_tokens_and_length(spark):
    assert values(spark, text.tokens, "L'été à Foo_1 x 42") == [["été", "foo_1", "42"]]
    assert values(spark, lambda c: text.min_length(c, 2), "abc", "ab", None, "😀😀😀") == [True, False, False, True]
    assert values(spark, lambda c: text.matches_ci(c, "yield|prod"), "Crop YIELD", "x") == [True, False]
