from pyspark.sql import functions as F

from textloom.functions import paths, text
from textloom.operators import marks


def one(spark, value, column):
    got = spark.createDataFrame([(value,)], "x string").select(column.alias("r")).first().r
    return tuple(got) if isinstance(got, tuple) else got


def test_paths_and_back(spark):
    x = F.col("x")
    for value, want in (("Readable\\\\EN\\a/b.txt", ("EN", "a/b.txt")), ("/EN/b", ("EN", "b")), ("Readable/x", None), ("EN/", None), ("", None), (None, None), ("Readable/EN//b/", ("EN", "b"))):
        assert one(spark, value and value.replace("\\\\", "/"), paths.under(x, "Readable")) == want, value
    for value, want in (("Subtitle/EN/a/b.SRT", ("EN", "a/b")), ("EN/c.srt/", ("EN", "c")), ("Subtitle/c.srt", None), ("EN/.srt", None), ("EN/c.txt", None)):
        assert one(spark, value, paths.subtitle_file(x)) == want, value
    assert one(spark, "a/b.SRT", paths.built("Subtitle", F.lit("EN"), x, ".srt")) == "Subtitle/EN/a/b.srt" and one(spark, "", paths.built("Subtitle", F.lit("EN"), x)) is None
    for value, want in (("a_b|2|1.0|2.0", ("a_b", 2)), ("a_b_2_1.0_2.0", ("a_b", 2)), ("a|2|1", None), ("a_2_1", None), ("|2|1|1", None), ("a|x|1|1", None), ("", None)):
        assert one(spark, value, paths.key_parts(x)) == want, value
    for value, want in (("b/weapon12_EN.txt", (9, 12, None)), ("Relic3_4", (10, 3, 4)), ("Relic3", (10, 3, None)), ("Costume", None), ("MyWeapon1", None)):
        assert one(spark, value, paths.thing(x)) == want, value
    assert one(spark, "d/Book1_EN.txt", paths.name_variants(x)) == ["Book1_EN.txt", "Book1_EN", "Book1.txt", "Book1"] and one(spark, "", paths.name_variants(x)) == []


def test_names_and_keys(spark):
    x = F.col("x")
    assert one(spark, " \u00c9va\u3000", text.speaker(x)) == "\u00e9va" and one(spark, "\u6d3e \u8499", text.speaker(x, True)) == "\u6d3e\u8499"
    tiers = [one(spark, v, text.spoken_tier(x, "\u00c9va")) for v in ("\u00e9va", "\u00c9valin", "old \u00e9va", "bob", "", None)]
    assert tiers == [0, 1, 2, 3, 3, 3] and one(spark, "a", text.spoken_tier(x, " ")) == 0
    assert one(spark, "\uff26\uff4f\uff4f \u2460!", text.item_name(x)) == "foo1" and one(spark, None, text.item_name(x)) == ""
    keys = {v: one(spark, v, text.typed_key(x)) for v in ('"1"', "1", "true", "null", '{"b":1,"a":[2]}', '{"a":[2],"b":1}', "1.5", '"a\\r\\nb"', "{", None)}
    assert keys['"1"'] == ("str", "1") and keys["1"] == ("int", "1") and keys["true"] == ("bool", "true") and keys["null"][0] == "none" and keys["1.5"] == ("float", "1.5")
    assert keys['{"b":1,"a":[2]}'] == keys['{"a":[2],"b":1}'] and keys["{"] is None and keys[None] is None and keys['"a\\r\\nb"'] == ("str", "a\nb")
    got = one(spark, "gcg:skill:1:2", text.synthetic_id(x))
    assert -2_000_000_000 <= got < 0 and got == one(spark, "gcg:skill:1:2", text.synthetic_id(x)) != one(spark, "gcg:skill:1:3", text.synthetic_id(x)) and one(spark, None, text.synthetic_id(x)) is None


def test_marks(spark):
    make = spark.createDataFrame
    dim = make([(1, 30), (2, 10), (3, None)], "id long, version_sort_key int")
    rows = make([(1, 2, 1), (2, 1, 2), (3, None, 1), (4, 1, None), (5, 3, 1), (6, 1, 3)], "k long, floor long, created long")
    assert {r.k: r.created for r in marks.floored(rows, "floor", "created", dim).collect()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    snaps = make([(i, f"v{i}") for i in range(5)], "nth long, tag string")
    at = lambda *a: sorted((r.nth, r.role) for r in marks.replay_range(snaps, *a).collect())
    assert at("v3", "v1") == [(1, "base"), (2, "replay"), (3, "replay")] and at("v1") == [(0, "replay"), (1, "replay")] and at("none") == [] and at("v1", "v3") == [(3, "base")]
    assert marks.reset(rows, ("created",)).where("created is not null").count() == 0


def test_runs_of_characters(spark):
    x = F.col("x")
    for value in ("abcd", "a\U0001f600b\U0001f601\U0001f602c", "a\nb c", "ab", "\u4e2d\u6587\u5b57"):
        assert one(spark, value, text.every_run(x, 2)) == [value[i : i + 2] for i in range(len(value) - 1)]
    assert one(spark, "a", text.every_run(x, 2)) == [] and one(spark, "", text.every_run(x, 2)) == []
