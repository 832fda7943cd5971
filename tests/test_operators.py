import os
import random
import time
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from textloom.functions import text, versions
from textloom.operators import groups, history, lineage, merge, search
from textloom.sources import readers
from textloom.streaming import changes


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*columns).first())


def test_keywords():
    assert text.keyword(" “the” ") == "the" and text.keyword("「a 'b'」") == "a 'b'" and text.keyword('"x') == "x" and text.keyword('""') == '""'
    assert text.keyword(None) == "" and text.keyword("don't") == "don't"


def test_tiers_and_escapes(spark):
    x = F.col("x")
    for value, want in (("ab", 0), ("Abc", 1), ("xab", 2), ("xyz", 3), (None, 3)):
        assert one(spark, value, text.tier(x, "AB")) == (want,)
    assert one(spark, "50%", x.like(f"%{text.escaped('50%')}%")) == (True,) and one(spark, "5012", x.like(f"%{text.escaped('50%')}%")) == (False,)
    assert one(spark, "É", text.like_any(x, "é")) == (False,) and one(spark, "a(b", text.like_any(x, "(b")) == (True,)
    assert one(spark, "t.h[x", text.like_any(x, "th[x", True), text.like_any(x, "xht", True)) == (True, False)


def test_texts(spark):
    x = F.col("x")
    assert one(spark, "a​b\x01c�中E文", text.sanitized(x)) == ("abc中,文",)
    assert one(spark, "dir/Book_CHS.txt", text.base_name(x)) == ("Book.txt",)
    assert one(spark, "  a\\n b ", text.preview(x)) == ("a b",) and one(spark, " ", text.preview(x)) == (None,)
    assert one(spark, "w" * 40 + " Key " + "v" * 40, text.snippet(x, "key")) == ("..." + "w" * 27 + " Key " + "v" * 27 + "...",)
    assert one(spark, "u" * 80, text.snippet(x, "key")) == ("u" * 69 + "...",)
    assert one(spark, "#{F#she}{M#he} is", text.twin_text(x, True), text.twin_text(x, False), text.twin_text(x, None)) == ("he is", "she is", "{he/she} is")
    assert [one(spark, v, text.is_generic(x))[0] for v in ("嗯…", "好的。", "好的", "plain", "", None)] == [True, True, False, False, False, False]


def test_versions(spark):
    x = F.col("x")
    tag = versions.tag(x)
    assert one(spark, "OSRELWin3.2.0 4.1", tag, versions.sort_key(tag)) == ("4.1", 4001) and one(spark, "none", tag, versions.sort_key(tag)) == (None, None)
    dim = spark.createDataFrame([(1, "3.0"), (2, "3.1")], "id long, version_tag string").withColumn("raw_version", F.col("version_tag"))
    rows = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 2)], "hash long, created_version_id long, updated_version_id long")
    assert [r.hash for r in search.by_version(rows, dim, updated="3.1").collect()] == [2]
    assert search.clamp(9, 41, 10) == 5 and search.clamp(0, 0, 10) == 1


def test_lineage_duplicates_and_generic_texts(spark):
    make = lambda rows: spark.createDataFrame(rows, "hash long, content string")
    got = lineage.same_content(make([(3, "t"), (4, "t"), (5, "嗯…"), (6, "same")]), make([(1, "t"), (2, "t"), (9, "嗯…"), (6, "same")]))
    assert sorted(map(tuple, got.collect())) == [(3, 1, "moved"), (4, 2, "moved"), (6, 6, "same_hash")]
    got = lineage.changed(make([(1, "new")]), make([(1, "old")]), lineage.same_content(make([(1, "new")]), make([(1, "old")])))
    assert [tuple(r) for r in got.collect()] == [(1, 1, "changed")]


def test_similar_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 40))) for _ in range(25)]
    old = [(i, t) for i, t in enumerate(base)]
    cur = []
    for i, t in enumerate(base[:15]):
        at = rng.randrange(4, len(t) - 4)
        cur.append((100 + i, t[:at] + rng.choice("xyz") + t[at + 1 :]))
    cur += [(200, base[0][:-1] + "q"), (201, base[0][:-1] + "r")]
    # Shifted at the front and edited at the end: no anchor is shared, so texts of like length meet it.
    cur += [(300 + i, "zz" + t[: len(t) // 2] + "yy" + t[len(t) // 2 : -2] + "xx") for i, t in enumerate(base[15:20])]
    # Much longer than before: found by the runs that both have.
    cur += [(400 + i, "XX " + t + " over it all and") for i, t in enumerate(base[20:])]
    ratio = {(a, b): round(SequenceMatcher(None, x, y, autojunk=False).ratio(), 6) for a, x in cur for b, y in old}
    near = {(a, b) for a, x in cur for b, y in old if abs(len(x) - len(y)) <= max(2, min(64, len(x) // 8))}
    runs = lambda t: {("p", t[:4]), ("s", t[-4:]), ("m", t[(len(t) - 4) // 2 :][:4])}
    keyed = {(a, b) for a, x in cur for b, y in old if (a, b) in near and runs(x) & runs(y)}
    alone = {a for a, _ in cur} - {a for a, _ in keyed}
    assert len(alone) >= 4
    runs_of = lambda t: Counter(t[i : i + 8] for i in range(max(1, len(t) - 7)))
    shared = {(a, b) for a, x in cur for b, y in old if 100 * (runs_of(x) & runs_of(y)).total() >= 25 * max(runs_of(x).total(), runs_of(y).total())}
    assert shared - near
    pairs = {p: ratio[p] for p in keyed | shared | {p for p in near if p[0] in alone} if ratio[p] >= 0.6}
    want = set()
    for a, _ in cur:
        mine = sorted((-s, b) for (x, b), s in pairs.items() if x == a)
        if mine and (len(mine) == 1 or mine[1][0] - mine[0][0] >= 0.08) and min((-s, x) for (x, b), s in pairs.items() if b == mine[0][1])[1] == a:
            want.add((a, mine[0][1]))
    got = {(r.hash, r.previous_hash) for r in lineage.similar(spark.createDataFrame(cur, "hash long, content string"), spark.createDataFrame(old, "hash long, content string")).collect()}
    assert got == want and len(got) >= 15 and any(300 <= a < 400 for a, _ in got) and any(a >= 400 for a, _ in got)


def test_presence(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, lineage.presence(rows, "k", "v").collect())) == [("a", 4, 1), ("b", 3, 3)]


def test_merges_with_nulls(spark):
    old = spark.createDataFrame([(1, "a", 3, 3), (2, None, 2, 2), (3, "c", 5, 6)], "k long, v string, created_version_id long, updated_version_id long")
    new = spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "k long, v string")
    got = sorted(map(tuple, merge.versioned_upsert(old, new, ["k"], "v", 4).collect()))
    assert got == [(1, "b", 3, 4), (2, None, 2, 2), (3, "c", 5, 6), (4, "d", 4, 4)]
    got = sorted((r.k, r.action) for r in merge.guarded_upsert(old.select("k", "v"), new, ["k"], "v").collect())
    assert got == [(1, "update"), (2, "keep"), (3, "keep"), (4, "insert")]


def test_signature_ignores_order(spark):
    rows = spark.createDataFrame([(1, 10), (1, 9), (1, 10), (2, 9), (2, 10), (2, 10), (3, 9)], "q long, h long")
    got = {r.q: r.signature for r in groups.signature(rows, ["q"], "h").collect()}
    assert got[1] == got[2] != got[3]


def test_readers(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:10,500 --> 00:01:12,000\nHello\nthere\n\nbroken\n\n2\nbad --> 00:00:02,000\nLast\n", encoding="utf-8")
    rows = sorted(map(tuple, readers.subtitles(spark, f"file://{tmp_path}/a.srt").collect()), key=str)
    assert rows == [("a.srt", 0.0, 2.0, "Last", "a.srt|0.000|2.000"), ("a.srt", 10.5, 72.0, "Hello\nthere", "a.srt|10.500|72.000")]
    maps = tmp_path / "maps"
    maps.mkdir()
    (maps / "TextMapEN.json").write_text('{"1": "a", "2": "b", "x": "c"}')
    (maps / "TextMapEN_1.json").write_text('{"2": "later"}')
    (maps / "notes.json").write_text('{"3": "no"}')
    assert sorted(map(tuple, readers.text_maps(spark, f"file://{maps}").collect())) == [("EN", 1, "a"), ("EN", 2, "later")]


def test_change_feed_and_sliding_counts(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, 1.0, "2024-01-01 00:00:00"), (1, 2.0, "2024-01-01 00:00:30"), (2, 3.0, "2024-01-01 00:00:10"), (1, 4.0, "2024-01-01 00:01:15")]
    events = spark.createDataFrame(rows, "k long, v double, t string").withColumn("t", F.col("t").cast("timestamp"))
    events.write.parquet(f"file://{source}")
    feed = spark.readStream.schema(events.schema).parquet(f"file://{source}")
    changes.merge_stream(feed, f"file://{tmp_path}/out", ["k"], "t", f"file://{tmp_path}/c1").awaitTermination(60)
    assert sorted((r.k, r.v) for r in changes.merged(spark.read.parquet(f"file://{tmp_path}/out"), ["k"], "t").collect()) == [(1, 4.0), (2, 3.0)]
    want = sorted((r.k, r.v, r.n) for r in changes.sliding_count(events, "k", "t", 60).collect())
    assert want == [(1, 1.0, 1), (1, 2.0, 2), (1, 4.0, 2), (2, 3.0, 1)]
    counts = changes.sliding_count_stream(feed, "k", "t", 60)
    counts.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r.k, r.n) for r in spark.table("counts").collect()) == sorted((k, n) for k, _, n in want)


def test_keywords_without_quotes():
    for given, want in (('"a b"', "a b"), ("“x”", "x"), ('"', '"'), ('""', '""'), ("« ‹q› »", "q"), ("“open", "open"), ("close”", "close"), ('say "hi" now', 'say "hi" now'), (" ", ""), (None, "")):
        assert text.keyword(given) == want


def test_query_terms_aliases_and_numbers():
    assert text.query_terms("“Big big House”", words=True) == ["big", "house"]
    assert text.query_terms("天 地人", words=False) == ["天地", "地人"] and text.query_terms("天", words=False) == ["天"]
    assert text.query_terms("the a house", words=True, stop=("the",), least=2) == ["house"]
    assert text.language_aliases("TextMapEn.json") == ["TextMapEn.json", "TEXTMAPEN.JSON", "En", "EN", "TextMapEN.json", "TextEN.json"]
    assert text.language_aliases("fr") == ["fr", "FR", "TextMapFR.json", "TextFR.json"] and text.language_aliases(" ") == []
    assert [text.int_keyword(x) for x in ("-0x1F", "+12", "1.0", "")] == [-31, 12, None, None]


def test_placeholders(spark):
    rows = spark.createDataFrame([("#{F#her}{M#his} {NICKNAME}",), ("{PLAYERAVATAR#SEXPRO[A|B]}/{MATEAVATAR#SEXPRO[A|B]}/{XAVATAR#SEXPRO[A|C]}",), ("#{REALNAME[ID(2)|SHOWHOST(true)]}!{REALNAME[ID(1)|HOSTONLY(true)]}",), (None,), ("",)], "t string")
    words = F.create_map(F.lit("A"), F.lit("a"), F.lit("B"), F.lit("b"))
    # The mate's pronoun is of the other form; an unknown id stands for nothing.
    for male, want in ((True, ["his N", "a/b/a"]), (False, ["her N", "b/a/"]), (None, ["{his/her} N", "{a/b}/{a/b}/{a/}"])):
        got = [r[0] for r in rows.select(text.placeholders(F.col("t"), male, F.lit("W"), F.lit("N"), F.lit("L"), words)).collect()]
        assert got == [*want, "L!W", None, ""]


def test_versions_follow_a_text(spark):
    frame = lambda rows: spark.createDataFrame(rows, "hash long, content string")
    first = frame([(1, "a long enough text of the first day"), (2, "another text that stays as it is"), (3, "gone soon, this one")])
    second = frame([(9, "a long enough text of the first day"), (2, "another text that changes a bit here"), (4, "new on the second day, and quite alone")])
    third = frame([(9, "a long enough text of the first day!!"), (2, "another text that changes a bit here"), (4, "new on the second day, and quite alone")])
    got = {r.hash: (r.created, r.updated) for r in history.replay([(1, first), (2, second), (3, third)]).collect()}
    assert got == {9: (1, 3), 2: (1, 2), 4: (2, 2)}
    shifted = frame([(20, "a long enough text of the first day, now"), (2, "another text that stays as it is")])
    got = {r.hash: (r.created, r.updated) for r in history.replay([(1, first), (2, shifted)], similar=True).collect()}
    assert got == {20: (1, 2), 2: (1, 1)}


def test_scratch_tables_go(spark):
    from textloom.operators import scratch

    path = f"{scratch.shared_dir(spark)}/textloom".removeprefix("file://")
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    assert scratch.written(spark.range(5), "test").count() == 5
    made = set(os.listdir(path)) - before
    assert len(made) == 1 and all(name.startswith("test-") for name in made)
    assert scratch.clear(spark) and not os.path.exists(path)


def test_runs_of_characters_in_linear_time(spark):
    """Pairs of a text of a million characters: one pass over the text, not one for each pair."""
    text_ = "é" * 20 + "aß\n😀b " * 150_000
    rows = spark.createDataFrame([(text_,), ("x",), ("",), (None,), ("😀é",)], "c string")
    began = time.perf_counter()
    got = [r[0] for r in rows.select(text.grams(F.col("c"), 2)).collect()]
    assert time.perf_counter() - began < 60
    assert got == [list(dict.fromkeys(text_[i : i + 2] for i in range(len(text_) - 1))), ["x"], [], [], ["😀é"]]
