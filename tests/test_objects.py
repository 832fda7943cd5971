import json
import random
import re

from pyspark.sql import functions as F

from textloom.operators import templates
from textloom.sources import trees, variants


def walk(value, path="$", depth=0, name=None):
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "string" if isinstance(value, str) else "other"
    yield path, depth, name, kind, value
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}", depth + 1, k)
    if isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]", depth + 1)


def test_nodes_against_brute_force(spark):
    rng = random.Random(5)

    def made(depth):
        kind = rng.randint(0, 5) if depth < 5 else rng.randint(2, 5)
        if kind == 0:
            return {rng.choice("abcdef"): made(depth + 1) for _ in range(rng.randint(0, 3))}
        if kind == 1:
            return [made(depth + 1) for _ in range(rng.randint(0, 3))]
        return [rng.randint(-9, 9), True, None, rng.choice(["", "Switch_X", "t\"é\n"])][kind - 2]

    rows = [(i, made(0)) for i in range(60)] + [(100, [[[[["Switch_deep"]]]]])]
    bodies = [(i, json.dumps(v)) for i, v in rows] + [(200, "{"), (201, None), (202, "")]
    found = trees.nodes(spark.createDataFrame(bodies, "id long, body string"), "id", "body")
    got = sorted((r.id, r.path, r.depth, r.name or "", r.kind, r.text if r.kind == "string" else "") for r in found.collect())
    want = sorted((i, p, d, n or "", k, x if k == "string" else "") for i, v in rows for p, d, n, k, x in walk(v))
    assert got == want
    held = sorted((r.id, r.text) for r in trees.strings_with(found, "switch_", ("switch_x",)).collect())
    assert held == [(100, "switch_deep")]


def test_variants_and_rejects(spark):
    objects = [
        ("a", '{"talkId": 7, "dialogList": [{"id": 1, "talkRole": {"type": "npc", "_id": 5}, "talkContentTextMapHash": 11}, {"id": 2, "talkRole": {"type": "npc"}, "talkContentTextMapHash": 12}, {"id": 3}, 4, {"talkContentTextMapHash": 9}]}'),
        ("b", '{"FEOACBMDCKJ": 8, "AAOAAFLLOJI": [{"CCFPGAKINNB": 21, "HJLEMJIGNFE": {"type": "pc", "id": "6"}, "BDOKCLNNDGN": 13}]}'),
        ("c", '{"FEOACBMDCKJ": 8}'),
        ("d", "{"),
        ("e", '{"talkId": "x", "dialogList": []}'),
        ("f", '{"talkId": 9}'),
        ("g", None),
        ("h", "[1]"),
    ]
    rows, rest = variants.talks(spark.createDataFrame(objects, "file string, body string"))
    got = sorted((r.file, r.talk, r.entry, r.kind, r.who, r.text) for r in rows.collect())
    assert got == [("a", 7, 1, "npc", 5, 11), ("a", 7, 2, None, -1, 12), ("b", 8, 21, "pc", 6, 13)]
    assert {tuple(r) for r in rest.collect()} == {("c", "no variant"), ("d", "malformed"), ("e", "id"), ("g", "malformed"), ("h", "malformed")}


def test_a_new_variant_is_data(spark):
    more = variants.talk_registry(spark).unionByName(
        spark.createDataFrame([("new", 99, level, role, name, needed, 0) for level, role, name, needed in ((1, "talk", "T", True), (1, "entries", "L", True), (2, "entry", "E", True), (2, "text", "X", True))], variants.REGISTRY)
    )
    objects = spark.createDataFrame([("n", '{"T": 1, "L": [{"E": 2, "X": 3}]}')], "file string, body string")
    assert variants.talks(objects)[0].count() == 0
    assert [(r.talk, r.entry, r.who, r.text) for r in variants.talks(objects, registry=more)[0].collect()] == [(1, 2, -1, 3)]


def test_voice_items(spark):
    objects = [
        ("a", '{"guid": 1, "gameTriggerArgs": 5, "gameTrigger": " Dialog", "sourceNames": [{"sourceFileName": "p/1", "avatarName": "Switch_A"}, {"sourceFileName": ""}, 3, {"NKPOOPONEHG": "p/2"}]}'),
        ("b", '{"IACPGADBANJ": "dialog", "MGOMDNKKLCP": 6, "OPGDOEDEJOJ": [{"MDOCAGOFPAP": "p/3", "sourceFileName": "p/4"}]}'),
        ("c", '{"Guid": 1, "gameTriggerArgs": 5, "GameTrigger": "other", "SourceNames": []}'),
        ("d", '{"Guid": 1, "gameTriggerArgs": 5, "GameTrigger": "Dialog"}'),
    ]
    rows, rest = variants.voices(spark.createDataFrame(objects, "item string, body string"))
    assert sorted((r.item, r.entry, r.path, r.speaker) for r in rows.collect()) == [("a", 5, "p/1", "switch_a"), ("a", 5, "p/2", None), ("b", 6, "p/3", None)]
    assert {tuple(r) for r in rest.collect()} == {("c", "not dialog"), ("d", "missing")}


def test_tokens_rounds_and_cycles(spark):
    refs = [("K", 1, "en", "one $[K2]"), ("K", 2, "en", "two $[C3|x]"), ("C", 3, "en", "three"), ("K", 4, "en", "loop $[K5] $[C3]"), ("K", 5, "en", "back $[K4]"), ("K", 6, "en", "self $[K6]"), ("K", 7, "en", "to $[K4]"), ("K", 1, "de", "eins")]
    texts = [(1, "en", "a $[K1], b"), (1, "de", "$[K1]$[K2]"), (2, "en", "$[K4]$[K6]$[K7]"), (3, "en", "{PLURAL# 1 |one|more} {PLURAL#-1|one|more} {PLURAL#2.5|one|more} {PLURAL#x|one|more}"), (4, "en", "plain"), (5, "en", "$[ ] $[K] $[K-9]"), (6, "en", None)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    done = templates.resolved(make(texts, "id long, lang string, content string"), ["id"], make(refs, "kind string, ref long, lang string, value string"))
    got = {(r.id, r.lang): (r.content, r.changed) for r in done.collect()}
    assert got[1, "en"] == ("a one two three, b", True) and got[1, "de"] == ("eins$[K2]", True)
    loop = "loop $[K5] three"
    assert got[2, "en"] == (f"{loop}self $[K6]to $[K4]", True)
    assert got[3, "en"] == ("one one more {PLURAL#x|one|more}", True)
    assert got[4, "en"] == ("plain", False) and got[5, "en"] == ("$[ ] $[K] $[K-9]", False) and got[6, "en"] == (None, False)
    stored = templates.synthetic(make(texts, "id long, lang string, content string"), ["id"], make(refs, "kind string, ref long, lang string, value string"))
    assert {r.id for r in stored.collect()} == {1, 2, 3}


def test_plurals_alone(spark):
    rows = spark.createDataFrame([("{PLURAL#1|a|b}{PLURAL#3|a|b}",), ("x",), ("",)], "c string")
    assert [r[0] for r in rows.select(templates.plurals(F.col("c"))).collect()] == ["ab", "x", ""]
    assert re.fullmatch(templates.TOKEN, "$[K1|a]")


def test_objects_of_one_key_are_told_apart(spark):
    """Each object is compared with the registry where it stands: two of one key are two, and none is shuffled for it."""
    objects = [("a", '{"talkId": 7, "dialogList": []}'), ("a", '{"talkId": 8, "dialogList": []}'), ("a", "{"), (None, '{"talkId": 9}')]
    own, rest = variants.classified(spark.createDataFrame(objects, "file string, body string"), variants.talk_registry(spark), "file", "body")
    assert sorted((str(r.file), r.roles["talk"]) for r in own.collect()) == [("None", "9"), ("a", "7"), ("a", "8")]
    assert [tuple(r) for r in rest.collect()] == [("a", "malformed")]


def test_objects_declare_by_themselves(spark):
    bodies = [(1, '{"a": {"n": "X y", "n2": 1}, "b": [{"n": "x-Y", "z": 2}, {"n": 5}, {"n": ""}, {"m": {"n": null}}]}'), (2, '"n"'), (3, "{")]
    found = trees.declared(trees.nodes(spark.createDataFrame(bodies, "id long, body string"), "id", "body"), "id", "n")
    assert [(r.id, r.declared, json.loads(r.text)) for r in found.collect()] == [(1, "xy", {"n": "x-Y", "z": 2})]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
