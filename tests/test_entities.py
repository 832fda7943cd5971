"""Things and their texts."""

from pyspark.sql import functions as F

from textloom.operators import entities


def test_links_carry_what_is_wanted_of_texts(spark):
    """Digests and lengths are made once for each text; the rows are those of the whole texts."""
    links = spark.createDataFrame([(1, 10, 1, 2, 1, 0), (1, 11, 1, 9, 2, 0), (2, 10, 3, 1, 1, 1), (2, 12, 4, 1, 1, 1)], "source int, entity long, hash long, title_hash long, extra int, category int")
    texts = spark.createDataFrame([(1, "en", "one"), (1, "fr", "un"), (1, "fr", "uf"), (2, "de", "zwei"), (3, "en", "three"), (4, "en", "")], "hash long, lang string, content string")
    labels = spark.createDataFrame([(None, None, 1, "first")], "source int, category int, field int, label string")
    own = lambda **how: entities.entries(links, texts, labels, ["fr", "en"], **how)
    want = {(1, 10, 1, "zwei", "first", 0, "fr", "uf"), (1, 11, 1, None, "text", 0, "fr", "uf"), (2, 10, 3, "uf", "first", 0, "en", "three")}
    assert set(map(tuple, own().collect())) == want
    short = own(title_as=F.upper, content_as=F.length)
    assert set(map(tuple, short.collect())) == {(*r[:3], r[3] and r[3].upper(), *r[4:7], len(r[7])) for r in want}
