"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common
from .bpe_tree import op11_byte_bpe
from .decontaminate import op6_decontamination
from .id_files import op2_token_ids
from .jaccard import op9_ngram_jaccard
from .lm_score import op8_lm_scoring
from .packing import op7_packing
from .phrases import op13_phrases
from .pii import op5_pii
from .quality import op4_quality_rules
from .sharding import op10_sharding
from .token_count import op1_token_counts
from .toxicity import op3_toxicity
from .vector_codes import op12_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_token_ids, op3_toxicity, op4_quality_rules, op5_pii, op6_decontamination, op7_packing, op8_lm_scoring, op9_ngram_jaccard, op10_sharding, op11_byte_bpe, op12_vector_codes, op13_phrases)
    return {f.__name__: f for f in found}


#: Words of the Jaccard join and of decontamination, in DuckDB.
FOLDED = f"translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}')"
SPACED = rf"list_filter(string_split_regex({FOLDED}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LETTERED = rf"list_filter(string_split_regex({FOLDED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SPACED} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
LEAKS = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {LETTERED} AS words FROM benchmark),
win AS (SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[i : i + 9], ' ') AS run FROM (SELECT *, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
d AS (SELECT doc_id, {LETTERED} AS words FROM documents),
g AS (SELECT doc_id, size, i, array_to_string(words[i : i + size - 1], ' ') AS run FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win))),
h AS (SELECT g.doc_id, g.i, g.size, win.item FROM g JOIN win ON g.size = win.size AND g.run = win.run),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def _round(before: str, after: str) -> str:
    """SQL of codes by the codebooks before, and of the codebooks after: the floored means of their parts."""
    far = " + ".join(f"(x[{i}] - y[{i}]) * (x[{i}] - y[{i}])" for i in range(1, 5))
    mean = ", ".join(f"((s{i} - ((s{i} % n) + n) % n) // n)::BIGINT" for i in range(1, 5))
    sums = ", ".join(f"sum(x[{i}]) AS s{i}" for i in range(1, 5))
    return (
        f"{after}_near AS (SELECT rn, part, any_value(x) AS x, min(({far}) * 64 + e) AS m FROM cut JOIN {before} USING (part) GROUP BY rn, part), "
        f"{after}_sums AS (SELECT part, m % 64 AS e, count(*) AS n, {sums} FROM {after}_near GROUP BY 1, 2), "
        f"{after} AS (SELECT b.part, b.e, CASE WHEN n IS NULL THEN y ELSE [{mean}] END AS y FROM {before} b LEFT JOIN {after}_sums s ON s.part = b.part AND s.e = b.e)"
    )


#: Product quantisation of vectors of 64 components, in DuckDB.
CODES = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rn, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT rn, part, v[4 * part + 1 : 4 * part + 4] AS x FROM k, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, rn - 1 AS e, x AS y FROM cut WHERE rn <= 64),
{_round("b0", "b1")}, {_round("b1", "b2")}, {_round("b2", "b3")},
c AS (SELECT rn, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM b3_near GROUP BY rn),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (rn), h
"""

#: Phrases, in DuckDB.
PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({FOLDED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 100),
u AS (SELECT lang, phrase, a, j, array_to_string(ws[1 : j], ' ') AS x, array_to_string(ws[j + 1 :], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT u.lang, u.phrase, u.a, j, x.a AS l, y.a AS r, n, ((1000::HUGEINT * u.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.x JOIN f y ON y.lang = u.lang AND y.phrase = u.y JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, a, array_to_string(ws[o : o + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS o FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
h AS (SELECT lang, phrase, max(a) AS most FROM i GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN h USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": LEAKS, "op9_ngram_jaccard": JACCARD, "op12_vector_codes": CODES, "op13_phrases": PHRASES}
