"""One query per operator over the whole tables, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaindex.llm import (
    byte_bpe,
    decontaminate,
    language_id,
    near_dedup,
    pair_bpe,
    preference,
    recurrent_lm,
    resample,
    spelling,
    suffix_dedup,
    token_files,
    topk,
    whitening,
)
from areaindex.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_files(spark, sf):
    return token_files.token_file_digests(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_benchmark_decontamination(spark, sf):
    return decontaminate.contamination(documents(spark, sf), documents(spark, sf, "benchmark"))


@query
def op3_language_id(spark, sf):
    return language_id.language_predictions(documents(spark, sf))


@query
def op4_exact_top_k(spark, sf):
    return topk.exact_top_k(documents(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def op5_preference_format(spark, sf):
    return preference.format_preferences(preference.neighbour_pairs(documents(spark, sf, "conversations")))


@query
def op6_minhash_near_dedup(spark, sf):
    return near_dedup.near_duplicates(documents(spark, sf))


@query
def op7_recurrent_lm(spark, sf):
    return recurrent_lm.score_documents(documents(spark, sf))


@query
def op8_byte_bpe(spark, sf):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encoding_digests(documents(spark, sf), ranks, public_tokenizers.PATTERN)


@query
def op9_quality_resampling(spark, sf):
    return resample.resample(documents(spark, sf), documents(spark, sf, "labels"))


@query
def op10_suffix_array_dedup(spark, sf):
    return suffix_dedup.dedup_digests(documents(spark, sf))


@query
def op11_pair_index_bpe(spark, sf):
    return pair_bpe.encoding_digests(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_spelling_variants(spark, sf):
    return spelling.spelling_variants(documents(spark, sf))


@query
def op13_spectrum_whitening(spark, sf):
    return whitening.whiten(documents(spark, sf, "embeddings"))


ORACLES["op4_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op2_benchmark_decontamination"] = (
    """
WITH d AS (SELECT doc_id, regexp_extract_all(LOWERED, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(LOWERED, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, j, least(13, len(w)) AS n, list_slice(w, j, j + least(13, len(w)) - 1) AS g
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(j) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, i, j, n FROM dw JOIN bw USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM hit GROUP BY doc_id),
runs AS (
  SELECT doc_id, max(c + n - 1) AS longest FROM (
    SELECT doc_id, item_id, diagonal, n, start, count(*) AS c FROM (
      SELECT doc_id, item_id, i - j AS diagonal, n, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j, n ORDER BY i) AS start FROM hit
    ) GROUP BY ALL
  ) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
  CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN runs USING (doc_id)
""".replace("LOWERED", _LOWER.format("text"))
)

ORACLES["op5_preference_format"] = """
WITH t AS (
  SELECT DISTINCT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS is_chosen, turn,
    coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, is_chosen ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k,
    coalesce(a.role = b.role AND a.text = b.text, FALSE) AS same
  FROM (SELECT * FROM k WHERE is_chosen) a FULL JOIN (SELECT * FROM k WHERE NOT is_chosen) b ON a.pair_id = b.pair_id AND a.k = b.k
),
n AS (SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS n FROM m GROUP BY pair_id),
r AS (SELECT k.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM k JOIN n USING (pair_id)),
o AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, is_chosen ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + length(role) + 5 AS first
  FROM r WHERE k > n
),
p AS (SELECT pair_id, string_agg(shown, '' ORDER BY k) AS prompt FROM r WHERE is_chosen AND k <= n GROUP BY pair_id),
c AS (
  SELECT pair_id, is_chosen, string_agg(shown, '' ORDER BY k) AS completion,
    string_agg(CAST(CAST(first AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(first AS BIGINT) + length(text) + 7 AS VARCHAR), ',' ORDER BY k) FILTER (role = 'assistant') AS mask
  FROM o GROUP BY pair_id, is_chosen
)
SELECT n.pair_id, CAST(n.n AS BIGINT) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
  coalesce(a.completion, '') AS chosen, coalesce(a.mask, '') AS chosen_mask,
  coalesce(b.completion, '') AS rejected, coalesce(b.mask, '') AS rejected_mask
FROM n LEFT JOIN p USING (pair_id)
LEFT JOIN (SELECT * FROM c WHERE is_chosen) a USING (pair_id)
LEFT JOIN (SELECT * FROM c WHERE NOT is_chosen) b USING (pair_id)
"""

ORACLES["op6_minhash_near_dedup"] = (
    """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(LOWERED, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g
  FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
m AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n USING (doc_id)
""".replace("LOWERED", _LOWER.format("text"))
)

#: crc32 by its table, then words that share what is left when one code point goes from either or both.
ORACLES["op12_spelling_variants"] = (
    """
WITH RECURSIVE step AS (
  SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c, 0 AS b FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b + 1 FROM step WHERE b < 8
),
crc AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM step WHERE b = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, unnest(regexp_extract_all(LOWERED, '[A-Za-zÀ-ÿ]+')) AS w FROM documents
),
found AS (SELECT head, w, count(*) AS k FROM runs WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (
  SELECT w, k, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(head || w, ''), lambda x:
      CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM found, crc
),
damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, k FROM hashed
),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
),
near AS (
  SELECT word, count(*) AS n_near, min({'minus': -other_n, 'form': other}) FILTER (other_n >= 10 * n) AS best FROM pairs GROUP BY word
),
forms AS (SELECT word, n_near, best.form AS form, -best.minus AS form_n FROM near),
chain AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL
),
roots AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM forms WHERE form IS NOT NULL))
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
""".replace("LOWERED", _LOWER.format("text"))
)
