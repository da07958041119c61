"""Queries over words in text without spaces: the given texts are made so by taking their spaces out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import words
from lectern.functions.text import tokens
from lectern.operators import lexicon
from lectern.plans.base import query, table

LETTERS = r"\p{L}"

LEXICON_SQL = r"""WITH runs AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS run FROM benchmark),
grams AS (SELECT substr(run, i, n) AS gram, CASE WHEN i > 1 THEN substr(run, i - 1, 1) ELSE '' END AS before, substr(run, i + n, 1) AS after
  FROM runs, unnest(range(1, length(run) + 1)) a(i), unnest(range(1, 5)) b(n) WHERE i + n - 1 <= length(run)),
counts AS (SELECT gram, count(*) AS n FROM grams GROUP BY gram),
total AS (SELECT sum(n)::BIGINT AS total FROM counts WHERE length(gram) = 1),
frequent AS (SELECT * FROM counts WHERE n >= 5 AND length(gram) > 1),
split AS (SELECT gram, n, substr(gram, 1, k) AS l, substr(gram, k + 1) AS r FROM frequent, unnest(range(1, length(gram))) u(k)),
held AS (SELECT s.gram, s.n, min(ln(s.n * total / (a.n * b.n)::DOUBLE)) AS cohesion FROM split s JOIN counts a ON a.gram = l JOIN counts b ON b.gram = r, total GROUP BY s.gram, s.n),
b AS (SELECT gram, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT gram, before, count(*) AS c FROM grams GROUP BY ALL) GROUP BY gram),
a AS (SELECT gram, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT gram, after, count(*) AS c FROM grams GROUP BY ALL) GROUP BY gram)
SELECT gram AS word, n, round(cohesion, 6) AS cohesion, round(least(b.h, a.h), 6) + 0.0 AS freedom FROM held JOIN b USING (gram) JOIN a USING (gram)"""


@query("lexicon", LEXICON_SQL)
def lexicon_candidates(spark, sf_dir):
    """Runs of letters that may be words: how often they occur, how well they hold together, how free their neighbours are."""
    rows = lexicon.candidates(table(spark, sf_dir, "benchmark"), LETTERS)
    return rows.select("word", "n", F.round("cohesion", 6).alias("cohesion"), (F.round("freedom", 6) + 0.0).alias("freedom"))


CUT_SQL = r"""WITH RECURSIVE toks AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS tok FROM benchmark),
dict AS MATERIALIZED (SELECT tok, ln(count(*)::DOUBLE / (SELECT count(*) FROM toks)) AS w FROM toks GROUP BY tok),
runs AS MATERIALIZED (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS run FROM benchmark),
edges AS (
  SELECT item_id, stop, n, coalesce(w, CASE WHEN n = 1 THEN ln(0.5::DOUBLE / (SELECT count(*) FROM toks)) END) AS w
  FROM (SELECT item_id, stop, n, substr(run, stop - n + 1, n) AS part FROM runs, unnest(range(1, length(run) + 1)) a(stop), unnest(range(1, (SELECT max(length(tok)) FROM dict) + 1)) b(n) WHERE n <= stop)
  LEFT JOIN dict ON tok = part WHERE w IS NOT NULL OR n = 1),
packed AS MATERIALIZED (SELECT item_id, stop, list({'n': n, 'w': w}) AS es FROM edges GROUP BY item_id, stop),
best AS (
  SELECT item_id, 0::BIGINT AS stop, [0.0::DOUBLE] AS scores, [0::BIGINT] AS lengths FROM runs
  UNION ALL
  SELECT item_id, stop, list_append(scores, top.score), list_append(lengths, top.n) FROM (
    SELECT item_id, p.stop, scores, lengths, list_sort(list_transform(es, lambda e: {'score': scores[p.stop - e.n + 1] + e.w, 'n': e.n}), 'DESC')[1] AS top
    FROM best b JOIN packed p USING (item_id) WHERE p.stop = b.stop + 1)),
paths AS (
  SELECT item_id, length(run)::BIGINT AS stop, lengths, run FROM best JOIN runs USING (item_id) WHERE stop = length(run)
  UNION ALL
  SELECT item_id, stop - lengths[stop + 1], lengths, run FROM paths WHERE stop > 0),
words AS (SELECT item_id, stop, substr(run, stop - lengths[stop + 1] + 1, lengths[stop + 1]) AS word FROM paths WHERE stop > 0),
parts AS (
  SELECT item_id, stop, word, k, i, substr(word, i, k) AS part FROM words, unnest([2, 3]) a(k), unnest(range(1, length(word) - k + 2)) b(i) WHERE length(word) > k),
shown AS (
  SELECT item_id, stop, k AS place, i, part AS tok FROM parts JOIN dict ON tok = part UNION ALL SELECT item_id, stop, 9, 0, word FROM words)
SELECT item_id, count(*) AS n, md5(string_agg(tok, ' ' ORDER BY stop, place, i)) AS tokens_md5 FROM shown GROUP BY item_id"""


@query("cut_search", CUT_SQL)
def cut_search(spark, sf_dir):
    """The questions' texts without spaces, cut in search mode by a dictionary of their own words."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", tokens(F.col("text")).alias("toks"))
    counts = dict(rows.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*")).collect())  # the dictionary, of bounded size
    cut = words.tokenizer(spark, words.Cutter(counts, r"\p{L}\p{N}", guess=False))
    found = rows.select("item_id", cut(F.concat_ws("", "toks")).alias("cut"))
    return found.where(F.size("cut") > 0).select("item_id", F.size("cut").cast("long").alias("n"), F.md5(F.concat_ws(" ", "cut")).alias("tokens_md5"))
