"""SQL for the queries that SQL can express, for DuckDB over the same tables."""

from pointlake.llm.chat import PERSPECTIVES_SQL

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Every window as a string, the least document of each string, and the words that later documents' windows cover.
SUBSTRING_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
spot AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS body FROM spot),
firsts AS (SELECT body, min(doc_id) AS least FROM win GROUP BY body),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (body) WHERE least < doc_id)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, cast(len(words) AS bigint) AS n_words, cast(coalesce(lost.n, 0) AS bigint) AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

#: Sources sorted by how soon they clamp: the first k are clamped where the next one is not.
MIXING_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, cast(len({_WORDS}) AS bigint) AS size,
         cast('0x' || substr(md5('42:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 15) AS bigint) AS place
  FROM documents
), s AS (
  SELECT source, cast(sum(size) AS bigint) AS source_size, cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS bigint) AS weight FROM d GROUP BY source
), o AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, (SELECT sum(source_size) FROM s) AS total FROM s
), level AS (
  SELECT before, free, total FROM o WHERE weight * (total - 3 * before) <= 3 * source_size * free ORDER BY before LIMIT 1
), t AS (
  SELECT s.*, CASE WHEN free IS NULL OR weight * (total - 3 * before) > 3 * source_size * free THEN cast(3 * source_size AS double)
                   ELSE cast(weight * (total - 3 * before) AS double) / cast(free AS double) END AS target FROM s LEFT JOIN level ON true
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN cast(round(target) AS bigint) // source_size ELSE 0 END AS whole FROM t
), n AS (
  SELECT *, cast(round(target) AS bigint) - whole * source_size AS need FROM g
), r AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.need, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target, cast(size * whole + greatest(0, least(size, need - (upto - size))) AS bigint) AS taken FROM r
"""

QUALITY_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents
), spot AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS body FROM spot),
twice AS (SELECT doc_id, body FROM win GROUP BY ALL HAVING count(*) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, body)) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, cast(len(words) AS bigint) AS n_words, cast(length(array_to_string(words, '')) AS bigint) AS word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
         cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, cast(coalesce(cover.n, 0) AS bigint) AS n_repeat_words,
         len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
         length(text) - length(replace(text, '!', '')) AS n_shouts, len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
         len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutters
  FROM w LEFT JOIN cover USING (doc_id)
), b AS (
  SELECT *, cast((n_words < 20)::int + 2 * (100 * n_repeat_words > 30 * n_words)::int + 4 * (10 * n_symbols > 3 * n_words)::int + 8 * (n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines)::int
    + 16 * (word_chars < 2 * n_words)::int + 32 * (word_chars > 20 * n_words)::int + 64 * (10 * n_capitals > 4 * word_chars)::int
    + 128 * (10 * n_shouts > 3 * n_words)::int + 256 * (10 * n_letter_words < 6 * n_words)::int + 512 * (n_words > 1000000)::int + 1024 * (10 * n_stutters > 3 * n_words)::int AS bigint) AS fail_bits FROM m
)
"""
LEDGER_SQL = QUALITY_SQL + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 1535 = 0 AS kept, fail_bits FROM b"

_RULES = "(VALUES (0, 'few_words'), (1, 'repeated_windows'), (2, 'symbols'), (3, 'duplicate_lines'), (4, 'short_words'), (5, 'long_words'), (6, 'capitals'), (7, 'shouting'), (8, 'no_letters'), (10, 'stutter')) AS r(rule, name)"
ABLATION_SQL = (
    QUALITY_SQL
    + f"SELECT rule, name, count(*) FILTER (WHERE fail_bits & (1 << rule) <> 0) AS failed, count(*) FILTER (WHERE fail_bits & 1535 = (1 << rule)) AS failed_alone, "
    f"count(*) FILTER (WHERE fail_bits & 1535 = 0 OR fail_bits & 1535 = (1 << rule)) AS kept_without FROM b, {_RULES} GROUP BY rule, name"
)

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": SUBSTRING_SQL,
    "op5_source_mixing": MIXING_SQL,
    "op8_chat_perspectives": PERSPECTIVES_SQL,
    "op9_quality_ledger": LEDGER_SQL,
    "llm_quality_ablation": ABLATION_SQL,
}
