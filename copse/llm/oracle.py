"""DuckDB texts of the queries that SQL can say."""

_WORD = r"'[^\x20\x09-\x0D]+'"


def quality_rows(docs: str, name: str = "q") -> str:
    """CTEs that end in ``name``: measurements and failure bits of the rows of ``docs``."""
    return rf"""
{name}_t AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
{name}_w AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, {_WORD}) AS ws FROM {name}_t),
{name}_g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM {name}_w WHERE len(ws) > 3)),
{name}_r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM {name}_g) WHERE n > 1) GROUP BY doc_id),
{name}_l AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM (
        SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM {name}_t)
        WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id),
{name}_m AS (SELECT {name}_w.doc_id, len(ws) AS n_words,
        length(array_to_string(ws, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_lines - n_distinct, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
        length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters,
        length(t) - length(replace(t, '!', '')) AS n_marks
        FROM {name}_w LEFT JOIN {name}_r USING (doc_id) LEFT JOIN {name}_l USING (doc_id)),
{name} AS MATERIALIZED (SELECT *, CAST(
        CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
        + CASE WHEN 2 * n_upper > n_letters THEN 16 ELSE 0 END + CASE WHEN 2 * n_marks > n_words THEN 32 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 64 ELSE 0 END
        + CASE WHEN n_words > 100000 THEN 128 ELSE 0 END AS BIGINT) AS failed_bits FROM {name}_m)"""


QUALITY = f"""
WITH {quality_rows('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits & 127 = 0 AS kept, failed_bits FROM q"""


FILTERS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, {_WORD}) AS ws FROM t),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
j AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
        max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
h AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS x
        FROM f LEFT JOIN j USING (doc_id) GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
        FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31
        AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS before
        FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, bit,
        coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
        coalesce(sum(g) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS good_lost,
        coalesce(sum(x) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
        FROM h, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
