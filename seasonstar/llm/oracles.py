"""DuckDB statements for the operators that SQL can express, from the given tables alone."""

from __future__ import annotations

from seasonstar.llm import cleaning

#: Digest of conversations straight from their rows; the escapes only count for the length.
CHAT = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
    FROM range(2) AS extra(i)
),
sized AS (
    SELECT *, len(regexp_extract_all(role || chr(10) || text, '[<\[]\\*(?:/?s>|/?INST\])')) AS marks
    FROM rows
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
           AS turns_sha256,
       CAST(sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>[INST] ' || role || ' [/INST]' || text || '</s>') + marks) AS BIGINT)
           AS formatted_chars
FROM sized
GROUP BY conv_id
"""

#: Statistics by relational means: lines and windows become rows, windows are counted.
CLEANING = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM texts
),
windows AS (
    SELECT doc_id, i, words[i:i + 2] AS three
    FROM words, LATERAL unnest(range(1, len(words) - 1)) AS place(i)
),
twice AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1
),
covered AS (
    SELECT doc_id, count(DISTINCT i + step) AS n
    FROM twice, unnest([0, 1, 2]) AS steps(step) GROUP BY doc_id
),
lines AS (
    SELECT doc_id, line,
           len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
           length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars
    FROM texts, LATERAL unnest(string_split(text, chr(10))) AS parts(line)
),
judged AS (
    SELECT *,
           NOT regexp_matches(line, '{cleaning.HAS_LETTER}')
           OR len(regexp_extract_all(line, '{cleaning.MARKS}')) * 100
              > chars * {cleaning.MAX_MARKS}
           OR (n < 4 AND NOT regexp_matches(line, '{cleaning.SENTENCE_END.replace("'", "''")}'))
           OR (len(string_split_regex(line, '{cleaning.SEPARATOR}')) >= {cleaning.MENU_CELLS}
               AND len(list_filter(string_split_regex(line, '{cleaning.SEPARATOR}'),
                                   lambda c: length(c) > {cleaning.CELL_CHARS})) = 0)
           OR (n <= {cleaning.LINK_WORDS} AND regexp_matches(line, '{cleaning.LINK}'))
           OR (n <= {cleaning.NOTICE_WORDS} AND regexp_matches(line, '{cleaning.NOTICE}')) AS failed
    FROM lines WHERE n > 0
),
per_text AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(chars) AS word_chars,
           count(*) FILTER (WHERE failed) AS n_failed_lines,
           coalesce(sum(chars) FILTER (WHERE failed), 0) AS lost_chars
    FROM judged GROUP BY doc_id
),
counted AS (
    SELECT doc_id,
           CAST(len(words) AS BIGINT) AS n_words,
           CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(text, '{cleaning.SYMBOL}')) AS BIGINT) AS n_symbols,
           CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines,
           CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
    FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN per_text USING (doc_id)
)
SELECT * EXCLUDE base_failed_, base_failed_ AS base_failed,
       NOT base_failed_ AND lost_chars * 100 <= word_chars * {cleaning.MAX_LOST} AS kept
FROM (
    SELECT *, n_words < {cleaning.MIN_WORDS}
              OR n_repeat_words * 100 > n_words * {cleaning.MAX_REPEAT} AS base_failed_
    FROM counted
)
"""



def _clustering(centroids: int = 16, rounds: int = 3, width: int = 64, scale: int = 64) -> str:
    """Plain k-means by comparing every vector with every centroid, a block of CTEs per round."""
    assigned = """
a{r} AS (
    SELECT row, vector, number, centroid,
           list_sum(list_transform(list_zip(vector, centroid),
                                   lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
    FROM kept, c{r}
    QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, number) = 1
)"""
    moved = """
parts{r} AS (
    SELECT number, place, CAST(sum(vector[place]) AS HUGEINT) AS total, count(*) AS n
    FROM a{r}, range(1, {width} + 1) AS places(place) GROUP BY number, place
),
means{r} AS (
    SELECT number, list((total - (((total % n) + n) % n)) // n ORDER BY place) AS centroid
    FROM parts{r} GROUP BY number
),
c{after} AS (
    SELECT number, coalesce(m.centroid, c.centroid) AS centroid
    FROM c{r} AS c LEFT JOIN means{r} AS m USING (number)
)"""
    steps = ",".join(
        assigned.format(r=r) + "," + moved.format(r=r, after=r + 1, width=width) for r in range(rounds)
    )
    return f"""
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
),
kept AS (
    SELECT row_number() OVER () AS row, vec_id,
           list_transform(v, lambda x: CAST(floor({scale} * x) AS HUGEINT)) AS vector
    FROM usable
    WHERE len(v) = {width} AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
ranked AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), vector)
               AS place, vector AS centroid
    FROM kept
),
c0 AS (SELECT place - 1 AS number, centroid FROM ranked WHERE place <= {centroids}),{steps},{assigned.format(r=rounds)},
sums AS (SELECT number, sum(distance) AS cluster_inertia FROM a{rounds} GROUP BY number)
SELECT vec_id, CAST(number AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(cluster_inertia AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(cluster_inertia) FROM sums) AS BIGINT) AS inertia,
       sha256(array_to_string(centroid, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (row) JOIN sums USING (number)
"""


ORACLES: dict[str, str] = {
    "op2_cleaning": CLEANING,
    "op4_chat_formatting": CHAT,
    "op11_clustering": _clustering(),
}
