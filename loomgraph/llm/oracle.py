"""SQL for the queries that SQL can express."""

from __future__ import annotations

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, k, array_to_string(w[k:k + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) u(k)),
rep AS (SELECT r, count(DISTINCT k + j) AS n FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS c FROM win) x, range(5) v(j) WHERE c > 1 GROUP BY r),
m AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(rep.n, 0) AS n_repeat_words,
  len(list_distinct(w)) AS n_unique_words, len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha_words
  FROM d LEFT JOIN rep ON d.r = rep.r),
f AS (SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM m),
b AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 15 * n_words THEN 4 ELSE 0 END
  + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 8 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END
  + CASE WHEN n_words > 0 AND 100 * n_upper_words > 60 * n_words THEN 32 ELSE 0 END + CASE WHEN n_words > 0 AND 100 * n_alpha_words < 60 * n_words THEN 64 ELSE 0 END
  + CASE WHEN n_words >= 50 AND 100 * n_unique_words < 8 * n_words THEN 128 ELSE 0 END AS failures FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  failures & 3 <> 0 AS base_failed, failures = 0 AS kept, CAST(failures AS BIGINT) AS failures FROM b
"""


def _repair() -> str:
    """A dynamic program over rows: for each state of the pattern the least (cost, audit, lines)."""

    def then(state: str, cost: str, letter: str, line: str | None, when: str = "true") -> str:
        told = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {told}}} END"

    bad, late = "fault IN (1, 2)", "CASE WHEN fault = 3 THEN 1 ELSE 0 END"
    keep = lambda s, i: then(s, late, "K", "role || ':' || text", f"NOT {bad} AND left(role, 1) = '{i}'")
    rerole = lambda s, r: then(s, f"2 + {late}", "R", f"'{r}:' || text", f"NOT {bad}")
    drop = lambda s: then(s, "3", "D", None)
    user = lambda of: ", ".join(f(s, w) for s in of for f, w in ((keep, "u"), (rerole, "user")))
    insert = lambda s, r: then(s, "2", "I", f"'{r}:'")
    return rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x,
  xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT), lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1]), 4294967295)) % 20 AS kind FROM conversations, tab),
live AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS text
  FROM d, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM live),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM numbered),
rows AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM seen),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
step AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS s1, {{'c': 2::BIGINT, 'a': 'I', 't': ['user:']}} AS s2, {{'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, k, s0, s1, s2, least(s3, {insert("s2", "assistant")}) FROM (SELECT conv_id, k, s0, s1, s3, least(s2, {", ".join(insert(s, "user") for s in ("s0", "s1", "s3"))}) AS s2 FROM (
    SELECT step.conv_id, rows.k, {drop("s0")} AS s0, least({drop("s1")}, {keep("s0", "s")}) AS s1, least({drop("s2")}, {user(("s0", "s1", "s3"))}) AS s2, least({drop("s3")}, {keep("s2", "a")}, {rerole("s2", "assistant")}) AS s3
    FROM step JOIN rows ON rows.conv_id IS NOT DISTINCT FROM step.conv_id AND rows.k = step.k + 1))),
ends AS (SELECT step.conv_id, counts.*, least(s0, s3) AS best FROM step LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM step.conv_id WHERE step.k = coalesce(counts.n, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256 FROM ends
"""


def _lloyd(width: int = 64, k: int = 40, rounds: int = 5) -> str:
    """Plain rounds: every vector against every centroid."""
    parts = [
        f"""q AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT *, sha256('2:' || vec_id::VARCHAR) AS h FROM q ORDER BY h, v LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min({{'d': list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, c{n}.v) + list_inner_product(c{n}.v, c{n}.v), 'c': c}}) AS best FROM q, c{n} GROUP BY r)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT c, list(floor(s / n) ORDER BY i) AS v FROM (SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{n} JOIN q USING (r), unnest(range(1, {width + 1})) u(i) GROUP BY ALL) GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(s{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN s{n} USING (c))")
    last = f"a{rounds}"
    return f"""
WITH {", ".join(parts)},
per AS (SELECT best.c AS c, sum(best.d)::BIGINT AS cluster_inertia FROM {last} GROUP BY ALL)
SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance, cluster_inertia, (SELECT sum(best.d)::BIGINT FROM {last}) AS inertia, sha256(array_to_string(list_transform(c{rounds}.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM {last} JOIN q USING (r) JOIN per ON per.c = best.c JOIN c{rounds} ON c{rounds}.c = best.c
"""


ORACLES = {"op8_rules": OP8, "op11_repair": _repair(), "op13_centroids": _lloyd()}
