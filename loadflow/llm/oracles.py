"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from loadflow.llm.secret_scan import BASE, LOOSE

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _spans(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    """Spans of one kind as a list of structs; the texts between matches give the positions."""
    p = pattern.replace("'", "''")
    length = lambda items: f"coalesce(list_sum(list_transform({items}, lambda y: length(y))), 0)"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda k: {{'start': CAST({length(f"string_split_regex(t, '{p}')[1:k]")} + {length(f"regexp_extract_all(t, '{p}')[1:k - 1]")} AS BIGINT),
      'rank': {rank}, 'kind': '{kind}', 'size': length(regexp_extract_all(t, '{p}')[k]), 'value': regexp_extract_all(t, '{p}', {group})[k]}}), lambda s: length(s['value']) >= {least})"""


_LOOKS = "regexp_matches({v}, '[0-9]') AND regexp_matches({v}, '[A-Za-z]') AND len(list_distinct(string_split({v}, ''))) >= 8"
_TEXT = "array_to_string(list_transform({s}, lambda s: s['kind'] || ':' || s['start'] || ':' || (s['start'] + s['size'])), ',')"

SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS (SELECT rid, doc_id, source, t, list_sort({" || ".join(_spans(*one, rank) for rank, one in enumerate(BASE))}) AS base, {_spans(*LOOSE, len(BASE))} AS loose FROM d),
g AS (SELECT rid, doc_id, source, t, base, list_filter(loose, lambda s: {_LOOKS.format(v="s['value']")} AND len(list_filter(base, lambda b: b['start'] < s['start'] + s['size'] AND s['start'] < b['start'] + b['size'])) = 0) AS loose FROM f),
e AS (SELECT rid, source, t, unnest(base || loose)['value'] AS v FROM g),
o AS (SELECT v, count(DISTINCT owner) > 2 OR count(*) > 20 AS copied FROM (SELECT v, t, min(CAST('0x' || left(md5(coalesce('0' || source, '1')), 15) AS BIGINT)) AS owner FROM e GROUP BY v, t) GROUP BY v),
s AS (SELECT rid, list(DISTINCT v) FILTER (NOT copied AND {_LOOKS.format(v="v")}) AS live, list(DISTINCT v) FILTER (copied) AS example FROM e JOIN o USING (v) GROUP BY rid),
r AS (SELECT doc_id, base, list_sort(base || list_filter(loose, lambda x: list_contains(coalesce(live, []), x['value']))) AS spans, coalesce(live, []) AS live, coalesce(example, []) AS example FROM g LEFT JOIN s USING (rid))
SELECT doc_id, {", ".join(f"CAST(len(list_filter(base, lambda s: s['kind'] = '{k}')) AS BIGINT) AS n_{k}" for k, *_ in BASE)}, sha256({_TEXT.format(s="base")}) AS base_sha256, {_TEXT.format(s="spans")} AS spans,
  CAST(len(list_filter(spans, lambda s: list_contains(live, s['value']))) AS BIGINT) AS n_live, CAST(len(list_filter(spans, lambda s: list_contains(example, s['value']))) AS BIGINT) AS n_example FROM r"""

LINE_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('0' || source, '1') AS host, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
k AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM d),
p AS (SELECT rid, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM k),
a AS (SELECT rid, i FROM p QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, sum(least(5, coalesce(n - i, 5))) AS n_repeat FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS n FROM a) GROUP BY rid),
t AS (SELECT host, t, first(l) AS l FROM k GROUP BY host, t),
x AS (SELECT host, t, h, sum(n) AS n FROM (SELECT host, t, trim(regexp_replace(regexp_replace(lower(u), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
  len(list_filter(string_split_regex(u, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n FROM (SELECT host, t, unnest(l) AS u FROM t)) GROUP BY ALL),
o AS (SELECT host, h FROM x JOIN (SELECT host, count(*) AS m FROM t GROUP BY host) USING (host) GROUP BY host, h, m HAVING count(*) > 2 AND count(*) > least(m * 0.05, 1000)),
r AS (SELECT host, t, sum(n) AS n_removed FROM x JOIN o USING (host, h) GROUP BY host, t),
z AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed FROM k LEFT JOIN c USING (rid) LEFT JOIN r USING (host, t))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - n_removed < 5 OR n_removed > n_words * 0.8) AS kept FROM z"""

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY rid ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

SUBSTRINGS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
x AS (SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) AS h FROM d WHERE len(w) > 12),
f AS (SELECT h, min(doc_id) AS m FROM x GROUP BY h),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS i FROM x JOIN f USING (h) WHERE m < doc_id),
a AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT a.rid, count(c.rid) AS gone, string_agg(word, ' ' ORDER BY a.i) FILTER (c.rid IS NULL) AS kept FROM a LEFT JOIN c ON a.rid = c.rid AND a.i = c.i GROUP BY a.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": SECRETS, "op4_line_rules": LINE_RULES, "op6_topk_bitslice": TOP_K, "op7_substring_dedup": SUBSTRINGS}
