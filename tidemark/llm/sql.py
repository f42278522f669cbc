"""SQL counterparts of the queries that SQL can express."""

OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM wins GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
cut AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM d),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM cut),
words AS (SELECT doc_id, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
facts AS (SELECT *, len(w) AS n, len(list_filter(range(1, len(w)), lambda k: w[k] = w[k + 1])) AS same,
  len(regexp_extract_all(line, '[#*$%&|<>]{2,}')) AS runs,
  len(list_filter(w, lambda x: x IN ('|', '»', '›', '·', '•', '::', '>', '<', '/'))) AS seps,
  length(regexp_replace(line, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM words),
judged AS (SELECT doc_id, n, nth, (n < 4 AND NOT regexp_matches(w[-1], '[.!?:;…。！？"'')\]”’»]$'))
  OR (n >= 8 AND 100 * same > 30 * n) OR 100 * runs >= 30 * n OR (seps >= 3 AND 100 * seps >= 20 * n)
  OR (n <= 15 AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|click here|read more|sign up|log in|enable javascript|subscribe to our newsletter|skip to content|back to top'))
  OR (letters >= 20 AND 100 * capitals > 60 * letters AND 2 * capitals > strlen(line) // 4) AS fails FROM facts),
sums AS (SELECT doc_id, sum(n) FILTER (fails) AS lost, count(*) FILTER (nth > 1) AS again FROM judged GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(again, 0)::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN sums USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT * EXCLUDE (lost), NOT base_failed AND 100 * lost <= 50 * n_words AS kept FROM failed
"""

OP3 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN sizes USING (doc_id)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM starts),
least AS (SELECT win, min(doc_id) AS first_doc FROM wins GROUP BY win),
gone AS (SELECT doc_id, list(i) AS begins FROM wins JOIN least USING (win) WHERE first_doc < doc_id GROUP BY doc_id),
covered AS (SELECT doc_id, list_distinct(flatten(list_transform(begins, lambda i: range(i, i + 13)))) AS pos FROM gone),
kept AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(pos), 0) AS n_removed,
    CASE WHEN pos IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(pos, i))), lambda i: w[i]) END AS left_words
  FROM d LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(left_words, ' ')) AS kept_sha256 FROM kept
"""

OP7 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
firsts AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1),
common AS (SELECT line, min(doc_id) AS first_doc FROM (SELECT doc_id, source, unnest(l) AS line FROM firsts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 10),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
marked AS (SELECT lines.*, regexp_matches(lines.line, '[^\x20\x09-\x0D]') AS word, first_doc IS NOT NULL AND first_doc <> doc_id AS gone
  FROM lines LEFT JOIN common ON lines.line = common.line)
SELECT doc_id, count(*) FILTER (word) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Counts by inversion: one comparison per table entry; a rate above 16 is a sum of equal draws.
OP8 = r"""
WITH size AS (SELECT source, sum(strlen(coalesce(text, '')))::DOUBLE AS bytes FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN bytes = 0 THEN 1.0 ELSE 1.0 / (SELECT count(*) FROM size) * (SELECT sum(bytes) FROM size) / bytes END AS rate FROM size),
drawn AS (SELECT source, rate, ceil(rate / 16)::INT AS draws FROM rates),
mass AS (SELECT source, k, exp(k * ln(rate / draws) - rate / draws - lgamma(k + 1)) AS p FROM drawn, range(0, 97) t(k) WHERE rate > 0),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM mass),
tables AS (SELECT source, list(c ORDER BY k) AS table_c FROM cdf GROUP BY source),
each AS (SELECT doc_id, d.source, unnest(range(1, draws + 1)) AS j, table_c FROM documents d JOIN drawn USING (source) JOIN tables USING (source)),
numbers AS (SELECT doc_id, source, table_c, (('0x' || substr(sha256('copies:8:' || doc_id || ':' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM each),
counts AS (SELECT doc_id, source, sum(len(list_filter(table_c, lambda p: p < u))) AS copies FROM numbers GROUP BY doc_id, source)
SELECT doc_id, source, c::INT AS copy, sha256('order:8:' || doc_id || ':' || c) AS order_key
FROM (SELECT doc_id, source, unnest(range(1, copies::BIGINT + 1)) AS c FROM counts)
"""

OP10 = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counts USING (vec_id)
"""

def _vector_codes(rounds: int = 6) -> str:
    """Every round spelt out: distances to all entries, nearest by (distance, index), means rounded down."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min({{'d': d, 'k': k}}) AS best
  FROM (SELECT vec_id, a.p, k, a.x, list_sum(list_transform(range(1, 9), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) AS d FROM parts a JOIN book{r} b ON a.p = b.p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (SELECT p, best.k AS k, list_transform(range(1, 9), lambda i: list_sum(list_transform(list(x), lambda y: y[i]))) AS s, count(*) AS n FROM near{r} GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.k, CASE WHEN n IS NULL THEN x ELSE list_transform(s, lambda t: ((t - ((t % n) + n) % n) // n)::BIGINT) END AS x FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.k = m.k)""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, list_slice(e, 8 * p + 1, 8 * p + 8) AS x FROM v, range(8) t(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT 16),
book0 AS MATERIALIZED (SELECT p, k, x FROM parts JOIN firsts USING (vec_id)),
{",".join(steps)},
codes AS (SELECT vec_id, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
labelled AS (SELECT codes.*, label FROM codes JOIN v USING (vec_id)),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS h FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM labelled, books
"""


OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
runs AS (SELECT lang, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS phrase
  FROM words, range(1, 6) t(width) WHERE len(w) >= width),
f AS MATERIALIZED (SELECT lang, width, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 100),
inner_ones AS (SELECT DISTINCT s.lang, s.phrase FROM f s JOIN f q ON s.lang = q.lang AND q.width = s.width + 1 AND q.a = s.a
  AND (array_to_string(string_split(q.phrase, ' ')[:-2], ' ') = s.phrase OR array_to_string(string_split(q.phrase, ' ')[2:], ' ') = s.phrase)),
own AS (SELECT * FROM f WHERE width > 1 AND NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.lang = f.lang AND i.phrase = f.phrase)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, width)) AS k FROM own)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, h.a AS l, t.a AS r, n, ((1000::HUGEINT * cuts.a * n) // (h.a::HUGEINT * t.a))::BIGINT AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail JOIN totals ON totals.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM lowest)
SELECT * FROM ranked WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": OP2,
    "op3_near_dup": OP3,
    "op6_substring_dedup": OP6,
    "op7_line_dedup": OP7,
    "op8_mixing": OP8,
    "op10_embedding_dedup": OP10,
    "op11_vector_codes": _vector_codes(),
    "op12_collocations": OP12,
}
