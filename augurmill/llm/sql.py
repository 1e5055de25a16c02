"""DuckDB texts of the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {WORDS} AS w FROM documents),
it AS (SELECT cast(item_id AS varchar) AS item, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + 12], ' ') AS win
       FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM it WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.rid, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid)
"""

OP8 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
c AS (SELECT doc_id, t, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
             cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
             cast(len(l) - len(list_distinct(l)) AS bigint) AS n_dup_lines, len(l) AS n_lines, cast(coalesce(rep.n, 0) AS bigint) AS n_repeat_words,
             len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{C0}-\x{10FFFF}]'))) AS n_lettered
      FROM d LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines)
            OR 5 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * word_chars OR 5 * n_lettered < 3 * n_words) AS kept
FROM b
"""

#: The phrases are lists of words; counts of all of them are made once, for two to four words and single ones.
OP12 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT lang, unnest([w[i:i], CASE WHEN len(w) > i THEN w[i:i + 1] END, CASE WHEN len(w) > i + 1 THEN w[i:i + 2] END, CASE WHEN len(w) > i + 2 THEN w[i:i + 3] END]) AS p FROM starts),
f AS (SELECT lang, p, count(*) AS f FROM grams WHERE p IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, cast(sum(f) AS bigint) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1 AND f >= 30),
inside AS (SELECT lang, p[i:i + m - 1] AS p, max(a) AS longer
           FROM (SELECT lang, p, a, unnest([[1, 2], [2, 2], [3, 2], [1, 3], [2, 3]]) AS im FROM c WHERE len(p) > 2), LATERAL (SELECT im[1] AS i, im[2] AS m)
           WHERE m < len(p) AND i + m - 1 <= len(p) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
cut AS (SELECT lang, p, a, unnest(generate_series(1, len(p) - 1)) AS k FROM kept),
scored AS (SELECT cut.lang, cut.p, a, k, x.f AS l, y.f AS r, cast((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS bigint) AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.p = cut.p[1:k] JOIN f y ON y.lang = cut.lang AND y.p = cut.p[k + 1:len(cut.p)]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, score FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

OP13 = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, cast(list_inner_product(a.x, b.x) AS bigint) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, cast(rank AS integer) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

TEXTS = {"op3_decontamination": OP3, "op8_quality_rules": OP8, "op12_collocations": OP12, "op13_hard_negatives": OP13}
