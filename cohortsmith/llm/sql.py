"""What the queries must return, as DuckDB SQL over the same tables, where SQL can say it."""

from . import quality_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM n),
s AS (SELECT doc_id, g, min(i) AS b, max(i) + 100 AS e FROM g GROUP BY ALL),
p AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS f FROM s),
k AS (SELECT doc_id, count(*) AS n_spans, sum(e - b) AS gone, max(e) AS last, string_agg(substr(h, 2 * f + 1, 2 * (b - f)), '' ORDER BY b) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM x) WHERE f < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM r)),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT a.doc_id, count(*) FILTER (c.i IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY a.i) FILTER (c.i IS NULL) AS kept
      FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.i = c.i GROUP BY a.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""



def _op9(alpha: float = quality_rules.ALPHA, delta: float = quality_rules.DELTA) -> str:
    features = quality_rules.FEATURES
    strata = len(quality_rules.STRATA) + 1
    value = {f: f"floor(1000 * {a} / greatest({b}, 1))" for f, (a, b, _) in features.items()}
    bins = {f: " + ".join(f"({value[f]} > {x})::INT" for x in bounds) for f, (_, _, bounds) in features.items()}
    n_bins = len(next(iter(features.values()))[2]) + 1
    return f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM b),
x AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM x) WHERE n > 1),
e AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, 8)) AS j FROM d) GROUP BY r),
q AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) AS n_upper FROM w LEFT JOIN e USING (r)),
f AS (SELECT *, {', '.join(f'{v} AS bin_{k}' for k, v in bins.items())}, {' + '.join(f'(n_words >= {x})::INT' for x in quality_rules.STRATA)} AS stratum FROM q),
k AS (SELECT f.*, quality, md5(doc_id::VARCHAR) < '8' AS half FROM f JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
c AS ({' UNION ALL '.join(f"SELECT '{k}' AS feature, bin_{k} AS bin, quality FROM k WHERE half" for k in features)}),
g AS (SELECT feature, bin, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 1) AS good FROM (FROM c UNION ALL SELECT DISTINCT feature, unnest(range(0, {n_bins})), NULL FROM c) GROUP BY ALL),
o AS (SELECT feature, bin, floor(100 * ln(((bad + 1) * (sum(good) OVER p + {n_bins}))::DOUBLE / ((good + 1) * (sum(bad) OVER p + {n_bins}))::DOUBLE) + 0.5) AS odds FROM g WINDOW p AS (PARTITION BY feature)),
s AS (SELECT f.*, {' + '.join(f'coalesce(o_{k}.odds, 0)' for k in features)} AS score FROM f {' '.join(f"LEFT JOIN o o_{k} ON o_{k}.feature = '{k}' AND o_{k}.bin = bin_{k}" for k in features)}),
h AS (SELECT stratum, score FROM s JOIN labels USING (doc_id) WHERE quality = 1 AND md5(doc_id::VARCHAR) >= '8'),
t AS (SELECT stratum, cut, count(*) AS n, count(*) FILTER (score > cut) AS k FROM h, (SELECT unnest({list(quality_rules.CUTOFFS)}) AS cut) GROUP BY ALL),
u AS (SELECT stratum, cut, k <= n * {alpha} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})))) <= {delta / strata} AS ok FROM t),
v AS (SELECT stratum, min(cut) AS cutoff FROM u WHERE ok AND NOT EXISTS (FROM u z WHERE z.stratum = u.stratum AND z.cut > u.cut AND NOT z.ok) GROUP BY stratum),
y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s LEFT JOIN v USING (stratum))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND NOT coalesce(score > cutoff, false) AS kept, score::BIGINT AS score FROM y
"""


OP1 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS x(i)),
e AS (SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS r, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS x FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(r) + 1 + length(x) + 10 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9 = _op9()

ORACLES = {"op1_chat_formatting": OP1, "op9_quality_rules": OP9, "op2_suffix_array_dedup": OP2, "op4_substring_dedup": OP4}
