"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from cuelake.llm import minhash, postings, quality, resample, topk
from cuelake.llm.common import LOWER, UPPER

_RULES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "capitals_share": ("n_capitals", "word_chars"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
}
_TESTS = " UNION ALL ".join(
    f"SELECT stratum, '{r}' AS rule, {c} AS cutoff, count(*) AS n, count(*) FILTER (100 * {_RULES[r][0]} > {c} * {_RULES[r][1]}) AS k FROM good GROUP BY stratum"
    for r, cuts in quality.RULES.items()
    for c in cuts
)
_P = quality.ALPHA / len(quality.RULES)

OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM w)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {quality.WINDOW})) AS p FROM dup) GROUP BY doc_id),
q AS (SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(t, '[!|]')) AS n_marks,
             len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals, len(ls) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
good AS (SELECT q.* FROM q JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) l ON q.doc_id = l.doc_id),
tests AS ({_TESTS}),
bound AS (SELECT *, CASE WHEN k <= n * {_P} THEN (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_P}) + (n - j) * ln(1 - {_P})))
                 FROM (SELECT unnest(range(0, k + 1)) AS j)) ELSE 1 END AS p FROM tests),
cut AS (SELECT stratum, {", ".join(f"min(cutoff) FILTER (rule = '{r}') AS {r}" for r in quality.RULES)}
        FROM bound WHERE p <= {quality.DELTA} / (SELECT count(*) FROM tests) GROUP BY stratum),
j AS (SELECT q.*, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
             {" OR ".join(f"coalesce(100 * {a} > cut.{r} * {b}, false)" for r, (a, b) in _RULES.items())} AS over
      FROM q LEFT JOIN cut ON q.stratum = cut.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept FROM j
"""

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {minhash.SHINGLE - 1}], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {minhash.SHINGLE - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= {minhash.PERCENT} * (x.n + y.n - inter)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id,
       coalesce(c.low, w.doc_id) >= w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.doc_id
"""

OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + {postings.WINDOW - 1}], ' ') AS g, least(len(ws), {postings.WINDOW}) AS size
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {postings.WINDOW - 2}, 2))) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS g
       FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
hit AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.size = bw.size),
pos AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(own.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(own.ids, '')) AS items_sha256, pos.n IS NOT NULL AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN own ON d.doc_id = own.doc_id
"""

_ESC = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l'), '[', chr(92) || 'b')"
OP8 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
             coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS said,
             sum(24 + length(replace({_ESC.format("role")}, chr(10), chr(92) || 'n')) + length({_ESC.format("text")})) AS chars FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(spoken) AS turns_sha256, CAST(length(said) AS BIGINT) AS loss_chars,
       sha256(said) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""

OP11 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= {topk.K}
"""

_WORDS13 = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
# CRC-32 by its rule: eight shifts make the table of 256, and a word's bytes are folded through it.
_SHIFT = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
OP13 = f"""
WITH RECURSIVE t8 AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, {_SHIFT}, k + 1 FROM t8 WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t8 WHERE k = 8),
d AS (SELECT doc_id, {_WORDS13} AS ws FROM documents), b AS (SELECT {_WORDS13} AS ws FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY ALL),
word AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST(concat('0x', substr(h, i, 2)) AS BIGINT))),
                                  lambda c, x: xor(tab[xor(c, x) % 256 + 1], c // 256)), 4294967295) % {resample.BUCKETS} AS bucket FROM word, tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN crc ON dw.w = crc.w GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN crc ON bw.w = crc.w GROUP BY bucket),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {resample.BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {resample.BUCKETS})::DOUBLE))) AS BIGINT) AS gain
      FROM s LEFT JOIN t ON s.bucket = t.bucket),
w AS (SELECT doc_id, sum(n * gain) AS weight FROM dw JOIN crc ON dw.w = crc.w JOIN g ON g.bucket = crc.bucket GROUP BY doc_id),
r AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256('{resample.SEED}:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5)::DOUBLE / 4294967296.0::DOUBLE))) AS BIGINT) AS u
      FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
k AS (SELECT *, weight + u AS score, row_number() OVER (PARTITION BY n_features >= {resample.LEAST_WORDS} ORDER BY weight + u DESC, doc_id) AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {resample.LEAST_WORDS} AND place <= (SELECT count(*) FILTER (n_features >= {resample.LEAST_WORDS}) * {resample.PERCENT} // 100 FROM r) THEN place END AS rank FROM k
"""

ORACLES: dict[str, str] = {"op2_minhash_dedup": OP2, "op4_decontamination": OP4, "op8_chat_format": OP8, "op10_quality_rules": OP10, "op11_topk": OP11, "op13_resampling": OP13}
