"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_REACH = """reach AS (SELECT u, u AS v FROM nodes UNION SELECT reach.u, l.v FROM reach JOIN links l ON reach.v = l.u)"""

ORACLES = {
    "op5_minhash_dedup": f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
entries AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v FROM entries a JOIN entries b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs), nodes AS (SELECT doc_id AS u FROM sets), {_REACH},
comps AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN comps ON doc_id = u""",
    "op7_itq_dedup": f"""WITH RECURSIVE vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
usable AS (SELECT * FROM vecs WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0),
pairs AS (SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs), nodes AS (SELECT vec_id AS u FROM vecs), {_REACH},
comps AS (SELECT u, min(v) AS c FROM reach GROUP BY u), counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept FROM vecs JOIN comps ON vec_id = comps.u LEFT JOIN counts ON vec_id = counts.u""",
    "op9_chat_prefix": r"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\.s>'), '</s>', '<\./s>'), '[INST]', '[\.INST]'), '[/INST]', '[\./INST]') AS body FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(role) + length(body) + 20) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples FROM shown GROUP BY conv_id""",
    "op11_filter_orders": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN said USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT 'A' AS f, 1 AS bit UNION ALL SELECT 'B', 2 UNION ALL SELECT 'C', 4 UNION ALL SELECT 'D', 8 UNION ALL SELECT 'E', 16),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, s.step, bits[s.step] AS bit, CAST(list_sum(bits[1:s.step]) AS INTEGER) - bits[s.step] AS gone FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
counted AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (gone + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & gone = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & gone <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & gone = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & gone = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted""",
    "op13_fim_checkpoints": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
c AS (SELECT *, least(a, b) AS p, greatest(a, b) - least(a, b) AS m, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, m) AS mid, substr(t, p + m + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(m AS BIGINT) END AS middle_chars, sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM o""",
}
