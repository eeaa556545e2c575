"""DuckDB SQL for the queries that SQL can express, by plain means (loops over bytes, ranks, running sums)."""

#: crc32 of a list of bytes, with the table of the reflected polynomial 0xEDB88320 made from its rule.
_CRC = """
bits AS (SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)),
crc_steps AS (SELECT i, list_reduce([i::UBIGINT] || [x::UBIGINT for x in range(8)],
                lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM bits),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps)"""

_BYTES = ("list_transform(range(0, strlen(coalesce(text, ''))), lambda p: "
          "('0x' || substr(h, (2 * p + 1)::BIGINT, 2))::UBIGINT)")

OP1 = f"""
WITH RECURSIVE {_CRC},
sized AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size,
    xor(list_reduce([4294967295::UBIGINT] || {_BYTES},
        lambda c, b: xor(c >> 8, t[((xor(c, b)) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents), crc_table),
jump AS (
  SELECT doc_id, -1::BIGINT AS b, 0::BIGINT AS j, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS k
  FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT, k2
  FROM (SELECT doc_id, j, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616 AS k2 FROM jump WHERE j < 41)),
shards AS (SELECT doc_id, max(b) FILTER (b < 40) AS shard, max(b) AS grown_shard FROM jump GROUP BY doc_id)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', d.doc_id, text_crc32)), 1, 3),
                     d.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM sized d JOIN shards s ON d.doc_id IS NOT DISTINCT FROM s.doc_id"""

OP7 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', 'mix-1', doc_id)) AS place FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM docs GROUP BY source),
-- clamp the sources above their cap and share again what is left, until none is above
fill AS (
  SELECT 0 AS step, source, weight, source_size, false AS full_, (SELECT sum(source_size) FROM sources)::BIGINT AS left_,
         (SELECT sum(weight) FROM sources)::BIGINT AS share FROM sources
  UNION ALL
  SELECT step + 1, source, weight, source_size, now_full,
         (sum(source_size) OVER () - coalesce(sum(CASE WHEN now_full THEN 3 * source_size END) OVER (), 0))::BIGINT,
         coalesce(sum(CASE WHEN NOT now_full THEN weight END) OVER (), 0)::BIGINT
  FROM (SELECT *, full_ OR left_ * weight > 3 * source_size * share AS now_full FROM fill)
  WHERE step < (SELECT count(*) FROM sources)),
targets AS (
  SELECT source, source_size, CASE WHEN full_ THEN (3 * source_size)::DOUBLE
         ELSE (left_ * weight)::DOUBLE / share END AS target
  FROM fill WHERE step = (SELECT count(*) FROM sources)),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
run AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM docs)
SELECT r.doc_id, r.size, t.source_size, t.target,
  (r.size * least(whole + CASE WHEN r.cum::DOUBLE + r.size / 2.0 <= greatest(target - (whole * source_size)::DOUBLE, 0) THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM run r JOIN rates t ON r.source IS NOT DISTINCT FROM t.source"""

OP2 = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u) USING (vec_id)"""

OP3 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM r"""

OP8 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(role = 'assistant', false) AS trained
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL
        VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (trained), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (trained), '')) AS loss_sha256,
  -- each turn: 4 + role + 2 + text + 8 characters, and a backslash for each escaped one
  sum(14 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rn, x, sha256(array_to_string(ws[x:x + 34], ' ')) AS h
      FROM (SELECT rn, ws, unnest(range(1, len(ws) - 33)) AS x FROM d)),
again AS (SELECT rn, x FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT rn, unnest(range(x, x + 35)) AS i FROM again),
words AS (SELECT rn, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
left_ AS (SELECT rn, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (rn, i) GROUP BY rn)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_ USING (rn)"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (
  SELECT *, len(ls) AS n, ('0x' || h[1:8])::UBIGINT % (len(ls) + 1) AS one, ('0x' || h[9:16])::UBIGINT % (len(ls) + 1) AS two,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 100
              THEN 'plain' WHEN ('0x' || h[25:32])::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (
  SELECT *, array_to_string(ls[1:least(one, two)::BIGINT], '') AS p, array_to_string(ls[least(one, two)::BIGINT + 1:greatest(one, two)::BIGINT], '') AS m,
         array_to_string(ls[greatest(one, two)::BIGINT + 1:], '') AS s FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""

OP12 = rf"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, r, count(*) AS c FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
    FROM documents) GROUP BY ALL),
marked AS (
  SELECT r, c, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(0, strlen(k)), lambda p: ('0x' || substr(hex(encode(k)), (2 * p + 1)::BIGINT, 2))::UBIGINT),
      lambda c, b: xor(c >> 8, t[((xor(c, b)) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h
  FROM (SELECT r, c, coalesce(doc_id::VARCHAR, '') || ':' || r AS k FROM runs WHERE length(r) >= 5), crc_table),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word FROM marked)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word AS u, y.word AS v, y.n FROM gaps x JOIN gaps y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.a || g.b
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.a || g.b),
best AS (SELECT u, count(*) AS n_near, first(v ORDER BY n DESC, v) AS v, max(n) AS most FROM near GROUP BY u),
told AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 2 * n THEN v END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n
  FROM words LEFT JOIN best ON word = u),
walk AS (
  SELECT word, word AS here, 0 AS step FROM told
  UNION ALL SELECT k.word, t.form, step + 1 FROM walk k JOIN told t ON k.here = t.word WHERE t.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)"""


def _level(rows: str, above: str) -> str:
    """Prior strength of a level by moments; ``above`` is the mean above each member."""
    spread = f"sum((k - n * {above}) ** 2) - sum(n * {above} * (1 - {above}))"
    return f"(SELECT 1 / least(greatest(coalesce(({spread}) / nullif(sum(n * (n - 1) * {above} * (1 - {above})), 0), 1.0), 1e-4), 0.5) - 1 FROM {rows} WHERE n > 0)"


OP13 = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
parted AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS r FROM rules),
g AS (SELECT doc_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) <> 1 THEN 1 WHEN quality IS NULL AND coalesce(toxic, 0) <> 1 THEN NULL ELSE 0 END AS good FROM labels),
hosts AS (
  SELECT *, string_split(name, '.') AS parts FROM (
    SELECT host, regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g') AS name, count(good) AS n, coalesce(sum(good), 0) AS k
    FROM p LEFT JOIN g ON page_id = doc_id GROUP BY host)),
named AS (
  SELECT host, n, k, CASE WHEN digits THEN name ELSE array_to_string(parts[-1 - deep:], '.') END AS domain,
         CASE WHEN digits THEN '' ELSE array_to_string(parts[-deep:], '.') END AS suffix
  FROM (SELECT *, regexp_matches(name, '^[0-9.]+$|^\[') AS digits,
               CASE WHEN array_to_string(parts[-2:], '.') IN ('ac.uk', 'co.uk', 'gov.uk', 'org.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'ne.jp',
                    'or.jp', 'co.nz', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'co.in', 'co.kr', 'co.za') THEN 2 ELSE 1 END AS deep FROM hosts)),
top AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS m FROM named),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM named, top GROUP BY suffix),
s1 AS (SELECT suffix, (k + w * m) / (n + w) AS m FROM s0, (SELECT {_level('s0', 'm')} AS w)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM named JOIN s1 USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT domain, suffix, (k + w * m) / (n + w) AS m FROM d0, (SELECT {_level('d0', 'm')} AS w)),
h0 AS (SELECT host, n, k, m FROM named JOIN d1 USING (domain, suffix)),
h1 AS (SELECT host, (k + w * m) / (n + w) AS rate, n + w AS weight FROM h0, (SELECT {_level('h0', 'm')} AS w)),
h2 AS (SELECT host, least(rate + least(sqrt(rate * (1 - rate) / (weight + 1) * (0.95 / 0.05)), sqrt(ln(1 / 0.05) / (2 * (weight + 1)))), 1) AS bound FROM h1),
fits AS (
  SELECT DISTINCT host, path, first(rule) OVER w AS rule, first(verdict) OVER w AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN parted ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r)
  WINDOW w AS (PARTITION BY host, path ORDER BY length(rule) DESC, rule))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN h2 USING (host) LEFT JOIN fits USING (host, path)"""

SQL: dict[str, str] = {"op1_sharding": OP1, "op2_nn_descent": OP2, "op3_exact_dedup": OP3, "op7_mixing": OP7, "op8_chat": OP8,
                       "op10_substring": OP10, "op11_fim": OP11, "op12_spelling": OP12, "op13_url_filter": OP13}
