"""DuckDB SQL of those queries that SQL can express, written on its own from the definitions."""

OP1 = r"""
WITH judged AS (
  SELECT *, lower(regexp_replace(u, '(?s)^.*?://', '')) AS text,
         translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT DISTINCT coalesce(url, '') AS u FROM pages)),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    ('0x' || substr(md5('held|' || u), 1, 8))::BIGINT % 5 = 0 AS held
  FROM judged),
labelled AS (SELECT *, CASE WHEN rule IS NOT NULL THEN rule IN ('example.net/en/', 'org/fr/') END AS accepted FROM ruled),
symbols AS (
  SELECT u, k, CASE WHEN place = 0 THEN 45 ELSE place END AS sym
  FROM (SELECT u, k, instr('abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&%', substr(text, k, 1)) AS place
        FROM (SELECT u, text, unnest(range(1, length(text) + 1)) AS k FROM labelled))),
coded AS (
  SELECT u, coalesce(lag(sym, 2) OVER w, 0) AS x, coalesce(lag(sym, 1) OVER w, 0) AS y, sym AS z
  FROM symbols WINDOW w AS (PARTITION BY u ORDER BY k)),
counts AS (
  SELECT x, y, z, count(*) FILTER (WHERE accepted) AS a, count(*) FILTER (WHERE NOT accepted) AS r
  FROM coded c JOIN labelled l ON c.u = l.u WHERE rule IS NOT NULL AND NOT held GROUP BY x, y, z),
cells AS (
  SELECT g.x, g.y, g.z, coalesce(a, 0) AS a, coalesce(r, 0) AS r
  FROM (SELECT DISTINCT x, y, z FROM coded UNION SELECT x, y, z FROM counts) g
  LEFT JOIN counts c ON g.x = c.x AND g.y = c.y AND g.z = c.z),
sums AS (
  SELECT *, sum(a) OVER () AS na, sum(r) OVER () AS nr,
    sum(a) OVER (PARTITION BY z) AS az, sum(r) OVER (PARTITION BY z) AS rz,
    sum(a) OVER (PARTITION BY y) AS ay, sum(r) OVER (PARTITION BY y) AS ry,
    sum(a) OVER (PARTITION BY y, z) AS ayz, sum(r) OVER (PARTITION BY y, z) AS ryz,
    sum(a) OVER (PARTITION BY x, y) AS axy, sum(r) OVER (PARTITION BY x, y) AS rxy
  FROM cells),
model AS (
  SELECT x, y, z, CASE WHEN na > 0 AND nr > 0 THEN ln(
      ((a + 2.0::DOUBLE * (ayz + 2.0::DOUBLE * (az + 2.0::DOUBLE / 46) / (na + 2)) / (ay + 2)) / (axy + 2))
    / ((r + 2.0::DOUBLE * (ryz + 2.0::DOUBLE * (rz + 2.0::DOUBLE / 46) / (nr + 2)) / (ry + 2)) / (rxy + 2))) ELSE 0 END AS ratio
  FROM sums),
scores AS (
  SELECT u, round(avg(ratio), 6) AS score
  FROM coded c JOIN model m ON c.x = m.x AND c.y = m.y AND c.z = m.z GROUP BY u),
scored AS (SELECT l.*, coalesce(s.score, 0)::DOUBLE AS score FROM labelled l LEFT JOIN scores s ON l.u = s.u),
bins AS (
  SELECT bin, sum(a) AS a, sum(r) AS r FROM (
    SELECT floor(score * 100)::BIGINT AS bin, accepted::INT AS a, 1 - accepted::INT AS r FROM scored WHERE rule IS NOT NULL AND held
    UNION ALL SELECT 0, 0, 0) GROUP BY bin),
costs AS (
  SELECT bin, coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(r) OVER ()
    + sum(r) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * sum(a) OVER () AS cost FROM bins),
threshold AS (SELECT bin AS t FROM costs ORDER BY cost, abs(bin), bin LIMIT 1)
SELECT p.page_id, s.host, s.path, s.rule, s.score,
  CASE WHEN coalesce(s.accepted, floor(s.score * 100) >= (SELECT t FROM threshold)) THEN 'allow' ELSE 'block' END AS verdict
FROM pages p JOIN scored s ON coalesce(p.url, '') = s.u
"""

OP7 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM both_ways
  UNION
  SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
lowest AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(l.low, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(l.low, w.doc_id) AS kept
FROM worded w LEFT JOIN sizes s ON w.doc_id = s.doc_id LEFT JOIN lowest l ON w.doc_id = l.doc_id
"""

#: windows stay within 128 places of a conversation and repeat from the 128 before
OP8 = r"""
WITH RECURSIVE all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
    len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\x20\x09-\x0D\p{L}\p{N}_]')) AS tokens,
    length(role) + 23 + length(regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '([<\[])(/?(?:s>|INST\]))', '\1' || chr(92) || chr(92) || '\2', 'g')) AS chars
  FROM all_turns),
systems AS (SELECT conv_id, tokens AS sys_tokens, chars AS sys_chars FROM counted WHERE place = 1 AND role = 'system'),
numbered AS (
  SELECT c.*, (place - 1) // 128 AS seg, row_number() OVER (PARTITION BY c.conv_id ORDER BY place) - 1 AS i,
    sum(tokens) OVER (PARTITION BY c.conv_id ORDER BY place) - tokens AS before,
    greatest(512 - coalesce(sys_tokens, 0) - 96, 1) AS room, coalesce(sys_chars, 0) AS sys_chars
  FROM counted c LEFT JOIN systems s ON c.conv_id = s.conv_id
  WHERE s.conv_id IS NULL OR c.place > 1),
walk AS (
  SELECT conv_id, i, seg, before AS base, true AS opens FROM numbered WHERE i = 0
  UNION ALL
  SELECT n.conv_id, n.i, n.seg, CASE WHEN n.before + n.tokens - w.base > n.room OR n.seg > w.seg THEN n.before ELSE w.base END,
    n.before + n.tokens - w.base > n.room OR n.seg > w.seg
  FROM walk w JOIN numbered n ON n.conv_id = w.conv_id AND n.i = w.i + 1),
repeats AS (
  SELECT o.conv_id, sum(h.chars) AS chars
  FROM walk o JOIN numbered s ON s.conv_id = o.conv_id AND s.i = o.i
  JOIN numbered h ON h.conv_id = o.conv_id AND h.i < o.i AND s.before - h.before <= 96 AND h.seg >= s.seg - 1
  WHERE o.opens GROUP BY o.conv_id),
windows AS (SELECT conv_id, count(*) AS windows FROM walk WHERE opens GROUP BY conv_id),
said AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM counted GROUP BY conv_id)
SELECT s.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  (s.chars + coalesce(r.chars, 0) + coalesce((w.windows - 1) * y.sys_chars, 0))::BIGINT AS formatted_chars
FROM said s LEFT JOIN repeats r ON s.conv_id = r.conv_id LEFT JOIN windows w ON s.conv_id = w.conv_id
LEFT JOIN systems y ON s.conv_id = y.conv_id
"""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS place
  FROM documents),
sizes AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY key, source),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS n, source_size * 3 AS cap FROM sizes),
weighted AS (SELECT *, (1 + (n - 1) % 3)::BIGINT AS weight FROM ordered),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted),
targets AS (
  SELECT key, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target,
         greatest(ceil(source_size / 262144.0), 1)::BIGINT AS shards
  FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.target, s.place % t.shards AS shard FROM sized s JOIN targets t ON s.key = t.key),
words AS (SELECT key, shard, sum(size)::BIGINT AS words FROM placed GROUP BY key, shard),
shards AS (
  SELECT *, CASE WHEN words > 0 THEN greatest(round(words / 64.0), 1)::BIGINT ELSE 0 END AS blocks FROM words),
ballots AS (
  SELECT t.key, b.blocks, CASE WHEN t.source_size > 0 THEN t.target * b.blocks / t.source_size ELSE 0.0 END::DOUBLE AS votes
  FROM targets t JOIN (SELECT key, sum(blocks)::BIGINT AS blocks FROM shards GROUP BY key) b ON t.key = b.key),
seats AS (SELECT *, round(sum(votes) OVER ())::BIGINT AS seats FROM ballots),
quotients AS (
  SELECT key, row_number() OVER (ORDER BY votes / (2 * s + 1) DESC, key) AS rank, seats
  FROM (SELECT *, unnest(range(0, (ceil(votes) + 2)::BIGINT)) AS s FROM seats WHERE votes > 0)),
won AS (SELECT key, count(*)::BIGINT AS won FROM quotients WHERE rank <= seats GROUP BY key),
source_quota AS (
  SELECT s.key, least(coalesce(w.won, 0), 3 * s.blocks) AS seats FROM seats s LEFT JOIN won w ON s.key = w.key),
shard_quotients AS (
  SELECT key, shard, seats, row_number() OVER (PARTITION BY key ORDER BY blocks::DOUBLE / (2 * s + 1) DESC, shard) AS rank
  FROM (SELECT h.*, q.seats, unnest(range(0, 3 * h.blocks + 2)) AS s
        FROM shards h JOIN source_quota q ON h.key = q.key WHERE h.blocks > 0)),
shard_won AS (SELECT key, shard, count(*)::BIGINT AS quota FROM shard_quotients WHERE rank <= seats GROUP BY key, shard),
spans AS (
  SELECT p.*, h.words, h.blocks, coalesce(w.quota, 0) AS quota,
         row_number() OVER (ORDER BY p.doc_id) AS row_no,
         ('0x' || substr(md5('1|' || p.key || '|' || p.shard::VARCHAR), 1, 8))::BIGINT AS shift,
         sum(p.size) OVER (PARTITION BY p.key, p.shard ORDER BY p.place, p.doc_id, p.size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM placed p JOIN shards h ON p.key = h.key AND p.shard = h.shard
  LEFT JOIN shard_won w ON p.key = w.key AND p.shard = w.shard),
pieces AS (
  SELECT row_no, sum(CASE WHEN (j * 2654435761 + shift) % blocks < quota % blocks
      THEN least(stop, (j + 1) * words // blocks) - greatest(stop - size, j * words // blocks) ELSE 0 END)::BIGINT AS more
  FROM (SELECT *, unnest(range(((stop - size + 1) * blocks - 1) // words, (stop * blocks - 1) // words + 1)) AS j
        FROM spans WHERE size > 0)
  GROUP BY row_no)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN (quota // blocks) * size + coalesce(more, 0) ELSE 0 END::BIGINT AS taken
FROM spans s LEFT JOIN pieces p ON s.row_no = p.row_no
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f) AS n FROM phrases WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f FROM phrases WHERE k >= 2 AND f >= 100),
cuts AS (
  SELECT lang, k, phrase, f, unnest(range(1, k)) AS c, string_split(phrase, ' ') AS w FROM candidates),
valued AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, c.c, x.f AS l, y.f AS r, t.n::BIGINT AS n,
    (1000::HUGEINT * c.f * t.n::HUGEINT) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c
  JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.c], ' ')
  JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.c + 1:], ' ')
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM candidates g
    WHERE g.lang = s.lang AND g.k > s.k AND g.f >= s.a AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

#: the digest is the CRC of gzip, here bit by bit over the bytes of each distinct id and word
OP12 = r"""
WITH RECURSIVE runs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL),
tables AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS b))),
digests AS (
  SELECT run, c, 4294967295 - list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(id || ':' || run))), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2))::BIGINT)),
      lambda x, b: xor(x // 256, t[xor(x % 256, b) + 1])) AS h
  FROM runs, tables),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM digests)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS rest FROM places),
holes AS (SELECT word, n, left(word, i - 1) || chr(0) || substr(word, i + 1) AS hole FROM places),
pairs AS (
  SELECT c.word AS a, c.n AS an, w.word AS b, w.n AS bn FROM cuts c JOIN words w ON c.rest = w.word
  UNION ALL SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION ALL SELECT x.word, x.n, y.word, y.n FROM holes x JOIN holes y ON x.hole = y.hole AND x.word <> y.word),
near AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY bn DESC, b) AS form, max(bn) AS form_n FROM pairs GROUP BY a),
forms AS (
  SELECT w.word, w.n, coalesce(p.n_near, 0) AS n_near,
    CASE WHEN p.form_n >= 2 * w.n THEN p.form END AS form, CASE WHEN p.form_n >= 2 * w.n THEN p.form_n END AS form_n
  FROM words w LEFT JOIN near p ON w.word = p.a),
walk AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL
  SELECT k.word, f.form, k.steps + 1 FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON f.word = r.word
"""
