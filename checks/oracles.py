"""The registered queries in DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

WS = r"'\s+', ' ', 'g'"

# Question table (see projections.questions); j<letter> = option text as JSON string.
Q = rf"""
q0 AS (
  SELECT d.doc_id AS id,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 10 = 9 THEN 'Q' || (d.doc_id - 1) ELSE 'Q' || d.doc_id END AS id_qc,
    d.text AS enunciado, lower(trim(regexp_replace(d.text, {WS}))) AS norm,
    CASE l.quality WHEN 1 THEN 'C' WHEN 0 THEN 'E' END AS gabarito,
    CASE WHEN d.doc_id % 3 = 0 THEN 'c' || d.doc_id END AS comentario,
    d.lang AS materia, CASE WHEN d.doc_id % 6 = 0 THEN '' ELSE d.source END AS assunto,
    CAST(2015 + d.doc_id % 12 AS INT) AS ano,
    CASE CAST(substr(d.source, 4) AS INT) % 3 WHEN 0 THEN 'qconcursos' WHEN 1 THEN 'pci' ELSE 'quadrix_pdf' END AS fonte,
    CAST(coalesce(l.toxic, 0) AS INT) AS usada,
    CASE d.doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN d.lang END AS texto_associado,
    CASE WHEN d.doc_id % 5 = 0 THEN 'i' || d.doc_id END AS imagem,
    CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.source END AS categoria,
    CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE 't' || (d.doc_id % 5) END AS tema,
    CAST(d.doc_id % 3 AS INT) AS n_urls,
    'banca' || (d.doc_id % 4) AS banca, 'orgao' || (d.doc_id % 3) AS orgao, 'cargo' || (d.doc_id % 2) AS cargo,
    (length(d.text) + 4) // 5 AS w, d.doc_id AS seq
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
q1 AS (
  SELECT *, substr(enunciado, 1, w) AS oa, substr(enunciado, 1 + w, w) AS ob, substr(enunciado, 1 + 2 * w, w) AS oc,
    substr(enunciado, 1 + 3 * w, w) AS od,
    CASE WHEN id % 9 = 0 THEN NULL ELSE substr(enunciado, 1 + 4 * w, w) END AS oe,
    CASE WHEN id % 17 = 0 THEN 'F' ELSE 'E' END AS le
  FROM q0),
q AS (
  SELECT *, sha256(norm) AS hash_enunciado,
    '{{"A": ' || to_json(oa) || ', "B": ' || to_json(ob) || ', "C": ' || to_json(oc) || ', "D": ' || to_json(od)
      || CASE WHEN oe IS NULL THEN '' ELSE ', "' || le || '": ' || to_json(oe) END || '}}' AS canon,
    CASE WHEN oe IS NULL THEN ['A','B','C','D'] ELSE ['A','B','C','D', le] END AS letras,
    CASE WHEN oe IS NULL THEN [oa, ob, oc, od] ELSE [oa, ob, oc, od, oe] END AS textos,
    md5(norm || '|' || '{{"A": ' || to_json(oa) || ', "B": ' || to_json(ob) || ', "C": ' || to_json(oc) || ', "D": ' || to_json(od)
      || CASE WHEN oe IS NULL THEN '' ELSE ', "' || le || '": ' || to_json(oe) END || '}}') AS content_hash
  FROM q1)"""

SPECS = """
s0 AS (
  SELECT n_name, n_nationkey, 'cargo' || ((c_custkey // 5) % 2) AS cargo, CAST(c_custkey % 5 AS INT) + 1 AS ordinal, count(*) AS peso
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
specs AS (
  SELECT n_name AS concurso, 'Concurso ' || n_name AS nome,
    CASE WHEN n_nationkey % 6 <> 5 THEN 'banca' || (n_nationkey % 4) END AS banca, CAST(2020 + n_nationkey % 5 AS INT) AS ano,
    'orgao' || (n_nationkey % 3) AS orgao, 'Multipla_Escolha' AS formato,
    CAST(sum(peso) OVER (PARTITION BY n_name, cargo) + n_nationkey % 3 AS INT) AS total_questoes, 120 AS tempo_minutos,
    cargo, 'superior' AS nivel, CAST(100 + n_nationkey AS INT) AS vagas, ordinal,
    ['en','fr','de','es','it'][ordinal] AS materia, peso, n_name || '/' || cargo AS exam,
    CAST(20 + 10 * (n_nationkey % 5) AS INT) AS q, n_nationkey * 2 + CAST(right(cargo, 1) AS INT) AS exam_pos,
    CAST(right(cargo, 1) AS INT) AS ordem_cargo
  FROM s0)"""

# largest remainder over (exam, q, ordinal, materia, peso)
QUOTAS = SPECS + """,
h0 AS (SELECT *, CASE WHEN sum(peso) OVER e = 0 THEN 0.0 ELSE CAST(q * peso AS DOUBLE) / CAST(sum(peso) OVER e AS DOUBLE) END AS share
       FROM specs WINDOW e AS (PARTITION BY exam)),
h1 AS (SELECT *, CAST(floor(share) AS BIGINT) AS base, q - sum(CAST(floor(share) AS BIGINT)) OVER (PARTITION BY exam) AS rest FROM h0),
quotas AS (SELECT *, base + CASE WHEN row_number() OVER (PARTITION BY exam ORDER BY share - base DESC, ordinal) <= rest THEN 1 ELSE 0 END AS quota FROM h1)"""

PRIORITY = "CASE fonte WHEN 'qconcursos' THEN 1 WHEN 'pci' THEN 2 ELSE 3 END"

# candidates of the draw by subject, unused first
RANKED = f"""
pool AS (SELECT DISTINCT ON (materia, usada, content_hash) materia, usada, content_hash, id FROM q
         ORDER BY materia, usada, content_hash, {PRIORITY}, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY materia ORDER BY usada, content_hash) AS rank FROM pool)"""

ACCEPTED = """
walk AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS n, seq, id_qc AS c, hash_enunciado AS d FROM batch),
steps(n, seq, ok, cs, ds) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT w.n, w.seq, o.ok,
    CASE WHEN o.ok AND w.c IS NOT NULL THEN list_append(s.cs, w.c) ELSE s.cs END,
    CASE WHEN o.ok THEN list_append(s.ds, w.d) ELSE s.ds END
  FROM steps s JOIN walk w ON w.n = s.n + 1,
  LATERAL (SELECT NOT (w.c IS NOT NULL AND list_contains(s.cs, w.c)) AND NOT list_contains(s.ds, w.d) AS ok) o),
accepted AS (SELECT seq FROM steps WHERE ok)"""

PROGRESS = """
latest AS (SELECT event_type AS fonte, CAST(user_id AS VARCHAR) AS chave, arg_max(CAST(floor(value) AS INT), event_id) AS ultima_pagina
           FROM events GROUP BY ALL)"""

TOPICS = """
topics AS (SELECT e.fonte, CAST(s_suppkey AS VARCHAR) AS chave,
             'http://example.org/' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN '?q=1' ELSE '' END AS base
           FROM supplier CROSS JOIN (SELECT unnest(['view', 'click', 'error', 'purchase', 'signup']) AS fonte) e)"""

LOW = r"""
low AS (SELECT doc_id, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[0-9<>&()\[\]:]', '#', 'g') AS low FROM documents),
lw AS (SELECT *, (length(low) + 2) // 3 AS w FROM low)"""

LISTED = """
anchors AS (
  SELECT page_id, regexp_extract(url, '/(en|fr|de|es)/', 1) AS cat,
    unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1)) AS h,
    unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 2)) AS t,
    unnest(range(len(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1)))) AS i
  FROM pages),
words AS (
  SELECT page_id, cat, i, replace(h, '&amp;', '&') AS sub, trim(replace(t, '&amp;', '&')) AS txt FROM anchors
  WHERE regexp_full_match(replace(h, '&amp;', '&'), '[^/"?#]+')),
firsts AS (SELECT page_id, cat, sub, min(i) AS i0, arg_min(txt, i) AS nome FROM words GROUP BY ALL),
temas AS (SELECT page_id, cat, sub, txt, min(i) AS i1 FROM words GROUP BY ALL)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round_even(100.0 * {part} / {whole}, 1) ELSE 0.0 END"


SQL: dict[str, str] = {}

# --- statistics ---------------------------------------------------------------
SQL["a1_stats_by_subject"] = _with(Q) + """
SELECT materia, count(*) AS total, count(*) FILTER (usada = 0) AS ineditas, CAST(sum(usada) AS BIGINT) AS usadas,
  count(*) FILTER (gabarito IS NULL) AS sem_gabarito FROM q GROUP BY materia"""
SQL["a2_source_status"] = _with(Q) + """
SELECT count(*) AS total, count(categoria) AS com_categoria, count(DISTINCT categoria) AS categorias_unicas FROM q WHERE fonte = 'pci'"""
SQL["a2_top_categories"] = _with(Q) + """
SELECT categoria, count(*) AS total FROM q WHERE fonte = 'pci' GROUP BY categoria ORDER BY total DESC, categoria NULLS FIRST LIMIT 10"""
SQL["a3_totals"] = _with(Q) + """
SELECT 'total' AS nivel, NULL AS chave, count(*) AS total FROM q
UNION ALL SELECT 'orgao', orgao, count(*) FROM q GROUP BY orgao
UNION ALL SELECT 'materia', materia, count(*) FROM q GROUP BY materia"""
SQL["a4_subject_profile"] = _with(Q) + """
SELECT materia, count(*) AS total, array_to_string(list_sort(list_distinct(list(fonte))), ', ') AS fontes,
  array_to_string(list_sort(list_distinct(list(categoria)))[1:3], ', ') AS categorias FROM q GROUP BY materia"""
SQL["a4_distinct_totals"] = _with(Q) + """
SELECT count(*) AS total, count(DISTINCT materia) AS materias_unicas, count(DISTINCT fonte) AS fontes_unicas,
  count(DISTINCT categoria) AS categorias_unicas FROM q"""
_TREE = """
SELECT 0 AS nivel, NULL AS categoria, NULL AS tema, count(*) AS total, count(*) FILTER (n_urls > 0) AS com_imagens FROM q WHERE fonte = 'pci'
UNION ALL SELECT 1, categoria, NULL, count(*), count(*) FILTER (n_urls > 0) FROM q WHERE fonte = 'pci' AND categoria IS NOT NULL GROUP BY categoria
UNION ALL SELECT 2, categoria, tema, count(*), count(*) FILTER (n_urls > 0) FROM q
  WHERE fonte = 'pci' AND categoria IS NOT NULL AND tema IS NOT NULL GROUP BY categoria, tema"""
SQL["a5_source_tree"] = _with(Q) + _TREE
SQL["a6_category_report"] = _with(Q) + f"""
SELECT *, {_pct('com_imagens', 'total')} AS percentual_imagens FROM ({_TREE}) WHERE nivel >= 1"""
SQL["a7_live_monitor"] = _with(Q) + """
SELECT count(*) AS total, count(categoria) AS com_categoria, count(tema) AS com_tema,
  round_even(100.0 * count(categoria) / greatest(1, count(*)), 1) AS pct_categoria,
  round_even(100.0 * count(tema) / greatest(1, count(*)), 1) AS pct_tema FROM q WHERE fonte = 'pci'"""
SQL["a7_sample_question"] = _with(Q) + """
SELECT id, materia, categoria, tema, enunciado FROM q WHERE fonte = 'pci' AND categoria IS NOT NULL ORDER BY id LIMIT 1"""
SQL["a8_count_by_source"] = _with(Q) + "SELECT fonte, count(*) AS total FROM q GROUP BY fonte"
SQL["a9_dashboard_counters"] = _with(Q) + """
SELECT count(DISTINCT categoria) AS categorias, count(DISTINCT categoria || '/' || tema) AS temas,
  count(*) FILTER (tema IS NOT NULL AND n_urls > 0) AS com_imagens, count(*) AS total FROM q WHERE fonte = 'pci' AND categoria IS NOT NULL"""
SQL["a10_pending_numbers"] = _with(Q) + """
SELECT DISTINCT materia, substr(id_qc, 2) AS numero FROM q WHERE gabarito IS NULL AND id_qc IS NOT NULL"""
SQL["a10_pending_counts"] = _with(Q) + """
SELECT materia, count(DISTINCT substr(id_qc, 2)) AS pendentes FROM q WHERE gabarito IS NULL AND id_qc IS NOT NULL GROUP BY materia"""
SQL["a11_bank_metrics"] = _with(Q) + """
SELECT count(*) AS total, count(categoria) AS com_categoria, count(*) FILTER (n_urls > 0) AS com_imagens FROM q"""
SQL["a12_distribution"] = _with(Q) + """
SELECT categoria, ano, banca, count(*) AS total, CAST(grouping(categoria, ano, banca) AS INT) AS nivel FROM q GROUP BY CUBE (categoria, ano, banca)"""
SQL["a1_lineitem_scale"] = """
SELECT l_returnflag AS materia, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS ineditas,
  CAST(count(*) FILTER (l_linestatus <> 'F') AS BIGINT) AS usadas, count(*) FILTER (l_linenumber % 2 = 0) AS sem_gabarito
FROM lineitem GROUP BY l_returnflag"""
SQL["a5_lineitem_scale"] = """
SELECT 0 AS nivel, NULL AS categoria, NULL AS tema, count(*) AS total, count(*) FILTER (l_quantity > 25) AS com_imagens FROM lineitem
UNION ALL SELECT 1, CAST(l_suppkey AS VARCHAR), NULL, count(*), count(*) FILTER (l_quantity > 25) FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT 2, CAST(l_suppkey AS VARCHAR), l_returnflag, count(*), count(*) FILTER (l_quantity > 25) FROM lineitem GROUP BY l_suppkey, l_returnflag"""

# --- windows, top-k -------------------------------------------------------------
SQL["w1_first_per_content"] = _with(Q) + f"""
SELECT DISTINCT ON (content_hash) content_hash, id FROM q ORDER BY content_hash, {PRIORITY}, id"""
SQL["w3_shares"] = _with(Q) + """,
c AS (SELECT materia, count(*) AS total FROM q GROUP BY materia),
t AS (SELECT sum(total) AS s, max(total) AS m FROM c)""".replace("WITH RECURSIVE", "") + """
SELECT materia, total, round(100.0 * total / s, 1) AS pct_total, CAST(floor(100.0 * total / s + 0.5) AS BIGINT) AS pct_inteiro,
  round(100.0 * total / m, 1) AS pct_maior, CAST(greatest(0, s - total) AS BIGINT) AS restante FROM c, t"""
SQL["w4_study_streaks"] = """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS dia FROM events),
g AS (SELECT *, dia - CAST(row_number() OVER (PARTITION BY user_id ORDER BY dia) AS INT) AS grupo FROM d),
r AS (SELECT user_id, count(*) AS dias, max(dia) AS ate FROM g GROUP BY user_id, grupo)
SELECT user_id, max(dias) AS maior, coalesce(max(CASE WHEN ate = (SELECT max(dia) FROM d) THEN dias END), 0) AS atual FROM r GROUP BY user_id"""
SQL["t1_top10_categories"] = SQL["a2_top_categories"]
SQL["t2_top3_progress"] = _with(PROGRESS) + """
SELECT fonte, chave, ultima_pagina FROM latest ORDER BY ultima_pagina DESC, fonte, chave LIMIT 3"""
SQL["t3_top_reports"] = _with(Q) + """,
c AS (SELECT 'top15' AS lista, categoria AS nome, count(*) AS total, 15 AS k FROM q GROUP BY categoria
  UNION ALL SELECT 'top10', orgao, count(*), 10 FROM q GROUP BY orgao
  UNION ALL SELECT 'top6', materia, count(*), 6 FROM q GROUP BY materia)""" + """
SELECT lista, nome, total FROM (SELECT *, row_number() OVER (PARTITION BY lista ORDER BY total DESC, nome NULLS FIRST) AS r FROM c) WHERE r <= k"""
SQL["t4_name_lists"] = _with(SPECS) + """
SELECT concurso, row_number() OVER (ORDER BY concurso) AS posicao FROM (SELECT DISTINCT concurso FROM specs)"""
SQL["t5_top_per_group"] = _with(Q, RANKED) + "SELECT materia, id, rank FROM ranked WHERE rank <= 20"

# --- scalar functions -------------------------------------------------------------
SQL["p1_normalize"] = _with(Q) + "SELECT id, norm FROM q"
SQL["p2_statement_hash"] = _with(Q) + "SELECT id, hash_enunciado FROM q"
SQL["p3_content_hash"] = _with(Q) + "SELECT id, canon, content_hash FROM q"
SQL["p4_encode_json"] = _with(Q) + """
SELECT id, CASE WHEN imagem IS NULL THEN NULL ELSE '["' || imagem || '"]' END AS imagens,
  CASE n_urls WHEN 0 THEN '[]' WHEN 1 THEN '["u' || id || '"]' ELSE '["u' || id || '","u' || id || '"]' END AS imagens_urls FROM q"""
SQL["p5_decode_json"] = _with(Q) + """
SELECT id, CASE WHEN id % 17 = 0 THEN NULL ELSE CAST(len(letras) AS INT) END AS opcoes,
  CASE WHEN id % 17 = 0 THEN NULL ELSE ob END AS opcao_b, CASE WHEN imagem IS NULL OR id % 19 = 0 THEN 0 ELSE 1 END AS n_imagens FROM q"""
SQL["p6_slug"] = """
SELECT p_partkey, replace(replace(lower(p_name), ' ', '-'), '_', '-') AS slug,
  replace(replace(lower(p_name), ' ', '_'), ',', '') AS arquivo, left(replace(replace(lower(p_name), ' ', '_'), ',', ''), 20) AS arquivo_curto FROM part"""
SQL["p7_display_name"] = _with(Q) + """
SELECT id, array_to_string(list_transform(string_split(lower(materia || '-' || categoria || '-' || tema), '-'),
    lambda w: upper(w[1]) || w[2:]), ' ') AS nome, upper(replace(materia || '_' || categoria, '_', ' ')) AS maiusculo
FROM q WHERE categoria IS NOT NULL AND tema IS NOT NULL"""
SQL["p8_options_in_order"] = _with(Q) + """
SELECT id, unnest(range(len(letras))) AS pos, unnest(letras) AS letra, unnest(textos) AS texto FROM q"""
SQL["p9_provenance"] = _with(Q) + """
SELECT id, concat_ws(' · ', banca, orgao, CAST(ano AS VARCHAR), nullif(assunto, '')) AS origem FROM q"""
SQL["p10_minutes"] = _with(QUOTAS) + "SELECT exam, CAST(sum(quota) * 3 AS BIGINT) AS minutos FROM quotas GROUP BY exam"
SQL["p11_corrected_source"] = _with(Q) + """
SELECT id, CASE WHEN fonte = 'quadrix_pdf' AND id_qc IS NOT NULL THEN 'pci' ELSE fonte END AS fonte FROM q"""
SQL["p12_origin"] = _with(Q) + """
SELECT id, CASE WHEN id % 5 IN (0, 3, 4) THEN orgao END AS orgao, CASE WHEN id % 5 <> 2 THEN banca END AS banca,
  CASE WHEN id % 5 IN (1, 4) THEN ano END AS ano FROM q"""
SQL["p13_info_line"] = _with(Q) + """
SELECT id, CASE WHEN id % 4 <> 0 THEN CAST(ano AS VARCHAR) END AS ano, banca, orgao, orgao || ' - ' || ano || ' | ' || cargo AS prova FROM q"""
SQL["p14_code_and_year"] = """
SELECT doc_id AS id, nullif(regexp_extract(text || ' Q' || doc_id, '(Q[0-9]+)', 1), '') AS codigo,
  TRY_CAST(regexp_extract(text || ' em ' || (1990 + doc_id % 30), '([0-9]{4})', 1) AS INT) AS ano FROM documents"""
SQL["p15_page_url"] = """
SELECT l_orderkey, l_linenumber, 'http://x/' || l_partkey || CASE WHEN l_linenumber = 1 THEN '' ELSE '/' || l_linenumber END AS url,
  'http://x/' || CASE WHEN l_partkey % 2 = 0 THEN l_partkey || '?a=1&' ELSE l_partkey || '?' END || 'page=' || l_linenumber AS busca FROM lineitem"""
SQL["p16_image_urls"] = """
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS w FROM pages),
u AS (SELECT page_id, CASE WHEN starts_with(w, 't') THEN 'http://cdn/' || replace(w, '&amp;', '&') ELSE 'http://site/' || replace(w, '&amp;', '&') END AS url FROM h WHERE w <> ''
  UNION ALL SELECT page_id, 'http://site/bg' || page_id || '.png' FROM pages)
SELECT DISTINCT page_id, url FROM u"""
SQL["p17_feedback_answer"] = """
SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN substr('EDCBA', CAST(1 + doc_id % 5 AS INT), 1)
  WHEN 1 THEN substr('ABCDE', CAST(1 + doc_id % 5 AS INT), 1) WHEN 2 THEN 'B' END AS gabarito FROM documents"""
SQL["p18_strip_tags"] = r"""
SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS texto FROM pages"""
_COVERAGE = _with(Q, SPECS) + f""",
c AS (SELECT materia, cargo, count(*) AS n FROM q GROUP BY ALL),
j AS (SELECT concurso, s.cargo, s.materia, coalesce(n, 0) AS coletadas, peso AS esperadas FROM specs s LEFT JOIN c ON c.materia = s.materia AND c.cargo = s.cargo),
cov AS (SELECT concurso, cargo, materia, 0 AS nivel_total, coletadas, CAST(esperadas AS BIGINT) AS esperadas FROM j
  UNION ALL SELECT concurso, cargo, NULL, 1, CAST(sum(coletadas) AS BIGINT), CAST(sum(esperadas) AS BIGINT) FROM j GROUP BY concurso, cargo)
SELECT *, {_pct('coletadas', 'esperadas')} AS percentual FROM cov"""
SQL["p19_progress_band"] = f"""
SELECT concurso, cargo, materia, CASE WHEN percentual = 0 THEN 'danger' WHEN percentual < 50 THEN 'warning' ELSE 'success' END AS faixa FROM ({_COVERAGE})"""
SQL["p20_rewards"] = _with(Q) + """,
t AS (SELECT count(*) AS total FROM q WHERE fonte = 'pci')""" + """
SELECT total, total // 10 AS xp, b.badge, b.lim IS NULL OR total > b.lim AS unlocked FROM t,
 (VALUES ('Penalista', 10000), ('Leitor', 5000), ('Streaker', NULL), ('Sniper', 30000), ('Mestre', 50000), ('Finalista', 40000)) b(badge, lim)"""

# --- extraction ----------------------------------------------------------------------
SQL["x1_site_a_blocks"] = _with(Q) + """
SELECT id // 10 AS page_id, CAST(row_number() OVER (PARTITION BY id // 10 ORDER BY id) - 1 AS INT) AS pos, id_qc, trim(enunciado, E' \\n\\t\\r') AS enunciado,
  array_to_string(list_transform(list_zip(letras, textos), lambda p: p[1] || '=' || trim(p[2], E' \\n\\t\\r')), '|') AS opcoes,
  'Base ' || materia AS texto_associado, '/b/' || id || '.png' AS imagens,
  'http://cdn/' || materia || '.png,http://site/b/' || id || '.png' AS imagens_urls, banca, orgao, ano
FROM q WHERE id_qc IS NOT NULL AND id % 13 <> 0"""
SQL["x2_site_b_blocks"] = _with(Q) + r"""
SELECT id // 10 AS page_id, CAST(row_number() OVER (PARTITION BY id // 10 ORDER BY id) - 1 AS INT) AS pos, id_qc,
  trim(regexp_replace(enunciado, '\s+', ' ', 'g')) AS enunciado,
  array_to_string(list_transform(list_zip(range(len(letras)), letras, textos), lambda p:
    CASE WHEN id % 2 = 0 THEN p[2] ELSE 'ABCDE'[p[1] + 1] END || '=' || trim(regexp_replace('[' || p[3] || ']', '\s+', ' ', 'g'))), '|') AS opcoes,
  materia AS materia_qc, nullif(assunto, '') AS assunto, ano, banca, orgao, orgao || ' - ' || ano AS prova,
  coalesce(texto_associado, '') AS texto_associado, 'i' || id || '.png' AS imagens
FROM q WHERE id_qc IS NOT NULL"""
SQL["x1_sql_function"] = _with(Q) + """
SELECT id // 10 AS page_id, CAST(row_number() OVER (PARTITION BY id // 10 ORDER BY id) - 1 AS INT) AS pos, id_qc, CAST(len(letras) AS INT) AS n_opcoes
FROM q WHERE id_qc IS NOT NULL AND id % 13 <> 0"""
SQL["x3_numbered"] = _with(LOW) + r"""
SELECT doc_id AS page_id, low AS enunciado, 'op ' || trim(substr(low, 1, w)) AS a, trim('op ' || substr(low, 1 + w, w)) AS b,
  trim('op ' || substr(low, 1 + 2 * w, w)) AS c,
  -- a word ending in "gab" at a line end also counts as the answer label of the next line
  nullif(regexp_extract(low || chr(10) || 'A) op ' || substr(low, 1, w) || chr(10) || 'B) op ' || substr(low, 1 + w, w) || chr(10) || 'C) op ' || substr(low, 1 + 2 * w, w)
    || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Gabarito: B' ELSE '' END, '[Gg](?:abarito|ab[.]?)[:\s]+([A-E])', 1), '') AS gabarito
FROM lw WHERE length(low) >= 15"""
SQL["x3_containers"] = _with(LOW) + """
SELECT doc_id AS page_id, low AS enunciado, 'op ' || trim(translate(substr(low, 1, w), 'abcde', '#####')) AS a,
  'op ' || translate(substr(low, 1 + w, w), 'abcde', '#####') || chr(10) || 'Comentário: visto em 2019' AS b, 'visto em 2019' AS comentario, 2019 AS ano
FROM lw WHERE length(low) >= 10"""
SQL["x3_lines"] = _with(LOW) + "SELECT doc_id AS page_id, '7) ' || low AS enunciado FROM lw WHERE length(low) >= 13"
SQL["x3_discovered"] = _with(LOW) + """
SELECT doc_id // 8 AS page_id, CAST(row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) - 1 AS INT) AS pos,
  trim('Questão ' || doc_id || ': ' || coalesce(low, '')) AS enunciado, 'alfa ' || doc_id AS a, 'beta ' || length(coalesce(low, '')) AS b, 'gama ' || doc_id % 7 AS c
FROM lw QUALIFY count(*) OVER (PARTITION BY doc_id // 8) >= 3"""
SQL["x4_hierarchy"] = _with(LISTED) + """
SELECT page_id, cat AS categoria, sub, nome AS sub_nome, '/simulados/' || cat || '/' || sub AS sub_url, 'x-' || sub AS tema,
  t.txt || ' x' AS tema_nome, '/simulados/' || cat || '/' || sub || '/x-' || sub AS tema_url
FROM firsts JOIN temas t USING (page_id, cat, sub)"""
SQL["x4b_topic_urls"] = _with(LISTED) + """
SELECT page_id, cat AS categoria, 'x-' || sub AS tema, '/simulados/' || cat || '/' || sub || '/x-' || sub AS url FROM firsts"""
SQL["x5_base_text"] = _with(Q) + """
SELECT id_qc, 'Base ' || materia AS texto_associado, '/b/' || id || '.png' AS imagem FROM q WHERE id_qc IS NOT NULL AND id % 13 <> 0"""
SQL["x6_page_flags"] = """
SELECT page_id, page_id % 5 = 0 OR contains(lower(html), 'not found') AS nao_encontrada, page_id % 7 = 0 AS conta_bloqueada,
  (page_id % 3 <> 0 AND page_id % 11 = 0) OR page_id % 6 = 0 AS limite_atingido,
  page_id % 3 = 0 OR page_id % 2 = 0 AS botao_bloqueado, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id AS VARCHAR) ELSE '' END AS respondiveis FROM pages"""

# --- filters ------------------------------------------------------------------------
SQL["l1_valid_source"] = _with(Q) + """,
f AS (SELECT id, CASE WHEN id % 23 = 0 THEN NULL WHEN id % 29 = 0 THEN 'outra' ELSE fonte END AS fonte, id % 13 = 0 AS vazia FROM q)""" + """
SELECT id, CASE WHEN fonte IS NULL OR fonte = 'outra' THEN 'invalid_source' WHEN vazia THEN 'no_options' END AS motivo FROM f"""
SQL["l2_draw_filters"] = _with(Q) + """
SELECT id FROM q WHERE materia = 'en' AND banca = 'banca1' AND cargo = 'cargo1'"""
SQL["l3_complete"] = _with(Q) + "SELECT id FROM q WHERE id_qc IS NOT NULL AND id % 13 <> 0"
SQL["l4_pending_answers"] = _with(Q) + "SELECT id, id_qc, materia FROM q WHERE gabarito IS NULL AND id_qc IS NOT NULL"
SQL["l5_with_images"] = _with(Q) + "SELECT id FROM q WHERE n_urls > 0"
SQL["l6_search_names"] = _with(Q) + """
SELECT categoria, count(*) AS total FROM q WHERE contains(lower(categoria), 'rc1') GROUP BY categoria"""
SQL["l7_browse"] = _with(Q) + """
SELECT id, materia, categoria, tema FROM q WHERE materia = 'en' AND categoria = 'src1' AND tema IS NOT NULL"""
SQL["l7_keyset_page"] = _with(Q) + "SELECT id, materia, categoria FROM q WHERE materia = 'en' AND id > 50 ORDER BY id LIMIT 25"
SQL["l7_paged_keyset"] = SQL["l7_keyset_page"]
SQL["l7_paged_offset"] = _with(Q) + "SELECT id, materia, categoria FROM q WHERE materia = 'en' ORDER BY id LIMIT 30 OFFSET 200"
SQL["l8_text_search"] = _with(Q) + """,
w AS (SELECT id, string_split(norm, ' ') AS ws FROM q)""" + """
SELECT id, CAST(len(list_filter(ws, lambda x: x = 'the' OR x = 'of')) AS INT) AS score FROM w WHERE list_contains(ws, 'the') AND list_contains(ws, 'of')"""

SQL["l8_index_search"] = SQL["l8_text_search"]
SQL["l8_index_top"] = f"SELECT * FROM ({SQL['l8_text_search']}) ORDER BY score DESC, id LIMIT 20"

# --- lookups ------------------------------------------------------------------------
_RULES = """
rules(categoria, tema, mat) AS (VALUES ('src1', 't1', 'M1'), ('src1', NULL, 'M2'), ('src2', NULL, 'M3'), ('src3', 't3', 'M4'), ('src99', NULL, 'M9')),
mapped AS (SELECT id, q.categoria, q.tema, coalesce(e.mat, g.mat) AS materia_edital FROM q
  LEFT JOIN rules e ON e.categoria = q.categoria AND e.tema = q.tema LEFT JOIN rules g ON g.categoria = q.categoria AND g.tema IS NULL)"""
SQL["j1_subject_of_topic"] = _with(Q, _RULES) + "SELECT id, categoria, tema, materia_edital FROM mapped"
SQL["j2_subject_of_title"] = """
WITH a(materia, pos, alias) AS (VALUES ('S1', 1, 'ECONOMY BRAND'), ('S2', 2, 'STAND'), ('S2', 2, 'PROMO'), ('S3', 3, 'RD B'), ('S4', 4, 'MO'), ('S5', 5, 'E')),
t AS (SELECT p_partkey, trim(upper(regexp_replace('  ' || lower(p_type) || '   ' || p_brand, '\\s+', ' ', 'g'))) AS t FROM part)
SELECT p_partkey, arg_min(a.materia, a.pos) AS materia FROM t LEFT JOIN a ON contains(t.t, a.alias) GROUP BY p_partkey""".replace("\\\\", "\\")
_KEYWORDS = """
kw(materia, categoria, pos, kws) AS (VALUES ('en', 'c1', 1, ['the', 'and', 'zzz']), ('en', 'c2', 2, ['of', 'in', 'that', 'thing']),
  ('fr', 'c1', 1, ['le ', 'la ']), ('fr', 'c2', 2, ['que', 'elle']), ('de', 'c0', 1, ['die', 'und'])),
tax(materia, first) AS (VALUES ('en', 't1'), ('fr', 'x1'), ('es', 'e1')),
sc AS (SELECT id, kw.categoria, kw.pos, CASE WHEN len(kws) = 0 THEN 0.0 ELSE len(list_filter(kws, lambda k: contains(lower(enunciado), k))) / CAST(len(kws) AS DOUBLE) END AS s
  FROM q JOIN kw ON kw.materia = q.materia),
best AS (SELECT DISTINCT ON (id) id, categoria, s FROM sc WHERE s > 0 ORDER BY id, s DESC, pos)"""
SQL["j3_suggest_category"] = _with(Q, _KEYWORDS) + """
SELECT q.id, CASE WHEN t.first IS NOT NULL THEN coalesce(b.categoria, t.first) END AS categoria_sugerida,
  round(CASE WHEN t.first IS NULL THEN 0.0 WHEN b.id IS NOT NULL THEN b.s ELSE 0.3 END, 6) AS confianca
FROM q LEFT JOIN best b ON b.id = q.id LEFT JOIN tax t ON t.materia = q.materia"""
SQL["j4_not_stored"] = _with(Q) + """
SELECT id FROM q WHERE id % 3 <> 0 AND content_hash NOT IN (SELECT content_hash FROM q WHERE id % 3 = 0)"""
SQL["j5_coverage"] = _COVERAGE
SQL["j6_spec_lookups"] = _with(SPECS) + """
SELECT concurso, cargo, array_to_string(list(materia || '=' || peso ORDER BY materia), ',') AS pesos, CAST(sum(peso) AS BIGINT) AS total FROM specs GROUP BY concurso, cargo"""
SQL["j6_list_jobs"] = _with(SPECS) + "SELECT DISTINCT concurso, cargo FROM specs"
SQL["j7_taxonomy_lookups"] = """
WITH t AS (SELECT DISTINCT p_brand, p_type, p_size FROM part),
c AS (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) AS cat_pos, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size) AS tema_pos FROM t)
SELECT p_brand AS materia, p_type AS categoria, 'tema-' || p_size AS tema, CAST(cat_pos AS INT) AS cat_pos, CAST(tema_pos AS INT) AS tema_pos FROM c"""
_FILLED = """
u AS (SELECT 'Q' || doc_id AS id_qc, CASE WHEN doc_id % 8 = 2 THEN '' ELSE 't1 ' || lang END AS t, CASE WHEN doc_id % 3 = 0 THEN 'n' || doc_id END AS i, doc_id * 2 AS s FROM documents
  UNION ALL SELECT 'Q' || doc_id, 't2 ' || source, NULL, doc_id * 2 + 1 FROM documents),
o AS (SELECT DISTINCT ON (id_qc) id_qc, nullif(t, '') AS t, i FROM u WHERE t <> '' OR i IS NOT NULL ORDER BY id_qc, s),
filled AS (SELECT q.id, q.id_qc, o.id_qc IS NOT NULL AND coalesce(q.texto_associado, '') = '' AND q.imagem IS NULL AS preenchida, q.texto_associado, q.imagem, o.t, o.i
  FROM q LEFT JOIN o ON o.id_qc = q.id_qc)"""
SQL["j8_fill_text"] = _with(Q, _FILLED) + """
SELECT id, preenchida, CASE WHEN preenchida THEN t ELSE texto_associado END AS texto_associado, CASE WHEN preenchida THEN i ELSE imagem END AS imagem FROM filled"""
SQL["j9_set_answers"] = _with(Q) + """,
u AS (SELECT 'Q' || (doc_id % 100) AS id_qc, max(doc_id) AS d FROM documents GROUP BY ALL),
v AS (SELECT u.id_qc, substr('ABCDE', CAST(1 + d % 5 AS INT), 1) AS g, CASE WHEN d % 2 = 1 THEN lang END AS c FROM u JOIN documents ON doc_id = d)""" + """
SELECT id, CASE WHEN v.id_qc IS NOT NULL THEN g ELSE gabarito END AS gabarito, CASE WHEN v.id_qc IS NOT NULL THEN c ELSE comentario END AS comentario
FROM q LEFT JOIN v ON v.id_qc = q.id_qc"""
SQL["j10_pages_to_fetch"] = _with(PROGRESS, TOPICS) + """,
n AS (SELECT t.*, coalesce(ultima_pagina, 0) + 1 AS de FROM topics t LEFT JOIN latest l ON l.fonte = t.fonte AND l.chave = t.chave),
e AS (SELECT *, unnest(range(de, 201)) AS p FROM n)""" + """
SELECT fonte, chave, CAST(p AS INT) AS pagina, base || CASE WHEN p = 1 THEN '' ELSE '/' || p END AS url FROM e"""
SQL["j10_session_pages"] = _with(PROGRESS, TOPICS) + """,
n AS (SELECT t.*, coalesce(ultima_pagina, 0) + 1 AS de FROM topics t LEFT JOIN latest l ON l.fonte = t.fonte AND l.chave = t.chave),
e AS (SELECT *, unnest(range(de, de + 40)) AS p FROM n)""" + """
SELECT fonte, chave, CAST(p AS INT) AS pagina, base || CASE WHEN p = 1 THEN '' ELSE '/' || p END AS url FROM e"""
SQL["j11_pages_to_revisit"] = _with(PROGRESS, TOPICS) + """,
e AS (SELECT t.*, unnest(range(1, ultima_pagina + 1)) AS p FROM topics t JOIN latest l ON l.fonte = t.fonte AND l.chave = t.chave)""" + """
SELECT fonte, chave, CAST(p AS INT) AS pagina, base || CASE WHEN contains(base, '?') THEN '&' ELSE '?' END || 'page=' || p AS url FROM e"""
SQL["j12_category_info"] = _with(Q) + """,
t(categoria, nome, esperado) AS (SELECT 'src' || s_suppkey, s_name, 3 * s_suppkey FROM supplier)""" + """
SELECT c.categoria, total, nome, coalesce(esperado, 0) AS esperado FROM (SELECT categoria, count(*) AS total FROM q GROUP BY categoria) c LEFT JOIN t ON t.categoria = c.categoria"""
SQL["j13_enrich_from_spec"] = _with(SPECS) + """,
e AS (SELECT concurso, max(banca) AS banca, max(orgao) AS orgao, min(cargo) AS cargo FROM specs GROUP BY concurso)""" + """
SELECT o_orderkey, n.n_name AS concurso, o_orderpriority AS materia, coalesce(banca, 'QConcursos') AS banca, coalesce(orgao, n.n_name) AS orgao, cargo, o_orderpriority AS assunto
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON n_nationkey = c_nationkey LEFT JOIN e ON e.concurso = n.n_name"""

# --- keyed writes ---------------------------------------------------------------------
_BATCH_ALL = "batch AS (SELECT seq, id_qc, hash_enunciado FROM q)"
SQL["f1_insert_if_new"] = _with(Q, _BATCH_ALL, ACCEPTED) + "SELECT seq AS id FROM accepted"
SQL["f2_one_per_content"] = _with(Q) + f"""
SELECT DISTINCT ON (materia, content_hash) materia, content_hash, id FROM q ORDER BY materia, content_hash, {PRIORITY}, id"""
SQL["f3_latest_progress"] = _with(PROGRESS) + "SELECT fonte, chave, ultima_pagina FROM latest"
SQL["f4_used_flags"] = _with(Q) + """,
r AS (SELECT coalesce(max(event_id), -1) AS r FROM events WHERE event_type = 'signup' AND event_id % 500 = 0),
u AS (SELECT DISTINCT user_id FROM events, r WHERE NOT (event_type = 'signup' AND event_id % 500 = 0) AND event_id > r.r)""" + """
SELECT id, CASE WHEN id IN (SELECT user_id FROM u) THEN 1 ELSE 0 END AS usada FROM q"""
SQL["f3_compacted_progress"] = SQL["f3_latest_progress"]
SQL["f4_compacted_usage"] = SQL["f4_used_flags"]
SQL["f5_keep_first"] = """
SELECT DISTINCT ON (user_id) user_id AS id, event_type AS lista, event_id AS pos FROM events ORDER BY user_id, event_type, event_id"""
SQL["f6_ingest_report"] = _with(Q, _BATCH_ALL, ACCEPTED) + """
SELECT materia, count(*) FILTER (a.seq IS NOT NULL) AS inserted, count(*) FILTER (a.seq IS NULL) AS duplicate, CAST(0 AS BIGINT) AS error
FROM q LEFT JOIN accepted a ON a.seq = q.seq GROUP BY materia"""
_F7 = """
bank AS (SELECT * FROM q WHERE id % 2 = 0 AND id_qc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hash_enunciado ORDER BY id) = 1),
offered AS (SELECT * FROM q WHERE id % 2 = 1 OR id_qc IS NULL),
batch AS (SELECT seq, id_qc, hash_enunciado FROM offered WHERE hash_enunciado NOT IN (SELECT hash_enunciado FROM bank)
   AND (id_qc IS NULL OR id_qc NOT IN (SELECT id_qc FROM bank)))"""
SQL["f7_insert_else_fill"] = _with(Q, _F7, ACCEPTED) + """,
o AS (SELECT DISTINCT ON (id_qc) id_qc, 'novo ' || id AS t FROM offered WHERE seq NOT IN (SELECT seq FROM accepted) AND id_qc IS NOT NULL ORDER BY id_qc, seq)""" + """
SELECT 'accepted' AS parte, seq AS id, 'novo ' || seq AS texto_associado FROM accepted
UNION ALL SELECT 'bank', b.id, CASE WHEN o.id_qc IS NOT NULL AND coalesce(b.texto_associado, '') = '' AND b.imagem IS NULL THEN o.t ELSE b.texto_associado END
FROM bank b LEFT JOIN o ON o.id_qc = b.id_qc"""
_LEGACY = """
leg AS (SELECT id, seq, id_qc, hash_enunciado, CASE WHEN id % 17 = 0 THEN 'bad_options_json' WHEN id % 19 = 0 THEN 'bad_images_json' WHEN id % 23 = 0 THEN 'invalid_source' END AS erro,
  CASE WHEN id % 23 = 0 THEN 'outra' WHEN fonte = 'quadrix_pdf' AND id_qc IS NOT NULL THEN 'pci' ELSE fonte END AS fonte FROM q),
batch AS (SELECT seq, id_qc, hash_enunciado FROM leg WHERE erro IS NULL)"""
SQL["s6_legacy_import"] = _with(Q, _LEGACY, ACCEPTED) + """
SELECT l.id, l.fonte, l.erro, CASE WHEN erro IS NOT NULL THEN 'error' WHEN a.seq IS NOT NULL THEN 'inserted' ELSE 'duplicate' END AS status
FROM leg l LEFT JOIN accepted a ON a.seq = l.seq"""
SQL["s6_import_counts"] = _with(Q, _LEGACY, ACCEPTED) + """
SELECT count(*) FILTER (erro IS NULL AND a.seq IS NOT NULL) AS inserted, count(*) FILTER (erro IS NULL AND a.seq IS NULL) AS duplicate, count(*) FILTER (erro IS NOT NULL) AS error
FROM leg l LEFT JOIN accepted a ON a.seq = l.seq"""
SQL["number_rows"] = "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS id FROM lineitem"

# --- sources and sinks ------------------------------------------------------------------
SQL["s1_scan"] = _with(Q) + "SELECT id, id_qc, materia, fonte, CAST(len(letras) AS INT) AS n_opcoes FROM q"
SQL["s2_exam_specs"] = _with(SPECS) + """
SELECT concurso, nome, banca, ano, orgao, formato, CAST(max(total_questoes) OVER (PARTITION BY concurso) AS INT) AS total_questoes, tempo_minutos, cargo, nivel, vagas,
  CAST(row_number() OVER (PARTITION BY concurso, cargo ORDER BY ordinal) AS INT) AS ordinal, materia, CAST(peso AS DOUBLE) AS peso FROM specs"""
SQL["s3_fallback_specs"] = _with(SPECS) + """,
fb AS (SELECT n_name AS concurso, n_comment_free AS cargo FROM (SELECT n_name, 'interno' AS n_comment_free FROM nation UNION ALL SELECT r_name || '_extra', 'interno' FROM region))""" + """
SELECT concurso, cargo FROM specs UNION ALL SELECT concurso, cargo FROM fb WHERE concurso NOT IN (SELECT concurso FROM specs)"""
SQL["s4_taxonomy"] = SQL["j7_taxonomy_lookups"]
SQL["s5_board_structure"] = """
SELECT r_name AS banca, n_nationkey AS ordem, n_name || ' (base)' AS disciplina, CAST(count(*) AS INT) AS qtd
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
SQL["s7_page_scan"] = "SELECT page_id, url, html FROM pages"
SQL["s8_append"] = _with(Q) + "SELECT fonte, id, hash_enunciado FROM q"
SQL["s9_add_columns"] = _with(Q) + """
SELECT id, materia, CAST(NULL AS VARCHAR) AS cargo, CAST(NULL AS VARCHAR) AS tema, '[]' AS imagens_urls, 'pendente' AS prova FROM q"""
SQL["u2_column_difference"] = _with(Q) + """
SELECT coluna, count(*) AS linhas FROM q, (
  SELECT unnest(['alternativas', 'ano', 'assunto', 'banca', 'cargo', 'categoria', 'comentario', 'content_hash', 'enunciado', 'fonte', 'gabarito',
    'hash_enunciado', 'id', 'id_qc', 'imagens', 'imagens_urls', 'materia', 'orgao', 'prova', 'tema', 'texto_associado', 'usada']) AS coluna
  EXCEPT SELECT unnest(['fonte', 'materia', 'tema', 'id'])) GROUP BY coluna"""
SQL["s10_export_csv"] = _with(Q) + "SELECT id, enunciado, materia FROM q"
SQL["s10_export_json"] = _with(Q) + "SELECT id, enunciado, CAST(len(letras) AS INT) AS n_opcoes FROM q WHERE fonte = 'pci'"
SQL["u5_exams_available"] = _with(SPECS) + """
SELECT DISTINCT concurso FROM specs UNION SELECT r_name FROM region WHERE r_regionkey % 2 = 0"""

# --- allocation and draws ------------------------------------------------------------------
SQL["h1_largest_remainder"] = _with(QUOTAS) + "SELECT exam, materia, CAST(quota AS BIGINT) AS quota FROM quotas"
SQL["h2_rounded_quota"] = _with(SPECS) + """,
r AS (SELECT exam, materia, CAST(round_even(CAST(q * peso AS DOUBLE) / CAST(sum(peso) OVER (PARTITION BY exam) AS DOUBLE), 0) AS BIGINT) AS quota FROM specs)""" + """
SELECT exam, materia, quota FROM r WHERE quota > 0"""
SQL["h3_quota_draw"] = _with(Q, QUOTAS, RANKED) + """
SELECT exam, r.materia, rank, usada, id FROM ranked r JOIN quotas s ON s.materia = r.materia AND rank <= quota"""
SQL["h3_clustered_draw"] = SQL["h3_quota_draw"]
SQL["h3_seeded_draw"] = _with(Q, QUOTAS, RANKED) + """,
seeded AS (SELECT *, row_number() OVER (PARTITION BY materia ORDER BY usada, md5(content_hash || '7')) AS rk FROM pool)""" + """
SELECT exam, r.materia, rk AS rank, usada, id FROM seeded r JOIN quotas s ON s.materia = r.materia AND rk <= quota"""
SQL["h3_reused_counts"] = _with(Q, QUOTAS, RANKED) + """
SELECT exam, r.materia, count(*) AS sorteadas, count(*) FILTER (usada = 1) AS repetidas
FROM ranked r JOIN quotas s ON s.materia = r.materia AND rank <= quota * 10 GROUP BY ALL"""
_CHOSEN = """
chosen AS (SELECT exam, r.id FROM ranked r JOIN quotas s ON s.materia = r.materia AND rank <= quota),
missing AS (SELECT exam, any_value(q) - count(c.id) AS n FROM (SELECT DISTINCT exam, q FROM quotas) LEFT JOIN chosen c USING (exam) GROUP BY exam),
gpool AS (SELECT DISTINCT ON (usada, content_hash) usada, content_hash, id FROM q ORDER BY usada, content_hash, CASE fonte WHEN 'qconcursos' THEN 1 WHEN 'pci' THEN 2 ELSE 3 END, id),
filled AS (SELECT m.exam, usada, g.id, m.n, row_number() OVER (PARTITION BY m.exam ORDER BY usada, content_hash) AS rank
  FROM missing m, gpool g WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.exam = m.exam AND c.id = g.id))"""
SQL["h4_backfill"] = _with(Q, QUOTAS, RANKED, _CHOSEN) + "SELECT exam, rank, usada, id FROM filled WHERE rank <= n"
_RAISED = """
av AS (SELECT materia, count(*) AS disp FROM pool GROUP BY materia),
r0 AS (SELECT s.*, coalesce(disp, 0) AS disp, least(quota, coalesce(disp, 0)) AS taken FROM quotas s LEFT JOIN av USING (materia)),
r1 AS (SELECT *, CASE WHEN taken > 0 THEN disp - taken ELSE 0 END AS spare, q - sum(taken) OVER (PARTITION BY exam) AS short FROM r0),
raised AS (SELECT *, greatest(0, least(spare, short - coalesce(sum(spare) OVER (PARTITION BY exam ORDER BY quota DESC, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS extra FROM r1)"""
SQL["h5_redistribute"] = _with(Q, QUOTAS, RANKED, _RAISED) + """
SELECT exam, materia, CAST(quota AS BIGINT) AS quota, CAST(taken AS BIGINT) AS taken, CAST(extra AS BIGINT) AS extra FROM raised"""
SQL["h6_board_exam"] = _with(Q, SPECS, RANKED) + """,
st AS (SELECT concurso AS exam, max(q) AS q, ordinal, materia, sum(peso) AS peso FROM specs GROUP BY concurso, ordinal, materia),
rq AS (SELECT *, CAST(round_even(CAST(q * peso AS DOUBLE) / CAST(sum(peso) OVER (PARTITION BY exam) AS DOUBLE), 0) AS BIGINT) AS n FROM st),
drawn AS (SELECT exam, ordinal, rank, id FROM rq JOIN ranked r ON r.materia = rq.materia AND rank <= n),
miss AS (SELECT s.exam, s.q - count(d.id) AS n, s.q FROM (SELECT DISTINCT exam, q FROM st) s LEFT JOIN drawn d USING (exam) GROUP BY s.exam, s.q),
gpool AS (SELECT DISTINCT ON (usada, content_hash) usada, content_hash, id FROM q ORDER BY usada, content_hash, CASE fonte WHEN 'qconcursos' THEN 1 WHEN 'pci' THEN 2 ELSE 3 END, id),
fill AS (SELECT m.exam, g.id, m.n, row_number() OVER (PARTITION BY m.exam ORDER BY usada, content_hash) AS rank
  FROM miss m, gpool g WHERE NOT EXISTS (SELECT 1 FROM drawn c WHERE c.exam = m.exam AND c.id = g.id)),
listed AS (SELECT exam, 0 AS part, ordinal AS l, rank, id FROM drawn UNION ALL SELECT exam, 1, 0, rank, id FROM fill WHERE rank <= n),
pos AS (SELECT *, row_number() OVER (PARTITION BY exam ORDER BY part, l, rank) AS pos FROM listed)""" + """
SELECT pos.exam, CAST(pos AS INT) AS pos, id FROM pos JOIN miss USING (exam) WHERE pos <= q"""
_SHEET = """
drawn AS (SELECT exam, r.materia, rank, id FROM ranked r JOIN quotas s ON s.materia = r.materia AND rank <= quota),
sheet AS (SELECT d.exam, CAST(row_number() OVER (PARTITION BY d.exam ORDER BY d.materia, rank) AS INT) AS numero, q.*
  FROM drawn d JOIN q USING (id))"""
SQL["h7_exam_sheet"] = _with(Q, QUOTAS, RANKED, _SHEET) + """
SELECT exam, numero, upper(materia) AS secao_titulo, id, enunciado, array_to_string(list_transform(list_zip(letras, textos), lambda p: p[1] || ') ' || p[2]), '|') AS opcoes,
  concat_ws(' · ', banca, orgao, CAST(ano AS VARCHAR), nullif(assunto, '')) AS origem,
  CASE WHEN coalesce(texto_associado, '') <> '' OR imagem IS NOT NULL THEN 'Texto para a questão ' || numero || '.' END AS chamada_texto FROM sheet"""
SQL["w2_running_number"] = _with(Q, QUOTAS, RANKED, _SHEET) + "SELECT exam, id, numero FROM sheet"
SQL["h8_answer_key"] = _with(Q, QUOTAS, RANKED, _SHEET) + """
SELECT exam, numero, coalesce(gabarito, '(gabarito ainda não coletado)') AS resposta, CASE WHEN gabarito IS NULL THEN '' ELSE coalesce(comentario, '') END AS comentario FROM sheet"""
# sequential exams over integers: ranks in digest order, one recursion step per exam
SQL["h9_pack_exams"] = _with(Q, QUOTAS) + """,
bank AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY hash_enunciado ORDER BY id) = 1),
un AS (SELECT materia, id, content_hash, row_number() OVER (PARTITION BY materia ORDER BY content_hash) AS r FROM bank WHERE usada = 0),
dem AS (SELECT exam, exam_pos, materia, quota AS n, coalesce(sum(quota) OVER (PARTITION BY materia ORDER BY exam_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
  FROM quotas WHERE quota > 0),
fresh AS (SELECT exam, d.materia, r - st AS pos, false AS reused, id FROM dem d JOIN un u ON u.materia = d.materia AND r > st AND r <= st + n),
got AS (SELECT d.exam, d.materia, d.st, d.n, count(f.id) AS g FROM dem d LEFT JOIN fresh f ON f.exam = d.exam AND f.materia = d.materia GROUP BY ALL),
again AS (SELECT g.exam, g.materia, g.g, g.n, b.id, row_number() OVER (PARTITION BY g.exam, g.materia ORDER BY b.content_hash) AS k
  FROM got g JOIN bank b ON b.materia = g.materia LEFT JOIN un u ON u.id = b.id WHERE g.g < g.n AND (b.usada = 1 OR u.r <= g.st))""" + """
SELECT exam, materia, CAST(pos AS INT) AS pos, reused, id FROM fresh
UNION ALL SELECT exam, materia, CAST(g + k AS INT), true, id FROM again WHERE k <= n - g"""
SQL["h10_subject_exam"] = _with(Q, RANKED) + """
SELECT 'prova ' || materia AS exam, materia, rank, id FROM ranked WHERE rank <= 20"""
SQL["h10_general_exam"] = _with(Q, QUOTAS, RANKED, _RAISED) + """
SELECT exam, r.materia, rank, id FROM ranked r JOIN raised s ON s.materia = r.materia AND rank <= taken + extra"""
SQL["h10_job_exam"] = _with(Q, QUOTAS) + f""",
jp AS (SELECT DISTINCT ON (s.exam, q.materia, usada, content_hash) s.exam, q.materia, s.quota, usada, content_hash, q.id
  FROM quotas s JOIN q ON q.materia = s.materia AND q.orgao = s.orgao AND q.cargo = s.cargo AND (s.banca IS NULL OR q.banca = s.banca)
  ORDER BY s.exam, q.materia, usada, content_hash, {PRIORITY}, q.id),
jr AS (SELECT *, row_number() OVER (PARTITION BY exam, materia ORDER BY usada, content_hash) AS rank FROM jp)""" + """
SELECT exam, materia, rank, usada, id FROM jr WHERE rank <= quota"""
SQL["h10_exam_summary"] = _with(Q, QUOTAS) + f""",
jp AS (SELECT DISTINCT s.exam, q.materia, s.quota, usada, content_hash
  FROM quotas s JOIN q ON q.materia = s.materia AND q.orgao = s.orgao AND q.cargo = s.cargo AND (s.banca IS NULL OR q.banca = s.banca)),
c AS (SELECT exam, materia, least(any_value(quota), count(*)) AS n FROM jp GROUP BY exam, materia),
t AS (SELECT s.exam, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT exam FROM quotas) s LEFT JOIN c USING (exam) GROUP BY s.exam)""" + """
SELECT exam, CAST(n AS BIGINT) AS questoes, CAST(n * 3 AS BIGINT) AS minutos FROM t"""
SQL["h11_exam_by_category"] = _with(Q) + f""",
cp AS (SELECT DISTINCT ON (categoria, usada, content_hash) categoria, usada, content_hash, id FROM q WHERE categoria IS NOT NULL ORDER BY categoria, usada, content_hash, {PRIORITY}, id),
cr AS (SELECT *, row_number() OVER (PARTITION BY categoria ORDER BY usada, content_hash) AS rank FROM cp)""" + """
SELECT 'cat ' || categoria AS exam, rank, id FROM cr WHERE rank <= 10"""
SQL["h11_exam_by_topic"] = _with(Q) + f""",
cp AS (SELECT DISTINCT ON (categoria, tema, usada, content_hash) categoria, tema, usada, content_hash, id FROM q WHERE categoria IS NOT NULL AND tema IS NOT NULL
  ORDER BY categoria, tema, usada, content_hash, {PRIORITY}, id),
cr AS (SELECT *, row_number() OVER (PARTITION BY categoria, tema ORDER BY usada, content_hash) AS rank FROM cp)""" + """
SELECT categoria || '/' || tema AS exam, rank, id FROM cr WHERE rank <= 5"""

# --- set operations ----------------------------------------------------------------------
SQL["u1_unused_then_used"] = _with(Q, RANKED) + "SELECT materia, CASE usada WHEN 0 THEN 'inedita' ELSE 'repetida' END AS pool, rank, id FROM ranked"
SQL["u3_not_chosen"] = _with(Q, QUOTAS, RANKED) + """
SELECT id FROM q WHERE id NOT IN (SELECT r.id FROM ranked r JOIN quotas s ON s.materia = r.materia AND rank <= quota)"""
SQL["u4_answerable_now"] = _with(Q) + """
SELECT DISTINCT materia, substr(id_qc, 2) AS numero FROM q WHERE gabarito IS NULL AND id_qc IS NOT NULL
  AND substr(id_qc, 2) IN (SELECT CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 3 <> 0)"""

# --- data quality ------------------------------------------------------------------------
SQL["q1_option_checks"] = _with(Q) + """
SELECT 'not_five_options' AS "check", fonte AS key, count(*) AS n_bad FROM q WHERE len(letras) <> 5 GROUP BY fonte
UNION ALL SELECT 'bad_letter', fonte, count(*) FROM q WHERE list_contains(letras, 'F') GROUP BY fonte"""
SQL["q2_answer_checks"] = _with(Q) + """
SELECT 'answer_missing' AS "check", fonte AS key, count(*) AS n_bad FROM q WHERE gabarito IS NULL GROUP BY fonte
UNION ALL SELECT 'answer_not_an_option', fonte, count(*) FROM q WHERE gabarito IS NOT NULL AND NOT list_contains(letras, gabarito) GROUP BY fonte"""
SQL["q3_spec_checks"] = _with(SPECS) + """,
z AS (SELECT *, CASE WHEN ordinal = 4 THEN 'en' ELSE materia END AS m, CASE WHEN ordinal = 5 AND vagas % 4 = 0 THEN 0 ELSE peso END AS p FROM specs)""" + """
SELECT 'exam_without_board' AS "check", concurso AS key, count(*) AS n_bad FROM z WHERE banca IS NULL GROUP BY concurso
UNION ALL SELECT 'weight_not_positive', concurso, count(*) FROM z WHERE p <= 0 GROUP BY concurso
UNION ALL SELECT 'subject_twice', concurso, count(*) FROM (SELECT concurso, cargo, m FROM z GROUP BY ALL HAVING count(*) > 1) GROUP BY concurso"""
SQL["q4_weight_sums"] = _with(SPECS) + """
SELECT concurso, cargo, CAST(sum(peso) AS BIGINT) AS soma, max(total_questoes) AS declarado FROM specs GROUP BY concurso, cargo HAVING sum(peso) <> max(total_questoes)"""
SQL["q5_quota_sums"] = _with(QUOTAS) + """
SELECT exam, CAST(sum(quota) AS BIGINT) AS soma, max(q) AS q, CAST(sum(quota) <> max(q) AS INT) AS n_bad FROM quotas GROUP BY exam"""
SQL["q6_unmapped_topics"] = _with(Q, _RULES) + """
SELECT categoria, tema, count(*) AS n FROM mapped WHERE materia_edital IS NULL AND categoria IS NOT NULL AND tema IS NOT NULL GROUP BY categoria, tema"""
SQL["q6_orphan_rules"] = _with(Q, _RULES) + "SELECT categoria, mat AS materia FROM rules WHERE categoria NOT IN (SELECT categoria FROM q WHERE categoria IS NOT NULL)"
SQL["q7_duplicates"] = _with(Q) + "SELECT hash_enunciado, count(*) AS n FROM q GROUP BY hash_enunciado HAVING count(*) > 1"
SQL["q8_round_trip"] = _with(Q) + "SELECT count(*) AS linhas, CAST(0 AS BIGINT) AS diferentes FROM q"

# --- streams (their batch answer) ----------------------------------------------------------
_PARSED = """,
parsed AS (SELECT id, id_qc, sha256(lower(trim(regexp_replace(enunciado, '\\s+', ' ', 'g')))) AS hash_enunciado, (id // 10) * 1048576 + row_number() OVER (PARTITION BY id // 10 ORDER BY id) - 1 AS seq
  FROM q WHERE id_qc IS NOT NULL AND id % 13 <> 0),"""
SQL["st1_page_ingest"] = _with(Q) + _PARSED + """
batch AS (SELECT seq, id_qc, hash_enunciado FROM parsed UNION ALL
  SELECT id - 1000000000000 AS seq, id_qc, sha256(lower(trim(regexp_replace(enunciado, '\\s+', ' ', 'g')))) FROM q WHERE id % 17 = 0),""" + ACCEPTED + """
SELECT id_qc, hash_enunciado, CAST(0 AS INT) AS usada, 'm' AS materia FROM parsed JOIN accepted USING (seq)"""
SQL["st1_second_checkpoint"] = _with(Q) + _PARSED + """
batch AS (SELECT seq, id_qc, hash_enunciado FROM parsed),""" + ACCEPTED + """
SELECT count(*) AS linhas, count(*) AS ids, count(*) AS enunciados FROM accepted"""
SQL["st1_progress"] = _with(Q) + """
SELECT 'pci' AS fonte, 'cat/t' || (id // 10) % 3 AS chave, CAST(max(id // 10) AS INT) AS ultima_pagina FROM q GROUP BY ALL"""
SQL["st2_quarantine"] = _with(Q) + """
SELECT 'invalid_source' AS motivo, count(*) AS n FROM q WHERE id_qc IS NOT NULL AND id % 13 <> 0 AND (id // 10) % 7 = 3 HAVING count(*) > 0"""
SQL["st3_live_statistics"] = SQL["a1_stats_by_subject"]
SQL["st3_kept_subjects"] = SQL["a1_stats_by_subject"]
SQL["st3_kept_status"] = SQL["a2_source_status"]
SQL["st3_kept_tree"] = SQL["a5_source_tree"]
SQL["st4_collection_rate"] = """
SELECT date_trunc('minute', ts) AS inicio, event_type AS fonte, count(*) AS n FROM events GROUP BY ALL"""
SQL["st4_batch_rate"] = SQL["st4_collection_rate"]
SQL["st5_drop_repeats"] = _with(Q) + "SELECT DISTINCT hash_enunciado FROM q"
