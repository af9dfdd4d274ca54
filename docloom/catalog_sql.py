"""The registered queries as SQL for DuckDB, written from the source columns.

Where documents are rendered from orders, the SQL states what the extraction must give back from the
order columns, not how it is extracted.
"""

from __future__ import annotations

# The documents' texts after fingerprint normalisation, one replacement per boundary kind.
NORMAL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, "
    r"'\[Sheet:[^\]]*\]\s*', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), "
    r"'(\p{{Nd}})([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])(\p{{Nd}})', '\1 \2', 'g'), '  +', ' ', 'g')"
)

# Rendered orders as source columns. kind: which template; half/cold: misses.
ORDERS = """
base AS (
  SELECT o.*, c.c_name, c.c_mktsegment, c.c_nationkey,
    CAST(o_orderkey AS VARCHAR) AS doc_id,
    CASE o_orderstatus WHEN 'F' THEN 'confirmation_v1' WHEN 'O' THEN 'delivery_v1' ELSE 'invoice_v1' END AS kind,
    o_orderpriority = '4-NOT SPECIFIED' AS half,
    o_orderpriority = '5-LOW' AND o_orderstatus = 'P' AS cold,
    o_orderpriority IN ('2-HIGH', '3-MEDIUM') AS no_date,
    o_orderpriority = '2-HIGH' AS no_customer,
    COALESCE(l.n, 0) AS n_lines,
    'inbox/' || year(o_orderdate) || '/order-' || o_orderkey || '.pdf' AS path
  FROM orders o JOIN customer c ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
),
hit AS (SELECT * FROM base WHERE NOT half AND NOT cold),
judged AS (
  SELECT *,
    list_filter([
      CASE WHEN no_date THEN 'Required field ''order_date'' is null or empty' END,
      CASE WHEN no_customer THEN 'Required field ''customer'' is null or empty' END,
      CASE WHEN kind = 'delivery_v1' AND n_lines = 0 THEN 'Field ''line_count'' value 0 is not > 0.0' END,
      CASE WHEN o_totalprice >= 450000 THEN 'Field ''total'' value ' || CAST(o_totalprice AS VARCHAR) || ' is not < 450000.0' END,
      CASE WHEN kind = 'invoice_v1' AND n_lines = 0 THEN 'Field ''line_count'' value 0 is not > 0.0' END
    ], lambda e: e IS NOT NULL) AS errors,
    CAST(no_date AS INT) + CAST(no_customer AS INT) AS critical
  FROM hit
),
routed AS (
  SELECT b.*, j.errors, j.critical,
    CASE WHEN b.cold THEN 'COLD_MISS' WHEN b.half THEN 'NEAR_MISS' WHEN len(j.errors) = 0 THEN 'HIT_PASS'
      WHEN j.critical < 2 THEN 'HIT_TOLERATED' ELSE 'HIT_REPAIR' END AS route,
    CASE WHEN b.cold THEN 0.1 WHEN NOT b.half THEN 1.0 WHEN b.kind = 'invoice_v1' THEN 0.4 ELSE 0.5 END AS score
  FROM base b LEFT JOIN judged j ON j.o_orderkey = b.o_orderkey
),
scores AS (
  SELECT r.*, t.template_id AS candidate,
    CASE WHEN t.template_id = r.kind AND NOT cold THEN r.score
      WHEN t.template_id = 'invoice_v1' THEN 0.0 ELSE 0.1 END AS candidate_score, t.seq
  FROM routed r, (VALUES (0, 'confirmation_v1'), (1, 'delivery_v1'), (2, 'invoice_v1')) t(seq, template_id)
)
"""

GERMAN = "translate(format('{{:,.2f}}', {x}), ',.', '.,')"

LINES = f"""
line_rows AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doc_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS line,
    CAST(l_linenumber AS VARCHAR) AS pos, 'Art-' || l_partkey AS article,
    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, {GERMAN.format(x='l_extendedprice')} AS amount,
    l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)
"""


def on_orders(body: str, *more: str) -> str:
    return "WITH " + ", ".join([ORDERS, *more]) + " " + body


# Free-text templates: keyword lists as stored.
TEXT_STORE = """
store(seq, template_id, kws, quorum) AS (VALUES
  (0, 'apache_v1', ['Licensed under the', 'Apache License', 'Version'], 0.6),
  (1, 'mit_v1', ['Released under', 'MIT License'], 0.6),
  (2, 'gpl_v1', ['licensed under the', 'GNU General', 'Public License', 'version'], 0.6),
  (3, 'cc_v1', ['Licensed under', 'BY-NC'], 0.6),
  (4, 'english_v1', [' the ', ' and ', ' that ', 'with', 'from'], 0.8),
  (5, 'german_v1', [' der ', ' und ', ' nicht ', 'für', ' ein '], 0.8),
  (6, 'french_v1', [' les ', ' que ', ' dans ', 'avec', 'pour'], 0.8),
  (7, 'repeated_v1', ['example.com', 'EXAMPLE.com', 'mail'], 0.9),
  (8, 'blank_v1', CAST([] AS VARCHAR[]), 0.6))
"""

TEXT_MATCH = (
    "texts AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, lower("
    + NORMAL.format(t="text")
    + ") AS tl FROM documents), "
    + TEXT_STORE
    + """,
hits AS (
  SELECT doc_id, seq, template_id, quorum, len(kws) AS n,
    len(list_filter(kws, lambda k: contains(tl, lower(k)))) AS hits
  FROM texts, store
),
scored AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / n END AS score FROM hits),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seq) AS place,
    row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 4) DESC, seq) AS near_place
  FROM scored
),
decided AS (
  SELECT doc_id, score, CASE WHEN score > 0 THEN template_id END AS best,
    CASE WHEN score >= 0.75 AND score >= quorum THEN template_id END AS hit
  FROM ranked WHERE place = 1
)
"""
)


def on_texts(body: str, *more: str) -> str:
    return "WITH " + ", ".join([TEXT_MATCH, *more]) + " " + body


FILES = """
files AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source,
    CASE lang WHEN 'en' THEN '.pdf' WHEN 'de' THEN '.XLSX' WHEN 'fr' THEN '.xls' ELSE '.tar.Gz' END AS suffix
  FROM documents
)
"""

SUPPLIERS = """
suppliers AS (
  SELECT s_suppkey AS seq, 'supplier_' || s_suppkey || '_v1' AS template_id, s_name, s_nationkey AS nation,
    ['Delivery Note', s_name, 'Nation ' || s_nationkey, 'Überweisung'] AS kws,
    CASE WHEN s_acctbal > 5000 THEN 0.8 ELSE 0.6 END AS quorum,
    CASE WHEN s_nationkey < 5 THEN 'Day (\\d+' WHEN s_nationkey < 10 THEN '(Day) (\\d+)' WHEN s_nationkey < 15 THEN NULL ELSE 'Day (\\S+)' END AS day_pattern,
    CASE WHEN s_nationkey < 5 THEN 'invalid pattern' WHEN s_nationkey < 10 THEN 'capture groups must be 1, not 2'
      WHEN s_nationkey < 15 THEN 'no pattern' ELSE 'kept' END AS day_verdict,
    CASE WHEN s_nationkey < 8 THEN 'table rule lacks anchor or stop' WHEN s_nationkey < 12 THEN 'invalid stop pattern' ELSE 'kept' END AS lines_verdict
  FROM supplier
)
"""

SHEETS = """
cells AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_returnflag,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS sheet_idx,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS row_idx,
    'Part' || l_partkey || '  ' || CASE WHEN l_discount > 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '' END
      || '  ' || l_linestatus || '  ' || CASE WHEN l_tax > 0 THEN CAST(l_suppkey AS VARCHAR) ELSE '' END AS row_text
  FROM lineitem
),
sheets AS (
  SELECT doc_id, sheet_idx, 'Flag' || l_returnflag AS sheet_name, count(*) AS n, string_agg(row_text, chr(10) ORDER BY row_idx) AS body
  FROM cells GROUP BY doc_id, sheet_idx, l_returnflag
),
books AS (
  SELECT doc_id, string_agg(sheet_name, ',' ORDER BY sheet_idx) AS sheets, CAST(sum(n) AS BIGINT) AS n_rows,
    string_agg('[Sheet: ' || sheet_name || ']' || chr(10) || body, chr(10) ORDER BY sheet_idx) AS full_text
  FROM sheets GROUP BY doc_id
)
"""

# What the fixture answers: one row per unsettled order.
ANSWERS = """
answers AS (
  SELECT o_orderkey AS response_seq, doc_id, kind, o_orderstatus, c_mktsegment AS segment, o_totalprice AS price,
    o_orderpriority = '2-HIGH' AS is_repair, half AS is_near, cold AS is_cold, route, errors, critical, score,
    CASE WHEN o_orderpriority = '2-HIGH' THEN kind WHEN half THEN 'nation_' || c_nationkey || '_v1' ELSE 'memo_v1' END AS answered_id,
    CASE WHEN o_totalprice > 400000 THEN 'malformed JSON'
      WHEN o_totalprice < 20000 AND o_orderstatus = 'O' THEN 'malformed JSON' ELSE '-' END AS reject,
    o_totalprice < 20000 AS blank,
    CASE WHEN o_totalprice < 100000 AND o_totalprice >= 20000 THEN 0.5 ELSE 0.6 END AS quorum
  FROM routed WHERE o_orderpriority = '2-HIGH' OR half OR cold
),
usable AS (
  SELECT *, CASE WHEN blank THEN 'unknown_v1' ELSE answered_id END AS new_id,
    CASE WHEN blank THEN CAST([] AS VARCHAR[]) ELSE ['Absender:', 'Segment ' || segment, 'segment ' || lower(segment)] END AS kws
  FROM answers WHERE reject = '-'
),
targeted AS (
  SELECT *, (is_repair OR is_near) AND new_id <> kind AS is_merge,
    CASE WHEN (is_repair OR is_near) THEN kind ELSE new_id END AS target_id
  FROM usable
)
"""

# Fixed values inside: the token pattern and the stop words of the mining contract.
TOKENS = r"""
toks AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(found) AS token, unnest(range(len(found))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9]{4,}') AS found FROM documents)
),
words AS (
  SELECT *, lower(token) AS low FROM toks
  WHERE lower(token) NOT IN ('gmbh', 'datum', 'seite', 'bitte', 'sehr', 'damen', 'herren', 'liefern',
    'artikel', 'menge', 'preis', 'summe', 'gesamt', 'netto', 'brutto', 'bestellung', 'lieferung', 'rechnung',
    'auftrag', 'position', 'nummer', 'anzahl', 'stück', 'euro', 'their', 'with', 'from', 'this', 'that')
),
freq AS (
  SELECT doc_id, low, count(*) AS freq, min(pos) AS first_pos, arg_min(token, pos) AS token
  FROM words GROUP BY doc_id, low
),
owned AS (
  SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9]{4,}'))) AS low FROM benchmark
),
collided AS (
  SELECT f.*, COALESCE(u.users, 0) AS collisions
  FROM freq f LEFT JOIN (SELECT low, count(*) AS users FROM owned GROUP BY low) u USING (low)
)
"""

ORACLES: dict[str, str] = {
    "s2_dispatch": "WITH " + FILES + """
        SELECT doc_id, CASE WHEN suffix = '.pdf' THEN 'pdf' WHEN suffix IN ('.XLSX', '.xls') THEN 'xlsx' ELSE '-' END AS file_type,
          CASE WHEN suffix = '.tar.Gz' THEN 'Unsupported file type: .gz' ELSE '-' END AS reason FROM files""",
    "s3_assemble_pages": "WITH talk AS (SELECT conv_id, count(*) AS n, string_agg(COALESCE(text, ''), chr(10) ORDER BY turn, text) AS full_text FROM conversations GROUP BY conv_id) SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'talk-' || conv_id || '.pdf' AS path, n AS n_pages, CAST(1 AS BIGINT) AS first_page, md5(full_text) AS text_digest, md5(" + NORMAL.format(t="full_text") + ") AS normal_digest FROM talk",
    "s4_assemble_sheets": "WITH " + SHEETS + "SELECT doc_id, sheets, n_rows, md5(full_text) AS text_digest, md5(" + NORMAL.format(t="full_text") + ") AS normal_digest FROM books",
    "s5_s6_store_roundtrip": "WITH " + SUPPLIERS + """
        SELECT seq, template_id, array_to_string(kws, ' | ') AS keywords, s_name AS supplier_hint, 'type_' || nation AS doc_type,
          CAST(quorum AS DOUBLE) AS keyword_quorum, CAST(3 AS BIGINT) AS n_rules,
          'No\\.\\s*(\\d+) | ' || COALESCE(day_pattern, '-') || ' | -' AS patterns, CAST(4 AS BIGINT) AS n_checks,
          CAST(nation AS VARCHAR) AS nation, '2024-01-01' AS created FROM suppliers""".replace("\\\\", "\\"),
    "s6_snapshot": "WITH " + SUPPLIERS + "SELECT template_id, CAST(3 AS BIGINT) AS snapshot_id, seq, CAST(3 AS BIGINT) AS n_rules, CAST(quorum AS DOUBLE) AS keyword_quorum FROM suppliers",
    "s7_s8_audit": on_orders("""
        SELECT 'order-' || doc_id || '.pdf' AS file, 'pdf' AS file_type,
          CASE WHEN half OR cold THEN '-' ELSE kind END AS template_id, CAST(score AS DOUBLE) AS match_score,
          CASE WHEN half OR cold THEN 'MISS' ELSE 'HIT' END AS result, route = 'HIT_PASS' AS validation_passed,
          COALESCE(array_to_string(errors, ' | '), '') AS errors,
          CAST(CASE WHEN route IN ('HIT_PASS', 'HIT_TOLERATED') THEN 6 ELSE 0 END AS BIGINT) AS field_count,
          12.3 AS duration_ms, CAST(3 AS BIGINT) AS n_candidates FROM routed"""),
    "s8_bad_lines": """SELECT '{"file": "' || n_name AS line, count(*) AS n FROM nation GROUP BY n_name""",
    "s9_results": on_orders("""
        , arts AS (SELECT doc_id, '[' || string_agg('"' || l_partkey || '"', ',' ORDER BY line) || ']' AS articles,
            '[' || string_agg('{"pos":"' || pos || '","article":"' || article || '","quantity":"' || quantity || '","amount":"' || amount || '"}', ',' ORDER BY line) || ']' AS lines
          FROM line_rows GROUP BY doc_id)
        SELECT doc_id, path AS document_path, CASE WHEN half OR cold THEN '-' ELSE kind END AS template_id, CAST(score AS DOUBLE) AS match_score,
          CASE WHEN route NOT IN ('HIT_PASS', 'HIT_TOLERATED') THEN '{}' ELSE
            '{"order_number":"' || doc_id || '","order_date":' ||
            CASE WHEN no_date THEN 'null' ELSE '"' || strftime(o_orderdate, '%Y-%m-%d') || '"' END || ',"customer":' ||
            CASE WHEN no_customer THEN 'null' ELSE '"' || c_name || '"' END || ',"total":' || CAST(o_totalprice AS VARCHAR) ||
            CASE WHEN kind = 'confirmation_v1' THEN ',"articles":' || COALESCE(articles, '[]') ELSE ',"line_count":' || n_lines END ||
            ',"lines":' || COALESCE(lines, '[]') || '}' END AS data_json,
          route, CASE WHEN route IN ('HIT_REPAIR', 'NEAR_MISS') THEN kind ELSE '-' END AS existing_template_id,
          CAST(CASE WHEN route IN ('HIT_PASS', 'HIT_TOLERATED') THEN 6 ELSE 0 END AS BIGINT) AS field_count, false AS llm_used, '-' AS responder,
          route = 'HIT_PASS' AS validation_passed, COALESCE(array_to_string(errors, ' | '), '') AS errors, CAST(3 AS BIGINT) AS n_candidates
        FROM routed LEFT JOIN arts USING (doc_id)""", LINES),
    "s8_extra": on_orders("SELECT 'order-' || doc_id || '.pdf' AS file, 'nightly' AS run, CAST(1 AS BIGINT) AS n_extra FROM routed"),
    "s10_export": on_orders("""
        SELECT 'order-' || doc_id || '.pdf' AS file, '2024-05-06T07:08:09.123456+00:00' AS ts,
          CASE WHEN half OR cold THEN 'MISS' ELSE 'HIT' END AS result, 'nightly' AS run FROM routed"""),
    "s1_discover": """
        SELECT name || '.parquet' AS file, true AS filled FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'),
          ('orders'), ('lineitem'), ('events'), ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) t(name)""",
    "s11_decode": on_orders("""
        SELECT response_seq, reject, CASE WHEN reject <> '-' THEN '-' WHEN blank THEN 'none' ELSE answered_id END AS answered_id,
          CASE WHEN reject <> '-' THEN '-' WHEN blank THEN 'none' ELSE segment END AS segment FROM answers""", ANSWERS),
    "s12_requests": """
        WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text,
          'Extract.' || CASE WHEN lang = 'en' THEN chr(10) || chr(10) || 'The store already holds template english_v1 for this kind of document; keep this template_id and extend it.' ELSE '' END
            || chr(10) || chr(10) || 'Document text:' || chr(10) || '---' || chr(10) AS head,
          chr(10) || '---' || chr(10) || chr(10) || 'Answer with the JSON object only.' AS tail FROM documents)
        SELECT doc_id, md5(head || substr(text, 1, 6000) || tail) AS capped_digest, length(text) > 6000 AS truncated, md5(head || text || tail) AS whole_digest FROM p""",
    "s13_folder_stream": on_orders("""
        SELECT CASE WHEN half OR cold THEN '-' ELSE kind END AS template_id, route, count(*) AS documents,
          CAST(CASE WHEN half OR cold THEN 0 ELSE sum(count(*) FILTER (route = 'HIT_PASS')) OVER (PARTITION BY CASE WHEN half OR cold THEN '-' ELSE kind END) END AS BIGINT) AS hits
        FROM routed GROUP BY CASE WHEN half OR cold THEN '-' ELSE kind END, route, half OR cold"""),
    "p1_normalise": "WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, " + NORMAL.format(t="text") + " AS t FROM documents) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM n",
    "p2_sheet_markers": "WITH " + SHEETS + r"SELECT doc_id, md5(regexp_replace(full_text, '\[Sheet:[^\]]*\]\s*', ' ', 'g')) AS digest FROM books",
    "p3_p4_fold_preview": """
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(lower(text)) AS folded,
          md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END) AS run_preview,
          md5(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END) AS value_preview,
          md5(substr(text, 1, 500)) AS span_preview FROM documents""",
    "p5_paths": "WITH " + FILES + "SELECT doc_id, 'd.' || doc_id || suffix AS file, CASE WHEN suffix = '.tar.Gz' THEN 'Gz' ELSE substr(suffix, 2) END AS file_type FROM files",
    "p6_build": on_orders("""
        SELECT response_seq, new_id AS template_id, array_to_string(kws, ' | ') AS keywords,
          CASE WHEN blank THEN 'unknown' ELSE lower(segment) END AS doc_type, CASE WHEN blank THEN '' ELSE 'Nordwind Handel KG' END AS supplier_hint,
          CAST(quorum AS DOUBLE) AS keyword_quorum,
          CASE WHEN blank THEN '' ELSE 'order_number:string | broken:string | pair:string' END AS rules,
          CAST(CASE WHEN blank THEN 0 ELSE 1 END AS BIGINT) AS required_checks, CAST(0 AS BIGINT) AS hit_count, 'true' AS generated FROM usable""", ANSWERS),
    "p7_listing": "WITH " + SUPPLIERS + "SELECT template_id, 'type_' || nation AS doc_type, s_name AS supplier, array_to_string(kws[1:3], ', ') || '...' AS keywords, '0' AS hits, '1' AS version FROM suppliers",
    "p8_lookup": "WITH " + SUPPLIERS + "SELECT template_id, s_name AS supplier_hint, 'type_' || nation AS doc_type, CAST(quorum AS DOUBLE) AS keyword_quorum FROM suppliers WHERE template_id = 'supplier_7_v1'",
    "p9_in_order": "WITH " + SUPPLIERS + "SELECT seq, template_id FROM suppliers ORDER BY seq",
    "p10_import": """
        WITH j AS (SELECT c_custkey AS line_id, c_name,
          CASE WHEN c_mktsegment = 'BUILDING' THEN 'nothing to import' WHEN c_mktsegment = 'MACHINERY' THEN 'malformed JSON'
            WHEN c_mktsegment = 'FURNITURE' THEN 'template_id is required' WHEN c_nationkey > 20 THEN 'fingerprint is required'
            WHEN c_nationkey < 3 THEN 'keyword_quorum outside [0, 1]' WHEN c_nationkey = 10 THEN 'rule without field' ELSE '-' END AS reason FROM customer)
        SELECT line_id, reason, CASE WHEN reason = '-' THEN c_name ELSE '-' END AS template_id,
          CASE WHEN reason = '-' THEN CAST(0.7 AS DOUBLE) ELSE 0.0 END AS keyword_quorum, CASE WHEN reason = '-' THEN 'unknown' ELSE '-' END AS doc_type FROM j""",
    "p11_questions": """
        SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, md5(c.text) AS question,
          md5('Extracted fields:' || chr(10) || '{"lang":"' || lang || '"}' || chr(10) || chr(10) || 'Document text:' || chr(10) || substr(d.text, 1, 8000) || chr(10) || chr(10) || 'Question: ' || c.text) AS prompt
        FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE role = 'user'""",
    "p12_response_fields": on_orders("""
        SELECT response_seq, 'raw' AS kind, f.field, CASE f.field WHEN 'order_number' THEN doc_id WHEN 'segment' THEN segment WHEN 'urgent' THEN 'true'
          WHEN 'share' THEN '0.25' WHEN 'items' THEN '[{"a":1},[]]' ELSE '<null>' END AS s
        FROM usable, (VALUES ('order_number'), ('segment'), ('customer'), ('urgent'), ('share'), ('items')) f(field) WHERE NOT blank""", ANSWERS),
    "j1_keyword_hits": on_texts("SELECT doc_id, template_id, hits, round(score, 6) AS keyword_score FROM scored"),
    "j3_supplier_contained": on_orders("SELECT doc_id, candidate AS template_id, CASE WHEN candidate = kind AND NOT cold THEN least(1.0, CASE WHEN half THEN 0.4 ELSE 1.0 END + 0.1) ELSE 0.1 END AS score FROM scores"),
    "j3_supplier_fuzzy": on_orders("""
        SELECT doc_id, candidate AS template_id, CAST(round(least(1.0, CASE WHEN candidate <> kind OR cold THEN 0.0 WHEN half THEN 0.4 ELSE 1.0 END
          + 0.1 * CASE WHEN o_orderstatus = 'F' THEN 0.9 ELSE 0.85 END), 6) AS DOUBLE) AS score FROM scores"""),
    "j5_best": on_texts("SELECT doc_id, COALESCE(best, '-') AS best_template_id, round(score, 6) AS match_score, round(score, 6) AS hit_rate FROM decided"),
    "j6_decision": on_texts("SELECT doc_id, COALESCE(hit, 'MISS') AS template_id FROM decided"),
    "j7_candidates": on_texts("SELECT doc_id, template_id, round(score, 4) AS score FROM scored"),
    "j8_near_miss": on_texts("""
        SELECT doc_id, CASE WHEN d.hit IS NULL AND d.score >= 0.3 THEN r.template_id ELSE '-' END AS near_miss_id
        FROM decided d JOIN ranked r USING (doc_id) WHERE r.near_place = 1"""),
    "j9_match_orders": on_orders("SELECT doc_id, CASE WHEN half OR cold THEN '-' ELSE kind END AS template_id, CAST(score AS DOUBLE) AS match_score, CASE WHEN half THEN kind ELSE '-' END AS near_miss_id FROM routed"),
    "j9_match_by_grams": "WITH " + SUPPLIERS + """,
        docs AS (SELECT l_orderkey, 'delivery note for ' || string_agg(lower(s_name), ', ' ORDER BY s_name) || ' end' AS tl FROM (SELECT DISTINCT l_orderkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY l_orderkey),
        hits AS (SELECT l_orderkey, seq, template_id, (CAST(contains(tl, lower(s_name)) AS INT) + CAST(contains(tl, 'note for ' || lower(s_name)) AS INT)
          + CAST(contains(tl, lower(s_name) || ' end') AS INT)) / 3.0 AS score FROM docs, suppliers),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, seq) AS place, count(*) FILTER (score > 0) OVER (PARTITION BY l_orderkey) AS n FROM hits)
        SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, template_id AS best_template_id, round(CAST(score AS DOUBLE), 6) AS match_score, n AS n_candidates FROM ranked WHERE place = 1""",
    "j9_plan_automaton": """
        WITH docs AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
        last AS (SELECT max(p_partkey) AS n FROM part),
        words AS (SELECT p_partkey * 5 + v AS seq, 'part_' || p_partkey || '_' || v AS template_id, v,
            unnest([p_partkey, (p_partkey * 7 + v * 13) % n + 1, (p_partkey * 11 + v * 29) % n + 1]) AS k FROM part, last, range(5) r(v)),
        hits AS (SELECT l_orderkey, seq, template_id, v, CAST(count(*) AS DOUBLE) / 3 AS rate FROM docs JOIN words ON l_partkey = k GROUP BY ALL),
        scored AS (SELECT *, least(1.0::DOUBLE, rate + CASE WHEN v = 2 THEN 0.1::DOUBLE ELSE 0 END) AS score FROM hits),
        best AS (SELECT *, score >= 0.75 AND rate >= CASE WHEN v % 2 = 0 THEN 0.6 ELSE 0.8 END AS hit FROM scored
            QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, seq) = 1)
        SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CASE WHEN hit THEN template_id ELSE '-' END AS template_id, round(score, 6) AS match_score,
            CASE WHEN hit THEN '-' ELSE template_id END AS near_miss_id FROM best""",
    "j10_family": "SELECT s_suppkey AS key, 'supplier_' || s_suppkey || '_v1' AS family_id, 100.0 AS ratio FROM supplier",
    # Common subsequences of the shorter name and every window of the longer one, bit-parallel: bit i of s is 0
    # once character i of the shorter name is matched. Both directions where the names are equally long.
    "j10_family_distorted": """
        WITH asked AS (
            SELECT s_suppkey AS key, CASE WHEN s_suppkey % 7 = 0 THEN 'type_none' ELSE 'type_' || s_nationkey END AS doc_type,
                lower(CASE WHEN s_suppkey % 8 = 1 THEN substr(s_name, 1, 8) || ' qv' WHEN s_suppkey % 4 = 0 THEN reverse(s_name)
                    WHEN s_suppkey % 4 = 1 THEN substr(s_name, 1, 8) || ' xyz qv' WHEN s_suppkey % 4 = 2 THEN replace(s_name, '0', '') ELSE 'The ' || substr(s_name, 4) || ' AG' END) AS a
            FROM supplier
        ), pairs AS (
            SELECT key, a, lower(s_name) AS b, s_suppkey AS stored FROM asked JOIN supplier ON doc_type = 'type_' || s_nationkey
        ), sides AS (
            SELECT key, stored, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM pairs
            UNION ALL SELECT key, stored, b, a FROM pairs WHERE length(a) = length(b)
        ), windows AS (
            SELECT key, stored, x, length(x) AS m, substr(y, greatest(st, 1), least(st + length(x) - 1, length(y)) - greatest(st, 1) + 1) AS w
            FROM (SELECT *, unnest(range(2 - length(x), length(y) + 1)) AS st FROM sides)
        ), runs AS (
            SELECT key, stored, m, length(w) AS width, list_reduce(
                list_prepend(((1::BIGINT << m::INT) - 1)::BIGINT, list_transform(string_split(w, ''), lambda c:
                    CAST(list_sum(list_transform(range(m), lambda i: CASE WHEN x[i + 1] = c THEN 1::BIGINT << i::INT ELSE 0 END)) AS BIGINT))),
                lambda s, k: ((s + (s & k)) | (s - (s & k))) & ((1::BIGINT << m::INT) - 1)) AS state
            FROM windows
        ), rated AS (
            SELECT key, stored, max(200.0::DOUBLE * (m - bit_count(state)) / (m + width)) AS ratio FROM runs GROUP BY key, stored
        ), best AS (
            SELECT key, arg_max(stored, ratio * 1e6 - stored * 1e-6) AS stored, max(ratio) AS ratio FROM rated WHERE ratio >= 70 GROUP BY key
        )
        SELECT key, CASE WHEN stored IS NULL THEN '-' ELSE 'supplier_' || stored || '_v1' END AS family_id, round(coalesce(ratio, 0.0), 4) AS ratio
        FROM asked LEFT JOIN best USING (key)""",
    "j11_rules_of_document": on_orders("SELECT doc_id, CAST(CASE WHEN half OR cold THEN 0 ELSE 6 END AS BIGINT) AS n_rules, CAST(CASE WHEN half OR cold THEN 0 WHEN kind = 'confirmation_v1' THEN 4 ELSE 5 END AS BIGINT) AS n_checks FROM routed"),
    "x1_values": on_orders("""
        SELECT doc_id, kind AS template_id, f.rule_pos, f.field, f.kind, CASE f.field
            WHEN 'order_number' THEN doc_id
            WHEN 'order_date' THEN CASE WHEN no_date THEN '<none>' ELSE strftime(o_orderdate, '%Y-%m-%d') END
            WHEN 'customer' THEN CASE WHEN no_customer THEN '<none>' ELSE c_name END
            WHEN 'total' THEN CAST(o_totalprice AS VARCHAR) ELSE CAST(n_lines AS VARCHAR) END AS shown
        FROM hit, (VALUES (0, 'order_number', 'string', ''), (1, 'order_date', 'date', ''), (2, 'customer', 'string', ''), (3, 'total', 'decimal', ''),
          (4, 'articles', 'list', 'confirmation_v1'), (4, 'line_count', 'integer', 'other'), (5, 'lines', 'table', '')) f(rule_pos, field, kind, only_for)
        WHERE only_for = '' OR (only_for = 'confirmation_v1') = (hit.kind = 'confirmation_v1')""").replace("SELECT doc_id, kind AS template_id, f.rule_pos", "SELECT doc_id, hit.kind AS template_id, CAST(f.rule_pos AS BIGINT) AS rule_pos"),
    "x2_string": on_orders("SELECT doc_id, doc_id AS order_number, CASE WHEN no_customer THEN '-' ELSE c_name END AS customer FROM hit"),
    "x3_date": on_orders("SELECT doc_id, CASE WHEN no_date THEN '-' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date FROM hit"),
    "x4_decimal": on_orders("SELECT doc_id, o_totalprice AS total FROM hit"),
    "x5_integer": on_orders("SELECT doc_id, CASE WHEN kind = 'confirmation_v1' THEN -1 ELSE n_lines END AS line_count FROM hit"),
    "x6_list": on_orders("SELECT doc_id, CASE WHEN kind <> 'confirmation_v1' THEN '-' ELSE COALESCE((SELECT string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY line) FROM line_rows l WHERE l.doc_id = hit.doc_id), '') END AS articles FROM hit", LINES),
    "x6_mails": r"SELECT CAST(doc_id AS VARCHAR) AS doc_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}.]+@[\p{L}\p{M}\p{Nd}\p{Pc}.]+\.[\p{L}\p{M}\p{Nd}\p{Pc}]+'), ' | ') AS mails FROM documents",
    "x6_links": r"""
        WITH f AS (SELECT page_id, regexp_extract_all(html, '(?i)<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS a, regexp_extract_all(html, '(?i)<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS b FROM pages)
        SELECT page_id, len(a) AS n_links, md5(array_to_string(list_transform(range(1, len(a) + 1), lambda i: '["' || replace(replace(a[i], '\', '\\'), '"', '\"') || '","' || replace(replace(b[i], '\', '\\'), '"', '\"') || '"]'), chr(10))) AS digest FROM f""",
    "x7_x9_table_pages": on_orders("SELECT l.doc_id, line, pos, article, quantity, amount FROM line_rows l JOIN hit USING (doc_id) WHERE kind = 'invoice_v1'", LINES),
    "x8_x9_table_text": on_orders("SELECT l.doc_id, line, pos, article, quantity, amount FROM line_rows l JOIN hit USING (doc_id) WHERE kind <> 'invoice_v1'", LINES),
    "x7_x8_python_tables": on_orders("SELECT l.doc_id, line, pos, article, quantity, amount FROM line_rows l JOIN hit USING (doc_id)", LINES),
    "v4_python_checks": on_orders(r"""
        , shown AS (SELECT *, CASE WHEN kind = 'delivery_v1' THEN rtrim(c_name, '#') ELSE c_name END AS name FROM hit)
        SELECT doc_id, concat_ws(' | ',
            CASE WHEN NOT no_customer AND CAST(right(c_name, 1) AS INT) % 2 = 1 THEN 'Field ''customer'' value ''' || name || ''' does not match pattern ''(C)?(?(1)ustomer.?\d*[02468]$|x)''' END,
            CASE WHEN left(doc_id, 1) = right(doc_id, 1) THEN 'Field ''order_number'' value ''' || doc_id || ''' does not match pattern ''(\d)\d*$(?<!\1)''' END) AS errors
        FROM shown"""),
    "x10_type_dispatch": on_orders("""
        , f AS (SELECT hit.kind AS template_id, f.kind, CASE f.field WHEN 'order_date' THEN NOT no_date WHEN 'customer' THEN NOT no_customer ELSE true END AS filled
          FROM hit, (VALUES ('order_number', 'string', ''), ('order_date', 'date', ''), ('customer', 'string', ''), ('total', 'decimal', ''),
            ('articles', 'list', 'confirmation_v1'), ('line_count', 'integer', 'other'), ('lines', 'table', '')) f(field, kind, only_for)
          WHERE only_for = '' OR (only_for = 'confirmation_v1') = (hit.kind = 'confirmation_v1'))
        SELECT template_id, kind, count(*) AS n, count(*) FILTER (filled AND kind IN ('string', 'date')) AS n_s, count(*) FILTER (kind = 'decimal') AS n_d,
          count(*) FILTER (kind = 'integer') AS n_i, count(*) FILTER (kind = 'list') AS n_l, count(*) FILTER (kind = 'table') AS n_t, CAST(0 AS BIGINT) AS n_error
        FROM f GROUP BY template_id, kind"""),
    "v1_v5_validate": on_orders("SELECT doc_id, len(errors) = 0 AS passed, array_to_string(errors, ' | ') AS errors FROM judged"),
    "v4_pattern_check": on_texts(r"""
        , v AS (SELECT d.doc_id, d.hit AS template_id, CASE WHEN hit = 'apache_v1' THEN nullif(rtrim(regexp_extract(text, '(?i)Apache License, Version ([\d.]+)', 1), '.'), '')
            WHEN hit = 'cc_v1' THEN nullif(regexp_extract(text, '(?i)BY-NC ([\d.]+)', 1), '') END AS version
          FROM decided d JOIN texts USING (doc_id) WHERE hit IS NOT NULL)
        SELECT doc_id, template_id, COALESCE(version, '-') AS version, CASE WHEN template_id = 'apache_v1' AND version IS NULL THEN 'Required field ''version'' is null or empty' ELSE '' END AS errors FROM v"""),
    "v6_critical": on_orders("SELECT doc_id, CAST(critical AS BIGINT) AS critical FROM judged"),
    "r1_route": on_orders("SELECT doc_id, route, CASE WHEN route IN ('HIT_REPAIR', 'NEAR_MISS') THEN kind ELSE '-' END AS existing_template_id, route = 'HIT_PASS' AS validation_passed FROM routed"),
    "r2_hits": on_orders("SELECT kind AS template_id, count(*) FILTER (route = 'HIT_PASS') AS hit_count FROM routed GROUP BY kind"),
    "r3_r4_fold": on_orders("""
        , stored(template_id, kws, quorum, doc_type) AS (VALUES
          ('confirmation_v1', ['Bestellung:', 'Bestelldatum', 'Kunde:', 'Auftragsbestaetigung', 'Summe'], 0.6, 'order_confirmation'),
          ('delivery_v1', ['Lieferschein', 'Liefertag', 'Empfaenger', 'Spedition', 'Packstuecke'], 0.6, 'delivery_note'),
          ('invoice_v1', ['Invoice number', 'Invoice date', 'Bill to', 'Payment terms', 'Amount due'], 0.8, 'invoice')),
        restart AS (SELECT target_id, max(response_seq) FILTER (NOT is_merge) AS at, max(response_seq) AS last FROM targeted GROUP BY target_id),
        live AS (SELECT t.* FROM targeted t JOIN restart r USING (target_id) WHERE r.at IS NULL OR response_seq >= r.at),
        base AS (SELECT r.target_id, CASE WHEN r.at IS NULL THEN COALESCE(s.kws, []) ELSE t.kws END AS kws, CASE WHEN r.at IS NULL THEN s.quorum END AS quorum
          FROM restart r LEFT JOIN targeted t ON t.target_id = r.target_id AND t.response_seq = r.at LEFT JOIN stored s ON s.template_id = r.target_id),
        spread AS (SELECT target_id, response_seq, unnest(kws) AS kw, unnest(range(len(kws))) AS pos FROM live),
        fresh AS (SELECT s.*, min(response_seq) OVER (PARTITION BY s.target_id, lower(kw)) AS first_at FROM spread s JOIN base b USING (target_id)
          WHERE NOT list_contains(list_transform(b.kws, lambda k: lower(k)), lower(kw))),
        added AS (SELECT target_id, list(kw ORDER BY response_seq, pos) AS kws FROM fresh WHERE response_seq = first_at GROUP BY target_id),
        folded AS (SELECT r.target_id AS template_id, list_concat(b.kws, COALESCE(a.kws, [])) AS kws,
            least(COALESCE(b.quorum, 9), (SELECT min(quorum) FROM live l WHERE l.target_id = r.target_id)) AS quorum,
            (SELECT CASE WHEN blank THEN 'unknown' ELSE lower(segment) END FROM targeted t WHERE t.target_id = r.target_id AND t.response_seq = r.last) AS doc_type,
            (SELECT CASE WHEN blank THEN 0 ELSE 3 END FROM targeted t WHERE t.target_id = r.target_id AND t.response_seq = r.last) AS n_rules
          FROM restart r JOIN base b USING (target_id) LEFT JOIN added a USING (target_id))
        SELECT template_id, array_to_string(kws, ' | ') AS keywords, doc_type, CAST(quorum AS DOUBLE) AS quorum, CAST(n_rules AS BIGINT) AS n_rules, CAST(0 AS BIGINT) AS hit_count FROM folded
        UNION ALL SELECT template_id, array_to_string(kws, ' | '), doc_type, CAST(quorum AS DOUBLE), CAST(6 AS BIGINT), CAST(0 AS BIGINT) FROM stored WHERE template_id NOT IN (SELECT template_id FROM folded)""", ANSWERS).replace("base AS (SELECT r.target_id", "bases AS (SELECT r.target_id").replace("JOIN base b USING (target_id)", "JOIN bases b USING (target_id)"),
    "r4_upsert": "WITH " + SUPPLIERS + """,
        incoming AS (SELECT 'supplier_' || (c_custkey * 2) || '_v1' AS template_id, c_name, 'new_' || c_nationkey AS doc_type FROM customer)
        SELECT COALESCE(s.template_id, i.template_id) AS template_id, COALESCE(i.c_name, array_to_string(s.kws, ' | ')) AS keywords, COALESCE(i.doc_type, 'type_' || s.nation) AS doc_type,
          CAST(CASE WHEN i.template_id IS NULL THEN 5 ELSE 0 END AS BIGINT) AS hit_count, CASE WHEN i.template_id IS NULL THEN s.seq ELSE -1 END AS kept_seq
        FROM suppliers s FULL OUTER JOIN incoming i ON s.template_id = i.template_id""",
    "r5_delete": "WITH " + SUPPLIERS + """,
        ids AS (SELECT DISTINCT 'supplier_' || o_custkey || '_v1' AS template_id FROM orders)
        SELECT i.template_id, CASE WHEN s.template_id IS NULL THEN 'missing' ELSE 'deleted' END AS state FROM ids i LEFT JOIN suppliers s USING (template_id)
        UNION ALL SELECT template_id, 'kept' FROM suppliers WHERE template_id NOT IN (SELECT template_id FROM ids)""",
    "r6_learn_results": on_orders("""
        SELECT r.doc_id, CASE WHEN t.doc_id IS NOT NULL THEN t.target_id WHEN r.half OR r.cold THEN '-' ELSE r.kind END AS template_id,
          t.doc_id IS NOT NULL AS llm_used, CASE WHEN t.doc_id IS NULL THEN '-' WHEN t.o_orderstatus = 'O' THEN 'local' ELSE 'remote' END AS llm_backend,
          r.route = 'HIT_PASS' OR t.doc_id IS NOT NULL AS validation_passed, COALESCE(array_to_string(r.errors, ' | '), '') AS errors,
          CAST(CASE WHEN t.doc_id IS NOT NULL THEN CASE WHEN t.blank THEN 0 ELSE 6 END WHEN r.route IN ('HIT_PASS', 'HIT_TOLERATED') THEN 6 ELSE 0 END AS BIGINT) AS field_count,
          CASE WHEN t.doc_id IS NULL THEN '-' WHEN t.blank THEN '{}' ELSE '{"order_number":"' || t.response_seq || '","segment":"' || t.segment ||
            '","customer":null,"urgent":true,"share":0.25,"items":[{"a":1},[]]}' END AS answer
        FROM routed r LEFT JOIN targeted t USING (doc_id)""", ANSWERS),
    "r7_responder_round": on_orders("""
        SELECT CASE WHEN cold THEN 'memo_v1' ELSE kind END AS template_id, route IN ('HIT_REPAIR', 'NEAR_MISS', 'COLD_MISS') AS llm_used, count(*) AS documents,
          CAST(sum(CASE WHEN route IN ('HIT_PASS', 'HIT_TOLERATED') THEN 6 ELSE 2 END) AS BIGINT) AS fields
        FROM routed GROUP BY 1, 2"""),
    "k1_k7_fill_keywords": "WITH " + TOKENS + """,
        proposed AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, list_filter([source, 'License', 'and', 'QUE', 'Nicht', 'example.com', 'the', 'that'], lambda k: contains(lower(text), lower(k))) AS kept FROM documents),
        pool AS (SELECT c.*, row_number() OVER (PARTITION BY doc_id ORDER BY freq / (1.0 + collisions) DESC, first_pos) AS place
          FROM collided c JOIN proposed p USING (doc_id) WHERE NOT list_contains(list_transform(kept, lambda k: lower(k)), low)),
        added AS (SELECT doc_id, list(token ORDER BY place) AS more FROM pool JOIN proposed USING (doc_id) WHERE place <= 5 - len(kept) GROUP BY doc_id)
        SELECT doc_id, array_to_string(list_concat(kept, COALESCE(more, [])), ' | ') AS keywords, len(kept) AS kept_count FROM proposed LEFT JOIN added USING (doc_id)""",
    "k2_tokens": "WITH " + TOKENS + "SELECT doc_id, count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY pos)) AS digest FROM toks GROUP BY doc_id",
    "k3_k4_frequency": "WITH " + TOKENS + "SELECT doc_id, low, freq, token FROM freq",
    "k5_collisions": "WITH " + TOKENS + "SELECT doc_id, low, collisions FROM collided WHERE collisions > 0",
    "k6_ranked_tokens": "WITH " + TOKENS + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY freq / (1.0 + collisions) DESC, first_pos) AS rank, token, round(CAST(freq AS DOUBLE) / (1 + collisions), 6) AS score FROM collided",
    "k8_k11_rule_verdicts": "WITH " + SUPPLIERS + """
        SELECT template_id, CAST(0 AS BIGINT) AS rule_pos, 'kept' AS verdict FROM suppliers UNION ALL SELECT template_id, CAST(1 AS BIGINT), day_verdict FROM suppliers
        UNION ALL SELECT template_id, CAST(2 AS BIGINT), lines_verdict FROM suppliers""",
    "k12_rule_coverage": on_orders("""
        , f AS (SELECT hit.kind AS template_id, f.field, CASE f.field WHEN 'order_date' THEN NOT no_date WHEN 'customer' THEN NOT no_customer WHEN 'articles' THEN n_lines > 0 ELSE true END AS found
          FROM hit, (VALUES ('order_number', ''), ('order_date', ''), ('customer', ''), ('total', ''), ('articles', 'confirmation_v1'), ('line_count', 'other')) f(field, only_for)
          WHERE only_for = '' OR (only_for = 'confirmation_v1') = (hit.kind = 'confirmation_v1'))
        SELECT template_id, field, count(*) AS documents, count(*) FILTER (found) AS matched, round(avg(CAST(found AS INT)), 6) AS match_rate FROM f GROUP BY template_id, field"""),
    "k13_orphan_checks": "WITH " + SUPPLIERS + """
        SELECT template_id, 'number' || CASE WHEN day_verdict = 'kept' THEN ',day' ELSE '' END || CASE WHEN lines_verdict = 'kept' THEN ',lines' ELSE '' END AS rules,
          'number' || CASE WHEN day_verdict = 'kept' THEN ',day' ELSE '' END || CASE WHEN lines_verdict = 'kept' THEN ',lines' ELSE '' END AS checks,
          CAST((day_verdict <> 'kept')::INT + (lines_verdict <> 'kept')::INT AS BIGINT) AS dropped FROM suppliers""",
    "a1_history": on_orders("""
        SELECT 'order-' || doc_id || '.pdf' AS file, CASE WHEN half OR cold THEN '—' ELSE kind END AS template, format('{:.3f}', CAST(score AS DOUBLE)) AS score,
          CASE WHEN half OR cold THEN 'MISS' ELSE 'HIT' END AS result, '' AS llm, CASE WHEN route = 'HIT_PASS' THEN '✓' ELSE '✗' END AS valid,
          CAST(CASE WHEN route IN ('HIT_PASS', 'HIT_TOLERATED') THEN 6 ELSE 0 END AS BIGINT) AS fields, CAST(12 AS BIGINT) AS ms, '2024-05-06 07:08:09' AS time FROM routed"""),
    "a2_candidates": on_orders("""
        SELECT 'order-' || doc_id || '.pdf' AS file, row_number() OVER (PARTITION BY doc_id ORDER BY candidate_score DESC, seq) AS rank, candidate AS template,
          format('{:.4f}', CAST(candidate_score AS DOUBLE)) AS score FROM scores"""),
    "a3_summary": on_orders("""
        SELECT 'order-' || doc_id || '.pdf' AS file, CASE WHEN half OR cold THEN 'N/A' ELSE kind END AS template, format('{:.2f}', CAST(score AS DOUBLE)) AS score,
          'No' AS llm_used, CASE WHEN route = 'HIT_PASS' THEN '✓' ELSE '✗' END AS valid FROM routed"""),
    "a4_match_metrics": on_texts("SELECT COALESCE(best, '-') AS best_template_id, count(*) AS documents, count(hit) AS hits, round(avg(CASE WHEN hit IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate, round(avg(score), 6) AS avg_score FROM decided GROUP BY best"),
    "a4_match_spans": on_texts("SELECT doc_id, md5(substr(text, 1, 500)) AS preview, CAST(0.75 AS DOUBLE) AS threshold, CAST(9 AS BIGINT) AS template_count, round(score, 4) AS match_score, hit IS NOT NULL AS hit FROM decided JOIN texts USING (doc_id)"),
    "a5_rule_metrics": on_orders("""
        SELECT kind AS template_id, count(*) AS documents, 6 * count(*) AS field_count,
          CAST(sum(2 + CAST(NOT no_date AS INT) + CAST(NOT no_customer AS INT) + CASE WHEN kind = 'confirmation_v1' THEN CAST(n_lines > 0 AS INT) ELSE 1 END + CAST(n_lines > 0 AS INT)) AS BIGINT) AS non_null_count
        FROM hit GROUP BY kind"""),
    "a6_validator_metrics": on_orders("SELECT kind AS template_id, count(*) AS documents, count(*) FILTER (len(errors) = 0) AS passed, CAST(sum(len(errors)) AS BIGINT) AS error_count, CAST(CASE WHEN kind = 'confirmation_v1' THEN 4 ELSE 5 END AS BIGINT) AS check_count FROM judged GROUP BY kind"),
    "a7_responder_metrics": on_orders("""
        SELECT CASE WHEN o_orderstatus = 'O' THEN 'local' ELSE 'remote' END AS backend, 'fixture' AS model, count(*) AS calls, count(*) FILTER (is_repair OR is_near) AS updates,
          count(*) FILTER (reject <> '-') AS rejected, CAST(sum(CASE WHEN reject = '-' AND NOT blank THEN 6 ELSE 0 END) AS BIGINT) AS field_count
        FROM answers GROUP BY 1""", ANSWERS),
    "a8_field_counts": on_orders("SELECT doc_id, kind AS template_id, CAST(6 AS BIGINT) AS field_count FROM hit"),
    "a9_batch_duration": on_orders("SELECT CASE WHEN half OR cold THEN 'MISS' ELSE 'HIT' END AS result, count(*) AS documents, true AS timed FROM routed GROUP BY 1"),
    "full_run": on_orders("""
        SELECT doc_id, CASE WHEN half OR cold THEN '-' ELSE kind END AS template_id, CAST(score AS DOUBLE) AS match_score, route,
          CASE WHEN half OR cold THEN '-' ELSE doc_id END AS order_number,
          CASE WHEN half OR cold OR no_date THEN '-' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
          CASE WHEN half OR cold THEN -1.0 ELSE o_totalprice END AS total, CASE WHEN half OR cold THEN -1 ELSE n_lines END AS n_lines,
          COALESCE(len(errors), 0) AS n_errors FROM routed"""),
    "k14_sanitise": on_orders("""
        SELECT response_seq, CASE WHEN NOT blank THEN 'Absender:' WHEN o_orderstatus = 'P' AND is_repair THEN 'Invoice' ELSE 'Absender' END AS first_keyword,
          CAST(CASE WHEN o_orderstatus = 'F' AND is_near THEN CASE WHEN blank THEN 3 ELSE 4 END ELSE 5 END AS BIGINT) AS n_keywords,
          CASE WHEN blank THEN '' ELSE 'order_number' END AS rules, CASE WHEN blank THEN '' ELSE 'order_number' END AS checks,
          CASE WHEN blank THEN '' ELSE 'invalid pattern | capture groups must be 1, not 2' END AS dropped FROM usable""", ANSWERS),
    "full_run_texts": on_texts(r"""
        , v AS (SELECT d.*, text, CASE WHEN hit = 'apache_v1' THEN nullif(rtrim(regexp_extract(text, '(?i)Apache License, Version ([\d.]+)', 1), '.'), '')
            WHEN hit = 'cc_v1' THEN nullif(regexp_extract(text, '(?i)BY-NC ([\d.]+)', 1), '') END AS version,
            regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}.]+@[\p{L}\p{M}\p{Nd}\p{Pc}.]+\.[\p{L}\p{M}\p{Nd}\p{Pc}]+') AS mails,
            nullif(regexp_extract(text, '(?i)the (MIT) License', 1), '') AS licence
          FROM decided d JOIN texts USING (doc_id))
        SELECT doc_id, COALESCE(hit, '-') AS template_id,
          CASE WHEN hit = 'apache_v1' AND version IS NULL THEN 'HIT_TOLERATED' WHEN hit IS NOT NULL THEN 'HIT_PASS' WHEN score >= 0.3 THEN 'NEAR_MISS' ELSE 'COLD_MISS' END AS route,
          CASE hit WHEN 'apache_v1' THEN '{"version":' || COALESCE('"' || version || '"', 'null') || ',"mails":[' || array_to_string(list_transform(mails, lambda m: '"' || m || '"'), ',') || ']}'
            WHEN 'mit_v1' THEN '{"licence":' || COALESCE('"' || licence || '"', 'null') || '}' WHEN 'cc_v1' THEN '{"version":' || COALESCE('"' || version || '"', 'null') || '}' ELSE '{}' END AS data_json
        FROM v"""),
}

# The same questions on other plans.
ORACLES["s5_s6_store_lines"] = ORACLES["s5_s6_store_roundtrip"]
ORACLES["s13_rematch"] = ORACLES["s13_folder_stream"]
ORACLES["j9_plan_inline"] = ORACLES["j9_plan_chunks"] = ORACLES["j9_match_orders"]
