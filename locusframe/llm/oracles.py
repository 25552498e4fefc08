"""DuckDB forms of the registered queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""

OP6 = """
WITH turns AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1)::BIGINT AS turn, coalesce(role, 'none') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, role AS o_role, text AS o_text, floor(conv_id / 1024)::BIGINT AS block
  FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1),
p1 AS (
  SELECT *, row_number() OVER w AS n, lead(conv_id) OVER w AS mate FROM convs
  WINDOW w AS (PARTITION BY o_role, o_text, block ORDER BY conv_id)),
p2 AS (
  SELECT conv_id, o_role, o_text, block, row_number() OVER w AS n, lead(conv_id) OVER w AS mate
  FROM p1 WHERE n % 2 = 1 AND mate IS NULL WINDOW w AS (PARTITION BY o_role, o_text ORDER BY conv_id)),
p3 AS (
  SELECT conv_id, block, row_number() OVER w AS n, lead(conv_id) OVER w AS mate
  FROM p2 WHERE n % 2 = 1 AND mate IS NULL WINDOW w AS (PARTITION BY block ORDER BY conv_id)),
p4 AS (
  SELECT conv_id, row_number() OVER w AS n, lead(conv_id) OVER w AS mate
  FROM p3 WHERE n % 2 = 1 AND mate IS NULL WINDOW w AS (PARTITION BY floor(block / 1024) ORDER BY conv_id)),
pairs AS (
  SELECT conv_id AS chosen_id, mate AS rejected_id FROM p1 WHERE n % 2 = 1 AND mate IS NOT NULL
  UNION ALL SELECT conv_id, mate FROM p2 WHERE n % 2 = 1 AND mate IS NOT NULL
  UNION ALL SELECT conv_id, mate FROM p3 WHERE n % 2 = 1 AND mate IS NOT NULL
  UNION ALL SELECT conv_id, mate FROM p4 WHERE n % 2 = 1),
a AS (SELECT chosen_id, rejected_id, turn, role, text FROM pairs JOIN turns ON conv_id = chosen_id),
b AS (SELECT chosen_id, rejected_id, turn, role, text FROM pairs JOIN turns ON conv_id = rejected_id),
ends AS (
  SELECT chosen_id, min(turn) AS stop
  FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY chosen_id),
parts AS (
  SELECT a.*, CASE WHEN stop IS NULL OR turn < stop THEN 'prompt' ELSE 'chosen' END AS part
  FROM a LEFT JOIN ends USING (chosen_id)
  UNION ALL
  SELECT b.*, 'rejected' FROM b JOIN ends USING (chosen_id) WHERE turn >= stop)
SELECT chosen_id, rejected_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
       part <> 'prompt' AND role = 'assistant' AS trained
FROM parts
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
total AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
item AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
held AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM item) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
  FROM item JOIN held USING (term) JOIN weight USING (term), total GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op6_preferences": OP6, "op12_ranked_search": OP12}
