"""SQL forms of the registered queries, for an independent engine.

Each query is written from the semantics, not from the Spark plan: plain
windows, inequality joins and recursive CTEs over the whole tables.
"""

from __future__ import annotations

from locusframe.adapters import BASE_OF, LETTERS
from locusframe.operators.liftover import REASON_EDGE, REASON_GOOD, REASON_MANY, REASON_NONE, REASON_ORDER, REASON_TARGETS

FEAT = """feat AS (
  SELECT concat('chr', l_suppkey) AS seqid,
    (l_orderkey*37 + l_linenumber*11) % 60000 AS start_pos,
    (l_orderkey*37 + l_linenumber*11) % 60000 + CAST(l_quantity AS INT) AS end_pos,
    concat_ws(':', l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_extendedprice) AS BIGINT)) AS entity_id,
    CASE l_returnflag WHEN 'A' THEN '+' WHEN 'N' THEN '-' ELSE '.' END AS strand,
    CASE WHEN l_discount > 0.08 THEN 'uncertain' ELSE 'high' END AS conf
  FROM lineitem)"""

SEQS = """seqs AS (
  SELECT concat('chr', s_suppkey) AS seqid, CAST(60100 AS BIGINT) AS length,
    CASE WHEN s_suppkey % 10 = 0 THEN 'unlocalized_scaffold' ELSE 'nuclear_chromosome' END AS seq_class,
    CASE WHEN s_suppkey % 7 = 0 THEN 'partial' WHEN s_suppkey % 7 = 1 THEN 'unknown' ELSE 'complete' END AS five_prime,
    CASE WHEN s_suppkey % 5 = 0 THEN 'partial' WHEN s_suppkey % 5 = 1 THEN 'unknown' ELSE 'complete' END AS three_prime
  FROM supplier)"""

ZONES = """zones AS (
  SELECT concat('chr', o_custkey % (SELECT count(*) FROM supplier) + 1) AS seqid,
    (o_orderkey*53) % 60000 AS z_start, (o_orderkey*53) % 60000 + 10 + o_custkey % 40 AS z_end,
    concat('zone_', lower(o_orderstatus)) AS rule_id, o_orderpriority AS reason, o_orderkey AS ordinal
  FROM orders)"""

CLUSTERS = FEAT + """, o AS (
  SELECT *, max(end_pos) OVER (PARTITION BY seqid ORDER BY start_pos, end_pos, entity_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM feat
), c AS (
  SELECT *, sum(CASE WHEN prev_end IS NULL OR start_pos >= prev_end THEN 1 ELSE 0 END) OVER (
    PARTITION BY seqid ORDER BY start_pos, end_pos, entity_id ROWS UNBOUNDED PRECEDING) AS cluster_no FROM o
), spans AS (
  SELECT seqid, cluster_no, min(start_pos) AS s, max(end_pos) AS e FROM c GROUP BY seqid, cluster_no
), edges AS (
  SELECT spans.seqid, spans.cluster_no, s, e,
    list(DISTINCT strand) FILTER (WHERE start_pos = s AND strand IN ('+','-')) AS ls,
    list(DISTINCT strand) FILTER (WHERE end_pos = e AND strand IN ('+','-')) AS rs,
    bool_and(conf = 'high') FILTER (WHERE start_pos = s) AS lh,
    bool_and(conf = 'high') FILTER (WHERE end_pos = e) AS rh
  FROM spans JOIN c ON c.seqid = spans.seqid AND c.cluster_no = spans.cluster_no
  GROUP BY spans.seqid, spans.cluster_no, s, e
), clusters AS (
  SELECT seqid, CAST(cluster_no AS BIGINT) AS cluster_no, s AS start_pos, e AS end_pos,
    CASE WHEN len(ls) = 1 THEN ls[1] ELSE '.' END AS left_strand,
    CASE WHEN len(rs) = 1 THEN rs[1] ELSE '.' END AS right_strand,
    CASE WHEN lh THEN 'high' ELSE 'uncertain' END AS left_confidence,
    CASE WHEN rh THEN 'high' ELSE 'uncertain' END AS right_confidence
  FROM edges)"""

GAPS = CLUSTERS + """, pairs AS (
  SELECT seqid, cluster_no AS region_no, end_pos AS start_pos, right_strand AS left_strand,
    right_confidence AS left_confidence,
    lead(start_pos) OVER w AS next_start, lead(left_strand) OVER w AS next_strand,
    lead(left_confidence) OVER w AS next_conf
  FROM clusters WINDOW w AS (PARTITION BY seqid ORDER BY cluster_no)
), gaps AS (
  SELECT seqid, region_no, format('{}:intergenic:{:06d}', seqid, region_no) AS region_id,
    start_pos, next_start AS end_pos, next_start - start_pos AS length, left_strand,
    next_strand AS right_strand,
    CASE WHEN left_strand = '.' OR next_strand = '.' THEN 'unknown'
      WHEN left_strand = next_strand THEN 'tandem' WHEN left_strand = '+' THEN 'convergent'
      ELSE 'divergent' END AS orientation,
    left_confidence, next_conf AS right_confidence
  FROM pairs WHERE next_start > start_pos)"""

TERMINALS = FEAT + ", " + SEQS + """, ext AS (
  SELECT seqid, min(start_pos) AS f, max(end_pos) AS t FROM feat GROUP BY seqid
), nuc AS (
  SELECT seqs.*, f, t FROM seqs LEFT JOIN ext ON ext.seqid = seqs.seqid
  WHERE seq_class = 'nuclear_chromosome'
), terminals AS (
  SELECT seqid, seqid || ':5p-terminal' AS region_id, CAST(0 AS BIGINT) AS start_pos, f AS end_pos,
    '5p' AS side, five_prime, three_prime, five_prime AS adjacent_end_status,
    'five_prime evidence' AS adjacent_end_evidence, five_prime = 'complete' AS true_telomere_distance
  FROM nuc WHERE f > 0
  UNION ALL SELECT seqid, seqid || ':3p-terminal', t, length, '3p', five_prime, three_prime, three_prime,
    'three_prime evidence', three_prime = 'complete' FROM nuc WHERE t < length
  UNION ALL SELECT seqid, seqid || ':whole-sequence', 0, length, 'whole_sequence_no_features', five_prime,
    three_prime, CASE WHEN five_prime = three_prime THEN five_prime ELSE 'unknown' END,
    '5p: five_prime evidence | 3p: three_prime evidence',
    five_prime = 'complete' AND three_prime = 'complete' FROM nuc WHERE f IS NULL)"""

BUFFER, MIN_WINDOW = 5, 10

RULES = GAPS + ", " + ZONES + f""", thr AS (
  SELECT length AS t FROM (SELECT length, row_number() OVER (ORDER BY length) - 1 AS i,
    count(*) OVER () AS n FROM gaps) WHERE i = round_even((n - 1) * CAST(0.95 AS DOUBLE), 0)
), spans2 AS (
  SELECT *, start_pos + {BUFFER} AS cs, end_pos - {BUFFER} AS ce,
    left_confidence = 'high' AND right_confidence = 'high' AS trusted FROM gaps
), cuts AS (
  SELECT g.*, rule_id, reason, ordinal, greatest(z_start, cs) AS k_start, least(z_end, ce) AS k_end
  FROM spans2 g JOIN zones z ON z.seqid = g.seqid AND z_end > cs AND z_start < ce
  WHERE trusted AND ce > cs
), marked AS (
  SELECT g.*, EXISTS (SELECT 1 FROM (SELECT DISTINCT region_id FROM cuts) k WHERE k.region_id = g.region_id) AS is_cut
  FROM spans2 g
), ordered AS (
  SELECT *, max(k_end) OVER (PARTITION BY region_id ORDER BY k_start, k_end, ordinal
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cuts
), remains AS (
  SELECT seqid, region_id, cs, ce, orientation, left_confidence, right_confidence,
    coalesce(reach, cs) AS s, k_start AS e FROM ordered WHERE k_start > coalesce(reach, cs)
  UNION ALL
  SELECT seqid, region_id, cs, ce, any_value(orientation), any_value(left_confidence),
    any_value(right_confidence), max(k_end), ce FROM cuts GROUP BY seqid, region_id, cs, ce
  HAVING max(k_end) < ce
), pieces AS (
  SELECT seqid, region_id, cs, ce, orientation, left_confidence, right_confidence, s, e,
    row_number() OVER (PARTITION BY region_id ORDER BY s) AS split_index,
    count(*) OVER (PARTITION BY region_id) AS split_count
  FROM remains WHERE e - s >= {MIN_WINDOW}
  UNION ALL
  SELECT seqid, region_id, cs, ce, orientation, left_confidence, right_confidence, cs, ce, 1, 1
  FROM marked WHERE trusted AND NOT is_cut AND ce - cs >= {MIN_WINDOW}
), windows AS (
  SELECT seqid, region_id, format('{{}}:window:{{:03d}}', region_id, split_index) AS candidate_id,
    s AS start_pos, e AS end_pos, e - s AS length, orientation,
    'predicted' AS evidence_level,
    CASE WHEN orientation = 'convergent' AND NOT (t > 0 AND e - s > t) THEN 'convergent_clean' ELSE 'flagged' END AS structural_tier,
    split_index, split_count, s = cs AS keeps_left, e = ce AS keeps_right,
    CASE WHEN orientation <> 'convergent' THEN 'neighbor_orientation_' || orientation END AS f1,
    CASE WHEN t > 0 AND e - s > t THEN 'unusually_long_interval' END AS f2
  FROM pieces, thr
), excluded AS (
  SELECT seqid, region_id, region_id || ':excluded' AS excluded_id, start_pos, end_pos, length,
    CASE WHEN trusted THEN 'below_minimum_window_length' ELSE 'boundary_confidence_insufficient' END AS rule_id,
    CASE WHEN trusted THEN format('remaining {{}}bp after {BUFFER}bp buffer on each side < minimum {MIN_WINDOW}bp', ce - cs)
    ELSE format('left_boundary_confidence={{}}, right_boundary_confidence={{}}; the conservative candidate set requires high confidence on both sides pending independent annotation support (ADR-0004/ADR-0005)', left_confidence, right_confidence) END AS reason
  FROM marked WHERE NOT trusted OR ce <= cs OR (NOT is_cut AND ce - cs < {MIN_WINDOW})
  UNION ALL
  SELECT seqid, region_id, format('{{}}:excluded:{{}}:{{}}', region_id, rule_id, k_start), k_start, k_end,
    k_end - k_start, rule_id, reason FROM cuts
  UNION ALL
  SELECT seqid, region_id, format('{{}}:excluded:below_minimum_window_length:{{}}', region_id, s), s, e, e - s,
    'below_minimum_window_length',
    format('remaining fragment {{}}bp after buffer and exclusion-zone subtraction < minimum {MIN_WINDOW}bp', e - s)
  FROM remains WHERE e - s < {MIN_WINDOW})"""

GFF = """gff AS (
  SELECT o_orderkey*2 AS line_number, concat('chr', o_custkey % 50) AS seqid, 'gene' AS feature_type,
    (o_orderkey*37) % 50000 AS start_pos, (o_orderkey*37) % 50000 + 1 + 200 + o_custkey % 50 AS end_pos,
    CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand,
    concat('g', o_orderkey) AS feature_id, CAST(NULL AS VARCHAR) AS parent_id,
    o_orderpriority = '1-URGENT' AS partial,
    CASE WHEN o_orderkey % 5 = 0 THEN concat('.,', (o_orderkey*37) % 50000 + 1) END AS start_range,
    CASE WHEN o_orderkey % 7 = 0 THEN concat((o_orderkey*37) % 50000 + 1, ',.') END AS end_range
  FROM orders
  UNION ALL
  SELECT event_id*2 + 1, concat('chr', (event_id // 64) % 50), kind,
    (event_id*53) % 50000, (event_id*53) % 50000 + 61, '+',
    CASE WHEN kind = 'CDS' THEN concat('cds', event_id // 8) ELSE concat('e', event_id) END,
    CASE WHEN event_id % 8 = 0 THEN concat('g', event_id) WHEN kind = 'mRNA' THEN concat('g', event_id*2)
      ELSE concat('e', (event_id // 8) * 8) END, false, NULL, NULL
  FROM (SELECT event_id, CASE WHEN event_id % 8 = 0 AND event_type = 'error' THEN 'region'
      WHEN event_id % 8 = 0 THEN 'mRNA' WHEN event_type = 'click' THEN 'mRNA'
      WHEN event_type = 'view' THEN 'exon' WHEN event_type = 'error' THEN 'CDS' ELSE 'region' END AS kind
    FROM events))"""

# Every table of a WITH RECURSIVE list may be recursive; only two are.
ENTITIES = GFF + """, ids AS (
  SELECT feature_id, count(*) AS n, min(start_pos) AS s, max(end_pos) AS e, bool_or(partial) AS p
  FROM gff GROUP BY feature_id
), below_gene(id) AS (
  SELECT feature_id FROM gff WHERE feature_type = 'gene'
  UNION
  SELECT g.feature_id FROM gff g JOIN below_gene b ON g.parent_id = b.id
    JOIN ids ON ids.feature_id = g.feature_id AND ids.n = 1
), standalone AS (
  SELECT * FROM gff WHERE feature_type = 'mRNA'
    AND (parent_id IS NULL OR parent_id NOT IN (SELECT id FROM below_gene))
), below_all(id) AS (
  SELECT id FROM below_gene UNION SELECT feature_id FROM standalone
  UNION
  SELECT g.feature_id FROM gff g JOIN below_all b ON g.parent_id = b.id
    JOIN ids ON ids.feature_id = g.feature_id AND ids.n = 1
), alive AS (
  SELECT * FROM gff WHERE feature_type = 'gene' UNION ALL SELECT * FROM standalone
  UNION ALL SELECT * FROM gff WHERE feature_type IN ('exon', 'CDS')
    AND parent_id NOT IN (SELECT id FROM below_all)
), entities AS (
  SELECT a.feature_id AS entity_id, a.seqid, ids.s AS start_pos, ids.e AS end_pos, a.strand,
    a.feature_type AS entity_type, ids.p AS partial, coalesce(a.start_range, '') AS start_range,
    coalesce(a.end_range, '') AS end_range, a.line_number,
    CASE WHEN a.start_range IS NOT NULL OR (ids.p AND a.end_range IS NULL) THEN 'uncertain' ELSE 'high' END AS start_conf,
    CASE WHEN a.end_range IS NOT NULL OR (ids.p AND a.start_range IS NULL) THEN 'uncertain' ELSE 'high' END AS end_conf
  FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY line_number) AS rn FROM alive) a
  JOIN ids ON ids.feature_id = a.feature_id WHERE rn = 1)"""

SAM = """sam AS (
  SELECT concat('q', o_orderkey) AS qname, o_orderkey, k,
    o_orderkey*4 + k AS line_number,
    CASE WHEN k = 2 THEN third WHEN u THEN CASE k WHEN 0 THEN 77 ELSE 141 END
      WHEN h THEN CASE k WHEN 0 THEN 73 ELSE 133 END
      WHEN o_orderkey % 3 = 0 THEN CASE k WHEN 0 THEN 65 ELSE 129 END
      ELSE CASE k WHEN 0 THEN 99 ELSE 147 END END AS flag,
    CASE WHEN lost THEN '*' WHEN o_orderkey % 4 = 0 THEN concat('chr', o_custkey % 3)
      ELSE concat('chr', (o_custkey + k) % (SELECT count(*) FROM supplier)) END AS rname,
    CASE WHEN lost THEN 0 WHEN o_orderkey % 4 = 0 THEN 20001 + o_orderkey % 97 + k*20
      ELSE (o_orderkey*37 + k*20) % 59000 + 1 END AS pos,
    CASE WHEN lost THEN '*' ELSE ['10M','5M10N5M','25S5M','4M22I4M','6M30D6M','3M7N4M9N3M'][(o_orderkey + k) % 6 + 1] END AS cigar,
    CASE WHEN lost OR o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 7 = 0 OR k = 2 THEN 2 ELSE 1 END AS nh
  FROM (SELECT *, (u OR (h AND k = 1)) AND k < 2 AS lost FROM (
    SELECT o_orderkey, o_custkey, o_orderkey % 11 = 0 AS u, o_orderkey % 13 = 0 AS h,
      CASE o_custkey % 5 WHEN 0 THEN 355 WHEN 1 THEN 2147 END AS third, unnest([0, 1, 2]) AS k
    FROM orders) WHERE k < 2 OR third IS NOT NULL)
), blocks AS (
  SELECT sam.*, b.o AS op, pos - 1 + b.a AS b_start, pos - 1 + b.z AS b_end FROM sam JOIN (VALUES
    ('10M','M',0,10), ('5M10N5M','M',0,5), ('5M10N5M','N',5,15), ('5M10N5M','M',15,20), ('25S5M','M',0,5),
    ('4M22I4M','M',0,4), ('4M22I4M','M',4,8), ('6M30D6M','M',0,6), ('6M30D6M','D',6,36), ('6M30D6M','M',36,42),
    ('3M7N4M9N3M','M',0,3), ('3M7N4M9N3M','N',3,10), ('3M7N4M9N3M','M',10,14), ('3M7N4M9N3M','N',14,23),
    ('3M7N4M9N3M','M',23,26)) AS b(cig, o, a, z) ON b.cig = sam.cigar)"""

PAIRS = SAM + """, mates AS (
  SELECT qname, bool_or(flag & 256 <> 0) AS sec, bool_or(flag & 2048 <> 0) AS sup,
    min_by(sam, line_number) FILTER (WHERE flag & 2304 = 0 AND flag & 64 <> 0) AS a,
    min_by(sam, line_number) FILTER (WHERE flag & 2304 = 0 AND flag & 128 <> 0) AS b
  FROM sam GROUP BY qname
), facts AS (
  SELECT qname, sec, sup, a IS NOT NULL AND b IS NOT NULL AS two,
    a.flag & 4 <> 0 AS ua, b.flag & 4 <> 0 AS ub, a.flag & 2 <> 0 AND b.flag & 2 <> 0 AS pr,
    coalesce(a.nh = 1 AND b.nh = 1, false) AS one, coalesce(a.nh > 1, false) OR coalesce(b.nh > 1, false) AS many,
    a.cigar = '25S5M' OR b.cigar = '25S5M' AS clip,
    a.cigar IN ('4M22I4M','6M30D6M') OR b.cigar IN ('4M22I4M','6M30D6M') AS indel,
    (a.rname NOT IN ('*','chr1','chr2','chr3')) OR (b.rname NOT IN ('*','chr1','chr2','chr3')) AS alien
  FROM mates
), pairs AS (
  SELECT qname, NOT two AS unknown_pair_structure, two AND ua AND ub AS pair_unmapped,
    two AND ua <> ub AS pair_mixed, two AND NOT ua AND NOT ub AS pair_both_mapped,
    two AND NOT ua AND NOT ub AND pr AS pair_proper, two AND NOT ua AND NOT ub AND NOT pr AS pair_discordant,
    two AND NOT ua AND NOT ub AND one AND NOT sec AS pair_unique,
    two AND NOT ua AND NOT ub AND NOT (one AND NOT sec) AND (sec OR many) AS pair_multi,
    two AND NOT ua AND NOT ub AND NOT (one AND NOT sec) AND NOT (sec OR many) AS pair_multiplicity_unknown,
    two AND clip AS pair_softclip_ge20, two AND indel AS pair_indel_ge20,
    two AND alien AS pair_non_nuclear_reference, sup AS pair_with_supplementary
  FROM facts)"""

DEPTH = SAM + ", " + SEQS + """, ev AS (
  SELECT rname AS seqid, p AS pos, sum(st) AS st FROM (
    SELECT rname, b_start AS p, 1 AS st FROM blocks WHERE op = 'M' AND flag & 1796 = 0
    UNION ALL SELECT rname, b_end, -1 FROM blocks WHERE op = 'M' AND flag & 1796 = 0) GROUP BY rname, p
), runs AS (
  SELECT seqid, start_pos, end_pos, depth FROM (SELECT seqid, pos AS start_pos, lead(pos) OVER w AS end_pos,
    CAST(sum(st) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY seqid ORDER BY pos))
  WHERE depth > 0
), bins AS (
  SELECT s.seqid, CAST(b AS BIGINT) AS bin, b*1000 AS start_pos, least(length, (b+1)*1000) AS end_pos,
    coalesce((SELECT sum(depth * (least(r.end_pos, (b+1)*1000) - greatest(r.start_pos, b*1000))) FROM runs r
      WHERE r.seqid = s.seqid AND r.start_pos < (b+1)*1000 AND r.end_pos > b*1000), 0)
      / CAST(least(length, (b+1)*1000) - b*1000 AS DOUBLE) AS mean_depth
  FROM seqs s, generate_series(0, 60) g(b)
), med AS (
  SELECT seqid, count(*) AS total_bins, count(*) FILTER (WHERE mean_depth > 0) AS nonzero_bins,
    coalesce(median(mean_depth) FILTER (WHERE mean_depth > 0), 0.0) AS median_nonzero FROM bins GROUP BY seqid
), stat AS (
  SELECT m.seqid, any_value(total_bins) AS total_bins, any_value(nonzero_bins) AS nonzero_bins,
    any_value(median_nonzero) AS median_nonzero,
    coalesce(median(abs(mean_depth - median_nonzero)) FILTER (WHERE mean_depth > 0), 0.0) AS mad_nonzero
  FROM med m JOIN bins ON bins.seqid = m.seqid GROUP BY m.seqid)"""

BASES = f"""bases AS (
  SELECT concat('doc', doc_id) AS seqid,
    regexp_replace(translate(text, '{LETTERS + LETTERS.lower()}', '{BASE_OF * 2}'), '[^ACGTN]', 'N', 'g') AS bases
  FROM documents)"""

#: Customers as runs, and the catalogue over them.
ENTRIES = """art AS (SELECT c_custkey AS k, i, n FROM customer, (VALUES (0,'baseline_report.md'),(1,'candidate_windows.json'),(2,'candidate_windows.tsv'),
            (3,'candidate_windows_report.md'),(4,'diagnostics.json'),(5,'excluded_regions.json'),(6,'excluded_regions.tsv'),
            (7,'functional_entities.json'),(8,'functional_entities.tsv'),(9,'intergenic_regions.json'),(10,'intergenic_regions.tsv'),
            (11,'statistics.json'),(12,'terminal_regions.json'),(13,'terminal_regions.tsv')) a(i, n)),
          t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 1 THEN 'candidate_windows' WHEN c_custkey % 10 <> 9 THEN 'baseline' ELSE 'unsupported' END AS run_type,
            CASE WHEN c_custkey % 8 = 0 THEN 'failed' ELSE 'complete' END AS ex, c_custkey % 5 = 3 AS lacks, c_custkey % 7 = 0 AS bad, c_acctbal FROM customer),
          r AS (SELECT *, CASE WHEN run_type = 'unsupported' THEN 'unrecognized or unsupported run_manifest schema'
            WHEN run_type = 'baseline' AND lacks THEN 'run_manifest is missing 1 required artifact entries'
            WHEN ex <> 'complete' THEN 'execution_status=failed, not complete'
            WHEN bad THEN 'one or more artifacts do not match the hashes recorded in run_manifest.json' ELSE 'ok' END AS reason FROM t),
          entries AS (SELECT concat('r', k) AS run_id, run_type, CASE WHEN k % 3 = 1 THEN concat('r', k - 1) END AS parent_run_id, ex AS execution_status,
            CASE WHEN k % 4 = 0 THEN 'passed' ELSE 'pending' END AS verification_status,
            CASE WHEN k % 4 = 0 AND c_acctbal > 0 THEN 'accepted' ELSE 'blocked' END AS scientific_acceptance_status,
            reason = 'ok' AS displayable, reason FROM r)"""

DESCRIBE = """count(*) AS count, min(length) AS min,
  max(length) FILTER (WHERE i = round_even((n-1)*CAST(0.25 AS DOUBLE), 0)) AS p25,
  max(length) FILTER (WHERE i = round_even((n-1)*CAST(0.5 AS DOUBLE), 0)) AS median,
  max(length) FILTER (WHERE i = round_even((n-1)*CAST(0.75 AS DOUBLE), 0)) AS p75,
  max(length) AS max, round(sum(length) / CAST(count(*) AS DOUBLE), 6) AS mean"""


def _w(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"


def oracle_sql() -> dict[str, str]:
    zero_filled = """SELECT d.orientation, count(g.region_id) AS n
      FROM (VALUES ('convergent'),('tandem'),('divergent'),('unknown')) d(orientation)
      LEFT JOIN gaps g ON g.orientation = d.orientation GROUP BY d.orientation"""
    return {
        "gap_inventory": _w(GAPS, "SELECT * FROM gaps"),
        "cluster_merge": _w(CLUSTERS, "SELECT seqid, cluster_no, start_pos, end_pos FROM clusters"),
        "edge_strands": _w(CLUSTERS, "SELECT * FROM clusters"),
        "cluster_members": _w(CLUSTERS, "SELECT seqid, entity_id, CAST(cluster_no AS BIGINT) AS cluster_no FROM c"),
        "gap_neighbours": _w(GAPS, """SELECT g.seqid, region_id, 'left' AS side, entity_id, strand, conf AS confidence
          FROM gaps g JOIN feat f ON f.seqid = g.seqid AND f.end_pos = g.start_pos
          UNION ALL SELECT g.seqid, region_id, 'right', entity_id, strand, conf
          FROM gaps g JOIN feat f ON f.seqid = g.seqid AND f.start_pos = g.end_pos"""),
        "terminal_regions": _w(TERMINALS, "SELECT *, end_pos - start_pos AS length FROM terminals"),
        "conservation": _w(GAPS + ", " + TERMINALS.split(FEAT + ", ")[1], """SELECT n.seqid, n.length,
          CAST(coalesce(cv, 0) AS BIGINT) AS covered_bp, CAST(coalesce(gv, 0) AS BIGINT) AS gap_bp,
          CAST(coalesce(tv, 0) AS BIGINT) AS terminal_bp,
          coalesce(cv, 0) + coalesce(gv, 0) + coalesce(tv, 0) = n.length AS conserved FROM nuc n
          LEFT JOIN (SELECT seqid, sum(end_pos - start_pos) AS cv FROM clusters GROUP BY seqid) a ON a.seqid = n.seqid
          LEFT JOIN (SELECT seqid, sum(length) AS gv FROM gaps GROUP BY seqid) b ON b.seqid = n.seqid
          LEFT JOIN (SELECT seqid, sum(end_pos - start_pos) AS tv FROM terminals GROUP BY seqid) t ON t.seqid = n.seqid"""),
        "overlap_pairs": _w(FEAT, """SELECT l.seqid, CASE WHEN r.end_pos <= l.end_pos THEN 'nested' ELSE 'overlaps' END AS kind,
          l.entity_id AS left_id, r.entity_id AS right_id, r.start_pos AS intersection_start,
          least(l.end_pos, r.end_pos) AS intersection_end FROM feat l JOIN feat r ON l.seqid = r.seqid
          AND r.start_pos >= l.start_pos AND r.start_pos < l.end_pos
          AND (l.start_pos, l.end_pos, l.entity_id) < (r.start_pos, r.end_pos, r.entity_id)"""),
        "overlap_pair_counts": _w(FEAT, """SELECT l.seqid, CASE WHEN r.end_pos <= l.end_pos THEN 'nested' ELSE 'overlaps' END AS kind, count(*) AS n
          FROM feat l JOIN feat r ON l.seqid = r.seqid AND r.start_pos >= l.start_pos AND r.start_pos < l.end_pos
          AND (l.start_pos, l.end_pos, l.entity_id) < (r.start_pos, r.end_pos, r.entity_id) GROUP BY ALL"""),
        "zone_overlaps": _w(GAPS + ", " + ZONES, """SELECT g.seqid, region_id, ordinal,
          greatest(z_start, start_pos) AS cut_start, least(z_end, end_pos) AS cut_end FROM gaps g
          JOIN zones z ON z.seqid = g.seqid AND z_start < end_pos AND z_end > start_pos"""),
        "interval_subtraction": _w(GAPS + ", " + ZONES, """, cut AS (SELECT g.seqid, region_id, start_pos AS gs, end_pos AS ge,
            greatest(z_start, start_pos) AS a, least(z_end, end_pos) AS b, ordinal FROM gaps g
            JOIN zones z ON z.seqid = g.seqid AND z_start < end_pos AND z_end > start_pos
          ), ord AS (SELECT *, max(b) OVER (PARTITION BY region_id ORDER BY a, b, ordinal
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cut)
          SELECT seqid, region_id, coalesce(reach, gs) AS start_pos, a AS end_pos FROM ord WHERE a > coalesce(reach, gs)
          UNION ALL SELECT seqid, region_id, max(b), ge FROM cut GROUP BY seqid, region_id, ge HAVING max(b) < ge
          UNION ALL SELECT seqid, region_id, start_pos, end_pos FROM gaps WHERE region_id NOT IN (SELECT region_id FROM cut)"""),
        "fixed_windows": _w(SEQS, """SELECT seqid, length, w.window, w.s AS start_pos, w.e AS end_pos FROM seqs,
          (VALUES ('start', CAST(0 AS BIGINT), CAST(5000 AS BIGINT)), ('middle', 27550, 32550), ('end', 55100, 60100)) w("window", s, e)"""),
        "endpoint_proximity": _w(FEAT + ", " + SEQS, """SELECT feat.seqid, entity_id, start_pos, end_pos,
          CASE WHEN start_pos < 1000 AND five_prime <> 'complete' THEN 'five_prime'
            WHEN length - end_pos < 1000 AND three_prime <> 'complete' THEN 'three_prime' END AS endpoint_side,
          CASE WHEN start_pos < 1000 AND five_prime <> 'complete' THEN five_prime
            WHEN length - end_pos < 1000 AND three_prime <> 'complete' THEN three_prime END AS endpoint_status
          FROM feat JOIN seqs ON seqs.seqid = feat.seqid"""),
        "point_in_window": _w(SEQS, """SELECT 'chr' || (user_id % (SELECT count(*) FROM supplier)) AS seqid, w.window,
          count(*) AS points, round(sum(value), 2) AS total FROM events,
          (VALUES ('start', 0, 5000), ('middle', 27550, 32550), ('end', 55100, 60100)) w("window", s, e)
          WHERE event_id * 97 % 60100 >= w.s AND event_id * 97 % 60100 < w.e GROUP BY ALL"""),
        "bounds_violations": _w(FEAT + ", " + SEQS, """SELECT feat.seqid, entity_id, start_pos, end_pos,
          CASE WHEN length IS NULL THEN 'sequence is absent' ELSE 'coordinate out of bounds' END AS problem
          FROM feat LEFT JOIN (SELECT * FROM seqs WHERE seq_class = 'nuclear_chromosome') s ON s.seqid = feat.seqid
          WHERE length IS NULL OR end_pos > 59900"""),
        "unclassified_sequences": _w(SEQS, """SELECT seqid, 'unclassified' AS problem FROM seqs
          WHERE seqid NOT IN (SELECT 'chr' || p_partkey * 2 FROM part)
          UNION ALL SELECT 'chr' || p_partkey * 2, 'absent' FROM part WHERE 'chr' || p_partkey * 2 NOT IN (SELECT seqid FROM seqs)"""),
        "sequence_remap": _w(FEAT + ", " + SEQS, """, named AS (SELECT DISTINCT seqid,
            CASE WHEN CAST(substr(seqid, 4) AS BIGINT) % 4 = 1 THEN 'chr' || (CAST(substr(seqid, 4) AS BIGINT) + 1)
              WHEN CAST(substr(seqid, 4) AS BIGINT) % 4 = 3 THEN 'gone' || substr(seqid, 4) ELSE seqid END AS target FROM feat)
          SELECT seqid, target, CASE WHEN target NOT IN (SELECT seqid FROM seqs) THEN 'cannot map to a sequence'
            WHEN count(*) OVER (PARTITION BY target) > 1 THEN 'several names map to one sequence' END AS problem FROM named"""),
        "nuclear_only": _w(FEAT + ", " + SEQS, """SELECT seqid, entity_id FROM feat
          WHERE seqid IN (SELECT seqid FROM seqs WHERE seq_class = 'nuclear_chromosome')"""),
        "endpoint_violations": """SELECT concat('chr', s_suppkey) AS seqid, endpoint, status FROM (
          SELECT s_suppkey, 'five_prime' AS endpoint, CASE WHEN s_acctbal < 0 THEN 'broken' ELSE 'complete' END AS status FROM supplier
          UNION ALL SELECT s_suppkey, 'three_prime', CASE WHEN s_nationkey > 12 THEN NULL ELSE 'partial' END FROM supplier)
          WHERE status IS NULL OR status = 'broken'""",
        "duplicate_ids": """SELECT concat('i', l_orderkey) AS feature_id, count(*) AS records,
          min(l_orderkey*100 + l_linenumber) AS first_line,
          count(DISTINCT (l_orderkey*37 + l_linenumber*11) % 60000 * 1000 + CAST(l_quantity AS INT)) > 1 AND l_orderkey % 2 = 1 AS conflicting
          FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
          UNION ALL SELECT concat('x', o_orderkey), count(*), min(o_orderkey*100 + 50), false FROM orders GROUP BY o_orderkey HAVING count(*) > 1""",
        "duplicate_lines": """WITH f AS (
            SELECT concat('i', l_orderkey) AS feature_id, l_orderkey*100 + l_linenumber AS line_number, l_orderkey % 2 = 1 AS whole,
              (l_orderkey*37 + l_linenumber*11) % 60000 * 1000 + CAST(l_quantity AS INT) AS place FROM lineitem
            UNION ALL SELECT concat('x', o_orderkey), o_orderkey*100 + 50, true, 0 FROM orders)
          SELECT feature_id, line_number, whole AND min(place) OVER w < max(place) OVER w AS conflicting
          FROM f WINDOW w AS (PARTITION BY feature_id) QUALIFY count(*) OVER w > 1""",
        "missing_parents": """SELECT o_orderkey*100 + 50 AS line_number, concat('x', o_orderkey) AS feature_id,
          concat('i', o_orderkey) AS parent_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
        "ambiguous_parents": """SELECT o_orderkey*100 + 50 AS line_number, concat('x', o_orderkey) AS feature_id,
          concat('i', o_orderkey) AS parent_id FROM orders
          WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""",
        "ancestor_closure": """WITH RECURSIVE links AS (
            SELECT concat('o', o_orderkey) AS child_id, concat('c', o_custkey) AS parent_id FROM orders
            UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer
          ), below(id, steps) AS (SELECT concat('n', n_nationkey), 0 FROM nation WHERE n_regionkey = 1
            UNION SELECT child_id, steps + 1 FROM links JOIN below ON parent_id = id)
          SELECT id, CAST(min(steps) AS INT) AS steps FROM below GROUP BY id""",
        "normalized_entities": _w(ENTITIES, "SELECT * FROM entities", True),
        "published_runs": _w(ENTITIES, """, o AS (SELECT seqid, start_pos, end_pos, max(end_pos) OVER (PARTITION BY seqid
            ORDER BY start_pos, end_pos, entity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM entities),
          ext AS (SELECT s.seqid, length, f, t FROM (SELECT seqid, max(end_pos) + 10 AS length FROM gff GROUP BY seqid) s
            LEFT JOIN (SELECT seqid, min(start_pos) AS f, max(end_pos) AS t FROM entities GROUP BY seqid) e ON e.seqid = s.seqid),
          sizes AS (SELECT 'entities' AS table_name, count(*) AS rows FROM entities
            UNION ALL SELECT 'regions', count(*) FILTER (WHERE start_pos > prev_end) FROM o
            UNION ALL SELECT 'terminals', CAST(sum(CASE WHEN f IS NULL THEN 1 ELSE CAST(f > 0 AS INT) + CAST(t < length AS INT) END) AS BIGINT) FROM ext
            UNION ALL SELECT 'split regions', count(*) FILTER (WHERE start_pos > prev_end) FROM o)
          SELECT CASE WHEN table_name = 'split regions' THEN 'candidate_windows' ELSE 'baseline' END AS run_type,
            CASE WHEN table_name = 'split regions' THEN 'baseline-derived' END AS parent_run_id, true AS displayable, 'ok' AS reason,
            'pending' AS verification_status, table_name, rows FROM sizes""", True),
        "table_hash": """WITH t AS (SELECT md5(concat_ws('', """ + ", ".join(
            f"coalesce(concat(length({c}), ':', {c}), '-')" for c in (
                "CAST(CAST(l_discount AS DECIMAL(38,6)) AS VARCHAR)", "CAST(CAST(l_extendedprice AS DECIMAL(38,6)) AS VARCHAR)",
                "CAST(l_linenumber AS VARCHAR)", "l_linestatus", "CAST(l_orderkey AS VARCHAR)", "CAST(l_partkey AS VARCHAR)",
                "CAST(CAST(l_quantity AS DECIMAL(38,6)) AS VARCHAR)", "l_returnflag", "CAST(epoch_us(l_shipdate) AS VARCHAR)",
                "CAST(l_suppkey AS VARCHAR)", "CAST(CAST(l_tax AS DECIMAL(38,6)) AS VARCHAR)")) + """)) AS h FROM lineitem)
          SELECT count(*) AS rows, concat_ws('-', """ + ", ".join(
            f"CAST(sum(CAST(concat('0x', substr(h, {8 * k + 1}, 8)) AS BIGINT)) AS VARCHAR)" for k in range(4)) + """) AS content_hash FROM t""",
        "diagnostic_counts": _w(ENTITIES, """, prev AS (SELECT seqid,
            (start_pos, end_pos, entity_id) < lag((start_pos, end_pos, entity_id)) OVER (PARTITION BY seqid ORDER BY line_number) AS bad FROM entities)
          SELECT * FROM (
          SELECT 'duplicate_id' AS kind, count(*) AS n FROM ids WHERE n > 1
          UNION ALL SELECT 'missing_parent', count(*) FROM gff WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT feature_id FROM ids)
          UNION ALL SELECT 'ambiguous_parent', count(*) FROM gff WHERE parent_id IN (SELECT feature_id FROM ids WHERE n > 1)
          UNION ALL SELECT 'ignored_type', count(DISTINCT feature_type) FROM gff WHERE feature_type = 'region'
          UNION ALL SELECT 'abnormal_order', count(DISTINCT seqid) FROM prev WHERE bad
          UNION ALL SELECT CASE WHEN r.end_pos <= l.end_pos THEN 'nested' ELSE 'overlaps' END, count(*) FROM entities l
            JOIN entities r ON l.seqid = r.seqid AND r.start_pos >= l.start_pos AND r.start_pos < l.end_pos
            AND (l.start_pos, l.end_pos, l.entity_id) < (r.start_pos, r.end_pos, r.entity_id) GROUP BY 1) WHERE n > 0""", True),
        "abnormal_order": """SELECT concat('chr', user_id) AS seqid, count(*) AS entity_count FROM (
            SELECT user_id, event_id, (CAST(trunc(value) AS BIGINT), event_id) < lag((CAST(trunc(value) AS BIGINT), event_id))
              OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM events) GROUP BY user_id HAVING bool_or(bad)""",
        "entity_boundary_summary": _w(ENTITIES, """SELECT t AS entity_type, count(*) AS count,
          count(*) FILTER (WHERE partial) AS partial_count, count(*) FILTER (WHERE start_range <> '') AS start_range_count,
          count(*) FILTER (WHERE end_range <> '') AS end_range_count,
          round(count(*) FILTER (WHERE partial) / CAST(count(*) AS DOUBLE), 6) AS partial_fraction
          FROM (SELECT *, unnest(['*', entity_type]) AS t FROM entities) GROUP BY t""", True),
        "gff_parse": _w(GFF, """SELECT line_number, seqid, feature_type, start_pos, end_pos, strand, feature_id,
          coalesce(parent_id, '') AS parent_ids FROM gff"""),
        "attribute_map": """SELECT o_orderkey*2 AS line_number, concat('g', o_orderkey) AS feature_id,
          concat('gene ', o_orderkey) AS name, 'a,b|c+d' AS notes, CAST(o_orderkey AS VARCHAR) AS gene_id,
          o_orderpriority = '1-URGENT' AS partial FROM orders""",
        "type_counts": _w(GFF, "SELECT feature_type, count(*) AS n FROM gff GROUP BY feature_type"),
        "source_profile": _w(GFF, """SELECT seqid AS source_id, count(*) FILTER (WHERE feature_type = 'gene') AS gene_count,
          count(*) FILTER (WHERE feature_type = 'mRNA') AS transcript_count,
          count(*) FILTER (WHERE feature_type = 'CDS') AS orf_cds_count, 0 AS ncrna_count, 0 AS trna_count, 0 AS rrna_count,
          count(*) FILTER (WHERE feature_type = 'gene' AND partial) AS partial_gene_count,
          count(start_range) AS start_range_gene_count, count(end_range) AS end_range_gene_count,
          round(count(*) FILTER (WHERE feature_type = 'gene' AND partial)
            / CAST(nullif(count(*) FILTER (WHERE feature_type = 'gene'), 0) AS DOUBLE), 6) AS partial_gene_fraction,
          count(DISTINCT seqid) AS sequence_count, 'ncRNA,tRNA,rRNA' AS missing_feature_types FROM gff GROUP BY seqid"""),
        "describe_lengths": _w(GAPS, f""", sub AS (SELECT 'all' AS subset, length FROM gaps
            UNION ALL SELECT orientation, length FROM gaps
            UNION ALL SELECT 'high_confidence', length FROM gaps WHERE left_confidence = 'high' AND right_confidence = 'high'
          ), r AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY length) - 1 AS i,
            count(*) OVER (PARTITION BY subset) AS n FROM sub)
          SELECT subset, {DESCRIBE} FROM r GROUP BY subset"""),
        "orientation_counts": _w(GAPS, zero_filled),
        "high_confidence_subset": _w(GAPS, """SELECT count(*) AS region_count,
          count(*) FILTER (WHERE h) AS high_confidence_count,
          round(count(*) FILTER (WHERE h) / CAST(count(*) AS DOUBLE), 6) AS high_confidence_fraction,
          count(*) FILTER (WHERE h AND orientation = 'convergent') AS convergent_count,
          count(*) FILTER (WHERE h AND orientation = 'tandem') AS tandem_count,
          count(*) FILTER (WHERE h AND orientation = 'divergent') AS divergent_count,
          count(*) FILTER (WHERE h AND orientation = 'unknown') AS unknown_count
          FROM (SELECT *, left_confidence = 'high' AND right_confidence = 'high' AS h FROM gaps)"""),
        "sequence_statistics": _w(GAPS + ", " + SEQS, """SELECT s.seqid, seq_class, s.length,
          (SELECT count(*) FROM feat f WHERE f.seqid = s.seqid) AS functional_entity_count,
          CASE WHEN seq_class = 'nuclear_chromosome' THEN (SELECT count(*) FROM clusters f WHERE f.seqid = s.seqid) ELSE 0 END AS boundary_cluster_count,
          CASE WHEN seq_class = 'nuclear_chromosome' THEN (SELECT count(*) FROM gaps f WHERE f.seqid = s.seqid) ELSE 0 END AS intergenic_region_count,
          seq_class <> 'nuclear_chromosome' AS excluded_from_nuclear_statistics FROM seqs s"""),
        "candidate_windows": _w(RULES, """SELECT seqid, region_id, candidate_id, start_pos, end_pos, length, orientation,
          evidence_level, structural_tier, split_index, split_count, keeps_left, keeps_right,
          'unavailable' AS collinearity_status, concat_ws(', ', f1, f2) AS rule_flag_ids FROM windows"""),
        "excluded_regions": _w(RULES, "SELECT * FROM excluded"),
        "excluded_by_rule": _w(RULES, "SELECT rule_id, count(*) AS n FROM excluded GROUP BY rule_id"),
        "rule_summary": _w(RULES, """SELECT 'input_intergenic_region_count' AS measure, '*' AS label, count(*) AS n FROM gaps
          UNION ALL SELECT 'candidate_window_count', '*', count(*) FROM windows
          UNION ALL SELECT 'excluded_region_count', '*', count(*) FROM excluded
          UNION ALL SELECT 'excluded_by_rule', rule_id, count(*) FROM excluded GROUP BY rule_id
          UNION ALL SELECT 'candidate_structural_tier_counts', structural_tier, count(*) FROM windows GROUP BY structural_tier"""),
        "window_split": _w(RULES, """SELECT split_count, count(DISTINCT region_id) AS regions, count(*) AS windows,
          count(*) FILTER (WHERE keeps_left) AS keep_left, count(*) FILTER (WHERE keeps_right) AS keep_right
          FROM windows GROUP BY split_count"""),
        "long_interval_threshold": _w(RULES, "SELECT t AS long_threshold FROM thr"),
        "sam_parse": _w(SAM, "SELECT line_number, qname, flag, rname, pos, cigar, nh FROM sam"),
        "pair_classes": _w(PAIRS, "SELECT * FROM pairs"),
        "pair_summary": _w(PAIRS, """SELECT count(*) AS total_query_pairs, """ + ", ".join(
            f"count(*) FILTER (WHERE {c}) AS {c}" for c in (
                "unknown_pair_structure", "pair_unmapped", "pair_mixed", "pair_both_mapped", "pair_proper",
                "pair_discordant", "pair_unique", "pair_multi", "pair_multiplicity_unknown",
                "pair_softclip_ge20", "pair_indel_ge20", "pair_non_nuclear_reference",
                "pair_with_supplementary")) + """,
          bool_and(unknown_pair_structure OR pair_unmapped OR pair_mixed OR pair_both_mapped) AS classification_complete FROM pairs"""),
        "record_counts": _w(SAM, """SELECT count(*) AS alignment_records,
          count(*) FILTER (WHERE flag & 256 <> 0) AS secondary_alignment_records,
          count(*) FILTER (WHERE flag & 2048 <> 0) AS supplementary_alignment_records FROM sam"""),
        "both_unmapped": _w(SAM, "SELECT line_number, qname, flag FROM sam WHERE flag & 12 = 12 AND flag & 2304 = 0"),
        "junction_support": _w(SAM, """SELECT rname, b_start AS intron_start, b_end AS intron_end,
          count(DISTINCT qname) FILTER (WHERE coalesce(nh = 1, false) AND flag & 256 = 0) AS unique_support,
          count(DISTINCT qname) FILTER (WHERE NOT (coalesce(nh = 1, false) AND flag & 256 = 0)) AS multi_support
          FROM blocks WHERE op = 'N' AND flag & 2052 = 0 AND rname <> '*' GROUP BY ALL"""),
        "depth_runs": _w(DEPTH, "SELECT * FROM runs"),
        "coverage_profile": _w(DEPTH, """, hist AS (SELECT r.seqid, depth, sum(end_pos - start_pos) AS n FROM runs r
            JOIN seqs ON seqs.seqid = r.seqid GROUP BY r.seqid, depth
          ), full_hist AS (SELECT * FROM hist UNION ALL SELECT s.seqid, 0, length - coalesce((SELECT sum(n) FROM hist h WHERE h.seqid = s.seqid), 0) FROM seqs s
          ), cum AS (SELECT *, sum(n) OVER (PARTITION BY seqid ORDER BY depth) AS hi, sum(n) OVER (PARTITION BY seqid) AS total FROM full_hist)
          SELECT seqid, CAST(any_value(total) AS BIGINT) AS length, CAST(coalesce(sum(n) FILTER (WHERE depth > 0), 0) AS BIGINT) AS covered_bases,
            round(coalesce(sum(n) FILTER (WHERE depth > 0), 0) / CAST(any_value(total) AS DOUBLE), 6) AS coverage_fraction,
            round(sum(n * depth) / CAST(any_value(total) AS DOUBLE), 6) AS mean_depth,
            (min(depth) FILTER (WHERE hi > (total - 1) // 2) + min(depth) FILTER (WHERE hi > total // 2)) / 2.0::DOUBLE AS median_depth,
            CAST(max(depth) AS BIGINT) AS max_depth FROM cum GROUP BY seqid"""),
        "bin_means": _w(DEPTH, "SELECT seqid, bin, start_pos, end_pos, round(mean_depth, 6) AS mean_depth FROM bins"),
        "bin_statistics": _w(DEPTH, """SELECT seqid, total_bins, nonzero_bins, round(median_nonzero, 6) AS median_nonzero,
          round(mad_nonzero, 6) AS mad_nonzero,
          round(median_nonzero + greatest(10 * mad_nonzero, 5 * median_nonzero, 10.0), 6) AS threshold FROM stat"""),
        "depth_outliers": _w(DEPTH, """, m2 AS (SELECT seqid, median(mean_depth) AS mm FROM bins WHERE mean_depth > 0 GROUP BY seqid),
          sp AS (SELECT b.seqid, mm, median(abs(mean_depth - mm)) AS mad FROM bins b JOIN m2 ON m2.seqid = b.seqid
            WHERE mean_depth > 0 GROUP BY b.seqid, mm),
          peaks AS (SELECT b.*, mm, mad FROM bins b JOIN sp ON sp.seqid = b.seqid)
          SELECT seqid, start_pos, end_pos, round(mean_depth, 6) AS mean_depth, round(mm, 6) AS median_nonzero,
            round(mad, 6) AS mad_nonzero, 'high_depth_outlier' AS classification FROM peaks
          WHERE mean_depth > mm + greatest(10 * mad, 5 * mm, 10.0)"""),
        "window_coverage": _w(DEPTH, """SELECT seqid, "window" AS window_id, s AS start_pos, e AS end_pos,
            CAST(coalesce(sum(least(end_pos, e) - greatest(start_pos, s)), 0) AS BIGINT) AS covered_bases,
            round(coalesce(sum(least(end_pos, e) - greatest(start_pos, s)), 0) / 5000.0, 6) AS coverage_fraction,
            round(coalesce(sum(depth * (least(end_pos, e) - greatest(start_pos, s))), 0) / 5000.0, 6) AS mean_depth,
            CAST(coalesce(max(depth), 0) AS BIGINT) AS max_depth FROM (
          SELECT seqs.seqid, w.window, w.s, w.e, r.start_pos, r.end_pos, r.depth FROM seqs CROSS JOIN
            (VALUES ('start', 0, 5000), ('middle', 27550, 32550), ('end', 55100, 60100)) w("window", s, e)
          LEFT JOIN runs r ON r.seqid = seqs.seqid AND r.start_pos < w.e AND r.end_pos > w.s) GROUP BY ALL"""),
        "mirror_compare": _w(FEAT, """, l AS (SELECT concat('g', l_orderkey) AS id, concat('chr', l_suppkey) AS seqid,
            (l_orderkey*37 + l_linenumber*11) % 60000 AS s, (l_orderkey*37 + l_linenumber*11) % 60000 + CAST(l_quantity AS INT) AS e,
            CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END AS st FROM lineitem),
          ld AS (SELECT DISTINCT * FROM l), rd AS (SELECT DISTINCT id, seqid, s, CASE WHEN s % 3 = 0 THEN e + 1 ELSE e END AS e, st FROM l WHERE s % 5 <> 0),
          lo AS (SELECT id, max((seqid, s, e, st)) AS p FROM ld GROUP BY id), ro AS (SELECT id, max((seqid, s, e, st)) AS p FROM rd GROUP BY id)
          SELECT (SELECT count(*) FROM ld) AS left_gene_count, (SELECT count(*) FROM rd) AS right_gene_count,
            count(*) AS shared_gene_id_count, count(*) FILTER (WHERE lo.p = ro.p) AS exact_boundary_match_count,
            round(count(*) FILTER (WHERE lo.p = ro.p) / CAST(count(*) AS DOUBLE), 6) AS exact_boundary_match_fraction
          FROM lo JOIN ro ON lo.id = ro.id"""),
        "exact_shared": """SELECT count(*) AS shared, count(*) FILTER (WHERE c_nationkey = s_nationkey) AS exact
          FROM customer JOIN supplier ON c_custkey = s_suppkey""",
        "two_sided_diff": """SELECT o_custkey, o_orderstatus, CAST(sum(a) AS BIGINT) AS published_rows, CAST(sum(b) AS BIGINT) AS recomputed_rows FROM (
            SELECT o_custkey, o_orderstatus, 1 AS a, 0 AS b FROM orders
            UNION ALL SELECT o_custkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END, 0, 1 FROM orders)
          GROUP BY ALL HAVING sum(a) <> sum(b)""",
        "set_difference": """SELECT k AS custkey, 'left_only' AS side FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
          UNION ALL SELECT k, 'right_only' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT c_custkey FROM customer)""",
        "repeatability": """SELECT name, left_sha256, right_sha256, CASE WHEN right_sha256 IS NULL THEN 'left_only'
            WHEN left_sha256 IS NULL THEN 'right_only' WHEN left_sha256 = right_sha256 THEN 'identical' ELSE 'different' END AS status
          FROM (SELECT concat('doc', doc_id) AS name, sha256(text) AS left_sha256 FROM documents WHERE doc_id % 13 <> 2) l
          FULL JOIN (SELECT concat('doc', doc_id) AS name, sha256(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END) AS right_sha256
            FROM documents WHERE doc_id % 13 <> 1) r USING (name)""",
        "declared_identity": """SELECT concat('doc', doc_id) AS path, CASE WHEN doc_id % 13 = 1 THEN 'file is missing'
            WHEN doc_id % 9 = 0 THEN 'file identity mismatch' END AS problem,
          NOT (doc_id % 13 = 1 OR doc_id % 9 = 0) AS matches FROM documents WHERE doc_id % 13 <> 2""",
        "reverse_complement_documents": _w(BASES, "SELECT seqid, reverse(translate(bases, 'ACGTN', 'TGCAN')) AS reversed FROM bases"),
        "sequence_chunks": _w(BASES, """SELECT seqid, CAST(i AS BIGINT) AS chunk_no, substr(bases, i*4096 + 1, 4096) AS bases FROM (
          SELECT seqid, bases, unnest(range((length(bases) + 4095) // 4096)) AS i FROM bases)"""),
        "fasta_index": _w(BASES, """SELECT seqid, length(bases) AS length, seqid || ' document ' || length(bases) AS description
          FROM bases WHERE bases IS NOT NULL"""),
        "fasta_chunks": _w(BASES, """SELECT seqid, i AS chunk_no, substr(bases, i * 4096 + 1, 4096) AS bases FROM (
          SELECT seqid, bases, unnest(range(0, (length(bases) + 4095) // 4096)) AS i FROM bases WHERE bases <> '')"""),
        "window_sequence": _w(BASES, """SELECT seqid, start_pos, end_pos, substr(bases, start_pos + 1, end_pos - start_pos) AS sequence FROM (
          SELECT seqid, bases, CAST(length(bases) // 4 AS BIGINT) AS start_pos, CAST(length(bases) // 2 AS BIGINT) AS end_pos FROM bases)
          WHERE end_pos > start_pos"""),
        "anchor_hits": _w(BASES, """, anchors AS (SELECT DISTINCT substr(bases, spot + 1, 21) AS anchor FROM (
            SELECT bases, unnest(range(0, length(bases) - 20, 500)) AS spot FROM bases WHERE length(bases) >= 21)),
          probes AS (SELECT anchor, anchor AS q, '+' AS o FROM anchors
            UNION ALL SELECT anchor, reverse(translate(anchor, 'ACGTN', 'TGCAN')), '-' FROM anchors),
          kmers AS (SELECT seqid, i AS pos, substr(bases, i + 1, 21) AS k FROM (
            SELECT seqid, bases, unnest(range(length(bases) - 20)) AS i FROM bases WHERE length(bases) >= 21)),
          hit AS (SELECT anchor, o, k.*, row_number() OVER (PARTITION BY anchor ORDER BY seqid, o, pos) AS nth,
            count(*) OVER (PARTITION BY anchor) AS hits FROM probes JOIN kmers k ON k = q)
          SELECT anchor, hits, least(hits, 3) AS capped_hits, seqid AS hit_seqid, o AS hit_orientation, pos AS hit_pos
          FROM hit WHERE nth = 1"""),
        "boundary_mapping": _w(BASES, f""", places AS (
            SELECT seqid, bases, length(bases) AS length, unnest(range(0, greatest(length(bases) - 1, 0) + 1, 1000)) AS spot
            FROM bases WHERE bases IS NOT NULL),
          gene AS (SELECT seqid || ':' || spot AS feature_id, seqid, bases, length, spot + least(length - spot, 1000) // 4 AS s,
            spot + least(length - spot, 1000) // 2 AS e FROM places),
          flag AS (SELECT *, s - 50 < 0 OR e - 1 + 50 >= length AS edge FROM gene),
          side AS (SELECT *, CASE WHEN NOT edge THEN substr(bases, s - 49, 101) END AS a, CASE WHEN NOT edge THEN substr(bases, e - 50, 101) END AS b FROM flag),
          anchors AS (SELECT a AS anchor FROM side WHERE a IS NOT NULL UNION SELECT b FROM side WHERE b IS NOT NULL),
          probes AS (SELECT anchor, anchor AS q, '+' AS o FROM anchors
            UNION ALL SELECT anchor, reverse(translate(anchor, 'ACGTN', 'TGCAN')), '-' FROM anchors),
          kmers AS (SELECT seqid, i AS pos, substr(bases, i + 1, 101) AS k FROM (
            SELECT seqid, bases, unnest(range(length(bases) - 100)) AS i FROM bases WHERE length(bases) >= 101)),
          hit AS (SELECT anchor, count(*) AS n, least(count(*), 3) AS c, min(seqid) AS t, min(o) AS o, min(pos) + 50 AS m
            FROM probes JOIN kmers ON k = q GROUP BY anchor),
          x AS (SELECT side.*, coalesce(h.n, 0) AS an, coalesce(h.c, 0) AS ac, h.t AS at1, h.o AS ao, h.m AS am,
              coalesce(g.n, 0) AS bn, coalesce(g.c, 0) AS bc, g.t AS bt, g.o AS bo, g.m AS bm
            FROM side LEFT JOIN hit h ON h.anchor = a LEFT JOIN hit g ON g.anchor = b),
          v AS (SELECT *, CASE WHEN edge THEN 0 WHEN an = 0 AND bn = 0 THEN 1 WHEN an <> 1 OR bn <> 1 THEN 2
            WHEN at1 <> bt OR ao <> bo THEN 3 WHEN CASE WHEN ao = '+' THEN am > bm ELSE bm > am END THEN 4 ELSE 5 END AS v FROM x)
          SELECT feature_id, CASE WHEN NOT edge THEN seqid END AS source_seqid, CASE WHEN NOT edge THEN s END AS source_start,
            CASE WHEN NOT edge THEN e END AS source_end, CASE WHEN NOT edge THEN '+' END AS source_strand,
            CASE WHEN NOT edge THEN 101 END AS anchor_length,
            CASE WHEN NOT edge THEN ac END AS start_anchor_hit_count, CASE WHEN NOT edge THEN bc END AS end_anchor_hit_count,
            (['uncertain', 'unmappable', 'uncertain', 'conflict', 'conflict', 'consistent'])[v + 1] AS mapping_status,
            (['{REASON_EDGE}', '{REASON_NONE}', '{REASON_MANY}', '{REASON_TARGETS}', '{REASON_ORDER}', '{REASON_GOOD}'])[v + 1] AS mapping_reason,
            CASE WHEN v = 5 THEN at1 END AS target_seqid, CASE WHEN v = 5 THEN least(am, bm) END AS target_start,
            CASE WHEN v = 5 THEN greatest(am, bm) + 1 END AS target_end, CASE WHEN v = 5 THEN ao END AS assembly_orientation,
            CASE WHEN v = 5 THEN ao END AS mapped_strand,
            CASE WHEN v = 5 THEN least(am, bm) - s END AS start_boundary_offset,
            CASE WHEN v = 5 THEN greatest(am, bm) + 1 - e END AS end_boundary_offset FROM v"""),
        "probe_trios": _w(FEAT, """, r AS (SELECT seqid, entity_id, row_number() OVER (PARTITION BY seqid ORDER BY start_pos, end_pos, entity_id) - 1 AS i,
            count(*) OVER (PARTITION BY seqid) AS n FROM feat),
          t AS (SELECT *, CASE WHEN i IN (0, 1, least(n - 1, 2)) THEN 'first'
            WHEN i IN (greatest(0, n // 2 - 1), n // 2, least(n - 1, n // 2 + 1)) THEN 'middle'
            WHEN i IN (greatest(0, greatest(1, n - 2) - 1), greatest(1, n - 2), least(n - 1, greatest(1, n - 2) + 1)) THEN 'last' END AS window_position FROM r)
          SELECT seqid, entity_id, window_position, seqid || ':' || window_position AS window_id FROM t WHERE window_position IS NOT NULL"""),
        "first_middle_last": _w(GAPS, """, r AS (SELECT *, row_number() OVER (PARTITION BY seqid ORDER BY start_pos, end_pos) - 1 AS i,
            count(*) OVER (PARTITION BY seqid) AS n FROM gaps)
          SELECT seqid, region_id, start_pos, end_pos FROM r WHERE i IN (0, n // 2, n - 1)"""),
        "top_n_per_window": """SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 5""",
        "phrase_gate": """SELECT doc_id, contains(t, 'the of') AND contains(t, 'with') AS phrases_present FROM (
          SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS t FROM documents)""",
        "gate_eligibility": """SELECT study, 3 AS gate_count, a + b + c AS passed_count, a + b + c = 3 AS eligible,
          CASE WHEN a + b + c = 3 THEN 'accepted' ELSE 'blocked' END AS scientific_acceptance_status FROM (
          SELECT concat('study', o_custkey) AS study, CAST(max(o_totalprice) > 250000 AS INT) AS a,
            CAST(min(o_orderdate) > TIMESTAMP '1993-01-01' AS INT) AS b, CAST(count(DISTINCT o_orderstatus) = 3 AS INT) AS c FROM orders GROUP BY o_custkey)""",
        "replication_gate": """SELECT concat('study', o_custkey) AS study,
          count(DISTINCT o_orderkey // 2) FILTER (WHERE o_orderpriority <> '5-LOW') AS sample_count,
          CASE WHEN count(DISTINCT o_orderkey // 2) FILTER (WHERE o_orderpriority <> '5-LOW') >= 10 THEN 'passed' ELSE 'not-passed' END AS status
          FROM orders GROUP BY o_custkey""",
        "date_gate": """SELECT concat('study', o_custkey) AS study, concat('s', o_orderkey // 2) AS sample,
          CASE WHEN CAST(o_orderdate AS DATE) > DATE '1995-06-17' THEN 'passed' ELSE 'unavailable' END AS status FROM orders""",
        "step_log_order": """SELECT run_id, count(*) AS steps, count(*) FILTER (WHERE event_type = 'error' AND event_id % 1000 < 100) AS failed_steps,
          0 AS backward_steps, count(*) FILTER (WHERE done > nxt) AS overlapping_steps,
          count(*) FILTER (WHERE event_type = 'error' AND event_id % 1000 < 100) + count(*) FILTER (WHERE done > nxt) = 0 AND count(*) = 100 AS valid
          FROM (SELECT *, event_id // 100 AS run_id, ts + to_seconds(CAST(trunc(value) AS INT)) AS done,
            lead(ts) OVER (PARTITION BY event_id // 100 ORDER BY event_id) AS nxt FROM events) GROUP BY run_id""",
        "run_catalog": _w(ENTRIES, "SELECT * FROM entries"),
        "displayable_runs": _w(ENTRIES, "SELECT run_id, scientific_acceptance_status FROM entries WHERE displayable AND run_type = 'baseline'"),
        "parent_status": _w(ENTRIES, """SELECT c.run_id, c.parent_run_id, c.displayable, p.execution_status AS parent_status,
          p.displayable AS parent_displayable FROM entries c LEFT JOIN entries p ON p.run_id = c.parent_run_id AND p.run_type = 'baseline'
          WHERE c.run_type = 'candidate_windows'"""),
        "status_banner": _w(ENTRIES, """SELECT run_id, run_type, execution_status, verification_status, scientific_acceptance_status,
          CASE WHEN c_custkey % 3 <> 1 THEN c_mktsegment END AS target_strain FROM entries JOIN customer ON run_id = concat('r', c_custkey)"""),
        "missing_artifacts": _w(ENTRIES, """SELECT concat('r', k) AS run_id, 'diagnostics.json' AS name FROM t WHERE run_type = 'baseline' AND lacks"""),
        "evidence_chain": _w(ENTRIES, """SELECT concat('label', c_custkey) AS label, CASE WHEN c_custkey % 6 <> 5 THEN concat('r', c_custkey) END AS run_id,
          CASE WHEN c_custkey % 6 = 5 THEN 0 WHEN c_custkey % 5 = 3 THEN 13 ELSE 14 END AS artifacts,
          CASE WHEN c_custkey % 6 = 5 THEN 0 ELSE CASE WHEN c_custkey % 5 = 3 THEN 13 ELSE 14 END - CAST(c_custkey % 7 = 0 AS INT) END AS verified,
          c_custkey % 6 <> 5 AND c_custkey % 7 <> 0 AS intact FROM customer"""),
        "parent_inputs": """SELECT concat('r', c.c_custkey) AS run_id, concat('r', c.c_custkey - 1) AS parent_run_id,
          CASE WHEN p.c_custkey IS NULL THEN 'parent run is missing' WHEN p.c_custkey % 8 = 0 THEN 'parent run is not complete'
            WHEN c.c_nationkey // 5 <> p.c_nationkey // 5 THEN 'sequence file differs' END AS problem
          FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey - 1 WHERE c.c_custkey % 3 = 1""",
        "run_id": """SELECT c_custkey AS run_key, concat('run-', substr(sha256(concat('[{"name":"balance","value":"', CAST(trunc(c_acctbal) AS BIGINT),
          '"},{"name":"name","value":"', c_name, '"},{"name":"segment","value":"', c_mktsegment, '"}]')), 1, 16)) AS run_id FROM customer""",
        "acceptance_checks": """SELECT concat('r', c_custkey) AS run_id, 2 AS checks,
          CAST(c_nationkey <> coalesce(s_nationkey, -1) AS INT) + CAST(c_acctbal < 0 AS INT) AS failed,
          c_nationkey = coalesce(s_nationkey, -1) AND c_acctbal >= 0 AS accepted
          FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier)""",
        "motif_counts": _w(BASES, """SELECT motif, motif IN ('GT-AG','GC-AG','AT-AC','CT-AC','CT-GC','GT-AT') AS canonical, count(*) AS n FROM (
          SELECT CASE WHEN length(bases) >= spot + 25 THEN substr(bases, spot + 1, 2) || '-' || substr(bases, spot + 24, 2) ELSE 'unavailable' END AS motif
          FROM (SELECT bases, unnest(range(5, greatest(length(bases), 6), 40)) AS spot FROM bases WHERE bases IS NOT NULL)) GROUP BY motif"""),
        "reference_identity": _w(BASES, """, place AS (SELECT seqid, bases, length(bases) AS n, unnest(range(0, length(bases), 200)) AS spot
            FROM bases WHERE bases <> ''),
          r AS (SELECT *, seqid || ':' || spot AS line_number, (spot // 200) % 3 AS turn,
            CASE (spot // 200) % 3 WHEN 0 THEN substr(bases, spot + 1, 20) || substr(bases, spot + 31, 30) || 'AAAAA'
              WHEN 1 THEN substr(bases, spot + 1, 10) || 'TTTTT' || substr(bases, spot + 11, 20) || substr(bases, spot + 39, 15)
              ELSE 'CCCC' || substr(bases, spot + 1, 12) || substr(bases, spot + 14, 18) END AS own FROM place),
          q AS (SELECT r.*, file, CASE file WHEN 'a' THEN own ELSE repeat('A', length(own)) END AS q FROM r, (VALUES ('a'), ('b')) f(file)),
          block(turn, k, t, s, size, gaps) AS (VALUES (0, 1, 0, 0, 20, 0), (0, 2, 30, 20, 30, 0), (1, 1, 0, 0, 10, 0), (1, 2, 10, 15, 20, 0),
            (1, 3, 38, 35, 15, 1), (2, 1, 0, 4, 12, 0), (2, 2, 12, 16, 18, 0)),
          whole(turn, span, junctions) AS (VALUES (0, 60, 0), (1, 53, 1), (2, 30, 0)),
          x AS (SELECT q.*, k, t, s, size, gaps, spot + t + size > n OR s + size > length(q) AS over FROM q JOIN block USING (turn)),
          stop AS (SELECT *, min(CASE WHEN over THEN k END) OVER (PARTITION BY file, line_number) AS stop FROM x),
          cnt AS (SELECT file, line_number, turn, spot, stop, coalesce(sum(size) FILTER (WHERE stop IS NULL OR k < stop), 0) AS aligned,
              max(CASE WHEN k = stop THEN spot + t END) AS reached,
              CAST(coalesce(max(gaps) FILTER (WHERE stop IS NULL OR k <= stop), 0) AS INT) AS splice_junctions FROM stop GROUP BY ALL),
          eq AS (SELECT file, line_number, sum(CAST(substr(q, s + i, 1) = substr(bases, spot + t + i, 1) AS INT)) AS m
            FROM stop, generate_series(1, 30) g(i) WHERE i <= size AND (stop IS NULL OR k < stop) GROUP BY ALL)
          SELECT file, line_number, CAST(aligned AS BIGINT) AS aligned_bases, CAST(coalesce(m, 0) AS BIGINT) AS matches, splice_junctions,
            CAST(coalesce(reached, spot + span) AS BIGINT) AS target_end, stop IS NULL AS coordinate_valid,
            CASE WHEN stop IS NULL THEN round(m / aligned::DOUBLE, 6) END AS reference_identity
          FROM cnt JOIN whole USING (turn) LEFT JOIN eq USING (file, line_number)"""),
        "fasta_export": _w(BASES, """SELECT format('>{0} seqid={0} start=0 end={1} length={1}', seqid, length(bases)) || chr(10) ||
          array_to_string(list_transform(range((length(bases) + 69) // 70), lambda i: substr(bases, i*70 + 1, 70)), chr(10)) AS value
          FROM bases WHERE length(bases) > 0"""),
        "gene_list_positions": """SELECT concat('G', o_orderkey // 2) AS gene_id, CAST(o_custkey % 7 AS VARCHAR) AS seqid,
          o_orderkey AS first, o_orderkey + CASE WHEN o_orderkey % 3 = 2 THEN 60 ELSE 9 END AS last,
          CASE WHEN o_orderkey % 3 = 1 THEN '-' ELSE '+' END AS strand
          FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_orderkey // 2)""",
        "header_compatibility": """SELECT concat('chr', s_suppkey) AS rname, concat('chr', s_suppkey) AS seqid,
          60100 + (s_suppkey % 3) * 2147483648 + CAST(s_suppkey % 4 = 0 AS INT) AS declared_length,
          60100 + CAST(s_suppkey % 4 = 0 AS INT) AS normalized_length, 60100 AS target_length, s_suppkey % 4 <> 0 AS length_identity FROM supplier""",
        "source_status": """SELECT c_custkey AS source_id, CASE WHEN c_custkey % 5 = 0 THEN 'unavailable' WHEN r = '' THEN 'qualified' ELSE 'unqualified' END AS qualification_status,
          CASE WHEN c_custkey % 5 = 0 THEN 'source file could not be obtained or verified'
            WHEN r = '' THEN 'same primary coordinate space with sufficiently explicit boundaries' ELSE r END AS reasons FROM (
          SELECT c_custkey, concat_ws('|', CASE WHEN c_custkey % 3 = 0 THEN 'same upstream annotation or coordinate mirror; not independent evidence' END,
            CASE WHEN c_mktsegment <> 'BUILDING' THEN 'different strain; cannot directly define BUILDING primary-coordinate boundaries' END,
            CASE WHEN c_custkey % 7 <> 0 AND abs(c_acctbal) / 10000 > 0.5 THEN 'systematic partial gene boundaries exceed 50 percent' END,
            CASE WHEN c_custkey % 2 = 1 THEN 'requires explicit mapping to the locked primary assembly' END,
            CASE WHEN c_custkey % 5 = 1 THEN 'metadata does not provide an independently qualified boundary file' END) AS r FROM customer)""",
        "engineering_screen": """SELECT run_id, round(a, 6) AS vector_fraction_all, round(u, 6) AS vector_fraction_unmapped, round(o, 6) AS outlier_fraction,
          a >= 0.2 OR u >= 0.3 AS global_vector_signal, o >= 0.5 AS widespread_high_depth,
          CASE WHEN a >= 0.2 OR u >= 0.3 OR o >= 0.5 THEN 'global or widespread signal detected' ELSE 'no global signal' END AS conclusion FROM (
          SELECT o_custkey AS run_id, count(*) FILTER (WHERE o_totalprice > 450000) / CAST(count(*) AS DOUBLE) AS a,
            coalesce(count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 450000) / CAST(nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS DOUBLE), 0) AS u,
            coalesce(count(*) FILTER (WHERE o_orderpriority < '2') / CAST(nullif(count(*) FILTER (WHERE o_orderpriority < '4'), 0) AS DOUBLE), 0) AS o
          FROM orders GROUP BY o_custkey)""",
        "paths_outside": """SELECT c_custkey, path FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN concat('../../e/', c_custkey)
            WHEN c_custkey % 5 = 0 THEN concat('a/', c_custkey) WHEN c_custkey % 5 = 1 THEN concat('../x/', c_custkey)
            WHEN c_custkey % 5 = 2 THEN concat('d/../', c_custkey) WHEN c_custkey % 5 = 3 THEN concat('/root/x/./', c_custkey)
            ELSE concat('/root/x/../', c_custkey) END AS path FROM customer) WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 4""",
        "forbidden_files": """SELECT c_custkey, concat('d/', CASE c_custkey % 3 WHEN 0 THEN 'SRR' WHEN 1 THEN 'srr_' ELSE 'xsrr' END, c_custkey) AS path
          FROM customer WHERE c_custkey % 3 < 2""",
        "missing_assembly_directive": """SELECT concat('f', c_custkey) AS file FROM customer WHERE c_custkey % 4 <> 0 AND NOT EXISTS (
          SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 1)""",
        "incomplete_fields": """SELECT c_custkey AS source_id, concat_ws('|', CASE WHEN c_custkey % 3 = 0 THEN 'no strain' END,
            CASE WHEN c_custkey % 4 = 0 THEN 'no terms' END) AS reasons FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 = 0""",
        "mirror_groups": """SELECT c_nationkey AS independence_group, count(*) AS source_count,
          count(*) FILTER (WHERE c_custkey % 3 = 0) AS mirror_count, count(*) FILTER (WHERE c_custkey % 3 <> 0) = 1 AS explicit
          FROM customer GROUP BY c_nationkey""",
        "metadata_contract": """SELECT c_custkey AS run, 'nation' AS "check", CAST(c_nationkey AS VARCHAR) AS expected,
            CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey + CAST(c_custkey % 3 = 0 AS INT) AS VARCHAR) END AS observed,
            c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AS ok FROM customer
          UNION ALL SELECT c_custkey, 'segment', c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, c_custkey % 5 <> 0 FROM customer""",
        "accession_links": """SELECT c_custkey AS run, concat('e', c_custkey) AS experiment, concat('p', c_nationkey) AS project,
          concat('10.1/', c_mktsegment) AS publication, c_custkey % 5 <> 0 AS archive_ok, c_custkey % 4 <> 0 AS report_ok,
          c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 AS consistent FROM customer""",
        "declared_bytes": "SELECT CAST(sum(o_orderkey + o_custkey) AS BIGINT) AS declared_total_bytes FROM orders",
        "alignment_classes": """SELECT classification, alignment_orientation, count(*) AS n FROM (SELECT
            CASE WHEN l_linenumber % 3 = 2 OR l_returnflag = 'A' THEN 'multi_mapping'
              WHEN l_discount > 0.08 OR l_quantity < 25 THEN 'conflict' WHEN l_tax > 0.06 THEN 'endpoint_limited' ELSE 'success' END AS classification,
            CASE WHEN l_returnflag = 'N' THEN 'reverse' ELSE 'forward' END AS alignment_orientation FROM lineitem) GROUP BY ALL""",
        "endpoint_classes": """SELECT k.status AS alignment_class, count(l_orderkey) AS n FROM (
            VALUES ('success'), ('conflict'), ('multi_mapping'), ('endpoint_limited'), ('unmappable')) k(status) LEFT JOIN (SELECT l_orderkey,
            CASE WHEN l_linenumber % 3 = 2 OR l_returnflag = 'A' THEN 'multi_mapping'
              WHEN l_discount > 0.08 OR l_quantity < 25 THEN 'conflict' WHEN l_tax > 0.06 THEN 'endpoint_limited' ELSE 'success' END AS c
            FROM lineitem) ON c = k.status GROUP BY k.status""",
    }
