"""The same queries in DuckDB SQL over the driver tables."""

TREES = """
cm AS (SELECT DISTINCT o_custkey AS cust, date_trunc('month', o_orderdate)::DATE AS m FROM orders),
ce AS (SELECT cust, date_diff('day', DATE '1992-01-01', m)::DOUBLE AS l,
              year(m) * 12 + month(m) AS k FROM cm),
b AS (SELECT min(l) AS b FROM ce),
nr AS (SELECT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r,
              CASE WHEN n_nationkey = 0 THEN 50 ELSE n_nationkey + 10 END::BIGINT AS below FROM nation),
e0 AS (
  SELECT l AS lft, coalesce(lead(l) OVER (PARTITION BY cust ORDER BY l), 4000.0)::DOUBLE AS rgt,
         (10 + (cust + 7 * k) % 25)::BIGINT AS parent, (100 + cust)::BIGINT AS child FROM ce
  UNION ALL SELECT b, 2500.0, r, below FROM nr, b
  UNION ALL SELECT 2500.0, 4000.0, (r + 1) % 5, below FROM nr
  UNION ALL SELECT b, 4000.0, 50, 10 FROM nr, b WHERE n = 0
  UNION ALL SELECT b, CASE WHEN r_regionkey = 4 THEN 2500.0 ELSE 4000.0 END, 99, r_regionkey
            FROM region, b),
edges AS MATERIALIZED (SELECT child * 10000 + lft::BIGINT AS id, lft, rgt, parent, child FROM e0),
nodes AS MATERIALIZED (
  SELECT (c_custkey + 100)::BIGINT AS id, 1::BIGINT AS flags, 0.0::DOUBLE AS time,
         c_nationkey::BIGINT AS population,
         CASE WHEN c_custkey % 4 <> 0 THEN c_custkey::BIGINT END AS individual,
         '{"name":"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0
           THEN ',"segment":"' || c_mktsegment || '","tier":null' ELSE '' END || '}' AS metadata_json
  FROM customer
  UNION ALL SELECT n_nationkey + 10, 0, 10.0 + n_nationkey / 8.0, NULL, NULL, '{}' FROM nation
  UNION ALL SELECT 50, 0, 15.0, NULL, NULL, '{}' FROM nation WHERE n_nationkey = 0
  UNION ALL SELECT r_regionkey, 0, 20.0 + r_regionkey / 4.0, NULL, NULL, '{}' FROM region
  UNION ALL SELECT 99, 0, 30.0, NULL, NULL, '{}' FROM region WHERE r_regionkey = 0),
pts AS (SELECT DISTINCT p FROM (SELECT lft AS p FROM edges UNION ALL SELECT rgt FROM edges)),
bp AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p) - 1 AS i, p FROM pts),
iv AS MATERIALIZED (SELECT a.i AS tree_index, a.p AS lft, z.p AS rgt FROM bp a JOIN bp z ON z.i = a.i + 1),
te AS MATERIALIZED (
  SELECT iv.tree_index, e.child, e.parent, c.time AS child_time, p.time AS parent_time
  FROM edges e JOIN iv ON iv.lft >= e.lft AND iv.lft < e.rgt
  JOIN nodes c ON c.id = e.child JOIN nodes p ON p.id = e.parent),
kids AS (SELECT tree_index, parent, count(*) AS n_children FROM te GROUP BY ALL),
touch AS (SELECT tree_index, child AS node_id FROM te UNION SELECT tree_index, parent FROM te),
mem AS (SELECT * FROM touch UNION SELECT tree_index, id FROM iv, nodes WHERE flags = 1),
tna AS MATERIALIZED (
  SELECT m.tree_index, m.node_id, te.parent AS parent_id, n.time, n.flags,
         coalesce(k.n_children, 0) AS n_children, coalesce(k.n_children, 0) = 0 AS is_tip
  FROM mem m JOIN nodes n ON n.id = m.node_id
  LEFT JOIN te ON te.tree_index = m.tree_index AND te.child = m.node_id
  LEFT JOIN kids k ON k.tree_index = m.tree_index AND k.parent = m.node_id),
tnb AS MATERIALIZED (SELECT * FROM tna WHERE parent_id IS NOT NULL OR n_children > 0)
"""

ANC = """
anc(tree_index, seed, node_id, distance) AS (
  SELECT tree_index, node_id, node_id, 0 FROM tn
  UNION ALL
  SELECT a.tree_index, a.seed, t.parent_id, a.distance + 1
  FROM anc a JOIN tn t ON t.tree_index = a.tree_index AND t.node_id = a.node_id
  WHERE t.parent_id IS NOT NULL)
"""

# Tips in depth-first order by their path of visiting keys, then the layers above.
PLACED = """
tippath AS (
  SELECT a.tree_index, a.seed, list(CASE WHEN t.parent_id IS NULL THEN t.node_id ELSE -t.node_id END
         ORDER BY a.distance DESC) AS path
  FROM anc a JOIN tn t ON t.tree_index = a.tree_index AND t.node_id = a.node_id
  JOIN tn s ON s.tree_index = a.tree_index AND s.node_id = a.seed AND s.is_tip
  GROUP BY a.tree_index, a.seed),
xa AS MATERIALIZED (SELECT tree_index, seed AS node_id,
       (row_number() OVER (PARTITION BY tree_index ORDER BY path) - 1)::DOUBLE AS x FROM tippath),
xb AS (SELECT t.tree_index, t.parent_id AS node_id, (min(x) + max(x)) / 2 AS x FROM tn t JOIN xa
       USING (tree_index, node_id) WHERE t.parent_id BETWEEN 10 AND 34 GROUP BY ALL),
x1 AS (SELECT * FROM xa UNION ALL SELECT * FROM xb),
xc AS (SELECT t.tree_index, t.parent_id AS node_id, (min(x) + max(x)) / 2 AS x FROM tn t JOIN x1
       USING (tree_index, node_id) WHERE t.parent_id = 50 GROUP BY ALL),
x2 AS (SELECT * FROM x1 UNION ALL SELECT * FROM xc),
xd AS (SELECT t.tree_index, t.parent_id AS node_id, (min(x) + max(x)) / 2 AS x FROM tn t JOIN x2
       USING (tree_index, node_id) WHERE t.parent_id BETWEEN 0 AND 4 GROUP BY ALL),
x3 AS (SELECT * FROM x2 UNION ALL SELECT * FROM xd),
xe AS (SELECT t.tree_index, t.parent_id AS node_id, (min(x) + max(x)) / 2 AS x FROM tn t JOIN x3
       USING (tree_index, node_id) WHERE t.parent_id = 99 GROUP BY ALL),
x4 AS (SELECT * FROM x3 UNION ALL SELECT * FROM xe),
ntips AS (SELECT tree_index, count(*) AS n FROM tn WHERE is_tip GROUP BY ALL),
trange AS (SELECT min(time) AS lo, max(time) AS hi FROM nodes),
placed AS MATERIALIZED (
  SELECT t.*, (x4.x / greatest(1, ntips.n - 1))::REAL AS x,
         (1.0 - (t.time - lo) / (hi - lo))::DOUBLE::REAL AS y
  FROM tn t JOIN x4 USING (tree_index, node_id) JOIN ntips USING (tree_index), trange)
"""

MUTS = """
ship AS (SELECT DISTINCT date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::BIGINT AS pos,
                CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::BIGINT AS code,
                l_returnflag AS derived_state, o_custkey AS cust
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sites AS MATERIALIZED (SELECT DISTINCT pos - 1000 AS id, pos::DOUBLE AS position,
                CASE pos % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS ancestral_state
         FROM ship),
mutations AS MATERIALIZED (
  SELECT (pos * 4 + code) * 100000000000 + cust AS id, pos - 1000 AS site_id, cust + 100 AS node_id,
         lag((pos * 4 + code) * 100000000000 + cust) OVER (PARTITION BY pos, cust ORDER BY code) AS parent_id,
         CASE WHEN (cust + pos) % 5 <> 0 THEN (pos % 31)::DOUBLE END AS time, derived_state FROM ship),
muts AS MATERIALIZED (
  SELECT m.*, s.position, s.ancestral_state, coalesce(p.derived_state, s.ancestral_state) AS inherited_state,
         iv.tree_index, iv.lft AS interval_left, iv.rgt AS interval_right
  FROM mutations m JOIN sites s ON s.id = m.site_id LEFT JOIN mutations p ON p.id = m.parent_id
  LEFT JOIN iv ON iv.lft <= s.position AND s.position < iv.rgt)
"""

META = """
individuals AS (SELECT c_custkey::BIGINT AS id, 0::BIGINT AS flags,
    CASE WHEN c_custkey % 2 = 0 THEN [c_nationkey::DOUBLE, c_acctbal] END AS location,
    CASE WHEN c_custkey % 6 = 0 THEN '{"group":{"a":1}}'
         ELSE '{"segment":"' || lower(c_mktsegment) || '"}' END AS metadata_json
    FROM customer WHERE c_custkey % 4 <> 0),
populations AS (SELECT n_nationkey::BIGINT AS id,
    '{"nation":"' || n_name || '","region":"' || r_name || '"}' AS metadata_json
    FROM nation JOIN region ON n_regionkey = r_regionkey),
smp AS (SELECT c.c_custkey + 100 AS node_id, c.c_name AS name, c.c_custkey AS k, c.c_mktsegment AS seg,
               n.n_name AS nation, r.r_name AS region
        FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
        LEFT JOIN region r ON r.r_regionkey = n.n_regionkey),
vals AS MATERIALIZED (SELECT *, CASE WHEN k % 4 <> 0 AND k % 6 <> 0 THEN lower(seg)
                                     WHEN k % 3 = 0 THEN seg END AS value FROM smp),
mrows AS (
  SELECT 'node' AS source, 'name' AS key, name AS value, node_id, name FROM smp
  UNION ALL SELECT 'node', 'segment', seg, node_id, name FROM smp WHERE k % 3 = 0
  UNION ALL SELECT 'node', 'tier', NULL, node_id, name FROM smp WHERE k % 3 = 0
  UNION ALL SELECT 'individual', 'group', '{"a":1}', node_id, name FROM smp WHERE k % 4 <> 0 AND k % 6 = 0
  UNION ALL SELECT 'individual', 'segment', lower(seg), node_id, name FROM smp WHERE k % 4 <> 0 AND k % 6 <> 0
  UNION ALL SELECT 'population', 'nation', nation, node_id, name FROM smp WHERE nation IS NOT NULL
  UNION ALL SELECT 'population', 'region', region, node_id, name FROM smp WHERE nation IS NOT NULL)
"""

NEWICK = """
lv AS MATERIALIZED (SELECT l_orderkey AS k, l_linenumber AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
lvr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS j,
             count(*) OVER (PARTITION BY k) AS nl FROM lv),
ot AS MATERIALIZED (SELECT k AS orderkey, max(nl) AS n_leaves, max(q) AS top,
         string_agg('S' || n, ',' ORDER BY n) AS names,
         string_agg(CASE WHEN j < nl AND nl > 1 THEN '(' ELSE '' END || 'S' || n || ':' || q::VARCHAR, ','
                    ORDER BY n) AS body FROM lvr GROUP BY k),
rows0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY orderkey * 100 + orderkey * 37 % 90) - 1 AS tree_index,
       (orderkey * 100 + orderkey * 37 % 90)::DOUBLE AS position, orderkey, n_leaves, top, names,
       CASE WHEN n_leaves = 1 THEN '(' || body || ');'
            ELSE body || repeat(')1:1.0', (n_leaves - 2)::INT) || ');' END AS newick,
       CASE WHEN orderkey % 4 <> 0 THEN top + 10 END AS max_branch_length,
       CASE WHEN orderkey % 3 = 0 THEN 'run' || (orderkey % 7) END AS tree_info FROM ot),
niv AS MATERIALIZED (SELECT tree_index, position AS lft,
       coalesce(lead(position) OVER (ORDER BY tree_index), position + 50000) AS rgt FROM rows0),
nbp AS MATERIALIZED (SELECT tree_index AS i, lft AS p FROM niv UNION ALL SELECT max(tree_index) + 1, max(rgt) FROM niv),
-- post-order: tips n1..nk come first, then the ladder from its end to the root
nn AS MATERIALIZED (
  SELECT r.tree_index, l.j - 1 AS postorder, true AS is_tip, 'S' || l.n AS name, l.q AS branch_length,
         CASE WHEN l.nl = 1 THEN l.q ELSE least(l.j, l.nl - 1) - 1 + l.q END AS root_distance,
         l.n - 1 AS node_id, l.nl, CASE WHEN l.nl = 1 THEN 7 ELSE 7 + (l.nl - 1 - least(l.j, l.nl - 1)) END AS parent_id,
         l.j
  FROM lvr l JOIN rows0 r ON r.orderkey = l.k
  UNION ALL
  SELECT r.tree_index, greatest(n_leaves, 1) + g.i, false, CASE WHEN g.i = greatest(n_leaves - 1, 1) - 1 THEN NULL ELSE '1' END,
         CASE WHEN g.i = greatest(n_leaves - 1, 1) - 1 THEN 0 ELSE 1 END,
         greatest(n_leaves - 1, 1) - 1 - g.i, 7 + g.i, n_leaves,
         CASE WHEN g.i < greatest(n_leaves - 1, 1) - 1 THEN 7 + g.i + 1 END, NULL
  FROM rows0 r, generate_series(0, 5) AS g(i) WHERE g.i < greatest(n_leaves - 1, 1))
"""

WINDOWS = """
win AS MATERIALIZED (SELECT 'chr' || (orderkey // 4096 + 1) AS chrom, orderkey % 4096 + 1 AS idx, newick, n_leaves, top,
       names, orderkey, (orderkey % 4096) * 50000 AS start_bp, (orderkey % 4096 + 1) * 50000 AS end_bp FROM rows0)
"""

TN_ALL = "tn AS MATERIALIZED (SELECT * FROM tna)"
TN_TOUCHED = "tn AS MATERIALIZED (SELECT * FROM tnb)"


def sql(body: str, *parts: str) -> str:
    """One statement from the named building blocks and a final SELECT."""
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + body.strip()


def trees(body: str, *more: str) -> str:
    return sql(body, TREES, *more)


def placed(body: str, *more: str, isolated: bool = True) -> str:
    return sql(body, TREES, TN_ALL if isolated else TN_TOUCHED, ANC, PLACED, *more)


def newick(body: str, *more: str) -> str:
    return sql(body, NEWICK, *more)
