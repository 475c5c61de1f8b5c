"""The queries of the core and, where SQL can say the same, their SQL."""

from __future__ import annotations

from quern.operators import assessment, elements, graph, hierarchy, orphans, sampling, scoring, tasks, website

QUERIES = {
    "p4_found": hierarchy.p4_found,
    "p4_paths": hierarchy.p4_paths,
    "p4_descendants": hierarchy.p4_descendants,
    "p5_found": orphans.p5_found,
    "p5_by_month": orphans.p5_by_month,
}

_P5 = r"""
WITH e AS (SELECT edge_id, source_node_id, target_node_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at DESC) AS rn FROM edges) WHERE rn = 1),
r AS (SELECT edge_id, 'source' AS endpoint, lower(regexp_replace(source_node_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS k, created_at FROM e
      UNION ALL SELECT edge_id, 'target', lower(regexp_replace(target_node_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), created_at FROM e),
n AS (SELECT node_id, created_at, deleted_at FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM nodes) WHERE rn = 1
      UNION ALL SELECT node_id, created_at, NULL FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM chunk_nodes) WHERE rn = 1
      UNION ALL SELECT node_id, created_at, NULL FROM entity_nodes),
p AS (SELECT lower(trim(node_id)) AS k, min(created_at) AS made, max(coalesce(deleted_at, TIMESTAMP '9999-01-01')) AS gone FROM n GROUP BY 1),
m AS (SELECT edge_id, endpoint, r.created_at, CASE WHEN p.k IS NULL THEN 'missing' WHEN gone <= r.created_at THEN 'deleted' WHEN made > r.created_at THEN 'late' END AS kind
      FROM r LEFT JOIN p USING (k) WHERE r.k <> '')
"""

_P4 = r"""
WITH RECURSIVE c AS (SELECT node_id, parent_chunk_id, child_chunk_ids FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM chunk_nodes) WHERE rn = 1),
k AS (SELECT kid, min(node_id) AS claim FROM (SELECT node_id, unnest(child_chunk_ids) AS kid FROM c) GROUP BY kid),
q AS (SELECT c.node_id, CASE WHEN trim(coalesce(parent_chunk_id, '')) <> '' THEN parent_chunk_id ELSE claim END AS parent FROM c LEFT JOIN k ON k.kid = c.node_id),
t AS (SELECT q.node_id, o.node_id AS parent FROM q LEFT JOIN c o ON o.node_id = q.parent),
w AS (SELECT node_id, node_id AS root, 0 AS depth, [node_id] AS path FROM t WHERE parent IS NULL
      UNION ALL SELECT t.node_id, w.root, w.depth + 1, list_append(w.path, t.node_id) FROM t JOIN w ON t.parent = w.node_id)
"""

#: Also the nodes that reach no root: up from each of them until a node would come again.
_P4_ALL = """, x AS (SELECT node_id AS start, node_id AS cur, [node_id] AS path FROM t WHERE node_id NOT IN (SELECT node_id FROM w)
      UNION ALL SELECT start, t.parent, list_prepend(t.parent, path) FROM x JOIN t ON t.node_id = x.cur WHERE NOT list_contains(path, t.parent)),
al AS (SELECT node_id, root, depth, path FROM w UNION ALL SELECT start, 'cycle', -1, arg_max(path, len(path)) FROM x GROUP BY start)"""

SQL = {
    "p4_found": _P4 + "SELECT t.node_id, coalesce(w.root, 'cycle') AS root_id, coalesce(w.depth, -1) AS depth FROM t LEFT JOIN w USING (node_id)",
    "p4_paths": _P4 + _P4_ALL + ", d AS (SELECT a AS node_id, count(*) - 1 AS descendants FROM (SELECT unnest(path) AS a FROM al) GROUP BY a) SELECT node_id, array_to_string(path, '/') AS path, depth, root AS root_id, descendants FROM al JOIN d USING (node_id)",
    "p4_descendants": _P4 + _P4_ALL + " SELECT a AS node_id, node_id AS descendant, (last - i)::INT AS distance FROM (SELECT node_id, len(path) - 1 AS last, unnest(path) AS a, unnest(range(len(path))) AS i FROM al) WHERE i < last",
    "p5_found": _P5 + "SELECT edge_id, endpoint, kind FROM m WHERE kind IS NOT NULL",
    "p5_by_month": _P5 + "SELECT endpoint, kind, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM m WHERE kind IS NOT NULL GROUP BY ALL",
}

for module in (elements, graph, scoring, tasks, sampling, website, assessment):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
