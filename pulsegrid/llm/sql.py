"""DuckDB twins of the operators' queries."""

#: Rules longest first: host, path, verdict.
_RULES = "('example.com', '/en/7', 'allow'), ('com', '/en/', 'block'), ('example.net', '/de/8', 'block'), ('net', '/de/', 'block'), ('org', '/es/', 'block')"

OP3 = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULES}),
parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM parts
), hits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM cut LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM hits WHERE k = 1
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}) || ':' || {0} END"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"))
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _tree(name: str, leaves: str) -> str:
    """CTEs of a level-by-level tree over leaves (tree, idx, node, n): its nodes, the text of every run of eight, its roots."""
    return f"""
{name} AS (
  SELECT tree, 0 AS lvl, idx, node, n FROM {leaves}
  UNION ALL SELECT tree, lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 8, n
), {name}_runs AS (SELECT tree, lvl, idx // 8 AS run, string_agg(node, '' ORDER BY idx) AS s FROM {name} WHERE n > 1 GROUP BY ALL),
{name}_roots AS (SELECT tree, lvl AS height, node FROM {name} WHERE n = 1)"""


def _walk(name: str, start: str, tree: str) -> str:
    """A CTE that folds start (row, tree, pos, folded, sib) up the tree; the rows at the root's level are the result."""
    left, right = "substr(s, 1, 64 * (pos % 8)::INT)", "substr(s, 64 * (pos % 8)::INT + 65)"
    return f"""
{name} AS (
  SELECT row, tree, 0 AS lvl, pos, folded, sib FROM {start}
  UNION ALL SELECT w.row, w.tree, w.lvl + 1, pos // 8, sha256({left} || folded || {right}), sib || {left} || {right}
  FROM {name} w JOIN {tree}_runs r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = pos // 8
), {name}_end AS (SELECT w.* FROM {name} w JOIN {tree}_roots t ON t.tree = w.tree AND t.height = w.lvl)"""


#: The checksum of doc_id is a fold over its digits with the usual table, made from its polynomial.
OP11 = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))
), docs AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({_FIELDS} || {_FIELD.format("text")}) AS leaf,
         sha256({_FIELDS} || {_FIELD.format(f"translate(text, {_LETTERS})")}) AS lowered,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, d: xor(c >> 8, t[((xor(c, d) & 255) + 1)::INT]))) % 3 = 0 AS tampered
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM docs
), lower_leaves AS (SELECT tree, idx, leaf AS node, n FROM placed), {_tree("tree", "lower_leaves")},
upper_leaves AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, node, count(*) OVER () AS n, tree AS name FROM tree_roots),
upper_nodes AS (SELECT tree, idx, node, n FROM upper_leaves), {_tree("top", "upper_nodes")},
below AS (SELECT row, tree, idx AS pos, CASE WHEN tampered THEN lowered ELSE leaf END AS folded, '' AS sib FROM placed), {_walk("walk", "below", "tree")},
middle AS (SELECT w.row, '' AS tree, u.idx AS pos, folded, sib FROM walk_end w JOIN upper_leaves u ON u.name = w.tree), {_walk("climb", "middle", "top")}
SELECT p.doc_id, leaf, b.node AS subroot, r.node AS root, sha256(sib) AS proof_sha256, folded AS folded_root, folded = r.node AS verified
FROM climb_end c JOIN placed p USING (row) JOIN tree_roots b ON b.tree = p.tree CROSS JOIN top_roots r
"""

ORACLE = {"op3_url_filter": OP3, "op11_merkle_manifest": OP11}
