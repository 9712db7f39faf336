"""The results of the queries that SQL can state, as DuckDB SQL over the same tables."""

from __future__ import annotations

WHITE = r"[\x20\x09-\x0D]+"

# The unsigned CRC-32 of a decimal number, bit by bit: per byte the byte itself and eight shifts.
CRC32 = """xor(list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast({0} AS varchar), ''),
        lambda ch: [ord(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""

OP11 = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size,
       doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY n.t, doc_id) = 1 AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def _leaf(n_chars: str) -> str:
    values = ["cast(doc_id AS varchar)", "source", "lang", f"cast({n_chars} AS varchar)", "text"]
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + "))"


# One level at a time, every tree by itself; then the tree over the subroots; then each leaf's way.
OP12 = f"""
WITH RECURSIVE docs AS (
    SELECT *, {_leaf('n_chars')} AS leaf,
           {_leaf(f"(n_chars + CASE WHEN {CRC32.format('doc_id')} % 7 = 0 THEN 1 ELSE 0 END)")} AS other,
           coalesce('=' || lang, '') AS tree
    FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
low AS (
    SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS width FROM leaves
    UNION ALL
    SELECT tree, level, pos, h, count(*) OVER (PARTITION BY tree) FROM (
        SELECT tree, level + 1 AS level, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
        FROM low WHERE width > 1 GROUP BY tree, level, pos // 2)),
heads AS (SELECT tree, h, level, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM low WHERE width = 1),
high AS (
    SELECT 0 AS level, pos, h, count(*) OVER () AS width FROM heads
    UNION ALL
    SELECT level, pos, h, count(*) OVER () FROM (
        SELECT level + 1 AS level, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
        FROM high WHERE width > 1 GROUP BY level, pos // 2)),
nodes AS (SELECT tree, level, pos, h FROM low WHERE width > 1 UNION ALL
          SELECT heads.tree, heads.level + high.level, high.pos, high.h FROM heads CROSS JOIN high WHERE high.level > 0 OR high.pos <> heads.pos),
climb AS (
    SELECT leaves.doc_id, leaves.pos AS leaf_pos, leaves.tree, 0 AS level, leaves.pos AS pos, leaves.other AS reached, '' AS proof
    FROM leaves
    UNION ALL
    SELECT c.doc_id, c.leaf_pos, c.tree, c.level + 1, c.place // 2,
           sha256(CASE WHEN s.h IS NULL THEN c.reached WHEN c.place % 2 = 1 THEN s.h || c.reached ELSE c.reached || s.h END),
           c.proof || coalesce(s.h, '')
    FROM (SELECT climb.*, CASE WHEN climb.level = heads.level THEN heads.pos ELSE climb.pos END AS place
          FROM climb JOIN heads ON climb.tree = heads.tree
          WHERE climb.level < heads.level + (SELECT max(level) FROM high)) c
    LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.place, 1::bigint)),
done AS (SELECT climb.* FROM climb JOIN heads ON climb.tree = heads.tree WHERE climb.level = heads.level + (SELECT max(level) FROM high))
SELECT leaves.doc_id, leaves.leaf, heads.h AS subroot, root.h AS root, sha256(done.proof) AS proof_sha256, done.reached AS folded_root,
       done.reached = root.h AS verified
FROM leaves JOIN done ON done.tree = leaves.tree AND done.leaf_pos = leaves.pos JOIN heads ON heads.tree = leaves.tree
JOIN (SELECT h FROM high WHERE width = 1) root ON true
"""

SQL = {"op11_chunk_recipes": OP11, "op12_merkle_manifest": OP12}
