"""SQL that derives the same catalog as `fixtures`, for the comparison queries."""

from __future__ import annotations

from ..functions.names import CATEGORIES

#: Common table expressions; a query names those it needs.
CTE = {
    "tree": """tree AS (
  SELECT (r_regionkey + 1)::BIGINT AS id, (r_regionkey + 1)::BIGINT AS volume_id, NULL::BIGINT AS parent_id, '' AS name, true AS is_dir, 0::BIGINT AS size, 0::BIGINT AS alloc_size, NULL::BIGINT AS modified_ms, 16::BIGINT AS attrs FROM region
  UNION ALL SELECT n_nationkey + 1000, n_regionkey + 1, n_regionkey + 1, n_name, true, 0, 0, NULL, 16 FROM nation
  UNION ALL SELECT c_custkey + 1000000, n_regionkey + 1, c_nationkey + 1000, c_name, true, 0, 0, NULL, 16 FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT s_suppkey + 2000000, n_regionkey + 1, s_nationkey + 1000, s_name, true, 0, 0, NULL, 16 FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT o_orderkey + 10000000, n_regionkey + 1, o_custkey + 1000000, 'order_' || o_orderkey || '.' || CASE left(o_orderpriority, 1) WHEN '1' THEN 'pdf' WHEN '2' THEN 'jpg' WHEN '3' THEN 'mp4' WHEN '4' THEN 'zip' ELSE 'xyz' END,
    false, floor(o_totalprice * 100)::BIGINT, floor(o_totalprice * 100)::BIGINT, epoch_ms(o_orderdate), CASE WHEN o_orderstatus = 'P' THEN 4096 ELSE 0 END
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)""",
    "path": """path AS (
  SELECT id, [id] AS chain, '' AS path, 0::BIGINT AS depth FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT t.id, list_append(p.chain, t.id), CASE WHEN p.path = '' THEN t.name ELSE p.path || chr(92) || t.name END, p.depth + 1 FROM path p JOIN tree t ON t.parent_id = p.id)""",
    "stats": """stats AS (
  SELECT t.id AS entry_id, coalesce(sum(c.size), 0)::BIGINT AS total_size, coalesce(sum(coalesce(c.alloc_size, c.size)), 0)::BIGINT AS total_alloc,
    count(*) FILTER (NOT c.is_dir) AS file_count, count(*) FILTER (c.is_dir) AS dir_count
  FROM tree t LEFT JOIN (SELECT unnest(chain[1:-2]) AS a, id FROM path) x ON x.a = t.id LEFT JOIN tree c ON c.id = x.id WHERE t.is_dir GROUP BY t.id)""",
    "ent": "ent AS (SELECT DISTINCT * FROM entries)",
    "dst": "dst AS (SELECT DISTINCT * FROM dir_stats)",
    "doc": """doc AS (
  SELECT doc_id + 20000000 AS id, doc_id % 5 + 1 AS volume_id, replace(coalesce(source, 'none'), '/', '-') || '_' || doc_id || '.' || coalesce(lang, 'txt') AS name,
    coalesce(source, 'none') || chr(92) || replace(coalesce(source, 'none'), '/', '-') || '_' || doc_id || '.' || coalesce(lang, 'txt') AS path, coalesce(n_chars, 0) AS size, doc_id * 1000 AS modified,
    CASE WHEN text IS NOT NULL THEN md5(coalesce(n_chars, 0) || left(text, 65536) || right(text, 65536)) END AS quick, CASE WHEN text IS NOT NULL THEN sha256(text) END AS "full", doc_id % 5 % 2 = 0 AS online, doc_id FROM documents)""",
    "rdg": """rdg AS (
  SELECT 'disk-' || user_id AS disk_key, event_id AS reading_no, epoch_us(ts) // 1000 AS at_ms, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'good' END AS status, floor(abs(value))::BIGINT AS reallocated FROM events)""",
    "act": """act AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS at_ms, event_type AS action, user_id % 5 + 1 AS volume_id, floor(abs(value) * 100)::BIGINT AS size, ['done', 'skipped_changed', 'skipped_missing', 'failed'][(event_id % 4 + 1)::INT] AS outcome FROM events)""",
    "vec": """vec AS (
  SELECT vec_id AS id, list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] < embedding[i + 2] THEN (1::BIGINT << i::BIGINT) ELSE 0::BIGINT END))::BIGINT AS print FROM embeddings)""",
}
NEEDS = {"path": ["tree"], "stats": ["tree", "path"]}


def sql(names: str, select: str) -> str:
    """`select` with the named expressions, and what they need, before it; `select` may go on with expressions of its own after a comma."""
    order: list[str] = []
    for n in names.split():
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH RECURSIVE " + ",\n".join(CTE[x] for x in order) + "\n" + select


def ext_sql(name: str) -> str:
    e = rf"regexp_extract({name}, '(?s)^.+\.([^. ]+)$', 1)"
    return f"CASE WHEN strlen({e}) <= 16 THEN lower({e}) ELSE '' END"


def category_sql(ext: str) -> str:
    whens = " ".join(f"WHEN {ext} IN ({', '.join(repr(x) for x in exts.split())}) THEN '{name}'" for name, exts in CATEGORIES.items() if exts)
    return f"CASE {whens} ELSE 'other' END"


def band_sql(size: str) -> str:
    return f"(CASE WHEN {size} >= 1000000000 THEN 5 WHEN {size} >= 100000000 THEN 4 WHEN {size} >= 1000000 THEN 3 WHEN {size} >= 100000 THEN 2 WHEN {size} >= 1000 THEN 1 ELSE 0 END)::BIGINT"


def up_sql(name: str) -> str:
    """Names folded character by character: what would grow stays as it is."""
    return f"replace(replace(upper(replace({name}, 'ẞ', chr(57344))), 'ẞ', 'ß'), chr(57344), 'ẞ')"
