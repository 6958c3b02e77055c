"""Queries over the catalog's own test tables: change feed, hierarchy, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.changefeed import before_position, replay
from ..operators.hierarchy import hierarchy
from ..operators.snapdiff import snapshot_changes
from . import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query(
    "p1_found",
    """
WITH r AS (
  SELECT DISTINCT c.volume_id, c.file_ref, c.journal_id, c.usn, c.reason, c.parent_ref, c.name
  FROM changes c LEFT JOIN volumes v ON v.id = c.volume_id
  WHERE c.file_ref IS NOT NULL AND (v.journal_id IS NULL OR v.next_usn IS NULL OR c.journal_id < v.journal_id OR (c.journal_id = v.journal_id AND c.usn < v.next_usn))
), m AS (
  SELECT *, max(CASE WHEN (reason & 768) <> 0 THEN (journal_id, usn) END) OVER (PARTITION BY volume_id, file_ref) AS mark FROM r
), s AS (SELECT *, (journal_id, usn) AS seq FROM m WHERE (journal_id, usn) >= mark)
SELECT volume_id, file_ref, max(CASE WHEN parent_ref IS NOT NULL THEN (seq, parent_ref) END)[2] AS parent_ref,
       max(CASE WHEN name IS NOT NULL THEN (seq, name) END)[2] AS name, max((seq, usn))[2] AS usn
FROM s GROUP BY volume_id, file_ref HAVING bool_or(seq = mark AND (reason & 512) = 0)
""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = before_position(table(spark, sf_dir, "changes"), table(spark, sf_dir, "volumes"))
    return replay(feed, values=("parent_ref", "name")).select("volume_id", "file_ref", "parent_ref", "name", "usn")


@query(
    "p2_found",
    r"""
WITH RECURSIVE n AS (SELECT DISTINCT id, parent_id, coalesce(name, '') AS name FROM entries),
down AS (
  SELECT id, id AS root_id, 0::BIGINT AS depth, name AS path FROM n WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM n)
  UNION ALL SELECT n.id, d.root_id, d.depth + 1, concat_ws('\', nullif(d.path, ''), nullif(n.name, '')) FROM down d JOIN n ON n.parent_id = d.id
), up AS (
  SELECT c.id AS start, c.parent_id AS above FROM n c JOIN n p ON p.id = c.parent_id
  UNION SELECT u.start, c.parent_id FROM up u JOIN n c ON c.id = u.above JOIN n p ON p.id = c.parent_id
), turn AS (SELECT start AS id FROM up WHERE start = above),
lost AS (SELECT id, min(above) AS root_id FROM (SELECT start AS id, above FROM up UNION SELECT id, id FROM turn) WHERE above IN (SELECT id FROM turn) GROUP BY id),
below AS (SELECT above AS id, count(*) AS n_below FROM up GROUP BY above)
SELECT id, root_id, depth, path, coalesce(n_below, 0) AS n_below FROM down LEFT JOIN below USING (id)
UNION ALL SELECT id, root_id, -1, '', -1 FROM lost
""".replace("\\\\", "\\"),
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "entries")).select("id", "root_id", "depth", "path", "n_below")


@query(
    "p4_found",
    """
WITH m AS (SELECT volume_id, snap_no, max(delivery_no) AS delivery_no FROM snapshots GROUP BY ALL),
s AS (SELECT volume_id, snap_no, lead(snap_no) OVER (PARTITION BY volume_id ORDER BY snap_no) AS nxt FROM m),
r AS (SELECT DISTINCT volume_id, snap_no, file_ref, parent_ref, name, size, modified_at, attrs FROM snapshots SEMI JOIN m USING (volume_id, snap_no, delivery_no) WHERE file_ref IS NOT NULL),
e AS (SELECT r.*, nxt FROM r JOIN s USING (volume_id, snap_no) WHERE nxt IS NOT NULL),
l AS (SELECT r.* FROM r JOIN s ON r.volume_id = s.volume_id AND r.snap_no = s.nxt)
SELECT coalesce(e.volume_id, l.volume_id) AS volume_id, coalesce(e.nxt, l.snap_no) AS snap_no, coalesce(e.file_ref, l.file_ref) AS file_ref,
  CASE WHEN e.file_ref IS NULL THEN 'inserted' WHEN l.file_ref IS NULL THEN 'deleted'
       WHEN e.parent_ref IS DISTINCT FROM l.parent_ref OR e.name IS DISTINCT FROM l.name THEN 'moved' ELSE 'updated' END AS change_kind
FROM e FULL JOIN l ON e.volume_id = l.volume_id AND e.nxt = l.snap_no AND e.file_ref = l.file_ref
WHERE e.file_ref IS NULL OR l.file_ref IS NULL OR e.parent_ref IS DISTINCT FROM l.parent_ref OR e.name IS DISTINCT FROM l.name
   OR e.size IS DISTINCT FROM l.size OR e.modified_at IS DISTINCT FROM l.modified_at OR e.attrs IS DISTINCT FROM l.attrs
""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "snapshots"))
