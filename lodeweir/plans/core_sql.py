"""SQL with the meaning of the core queries for problems 1 and 3, over the same tables."""

from __future__ import annotations

_PENDING = """
WITH r AS (SELECT * FROM document_rows QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY recorded_at DESC, row_id DESC) = 1),
u AS (SELECT DISTINCT run_id, status, checkpoint_seq FROM update_runs),
i AS (SELECT i.doc_id, i.hash, i.processed_at FROM update_items i JOIN u USING (run_id)
      WHERE i.outcome <> 'extract_failed' AND (u.status = 'succeeded' OR i.item_seq <= u.checkpoint_seq)
      QUALIFY row_number() OVER (PARTITION BY i.doc_id ORDER BY i.processed_at DESC) = 1),
pending AS (SELECT r.doc_id, r.hash, r.recorded_at FROM r LEFT JOIN i USING (doc_id)
      WHERE r.active AND (i.doc_id IS NULL OR i.hash <> r.hash OR (r.fts_dirty AND i.processed_at < r.recorded_at)))
"""

_CUT = "(SELECT epoch_us(max(recorded_at)) - (epoch_us(max(recorded_at)) - epoch_us(min(recorded_at))) / 10 FROM document_rows)"


def _after_update(k: int) -> tuple[str, str]:
    """Documents touched by an update and pending after it, where the second sees all records."""
    before = "true" if k == 2 else f"coalesce(epoch_us({{}}) <= {_CUT}, true)"
    now = f"NOT coalesce(epoch_us({{}}) <= {_CUT}, true)" if k == 2 else before
    part = _PENDING.replace("FROM document_rows QUALIFY", f"FROM document_rows WHERE {before.format('recorded_at')} QUALIFY").replace("WHERE i.outcome", f"WHERE {before.format('i.processed_at')} AND i.outcome")
    durable = "i.outcome <> 'extract_failed' AND (u.status = 'succeeded' OR i.item_seq <= u.checkpoint_seq)"
    touched = f"SELECT doc_id FROM document_rows WHERE {now.format('recorded_at')} UNION SELECT i.doc_id FROM update_items i JOIN u USING (run_id) WHERE {durable} AND {now.format('i.processed_at')}"
    return f"SELECT {k} AS update, (SELECT count(*) FROM (SELECT doc_id FROM ({touched}) WHERE doc_id IS NOT NULL)) AS touched, count(*) AS pending FROM pending", part


def _two_updates() -> str:
    (first, a), (second, b) = _after_update(1), _after_update(2)
    return f"SELECT * FROM ({a} {first}) UNION ALL SELECT * FROM ({b} {second})"


_ORPHANS = r"""
WITH cases AS (SELECT case_id, max(space_name) AS case_space FROM eval_cases GROUP BY 1),
cols AS (SELECT DISTINCT collection_id, space_name, collection_name, created, removed_at FROM collections),
j AS (SELECT DISTINCT e.judgment_id, e.judged_at, c.case_space,
        list_filter(string_split(replace(regexp_replace(e.path, '^\s+|\s+$', '', 'g'), '\', '/'), '/'), lambda s: s <> '' AND s <> '.') AS seg
      FROM eval_judgments e LEFT JOIN cases c USING (case_id) WHERE e.path IS NOT NULL AND e.judged_at IS NOT NULL),
p AS (SELECT judgment_id, judged_at, coalesce(case_space, seg[1]) AS space_name,
        CASE WHEN case_space IS NULL THEN seg[2] ELSE seg[1] END AS collection_name,
        array_to_string(CASE WHEN case_space IS NULL THEN seg[3:] ELSE seg[2:] END, '/') AS doc_path FROM j),
q AS (SELECT p.judgment_id, p.judged_at, p.doc_path, k.collection_id FROM p LEFT JOIN cols k
        ON p.space_name = k.space_name AND p.collection_name = k.collection_name AND k.created <= p.judged_at AND (k.removed_at IS NULL OR k.removed_at > p.judged_at)),
v AS (SELECT q.judgment_id, q.judged_at, q.collection_id, arg_max(d.active, (d.recorded_at, d.row_id)) AS active
      FROM q LEFT JOIN document_rows d ON d.collection_id = q.collection_id AND d.path = q.doc_path AND d.recorded_at <= q.judged_at GROUP BY 1, 2, 3),
orphans AS (
  SELECT DISTINCT 'document_rows' AS ref_table, d.row_id AS ref_id, d.recorded_at AS ref_at FROM document_rows d
  WHERE d.collection_id IS NOT NULL AND d.recorded_at IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM cols k WHERE k.collection_id = d.collection_id AND k.created <= d.recorded_at AND (k.removed_at IS NULL OR k.removed_at > d.recorded_at))
  UNION
  SELECT 'eval_judgments', judgment_id, judged_at FROM v WHERE collection_id IS NULL OR active IS NULL OR NOT active)
"""

SQL = {
    "p1_found": _PENDING + "SELECT doc_id FROM pending",
    "p1_pending_by_month": _PENDING + "SELECT strftime(recorded_at, '%Y-%m') AS month, count(*) AS documents FROM pending GROUP BY 1",
    "p1_two_updates": _two_updates(),
    "p3_found": _ORPHANS + "SELECT ref_table, ref_id FROM orphans",
    "p3_orphans_by_month": _ORPHANS + "SELECT ref_table, strftime(ref_at, '%Y-%m') AS month, count(*) AS orphans FROM orphans GROUP BY 1, 2",
}
