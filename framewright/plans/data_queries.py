"""Queries of the general data problems (p2 to p5), and their SQL where SQL can express them."""

from __future__ import annotations

from framewright.operators import anomalies, drift, intervals, nested
from framewright.sources.tables import table


def p2_found(spark, sf_dir):
    return drift.schema_changes(table(spark, sf_dir, "metadata_files"))


def p2_table(spark, sf_dir):
    return drift.consistent_records(table(spark, sf_dir, "metadata_files"))


def p3_found(spark, sf_dir):
    return anomalies.implausible_readings(table(spark, sf_dir, "interests"), table(spark, sf_dir, "videos"))


def p4_found(spark, sf_dir):
    return intervals.label_periods(table(spark, sf_dir, "cluster_metadata"))


def p5_found(spark, sf_dir):
    return nested.nested_places(table(spark, sf_dir, "responses"))


def p5_bridge(spark, sf_dir):
    return nested.occurrences(table(spark, sf_dir, "responses"), "response_id", "body", every=True).drop("canonical")


def p5_objects(spark, sf_dir):
    return nested.objects(nested.occurrences(table(spark, sf_dir, "responses"), "response_id", "body", every=True))


def p5_tables(spark, sf_dir):
    return nested.flat_tables(table(spark, sf_dir, "responses"), "response_id", "body")


QUERIES = {f.__name__: f for f in (p2_found, p2_table, p3_found, p4_found, p5_found, p5_bridge, p5_objects, p5_tables)}

ORACLES = {
    "p4_found": """
        WITH iv AS (
            SELECT video_id, upper(trim(box_label)) AS box_label,
                   coalesce(start_frame, CAST(ceil(start_ms * 30 / 1000.0) AS BIGINT)) AS s,
                   coalesce(end_frame, CAST(ceil(end_ms * 30 / 1000.0) AS BIGINT)) AS e
            FROM cluster_metadata WHERE video_id IS NOT NULL AND box_label IS NOT NULL),
        ok AS (SELECT DISTINCT video_id, box_label, least(s, e) AS a, greatest(s, e) AS b FROM iv WHERE s IS NOT NULL AND e IS NOT NULL),
        seen AS (SELECT *, max(b) OVER (PARTITION BY video_id, box_label ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
        island AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END)
                             OVER (PARTITION BY video_id, box_label ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM seen),
        period AS (SELECT video_id, box_label, i, min(a) AS first_frame, max(b) AS last_frame FROM island GROUP BY ALL),
        gap AS (SELECT video_id, box_label, last_frame + 1 AS first_frame,
                       lead(first_frame) OVER (PARTITION BY video_id, box_label ORDER BY i) - 1 AS last_frame FROM period)
        SELECT video_id, box_label, 'period' AS kind, first_frame, last_frame FROM period
        UNION ALL SELECT video_id, box_label, 'gap', first_frame, last_frame FROM gap WHERE last_frame IS NOT NULL""",
    "p5_found": """
        WITH r AS (SELECT response_id, max(body) AS body FROM responses WHERE body IS NOT NULL GROUP BY 1),
        top AS (SELECT response_id, t.fullkey, t.type, t.key, t.atom FROM r, json_tree(r.body) t WHERE json_valid(r.body)),
        inside AS (SELECT response_id, fullkey, json_extract_string(atom, '$') AS j FROM top WHERE key = 'arguments' AND type = 'VARCHAR'),
        every AS (SELECT response_id, fullkey, type FROM top
                  UNION ALL SELECT response_id, i.fullkey || substr(t.fullkey, 2), t.type FROM inside i, json_tree(i.j) t WHERE json_valid(i.j)),
        node AS (SELECT response_id, ltrim(replace(substr(fullkey, 2), '"', ''), '.') AS path FROM every WHERE type = 'OBJECT' AND fullkey LIKE '%]')
        SELECT n.response_id, n.path AS node_path, coalesce(arg_max(p.path, length(p.path)), '') AS parent_path
        FROM node n LEFT JOIN node p ON p.response_id = n.response_id AND starts_with(n.path, p.path || '.') GROUP BY 1, 2""",
}
