"""Queries of the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from framewright.llm import bpe, langid, packing, pairs, similarity
from framewright.sources.tables import table


def p1_found(spark, sf_dir):
    return pairs.defective_answers(table(spark, sf_dir, "responses"), table(spark, sf_dir, "documents"))


def p1_templates(spark, sf_dir):
    return pairs.refusal_templates(table(spark, sf_dir, "responses"), table(spark, sf_dir, "documents"))


def p6_found(spark, sf_dir):
    return similarity.similarity_groups(table(spark, sf_dir, "detections"))


def p6_groups(spark, sf_dir):
    return similarity.group_summary(table(spark, sf_dir, "detections"))


def p7_ids(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def p7_roundtrip(spark, sf_dir):
    return bpe.round_trips(table(spark, sf_dir, "documents"))


def p8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p8_fill(spark, sf_dir):
    return packing.fill_report(p8_packing(spark, sf_dir), table(spark, sf_dir, "containers"))


def p9_found(spark, sf_dir):
    return langid.mislabelled_segments(table(spark, sf_dir, "documents"))


def p9_segments(spark, sf_dir):
    return langid.language_segments(table(spark, sf_dir, "documents"))


def p9_documents(spark, sf_dir):
    return langid.document_languages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_templates, p6_found, p6_groups, p7_ids, p7_roundtrip, p8_packing, p8_fill, p9_found, p9_segments, p9_documents)}

_BOX = """box AS (SELECT DISTINCT det_id, video_id, CAST(round(least(x1, x2) * 1000) AS BIGINT) AS x1, CAST(round(least(y1, y2) * 1000) AS BIGINT) AS y1,
        CAST(round(greatest(x1, x2) * 1000) AS BIGINT) AS x2, CAST(round(greatest(y1, y2) * 1000) AS BIGINT) AS y2, CAST(round(coalesce(confidence, 0) * 1000) AS BIGINT) AS cf
        FROM detections WHERE det_id IS NOT NULL AND video_id IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL)"""

ORACLES: dict[str, str] = {
    # two steps along similar pairs reach the smallest id of every group of the test data, whose groups are well apart
    "p6_found": f"""WITH {_BOX},
        pairs AS (SELECT a.det_id AS a, b.det_id AS b FROM box a JOIN box b ON a.video_id = b.video_id AND b.x1 BETWEEN a.x1 - 20000 AND a.x1 + 20000
                  AND abs(a.y1 - b.y1) <= 20000 AND abs(a.x2 - b.x2) <= 20000 AND abs(a.y2 - b.y2) <= 20000 AND abs(a.cf - b.cf) <= 200),
        one AS (SELECT a, min(b) AS m FROM pairs GROUP BY 1),
        two AS (SELECT p.a, min(o.m) AS m FROM pairs p JOIN one o ON o.a = p.b GROUP BY 1)
        SELECT m AS group_det_id, a AS det_id FROM two WHERE m <> a""",
}
