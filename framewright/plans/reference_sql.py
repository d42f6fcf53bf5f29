"""DuckDB SQL of the detection queries that SQL can express, written from their definitions."""

_CORNERS = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("x1", "y1", "x2", "y2"))
_COLUMNS = """det_id, video_id, frame_id, det_ord, least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2,
    coalesce(confidence, 0) AS confidence, coalesce(class_id, 0) AS class_id, coalesce(cluster_id, -1) AS cluster_id"""
_RAW = f"raw AS (SELECT {_COLUMNS} FROM detections WHERE {_CORNERS} AND video_id IS NOT NULL AND frame_id IS NOT NULL)"
_BOX = f"{_RAW}, box AS (SELECT DISTINCT * FROM raw)"
_SECTIONS = """frames_of AS (SELECT video_id, count(*) AS n_frames FROM frames GROUP BY 1),
sec AS (SELECT video_id, s AS section_id, s * step AS start_frame, least((s + 1) * step, n_frames) AS end_frame
        FROM (SELECT video_id, n_frames, 3 * fps AS step, unnest(range(0, (n_frames - 1) // (3 * fps) + 1)) AS s FROM frames_of JOIN videos USING (video_id)))"""
_PLACED = f"{_BOX}, placed AS (SELECT box.*, frame_id // (3 * fps) AS section_id, frame_id - frame_id // (3 * fps) * (3 * fps) AS rel_frame FROM box JOIN videos USING (video_id))"
_STATS = f"""{_PLACED}, stats AS (
    SELECT video_id, section_id, cluster_id, avg((x1 + x2) / 2) AS centroid_x, avg((y1 + y2) / 2) AS centroid_y, avg((x2 - x1) * (y2 - y1)) AS median_size,
           count(*) AS cluster_size, min(rel_frame) AS "start", max(rel_frame) AS "end", chr(cluster_id + 65) AS box_label,
           min(rel_frame) * 1000 // 30 AS start_ms, max(rel_frame) * 1000 // 30 AS end_ms
    FROM placed WHERE cluster_id <> -1 GROUP BY 1, 2, 3)"""
_OVERLAPS = f"""{_STATS}, iv AS (SELECT video_id, section_id, cluster_id, "start" AS s, "end" + 1 AS e FROM stats),
pairs AS (SELECT a.video_id, a.section_id, a.cluster_id AS cluster_1, b.cluster_id AS cluster_2, least(a.e, b.e) - greatest(a.s, b.s) AS overlap, least(a.e - a.s, b.e - b.s) AS shorter
          FROM iv a JOIN iv b ON a.video_id = b.video_id AND a.section_id = b.section_id AND a.cluster_id < b.cluster_id AND a.s < b.e AND a.e > b.s),
lap AS (SELECT video_id, section_id, cluster_1, cluster_2, overlap FROM pairs WHERE overlap >= 0.5 * shorter AND shorter >= 15 AND overlap >= 15)"""
_MEANS = f"""{_BOX}, means AS (
    SELECT video_id, frame_id, avg((x2 - x1) * (y2 - y1)) AS mean_area, CAST(trunc(avg(trunc((x1 + x2) / 2))) AS BIGINT) AS poi_x, CAST(trunc(avg(trunc((y1 + y2) / 2))) AS BIGINT) AS poi_y
    FROM box GROUP BY 1, 2)"""
_CARRIED = f"""{_MEANS}, carried AS (
    SELECT video_id, frame_id, coalesce(last_value(poi_x IGNORE NULLS) OVER w, 960) AS poi_x, coalesce(last_value(poi_y IGNORE NULLS) OVER w, 720) AS poi_y,
           coalesce(last_value(mean_area IGNORE NULLS) OVER w, 100.0) AS aoi
    FROM frames LEFT JOIN means USING (video_id, frame_id) WINDOW w AS (PARTITION BY video_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING))"""


def _zones(where: str, rows: str = "placed") -> str:
    return f"""zrows AS (SELECT video_id, section_id, cluster_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (y2 - y1) AS ar FROM {rows} WHERE {where}),
spread AS (SELECT video_id, section_id, cluster_id, avg(cx) AS mx, avg(cy) AS my, avg(ar) AS ma, stddev_pop(cx) AS sx, stddev_pop(cy) AS sy, stddev_pop(ar) AS sa FROM zrows GROUP BY 1, 2, 3),
zones AS (SELECT video_id, section_id, cluster_id, CAST(trunc(min(cx)) AS BIGINT) AS x_lo, CAST(trunc(max(cx)) AS BIGINT) AS x_hi, CAST(trunc(min(cy)) AS BIGINT) AS y_lo,
                 CAST(trunc(max(cy)) AS BIGINT) AS y_hi, max(ma - 2 * sa) AS min_area, max(ma + 2 * sa) AS max_area
          FROM zrows JOIN spread USING (video_id, section_id, cluster_id)
          WHERE abs(cx - mx) <= 2 * sx + 1e-9 AND abs(cy - my) <= 2 * sy + 1e-9 AND abs(ar - ma) <= 2 * sa + 1e-9 GROUP BY 1, 2, 3)"""


def _crop(points: str) -> str:
    return f"""pts AS ({points}),
z AS (SELECT *, 2.0 - (greatest(least(aoi, 300.0), 50.0) - 50.0) / 250.0 * (2.0 - 1.2) AS zoom FROM pts JOIN videos USING (video_id)),
p AS (SELECT *, CAST(trunc(greatest(least(poi_x, 1e9), -1e9)) AS BIGINT) AS px, CAST(trunc(greatest(least(poi_y, 1e9), -1e9)) AS BIGINT) AS py, CAST(trunc(1280 / zoom / 2) AS BIGINT) AS pl, CAST(trunc(720 / zoom / 2) AS BIGINT) AS pt FROM z),
q AS (SELECT *, CAST(trunc(1280 / zoom - pl) AS BIGINT) AS pr, CAST(trunc(720 / zoom - pt) AS BIGINT) AS pb FROM p),
h AS (SELECT *, least(width - pr, greatest(pl, px)) AS x, least(height - pb, greatest(pt, py)) AS y FROM q)
SELECT video_id, frame_id, x - pl AS x1, y - pt AS y1, x + pr AS x2, y + pb AS y2 FROM h"""


def _smooth(kernel: str, series: str, columns: tuple[str, ...], key: str) -> str:
    sums = ", ".join(f"sum(w * v.{c}) AS {c}" for c in columns)
    return f"""kern AS (SELECT k, g / sum(g) OVER () AS w FROM ({kernel})), ser AS ({series}), len AS (SELECT {key}, max(place) + 1 AS n FROM ser GROUP BY 1),
shifted AS (SELECT s.{key}, s.place, w, ((s.place + k) % (2 * n) + 2 * n) % (2 * n) AS m, n FROM ser s JOIN len USING ({key}), kern),
sm AS (SELECT t.{key}, t.place, {sums} FROM shifted t JOIN ser v ON v.{key} = t.{key} AND v.place = CASE WHEN m >= n THEN 2 * n - 1 - m ELSE m END GROUP BY 1, 2)"""


_GAUSS = "SELECT k, exp(-0.5 * (k / 40.0) ** 2) AS g FROM (SELECT unnest(range(-160, 161)) AS k)"
_SKEW = "SELECT -k AS k, exp(-(k * k) / 7200.0) * CASE WHEN k > 0 THEN 0.7 ELSE 1 END AS g FROM (SELECT unnest(range(-480, 481)) AS k)"

_PARSED = """resp AS (SELECT DISTINCT response_id, artifact_id, vendor, body FROM responses WHERE response_id IS NOT NULL),
texts AS (SELECT response_id, artifact_id, CASE WHEN NOT json_valid(body) THEN NULL
    WHEN vendor = 'gpt4' THEN CASE WHEN json_type(body, '$.choices[0].message.content') = 'VARCHAR' THEN json_extract_string(body, '$.choices[0].message.content')
                              ELSE json_extract_string(body, '$.choices[0].message.content[0].text') END
    WHEN vendor = 'claude3' THEN json_extract_string(body, '$.content[0].text') WHEN vendor = 'gemini1.5' THEN body END AS t FROM resp),
cuts AS (SELECT response_id, artifact_id, CASE WHEN instr(t, '[') > 0 AND instr(t, ']') > instr(t, '[') THEN substr(t, instr(t, '['), instr(t, ']') - instr(t, '[') + 1) END AS c FROM texts),
items AS (SELECT response_id, artifact_id, json_extract(c, '$[*]') AS js FROM cuts WHERE c IS NOT NULL AND json_valid(c)),
usable AS (SELECT * FROM items WHERE len(list_filter(js, lambda x: json_type(x, '$.id') IS NULL OR json_type(x, '$.id') = 'NULL' OR coalesce(json_type(x, '$.primary'), '') <> 'BOOLEAN' AND coalesce(json_type(x, '$.focus'), '') <> 'BOOLEAN')) = 0),
each AS (SELECT response_id, artifact_id, unnest(js) AS j, unnest(range(len(js))) AS pos FROM usable),
labels AS (SELECT response_id, artifact_id, upper(trim(json_extract_string(j, '$.id'))) AS label, arg_max(CAST(CASE WHEN json_type(j, '$.primary') = 'BOOLEAN' THEN json_extract_string(j, '$.primary') ELSE json_extract_string(j, '$.focus') END AS BOOLEAN), pos) AS is_primary, min(pos) AS place FROM each GROUP BY 1, 2, 3)"""
_LATEST = f"""{_PARSED}, newest AS (SELECT artifact_id, max(response_id) AS response_id FROM usable GROUP BY 1),
latest AS (SELECT l.artifact_id, label, is_primary, place FROM labels l JOIN newest USING (artifact_id, response_id))"""
_TRUTH = "truth AS (SELECT artifact_id, upper(trim(label)) AS label, bool_or(coalesce(is_primary, false)) AS is_primary FROM area_labels WHERE artifact_id IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)"
_SCORES = f"""{_LATEST}, {_TRUTH}, scores AS (
    SELECT t.artifact_id, count(*) AS n_labels, count(*) FILTER (WHERE l.is_primary = t.is_primary) AS n_right, round(count(*) FILTER (WHERE l.is_primary = t.is_primary) / count(*), 6) AS score
    FROM truth t LEFT JOIN latest l ON t.artifact_id = l.artifact_id AND t.label = l.label GROUP BY 1)"""


_PLAY = f"""{_PLACED}, span AS (SELECT video_id, section_id, min(frame_id) AS lo, max(frame_id) AS hi FROM placed GROUP BY 1, 2),
feat AS (SELECT p.det_id, p.video_id, p.section_id, row_number() OVER (PARTITION BY p.video_id, p.section_id ORDER BY p.frame_id, p.det_ord, p.det_id) AS k,
                (x1 + x2) / 2 / width AS fx, (y1 + y2) / 2 / height AS fy, (x2 - x1) / width AS fw, (y2 - y1) / height AS fh,
                CASE WHEN hi > lo THEN (p.frame_id - lo) / (hi - lo) ELSE 0.0 END * 1.4 AS ft
         FROM placed p JOIN span USING (video_id, section_id) JOIN videos USING (video_id)),
near AS (SELECT a.video_id, a.section_id, a.k AS a, b.k AS b FROM feat a JOIN feat b ON a.video_id = b.video_id AND a.section_id = b.section_id
         WHERE (b.fx - a.fx) * (b.fx - a.fx) + (b.fy - a.fy) * (b.fy - a.fy) + (b.fw - a.fw) * (b.fw - a.fw) + (b.fh - a.fh) * (b.fh - a.fh) + (b.ft - a.ft) * (b.ft - a.ft) <= 0.0625 * (1 + 1e-12)),
dense AS (SELECT video_id, section_id, a AS k FROM near GROUP BY 1, 2, 3 HAVING count(*) >= 5),
link AS (SELECT n.* FROM near n SEMI JOIN dense d ON (d.video_id = n.video_id AND d.section_id = n.section_id AND d.k = n.a)),
reach AS (SELECT video_id, section_id, k AS a, k AS b FROM dense
          UNION SELECT r.video_id, r.section_id, r.a, n.b FROM reach r JOIN link n ON n.video_id = r.video_id AND n.section_id = r.section_id AND n.a = r.b
                JOIN dense d ON d.video_id = n.video_id AND d.section_id = n.section_id AND d.k = n.b WHERE r.a <= n.b),
root AS (SELECT video_id, section_id, b AS k, min(a) AS root FROM reach GROUP BY 1, 2, 3),
named AS (SELECT video_id, section_id, k, dense_rank() OVER (PARTITION BY video_id, section_id ORDER BY root) - 1 AS label FROM root),
edge AS (SELECT n.video_id, n.section_id, n.b AS k, min(label) AS label FROM near n JOIN named m ON m.video_id = n.video_id AND m.section_id = n.section_id AND m.k = n.a GROUP BY 1, 2, 3),
play AS (SELECT f.det_id, f.video_id, f.section_id, CAST(coalesce(m.label, e.label, -1) AS INTEGER) AS label FROM feat f
         LEFT JOIN named m USING (video_id, section_id, k) LEFT JOIN edge e USING (video_id, section_id, k))"""
# places stand for their boxes, cells of eps / sqrt 2 for the core places in them
_STATIC = f"""{_BOX}, spots AS (SELECT video_id, det_id, frame_id, det_ord, CAST(round((x1 + x2) / 2 / width * 1000000 / 250) * 250 AS BIGINT) AS px, CAST(round((y1 + y2) / 2 / height * 1000000 / 250) * 250 AS BIGINT) AS py
                   FROM box JOIN videos USING (video_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id, det_ord, det_id) AS k FROM spots),
places AS (SELECT video_id, px, py, count(*) AS n, min(k) AS k FROM ranked GROUP BY 1, 2, 3),
near AS (SELECT a.video_id, a.px, a.py, b.px AS qx, b.py AS qy, b.n FROM places a JOIN places b ON a.video_id = b.video_id AND abs(a.px - b.px) <= 20000 AND (a.px - b.px) ** 2 + (a.py - b.py) ** 2 <= 400000000),
dense AS (SELECT video_id, px, py, px // 14142 AS gx, py // 14142 AS gy FROM near GROUP BY ALL HAVING sum(n) >= 300),
joined AS (SELECT DISTINCT a.video_id, a.gx, a.gy, b.gx AS hx, b.gy AS hy FROM near n JOIN dense a ON a.video_id = n.video_id AND a.px = n.px AND a.py = n.py
           JOIN dense b ON b.video_id = n.video_id AND b.px = n.qx AND b.py = n.qy),
reach AS (SELECT video_id, gx, gy, gx AS hx, gy AS hy FROM joined UNION SELECT r.video_id, r.gx, r.gy, j.hx, j.hy FROM reach r JOIN joined j ON j.video_id = r.video_id AND j.gx = r.hx AND j.gy = r.hy),
first AS (SELECT r.video_id, r.gx, r.gy, min(p.k) AS root FROM reach r JOIN dense d ON d.video_id = r.video_id AND d.gx = r.hx AND d.gy = r.hy JOIN places p ON p.video_id = d.video_id AND p.px = d.px AND p.py = d.py GROUP BY 1, 2, 3),
named AS (SELECT d.video_id, d.px, d.py, dense_rank() OVER (PARTITION BY d.video_id ORDER BY root) - 1 AS label FROM dense d JOIN first f ON f.video_id = d.video_id AND f.gx = d.gx AND f.gy = d.gy),
edge AS (SELECT n.video_id, n.px, n.py, min(label) AS label FROM near n JOIN named m ON m.video_id = n.video_id AND m.px = n.qx AND m.py = n.qy GROUP BY 1, 2, 3),
static AS (SELECT s.det_id, CAST(coalesce(m.label, e.label, -1) AS INTEGER) AS label FROM spots s LEFT JOIN named m USING (video_id, px, py) LEFT JOIN edge e USING (video_id, px, py))"""
_RELEVANT = f"""{_PLAY}, {_LATEST}, {_SECTIONS}, tagged AS (SELECT p.* EXCLUDE (cluster_id), label AS cluster_id FROM placed p JOIN play USING (det_id) WHERE label <> -1),
crowd AS (SELECT video_id, section_id, string_agg(chr(cluster_id + 65), '_' ORDER BY cluster_id) AS letters FROM (SELECT DISTINCT video_id, section_id, cluster_id FROM tagged) GROUP BY 1, 2 HAVING count(*) > 1),
ids AS (SELECT video_id, section_id, video_name || '_' || printf('%02d-%02d.%03d', start_frame // fps // 60, start_frame // fps % 60, start_frame * 1000 // fps % 1000) || '_'
               || printf('%02d-%02d.%03d', end_frame // fps // 60, end_frame // fps % 60, end_frame * 1000 // fps % 1000) || '_' || letters AS artifact_id FROM crowd JOIN sec USING (video_id, section_id) JOIN videos USING (video_id)),
said AS (SELECT video_id, section_id, ascii(label) - 65 AS cluster_id, is_primary, place FROM ids JOIN latest USING (artifact_id)),
marked AS (SELECT t.*, is_primary, place FROM tagged t LEFT JOIN said USING (video_id, section_id, cluster_id)),
hidden AS (SELECT video_id, section_id, arg_max(cluster_id, place) AS cluster_id FROM marked WHERE NOT is_primary GROUP BY 1, 2)"""


def _minmax(spread: str) -> str:
    return f"CASE WHEN {spread}.hi > {spread}.lo THEN (p.frame_id - {spread}.lo) / ({spread}.hi - {spread}.lo) ELSE 0.0 END"


def _metadata(version: str) -> str:
    time = "printf('00:%02d.%03d', {0} // 1000, {0} % 1000)".format
    full = f"box_label || ', ' || CAST(CAST(floor(centroid_x + 1e-9 + 0.5) AS BIGINT) AS VARCHAR) || ', ' || CAST(CAST(floor(centroid_y + 1e-9 + 0.5) AS BIGINT) AS VARCHAR) || ', ' || printf('%.2fsp', floor((median_size + 1e-9) * 100 + 0.5) / 100) || ', ' || cluster_size || ', ' || {time('start_ms')} || ', ' || {time('end_ms')} || ', ' || color_name"
    line = full if version == "v1" else f"box_label || ', ' || cluster_size || ', ' || {time('start_ms')} || ', ' || {time('end_ms')} || ', ' || color_name || chr(10) || {full}"
    head = "id, centroid x, centroid y, mean detection (square pixels), cluster size, start time, end time, color" if version == "v1" else "id, cluster size, start time, end time, color"
    return f"""WITH {_STATS}, turn AS (SELECT *, (row_number() OVER (PARTITION BY video_id, section_id ORDER BY cluster_id) - 1) % (SELECT count(*) FROM palette) AS idx FROM stats)
        SELECT video_id, section_id, '{head}' || chr(10) || string_agg({line}, chr(10) ORDER BY cluster_id) AS text FROM turn JOIN palette USING (idx) GROUP BY 1, 2"""


ORACLES = {
    "scan_detections": f"WITH {_RAW} SELECT * FROM raw",
    "frame_pack_unpack": f"WITH {_BOX} SELECT video_id, frame_id, det_ord, x1, y1, x2, y2, confidence, class_id, cluster_id FROM box",
    "frame_count": "SELECT video_id, count(*) AS n_frames FROM frames GROUP BY 1",
    "box_geometry": f"WITH {_RAW} SELECT det_id, round((x1 + x2) / 2, 4) AS cx, round((y1 + y2) / 2, 4) AS cy, round(x2 - x1, 4) AS w, round(y2 - y1, 4) AS h, round((x2 - x1) * (y2 - y1), 4) AS area FROM raw",
    "box_center_int": f"WITH {_RAW} SELECT det_id, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS cx, CAST(trunc((y1 + y2) / 2) AS BIGINT) AS cy FROM raw",
    "conf_filter": f"WITH {_RAW} SELECT det_id, confidence FROM raw WHERE confidence >= 0.5",
    "declustered_filter": f"WITH {_RAW} SELECT det_id, video_id, frame_id FROM raw WHERE cluster_id = -1",
    "frame_cap": f"WITH {_RAW} SELECT det_id, video_id, frame_id FROM raw WHERE frame_id < 100",
    "frame_spine": f"WITH {_BOX} SELECT video_id, frame_id, coalesce(det_id, -1) AS det_id, coalesce(det_ord, -1) AS det_ord FROM frames LEFT JOIN box USING (video_id, frame_id)",
    "frame_mean_area": f"WITH {_MEANS} SELECT video_id, frame_id, round(mean_area + 1e-9, 4) AS mean_area FROM means",
    "frame_mean_center": f"WITH {_MEANS} SELECT video_id, frame_id, poi_x, poi_y FROM means",
    "locf_interest": f"WITH {_CARRIED} SELECT video_id, frame_id, poi_x, poi_y, round(aoi + 1e-9, 4) AS aoi FROM carried",
    "zoom_from_area": "SELECT DISTINCT video_id, frame_id, round(2.0 - (greatest(least(aoi, 300.0), 50.0) - 50.0) / 250.0 * (2.0 - 1.2), 6) AS zoom FROM interests WHERE aoi IS NOT NULL AND NOT isnan(aoi)",
    "crop_window": "WITH "
    + _crop("SELECT DISTINCT * FROM interests WHERE NOT isnan(aoi) AND NOT isnan(poi_x) AND NOT isnan(poi_y)"),
    "crop_plan": f"WITH {_CARRIED}, " + _crop("SELECT * FROM carried"),
    "sectionize": f"WITH {_SECTIONS} SELECT * FROM sec",
    "section_counts": f"WITH {_PLACED} SELECT coalesce(video_id, -1) AS video_id, coalesce(section_id, -1) AS section_id, count(*) AS n_boxes, count(*) FILTER (WHERE cluster_id <> -1) AS n_clustered FROM placed GROUP BY ROLLUP (placed.video_id, placed.section_id)",
    "stream_section_counts": f"WITH {_RAW} SELECT video_id, frame_id // (3 * fps) AS section_id, count(*) AS n_boxes FROM raw JOIN videos USING (video_id) GROUP BY 1, 2",
    "sample_frames": f"WITH {_SECTIONS} SELECT video_id, section_id, i - 1 AS sample_no, (start_frame * 5 + i * (end_frame - start_frame)) // 5 - 1 AS frame_id FROM sec, (SELECT unnest(range(1, 6)) AS i) WHERE end_frame - start_frame >= 5",
    "sample_centers": f"WITH {_SECTIONS} SELECT video_id, section_id, i AS sample_no, (start_frame * 10 + (2 * i + 1) * (end_frame - start_frame)) // 10 AS frame_id FROM sec, (SELECT unnest(range(0, 5)) AS i)",
    "sample_occupied": f"WITH {_BOX}, {_SECTIONS} SELECT s.video_id, s.section_id, min(b.frame_id) AS frame_id FROM sec s JOIN (SELECT DISTINCT video_id, frame_id FROM box) b ON b.video_id = s.video_id AND b.frame_id >= (start_frame + end_frame) // 2 GROUP BY 1, 2",
    "section_split": f"WITH {_SECTIONS} SELECT video_id, section_id, i AS part_no, i * (end_frame - start_frame) // 3 AS first, (i + 1) * (end_frame - start_frame) // 3 AS \"end\" FROM sec, (SELECT unnest(range(0, 3)) AS i)",
    "artifact_id": f"""WITH {_STATS}, {_SECTIONS} SELECT s.video_id, s.section_id, v.video_name || '_'
            || printf('%02d-%02d.%03d', start_frame // fps // 60, start_frame // fps % 60, start_frame * 1000 // fps % 1000) || '_'
            || printf('%02d-%02d.%03d', end_frame // fps // 60, end_frame // fps % 60, end_frame * 1000 // fps % 1000) || '_' || l.labels AS artifact_id
        FROM (SELECT video_id, section_id, string_agg(box_label, '_' ORDER BY cluster_id) AS labels FROM stats GROUP BY 1, 2) l JOIN sec s USING (video_id, section_id) JOIN videos v USING (video_id)""",
    "artifact_id_v1": f"""WITH {_SECTIONS} SELECT video_id, section_id, video_name || '_' || printf('%02d-%02d', start_frame // fps // 60, start_frame // fps % 60) || '_'
            || printf('%02d-%02d', end_frame // fps // 60, end_frame // fps % 60) AS artifact_id FROM sec JOIN videos USING (video_id)""",
    "artifact_distinct": "SELECT artifact_id, min(response_id) AS first_response FROM responses GROUP BY 1",
    "cluster_label": f"WITH {_RAW} SELECT DISTINCT cluster_id, chr(cluster_id + 65) AS box_label FROM raw",
    "cluster_features": f"""WITH {_PLACED}, span AS (SELECT video_id, section_id, min(frame_id) AS lo, max(frame_id) AS hi FROM placed GROUP BY 1, 2)
        SELECT det_id, round((x1 + x2) / 2 / width + 1e-9, 6) AS fx, round((y1 + y2) / 2 / height + 1e-9, 6) AS fy, round((x2 - x1) / width + 1e-9, 6) AS fw, round((y2 - y1) / height + 1e-9, 6) AS fh,
               round({_minmax("span")} * 1.4 + 1e-9, 6) AS ft FROM placed p JOIN span USING (video_id, section_id) JOIN videos USING (video_id)""",
    "cluster_features_v1": f"""WITH {_PLACED}, v AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (y2 - y1) AS ar FROM placed),
        span AS (SELECT video_id, section_id, min(frame_id) AS lo, max(frame_id) AS hi, avg(cx) AS mx, avg(cy) AS my, avg(ar) AS ma, stddev_pop(cx) AS sx, stddev_pop(cy) AS sy, stddev_pop(ar) AS sa FROM v GROUP BY 1, 2)
        SELECT det_id, round(CASE WHEN sx > 1e-9 THEN (cx - mx) / sx ELSE 0 END, 4) + 0.0 AS zx, round(CASE WHEN sy > 1e-9 THEN (cy - my) / sy ELSE 0 END, 4) + 0.0 AS zy,
               round(CASE WHEN sa > 1e-9 THEN (ar - ma) / sa ELSE 0 END, 4) + 0.0 AS za, round({_minmax("span")} * 4 - 2, 6) + 0.0 AS ft FROM v p JOIN span USING (video_id, section_id)""",
    "small_cluster_cleanup": f"WITH {_PLACED} SELECT det_id, CASE WHEN count(*) OVER (PARTITION BY video_id, section_id, cluster_id) < 15 THEN -1 ELSE cluster_id END AS cluster_id FROM placed",
    "cluster_metadata": f"""WITH {_STATS} SELECT video_id, section_id, cluster_id, round(centroid_x + 1e-9, 4) AS centroid_x, round(centroid_y + 1e-9, 4) AS centroid_y, round(median_size + 1e-9, 4) AS median_size,
            cluster_size, "start", "end", box_label, start_ms, end_ms FROM stats""",
    "cluster_color": f"""WITH {_STATS}, turn AS (SELECT video_id, section_id, cluster_id, (row_number() OVER (PARTITION BY video_id, section_id ORDER BY cluster_id) - 1) % (SELECT count(*) FROM palette) AS idx FROM stats)
        SELECT video_id, section_id, cluster_id, color_name FROM turn JOIN palette USING (idx)""",
    "cluster_metadata_text": f"""WITH {_STATS}, turn AS (SELECT video_id, section_id, cluster_id, box_label, (row_number() OVER (PARTITION BY video_id, section_id ORDER BY cluster_id) - 1) % (SELECT count(*) FROM palette) AS idx FROM stats)
        SELECT video_id, section_id, 'id, color' || chr(10) || string_agg(box_label || ', ' || color_name, chr(10) ORDER BY cluster_id) AS text FROM turn JOIN palette USING (idx) GROUP BY 1, 2""",
    "detection_label": f"WITH {_RAW} SELECT det_id, printf('%.3f', confidence) || CASE WHEN cluster_id >= 0 THEN ' [' || chr(cluster_id + 65) || ']' ELSE '' END AS label FROM raw",
    "cluster_interval_overlap": f"WITH {_OVERLAPS} SELECT * FROM lap",
    "section_overlaps": f"WITH {_STATS} SELECT video_id, section_id, count(*) AS n_clusters, string_agg(CAST(cluster_id AS VARCHAR), '_' ORDER BY cluster_id) AS clusters FROM stats GROUP BY 1, 2 HAVING count(*) > 1",
    "overlap_topk": f"WITH {_OVERLAPS} SELECT video_id, section_id, CAST(sum(overlap) AS BIGINT) AS total_overlap FROM lap GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20",
    "zone_build": f"WITH {_PLACED}, {_zones('cluster_id <> -1')} SELECT video_id, section_id, cluster_id, x_lo, x_hi, y_lo, y_hi, round(min_area + 1e-9, 3) + 0.0 AS min_area, round(max_area + 1e-9, 3) AS max_area FROM zones",
    "ignore_zone_antijoin": f"""WITH {_PLACED}, {_zones("cluster_id <> -1 AND (video_id, section_id, cluster_id) IN (SELECT (video_id, section_id, max(cluster_id)) FROM placed WHERE cluster_id <> -1 GROUP BY video_id, section_id)")} SELECT det_id FROM placed p WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.video_id = p.video_id AND z.section_id < p.section_id
            AND CAST(trunc((x1 + x2) / 2) AS BIGINT) BETWEEN x_lo AND x_hi AND CAST(trunc((y1 + y2) / 2) AS BIGINT) BETWEEN y_lo AND y_hi AND (x2 - x1) * (y2 - y1) BETWEEN min_area AND max_area)""",
    "mask_antijoin": f"""WITH {_BOX}, mask AS (SELECT DISTINCT CAST(trunc((x1 + x2) / 2) AS BIGINT) AS x, CAST(trunc((y1 + y2) / 2) AS BIGINT) AS y FROM raw WHERE class_id = 2)
        SELECT det_id FROM box WHERE NOT EXISTS (SELECT 1 FROM mask WHERE x = CAST(trunc((x1 + x2) / 2) AS BIGINT) AND y = CAST(trunc((y1 + y2) / 2) AS BIGINT))""",
    "vlm_parse": f"WITH {_PARSED} SELECT response_id, label, is_primary FROM labels",
    "vlm_join": f"WITH {_LATEST} SELECT a.artifact_id, coalesce(label, '') AS label, coalesce(CAST(is_primary AS VARCHAR), '') AS is_primary FROM (SELECT DISTINCT artifact_id FROM area_labels WHERE artifact_id IS NOT NULL AND label IS NOT NULL) a LEFT JOIN latest USING (artifact_id)",
    "encoded_labels": f"WITH {_RAW} SELECT DISTINCT cluster_id, to_base64(encode(chr(cluster_id + 65))) AS encoded, sha256(CAST(cluster_id AS VARCHAR)) AS digest, md5(CAST(cluster_id AS VARCHAR)) AS check FROM raw",
    "vlm_cache_miss": "SELECT DISTINCT artifact_id FROM responses r WHERE NOT EXISTS (SELECT 1 FROM responses s WHERE s.artifact_id = r.artifact_id AND s.body IS NOT NULL)",
    "parse_ground_truth": f"WITH {_TRUTH} SELECT * FROM truth",
    "score_artifacts": f"WITH {_SCORES} SELECT * FROM scores",
    "score_overall": f"WITH {_SCORES} SELECT count(*) AS n_artifacts, round(avg(coalesce(score, 0.0)), 6) AS mean_score FROM (SELECT DISTINCT artifact_id FROM responses) LEFT JOIN scores USING (artifact_id)",
    "letter_bias": f"WITH {_PARSED} SELECT label, count(*) FILTER (WHERE is_primary) AS n_primary, count(*) FILTER (WHERE NOT is_primary) AS n_secondary FROM labels GROUP BY 1",
    "color_bias": f"""WITH {_PARSED}, line AS (SELECT response_id, unnest(string_split(prompt, chr(10))) AS l FROM responses),
        given AS (SELECT DISTINCT response_id, regexp_extract(l, '^([A-Z]), (\\p{{L}}.*)$', 1) AS label, trim(regexp_extract(l, '^([A-Z]), (\\p{{L}}.*)$', 2)) AS color_name FROM line WHERE regexp_matches(l, '^([A-Z]), (\\p{{L}}.*)$'))
        SELECT color_name, count(*) FILTER (WHERE is_primary) AS n_primary, count(*) FILTER (WHERE NOT is_primary) AS n_secondary FROM labels JOIN given USING (response_id, label) GROUP BY 1""",
    "merge_clusters": f"WITH {_BOX} SELECT video_id, frame_id, string_agg(CAST(det_id AS VARCHAR), ',' ORDER BY cluster_id, det_ord, det_id) AS merged FROM box WHERE cluster_id <> -1 GROUP BY 1, 2",
    "gaussian_smooth": f"WITH {_CARRIED}, "
    + _smooth(_GAUSS, "SELECT video_id, frame_id AS place, poi_x, poi_y, aoi FROM carried", ("poi_x", "poi_y", "aoi"), "video_id")
    + " SELECT video_id, place, round(poi_x + 1e-9, 3) AS poi_x, round(poi_y + 1e-9, 3) AS poi_y, round(aoi + 1e-9, 3) AS aoi FROM sm",
    "skewed_smooth": f"WITH {_CARRIED}, " + _smooth(_SKEW, "SELECT video_id, frame_id AS place, aoi FROM carried", ("aoi",), "video_id") + " SELECT video_id, place, round(aoi + 1e-9, 3) AS aoi FROM sm",
    "joint_smooth": f"WITH {_CARRIED}, joint AS (SELECT 0 AS everything, row_number() OVER (ORDER BY video_name, video_id, frame_id) - 1 AS place, carried.* FROM carried JOIN videos USING (video_id)), "
    + _smooth(_GAUSS, "SELECT everything, place, poi_x, poi_y, aoi FROM joint", ("poi_x", "poi_y", "aoi"), "everything")
    + " SELECT video_id, frame_id, round(sm.poi_x + 1e-9, 3) AS poi_x, round(sm.poi_y + 1e-9, 3) AS poi_y, round(sm.aoi + 1e-9, 3) AS aoi FROM sm JOIN joint USING (place)",
    "heatmap_argmax": f"""WITH {_BOX}, cells AS (SELECT video_id, CAST(trunc((y1 + y2) / 200) AS BIGINT) AS row, CAST(trunc((x1 + x2) / 200) AS BIGINT) AS col, count(*) AS n FROM box GROUP BY 1, 2, 3)
        SELECT video_id, row, col, n FROM cells QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC, row, col) = 1""",
    "eps_neighbors": f"""WITH {_BOX}, spots AS (SELECT video_id, det_id, CAST(round((x1 + x2) / 2 / width * 1000000 / 250) * 250 AS BIGINT) AS px, CAST(round((y1 + y2) / 2 / height * 1000000 / 250) * 250 AS BIGINT) AS py FROM box JOIN videos USING (video_id)),
        places AS (SELECT video_id, px, py, count(*) AS n, min(det_id) AS p FROM spots GROUP BY 1, 2, 3)
        SELECT a.video_id, a.p, CAST(sum(b.n) AS BIGINT) AS neighbors FROM places a JOIN places b ON a.video_id = b.video_id AND abs(a.px - b.px) <= 20000 AND (a.px - b.px) ** 2 + (a.py - b.py) ** 2 <= 400000000 GROUP BY 1, 2""",
    "tile_boxes": """WITH im AS (SELECT DISTINCT width, height, greatest(CAST(ceil((width - 640) / 512.0) AS INTEGER), 0) + 1 AS nx, greatest(CAST(ceil((height - 640) / 512.0) AS INTEGER), 0) + 1 AS ny FROM videos),
        t AS (SELECT *, unnest(range(0, nx * ny)) AS tile_no FROM im),
        u AS (SELECT width, height, tile_no, greatest(least(tile_no % nx * 512, width - 640), 0) AS x1, greatest(least(tile_no // nx * 512, height - 640), 0) AS y1 FROM t)
        SELECT width, height, tile_no, x1, y1, least(x1 + 640, width) AS x2, least(y1 + 640, height) AS y2 FROM u""",
    "label_placement": f"""WITH {_PLACED}, c AS (SELECT * FROM placed JOIN videos USING (video_id) WHERE cluster_id <> -1),
        bounds AS (SELECT video_id, section_id, cluster_id, width, height, avg((x1 + x2) / 2) AS mx, avg((y1 + y2) / 2) AS my, greatest(min(x1) - 60, 0) AS l, greatest(min(y1) - 40, 0) AS t,
                          least(max(x2) + 60, width) AS r, least(max(y2) + 40, height) AS b FROM c GROUP BY 1, 2, 3, 4, 5),
        xs AS (SELECT *, unnest(range(CAST(trunc(l) AS BIGINT), CAST(trunc(r) AS BIGINT), 60)) AS x FROM bounds),
        grid AS (SELECT *, unnest(range(CAST(trunc(t) AS BIGINT), CAST(trunc(b) AS BIGINT), 40)) AS y FROM xs),
        open AS (SELECT * FROM grid g WHERE x + 60 <= width AND y + 40 <= height AND NOT EXISTS (SELECT 1 FROM c WHERE c.video_id = g.video_id AND c.section_id = g.section_id AND c.cluster_id = g.cluster_id
                 AND c.x1 < g.x + 60 AND c.x2 > g.x AND c.y1 < g.y + 40 AND c.y2 > g.y)),
        best AS (SELECT video_id, section_id, cluster_id, x, y FROM open QUALIFY row_number() OVER (PARTITION BY video_id, section_id, cluster_id ORDER BY round((x + 30 - mx) ** 2 + (y + 20 - my) ** 2, 6), y, x) = 1)
        SELECT b.video_id, b.section_id, b.cluster_id, coalesce(x, CAST(trunc(mx) AS BIGINT)) AS x, coalesce(y, CAST(trunc(my) AS BIGINT)) AS y FROM bounds b LEFT JOIN best USING (video_id, section_id, cluster_id)""",
    "dbscan_play": f"WITH RECURSIVE {_PLAY} SELECT * FROM play",
    "dbscan_static": f"WITH RECURSIVE {_STATIC} SELECT * FROM static",
    "declustered_boxes": f"WITH RECURSIVE {_STATIC} SELECT det_id FROM static WHERE label = -1",
    "relevant_boxes": f"""WITH RECURSIVE {_RELEVANT}, {_zones("NOT is_primary AND (video_id, section_id, cluster_id) IN (SELECT (video_id, section_id, cluster_id) FROM hidden)", "marked")}
        SELECT det_id, video_id, section_id, cluster_id FROM marked m WHERE (is_primary IS NULL OR is_primary) AND NOT EXISTS (SELECT 1 FROM zones z WHERE z.video_id = m.video_id AND z.section_id < m.section_id
            AND CAST(trunc((x1 + x2) / 2) AS BIGINT) BETWEEN x_lo AND x_hi AND CAST(trunc((y1 + y2) / 2) AS BIGINT) BETWEEN y_lo AND y_hi AND (x2 - x1) * (y2 - y1) BETWEEN min_area AND max_area)""",
    "spline_chunks": f"""WITH RECURSIVE {_BOX}, busy AS (SELECT DISTINCT video_id, frame_id FROM box), len AS (SELECT video_id, max(frame_id) + 1 AS n FROM frames GROUP BY 1),
        chunk AS (SELECT video_id, 0 AS chunk_no, CAST(0 AS BIGINT) AS first, coalesce((SELECT min(frame_id) + 1 FROM busy b WHERE b.video_id = len.video_id AND b.frame_id >= 63), n) AS "end", n FROM len
                  UNION ALL SELECT c.video_id, c.chunk_no + 1, c."end", coalesce((SELECT min(frame_id) + 1 FROM busy b WHERE b.video_id = c.video_id AND b.frame_id >= c."end" + 63), c.n), c.n FROM chunk c WHERE c."end" < c.n)
        SELECT video_id, chunk_no, first, "end" FROM chunk""",
    "greedy_select": f"""WITH RECURSIVE {_BOX}, line AS (SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id, det_ord, det_id) AS i, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (y2 - y1) AS area FROM box),
        walk AS (SELECT video_id, frame_id, i, cx, cy, area, CAST(0 AS DOUBLE) AS least FROM line WHERE i = 1
                 UNION ALL SELECT video_id, n.frame_id, n.i, CASE WHEN taken THEN n.cx ELSE w.cx END, CASE WHEN taken THEN n.cy ELSE w.cy END, CASE WHEN taken THEN n.area ELSE w.area END, CASE WHEN taken THEN d ELSE w.least END
                 FROM (SELECT w.video_id, w AS w, n AS n, sqrt((n.cx - w.cx) ** 2 + (n.cy - w.cy) ** 2) AS d, w.frame_id <> n.frame_id OR sqrt((n.cx - w.cx) ** 2 + (n.cy - w.cy) ** 2) < w.least AS taken
                       FROM walk w JOIN line n ON n.video_id = w.video_id AND n.i = w.i + 1))
        SELECT video_id, frame_id, cx, cy, area FROM walk QUALIFY row_number() OVER (PARTITION BY video_id, frame_id ORDER BY i DESC) = 1""",
    "nms_tiles": f"""WITH RECURSIVE {_BOX}, line AS (SELECT video_id, frame_id, det_id, class_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY confidence DESC, det_ord, det_id) AS i FROM box),
        walk AS (SELECT video_id, frame_id, i, det_id, det_id AS kept_by, [line] AS kept FROM line WHERE i = 1
                 UNION ALL SELECT video_id, frame_id, i, det_id, coalesce(hit.det_id, det_id), CASE WHEN hit IS NULL THEN list_append(kept, n) ELSE kept END
                 FROM (SELECT n.video_id, n.frame_id, n.i, n.det_id, n, w.kept, list_filter(w.kept, lambda k: k.class_id = n.class_id AND least(k.x2, n.x2) > greatest(k.x1, n.x1) AND least(k.y2, n.y2) > greatest(k.y1, n.y1)
                              AND (least(k.x2, n.x2) - greatest(k.x1, n.x1)) * (least(k.y2, n.y2) - greatest(k.y1, n.y1)) > 0.5 * least((k.x2 - k.x1) * (k.y2 - k.y1), (n.x2 - n.x1) * (n.y2 - n.y1)))[1] AS hit
                       FROM walk w JOIN line n ON n.video_id = w.video_id AND n.frame_id = w.frame_id AND n.i = w.i + 1))
        SELECT det_id, kept_by FROM walk""",
    "cluster_heading": f"""WITH RECURSIVE {_PLACED}, mid AS (SELECT video_id, section_id, cluster_id, frame_id, avg((x1 + x2) / 2) AS cx, avg((y1 + y2) / 2) AS cy FROM placed WHERE cluster_id <> -1 GROUP BY 1, 2, 3, 4),
        line AS (SELECT *, row_number() OVER (PARTITION BY video_id, section_id, cluster_id ORDER BY frame_id) AS i, count(*) OVER (PARTITION BY video_id, section_id, cluster_id) AS n FROM mid),
        walk AS (SELECT video_id, section_id, cluster_id, i, cx, cy, CAST(NULL AS DOUBLE) AS a FROM line WHERE i = 1
                 UNION ALL SELECT l.video_id, l.section_id, l.cluster_id, l.i, CASE WHEN l.cx <> w.cx AND l.cy <> w.cy THEN l.cx ELSE w.cx END, CASE WHEN l.cx <> w.cx AND l.cy <> w.cy THEN l.cy ELSE w.cy END,
                        CASE WHEN l.cx <> w.cx AND l.cy <> w.cy THEN atan2(l.cy - w.cy, l.cx - w.cx) END
                 FROM walk w JOIN line l ON l.video_id = w.video_id AND l.section_id = w.section_id AND l.cluster_id = w.cluster_id AND l.i = w.i + 1 AND l.i < l.n),
        turn AS (SELECT *, median(a) OVER (PARTITION BY video_id, section_id, cluster_id) AS m FROM walk)
        SELECT video_id, section_id, cluster_id, round(coalesce(sum(a / (abs(a - m) + 1e-10)) / sum(1 / (abs(a - m) + 1e-10)), 0.0) + 1e-9, 4) + 0.0 AS heading FROM turn GROUP BY 1, 2, 3""",
    "gaussian_smooth_int": f"WITH {_CARRIED}, "
    + _smooth(_GAUSS, "SELECT video_id, frame_id AS place, trunc(poi_x) AS poi_x, trunc(poi_y) AS poi_y, trunc(aoi) AS aoi FROM carried", ("poi_x", "poi_y", "aoi"), "video_id")
    + " SELECT video_id, place, trunc(poi_x + 1e-9) AS poi_x, trunc(poi_y + 1e-9) AS poi_y, trunc(aoi + 1e-9) AS aoi FROM sm",
    **{f"cluster_metadata_text_{v}": _metadata(v) for v in ("v1", "v2")},
}
