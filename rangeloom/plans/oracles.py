"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

from rangeloom.operators.axes import CELLS, axis_steps

_ENDS = ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ab" for c in ("x", "y", "z", "rho", "horiz_angle"))
PCD = """pcd AS (
  SELECT event_id AS point_counter, user_id % 4 AS scan_id, user_id % 6 AS label,
         CASE WHEN event_id % 7 = 0 THEN (user_id + 1) % 6 ELSE user_id % 6 END AS pred,
         ((event_id * 7919) % 2001)::DOUBLE / 100.0::DOUBLE AS x, ((event_id * 104729) % 2003)::DOUBLE / 100.0::DOUBLE AS y,
         ((event_id * 1299709) % 997)::DOUBLE / 100.0::DOUBLE AS z, event_id::DOUBLE / 50.0::DOUBLE AS horiz_angle,
         ((event_id * 29) % 1800)::DOUBLE / 10.0::DOUBLE AS vert_angle, value AS rho, (event_id * 31) % 256 AS red, (event_id * 37) % 256 AS green
  FROM events)"""
LINES = f"""{PCD},
jumps AS (
  SELECT *, coalesce(abs(lead(vert_angle) OVER w - vert_angle), abs(vert_angle - lag(vert_angle) OVER w)) AS jump
  FROM pcd WINDOW w AS (PARTITION BY scan_id ORDER BY horiz_angle, point_counter)),
ids AS (
  SELECT *, (1 + coalesce(sum((coalesce(jump, 0) > 80)::INT) OVER (PARTITION BY scan_id ORDER BY horiz_angle, point_counter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS scanline_id
  FROM jumps),
lines AS (
  SELECT *, coalesce(abs(lead(rho) OVER w - rho), abs(rho - lag(rho) OVER w), 0) AS rho_diff
  FROM ids WINDOW w AS (PARTITION BY scan_id, scanline_id ORDER BY vert_angle, point_counter))"""
SEGS = f"""{LINES},
segs AS (
  SELECT *, (1 + coalesce(sum((rho_diff > 40)::INT) OVER (PARTITION BY scan_id ORDER BY scanline_id, vert_angle, point_counter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS segment_id
  FROM lines)"""
SHARES = f"""{SEGS},
counts AS (SELECT scan_id, segment_id, label, count(*) AS c FROM segs GROUP BY ALL),
shares AS (
  SELECT scan_id, segment_id, sum(c)::BIGINT AS n, arg_min(label, (-c, label)) AS mode_label, round(1 - sum(c * c)::DOUBLE / (sum(c) * sum(c))::DOUBLE, 4) AS gini
  FROM counts GROUP BY ALL)"""


def _profile(lines: str, value: str, size: str) -> str:
    """Range profile of a column of a relation with scan_id and rho."""
    return f"""tops AS (SELECT scan_id, greatest(ceil(max(rho) / {size}), 1)::BIGINT AS top FROM {lines} GROUP BY 1),
stats AS (SELECT scan_id, floor(rho / {size})::BIGINT + 1 AS b, max({value}) AS m, stddev_pop({value}) AS s FROM {lines} GROUP BY 1, 2),
grid AS (
  SELECT t.scan_id, g.b, CASE WHEN g.b > 0 THEN nullif(m, 0) END AS m, CASE WHEN g.b > 0 THEN nullif(s, 0) END AS s
  FROM tops t, LATERAL (SELECT unnest(range(0, t.top)) AS b) g LEFT JOIN stats ON stats.scan_id = t.scan_id AND stats.b = g.b),
ends AS (
  SELECT *, last_value(m IGNORE NULLS) OVER lo AS m0, last_value(CASE WHEN m IS NOT NULL THEN b END IGNORE NULLS) OVER lo AS mb0,
         first_value(m IGNORE NULLS) OVER hi AS m1, first_value(CASE WHEN m IS NOT NULL THEN b END IGNORE NULLS) OVER hi AS mb1,
         last_value(s IGNORE NULLS) OVER lo AS s0, last_value(CASE WHEN s IS NOT NULL THEN b END IGNORE NULLS) OVER lo AS sb0,
         first_value(s IGNORE NULLS) OVER hi AS s1, first_value(CASE WHEN s IS NOT NULL THEN b END IGNORE NULLS) OVER hi AS sb1
  FROM grid WINDOW lo AS (PARTITION BY scan_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (PARTITION BY scan_id ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
profile AS (
  SELECT scan_id, b + 1 AS bin, coalesce(m, CASE WHEN m0 IS NULL THEN m1 WHEN m1 IS NULL THEN m0 ELSE m0 + (m1 - m0) * (b - mb0) / greatest(mb1 - mb0, 1) END) AS profile_max,
         coalesce(s, CASE WHEN s0 IS NULL THEN s1 WHEN s1 IS NULL THEN s0 ELSE s0 + (s1 - s0) * (b - sb0) / greatest(sb1 - sb0, 1) END) AS profile_std
  FROM ends)"""


PROFILE = f"{LINES},\n{_profile('lines', 'rho_diff', '5')}"
NEAR = f"""{PCD},
near AS (
  SELECT q.scan_id, q.point_counter AS src, p.point_counter AS dst, p.x, p.y, p.z, p.rho, p.red, p.green, p.vert_angle, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS dist
  FROM pcd q JOIN pcd p ON p.scan_id = q.scan_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= 1)"""
CONFUSION = f"""{PCD},
names AS (SELECT label AS v FROM pcd UNION SELECT pred FROM pcd),
conf AS (SELECT t.v AS truth, p.v AS pred, count(c.label)::BIGINT AS n FROM names t CROSS JOIN names p LEFT JOIN pcd c ON c.label = t.v AND c.pred = p.v GROUP BY ALL)"""


def _statistics(*attributes: str) -> str:
    one = "round(stddev_pop({a}), 6) + 0.0 AS {a}_std, " + ", ".join(f"round(quantile_cont({{a}}, {p}), 6) + 0.0 AS {{a}}_{n}" for n, p in (("perc2nd", 0.02), ("perc98th", 0.98), ("perc25th", 0.25), ("perc75th", 0.75)))
    skew = "coalesce(round(avg({a} * {a} * {a} - 3 * {a} * {a} * m_{a} + 3 * {a} * m_{a} * m_{a} - m_{a} * m_{a} * m_{a}) / nullif(pow(var_pop({a}), 1.5), 0), 6), 0.0) + 0.0 AS {a}_skewness"
    return ", ".join((one + ", " + skew).format(a=a) for a in attributes)



def _features(p: str, lines: str) -> str:
    """``{p}shape`` with slopes and roughness of a relation of scanline points that has the half width ``k``."""
    return f"""{p}placed AS (SELECT *, row_number() OVER (PARTITION BY scan_id, scanline_id ORDER BY vert_angle, point_counter) - 1 AS i, count(*) OVER (PARTITION BY scan_id, scanline_id) AS n FROM {lines}),
{p}pairs AS (SELECT *, unnest(range(0, kk)) AS t FROM (SELECT *, least(k, n - 1) AS kk FROM {p}placed) WHERE kk > 0),
{p}refl AS (SELECT *, CASE WHEN i - kk + t < 0 THEN kk - t - i ELSE i - kk + t END AS ja, CASE WHEN i + 1 + t >= n THEN 2 * (n - 1) - (i + 1 + t) ELSE i + 1 + t END AS jb FROM {p}pairs),
{p}met AS (SELECT p.scan_id, p.point_counter, p.x, p.y, p.z, {_ENDS} FROM {p}refl p JOIN {p}placed a ON a.scan_id = p.scan_id AND a.scanline_id = p.scanline_id AND a.i = p.ja JOIN {p}placed b ON b.scan_id = p.scan_id AND b.scanline_id = p.scanline_id AND b.i = p.jb),
{p}line AS (SELECT *, (b_x - a_x) ** 2 + (b_y - a_y) ** 2 + (b_z - a_z) ** 2 AS uu FROM {p}met),
{p}foot AS (SELECT *, ((x - a_x) * (b_x - a_x) + (y - a_y) * (b_y - a_y) + (z - a_z) * (b_z - a_z)) / nullif(uu, 0) AS u FROM {p}line),
{p}sums AS (
  SELECT scan_id, point_counter, median(degrees(atan2(b_z - a_z, sqrt(uu)))) AS slope,
         avg(coalesce(sqrt((x - a_x - u * (b_x - a_x)) ** 2 + (y - a_y - u * (b_y - a_y)) ** 2 + (z - a_z - u * (b_z - a_z)) ** 2), 0)) AS roughness,
         2 * count(*) AS m, sum(a_horiz_angle + b_horiz_angle) AS sx, sum(a_rho + b_rho) AS sy, sum(a_horiz_angle ** 2 + b_horiz_angle ** 2) AS sxx, sum(a_horiz_angle * a_rho + b_horiz_angle * b_rho) AS sxy
  FROM {p}foot GROUP BY 1, 2),
{p}fit AS (SELECT *, CASE WHEN abs(m * sxx - sx * sx) > 1e-9 THEN (m * sxy - sx * sy) / (m * sxx - sx * sx) ELSE (sx / m) * sy / m / ((sx / m) ** 2 + 1) END AS beta FROM {p}sums),
{p}shape AS (SELECT l.scan_id, l.point_counter, coalesce(slope, 0) AS slope, coalesce(degrees(atan(beta)), 0) AS slope_lstsq, coalesce(roughness, 0) AS roughness FROM {lines} l LEFT JOIN {p}fit USING (scan_id, point_counter))"""


def _bent(p: str, expected: str, multiplier: float) -> str:
    """``{p}bent``: points with shape and both curvatures, neighbourhoods as wide as expected distances ask for."""
    return f"""{p}wide AS (SELECT *, round_even(greatest(3, ceil(sqrt(1 / nullif(expected_value / 1000, 0)))) * {multiplier}::DOUBLE, 0)::INT AS k FROM {expected}),
{_features(p, p + 'wide')},
{p}bent AS (
  SELECT *, coalesce((lead(slope_lstsq) OVER w - lag(slope_lstsq) OVER w) / 2, 0) AS curvature_lstsq, coalesce((lead(slope) OVER w - lag(slope) OVER w) / 2, 0) AS curvature
  FROM {expected} JOIN {p}shape USING (scan_id, point_counter) WINDOW w AS (PARTITION BY scan_id, scanline_id ORDER BY vert_angle, point_counter))"""


MULTIPLIERS = (1.0, 1.25, 1.5, 1.75, 2.0)
_FLAG = "coalesce(rho_diff > expected_value + expected_value_std * {std}, false) OR coalesce(abs(curvature_lstsq) > {curvature}, false)"


def _broken(bent: str) -> str:
    return f"""flags AS (SELECT *, ({_FLAG.format(std=1, curvature=30)})::INT AS flag FROM {bent})
SELECT point_counter, (1 + sum(flag) OVER (PARTITION BY scan_id ORDER BY scanline_id, vert_angle, point_counter ROWS UNBOUNDED PRECEDING) - flag)::BIGINT AS segment_id,
  round(slope, 4) + 0.0 AS slope, round(curvature, 4) + 0.0 AS curvature, round(roughness, 4) + 0.0 AS roughness FROM flags"""


def _report(p: str, rows: str) -> str:
    """``{p}report`` of a relation (label, pred)."""
    return f"""{p}names AS (SELECT label AS v FROM {rows} UNION SELECT pred FROM {rows}),
{p}conf AS (SELECT t.v AS truth, q.v AS pred, count(c.label)::BIGINT AS n FROM {p}names t CROSS JOIN {p}names q LEFT JOIN {rows} c ON c.label = t.v AND c.pred = q.v GROUP BY ALL),
{p}t AS (SELECT truth, sum(n) AS support, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS hit FROM {p}conf GROUP BY 1),
{p}p AS (SELECT pred, sum(n) AS named FROM {p}conf GROUP BY 1),
{p}s AS (SELECT truth, support, hit, coalesce(hit::DOUBLE / nullif(named, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall FROM {p}t JOIN {p}p ON truth = pred),
{p}f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM {p}s),
{p}report AS (
  SELECT truth::VARCHAR AS name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM (
  SELECT truth::VARCHAR AS truth, precision, recall, f1, support FROM {p}f
  UNION ALL SELECT 'accuracy', sum(hit)::DOUBLE / sum(support), sum(hit)::DOUBLE / sum(support), sum(hit)::DOUBLE / sum(support), sum(support) FROM {p}f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM {p}f
  UNION ALL SELECT 'weighted avg', sum(support * precision) / sum(support), sum(support * recall) / sum(support), sum(support * f1) / sum(support), sum(support) FROM {p}f))"""


EXPECTED = f"{PROFILE},\nexpected AS (SELECT l.*, profile_max AS expected_value, profile_std AS expected_value_std FROM lines l LEFT JOIN profile p ON p.scan_id = l.scan_id AND p.bin = floor(l.rho / 5)::BIGINT + 1)"
KNN_EXPECTED = f"""{LINES},
nearest AS (SELECT q.scan_id, q.point_counter, min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)), 16) AS d FROM lines q JOIN lines p ON p.scan_id = q.scan_id GROUP BY 1, 2),
far AS (SELECT l.*, list_sum(d[2:]) / len(d[2:]) AS mean_dist FROM lines l JOIN nearest USING (scan_id, point_counter)),
{_profile('far', 'mean_dist', '0.5::DOUBLE')},
expected AS (SELECT l.*, profile_max AS expected_value, profile_std AS expected_value_std FROM far l LEFT JOIN profile p ON p.scan_id = l.scan_id AND p.bin = floor(l.rho / 0.5::DOUBLE)::BIGINT + 1)"""
RAISED = f"""{SHARES},
raised AS (SELECT * REPLACE (z - min(z) OVER (PARTITION BY scan_id) AS z) FROM segs),
means AS (SELECT *, avg(z) OVER (PARTITION BY scan_id, segment_id) AS m_z, avg(rho) OVER (PARTITION BY scan_id, segment_id) AS m_rho FROM raised)"""
_REPRESENT = ", ".join(
    f"round(arg_min({c}, ((x - x_{t}) ** 2 + (y - y_{t}) ** 2 + (z - z_{t}) ** 2, point_counter)), 6) AS {c}_{t}_nn" for t in ("median", "perc2nd", "perc98th") for c in "xyz"
)
_TARGETS = ", ".join(f"quantile_cont({c}, {p}) AS {c}_{t}" for t, p in (("median", 0.5), ("perc2nd", 0.02), ("perc98th", 0.98)) for c in "xyz")

_CELLS = ", ".join(f"covar_samp({c[1]}, {c[2]}) AS {c}" for c in CELLS)
_CENTRED = """centred AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, z - avg(z) OVER w AS dz FROM pcd WINDOW w AS (PARTITION BY scan_id)),
views AS (SELECT scan_id, point_counter, x AS ox, y AS oy, z AS oz, red, green, vert_angle, coalesce(-dx / r, 0) AS lx, coalesce(-dy / r, 0) AS ly, coalesce(-dz / r, 0) AS lz FROM (SELECT *, nullif(sqrt(dx * dx + dy * dy + dz * dz), 0) AS r FROM centred))"""


def _axes(name: str, of: str, prefix: str = "", few: int = 2) -> str:
    """Relation ``name``: ``of`` with curvature and normal, through the steps of the closed form."""
    steps = axis_steps(prefix, few)
    chain = [f"{name}{i} AS (SELECT *, {', '.join(f'{v} AS {c}' for c, v in step.items())} FROM {f'{name}{i - 1}' if i else of})" for i, step in enumerate(steps)]
    return ",\n".join([*chain, f"{name} AS (SELECT o.*, {', '.join(f'l.{c}' for c in steps[-1])} FROM {of} o JOIN {name}{len(steps) - 1} l USING (scan_id, src))"])


def _surface(near: str) -> str:
    """``surface`` of a relation of neighbours (scan_id, src, x, y, z)."""
    return f"""cov AS (SELECT scan_id, src, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {_CELLS} FROM {near} GROUP BY 1, 2),
{_axes("axes", "cov")},
{_CENTRED},
turns AS (SELECT a.scan_id, src, n, curvature, mx, my, mz, ox, oy, oz, red, green, vert_angle, CASE WHEN nx * lx + ny * ly + nz * lz < 0 THEN -1 ELSE 1 END AS t, nx, ny, nz FROM axes a JOIN views v ON v.scan_id = a.scan_id AND v.point_counter = a.src),
surface AS (
  SELECT scan_id, src, n, curvature, t * nx AS nx, t * ny AS ny, t * nz AS nz, abs((ox - mx) * nx + (oy - my) * ny + (oz - mz) * nz) AS roughness,
         CASE WHEN n > 2 THEN degrees(acos(least(greatest(t * nz, -1), 1))) ELSE 0 END AS zenith_angle, ox AS x, oy AS y, oz AS z, red, green, vert_angle FROM turns)"""


_SURFACE = "SELECT src, n, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("curvature", "nx", "ny", "nz", "roughness", "zenith_angle")) + " FROM surface"
_AROUND = ("z", "red", "green", "vert_angle", "zenith_angle", "curvature", "roughness", "nx", "ny", "nz")
_RADII = (1.0, 2.5, 5.0, 10.0)


_IMPURITY = """count(*) AS segments, count(*) FILTER (n < 5) AS below_5, count(*) FILTER (n < 10) AS below_10,
  round(100.0::DOUBLE * count(*) FILTER (n < 5) / count(*), 4) AS below_5_pct, round(100.0::DOUBLE * count(*) FILTER (n < 10) / count(*), 4) AS below_10_pct, round(sum(round(gini * 10000)::BIGINT)::DOUBLE / count(*) / 10000, 6) AS mean,
  round(stddev_samp(gini), 6) AS std, round(var_samp(gini), 6) AS var, round(max(gini) - min(gini), 6) AS ptp, round(quantile_cont(gini, 0.02), 6) AS p2, round(quantile_cont(gini, 0.98), 6) AS p98"""

SQL: dict[str, str] = {
    "angle_adjust": f"WITH {PCD} SELECT point_counter, round(CASE WHEN 360 - 2 * vert_angle > 180 THEN 2 * vert_angle ELSE 360 - 2 * vert_angle END, 6) AS vert_angle, round(CASE WHEN 360 - 2 * vert_angle > 180 THEN horiz_angle - 180 ELSE horiz_angle END, 6) AS horiz_angle FROM pcd",
    "scanline_summary": f"WITH {LINES} SELECT scan_id, scanline_id, count(*) AS n, min(point_counter) AS first_point FROM lines GROUP BY 1, 2",
    "rho_diff": f"WITH {LINES} SELECT point_counter, scanline_id, round(rho_diff, 6) AS rho_diff FROM lines",
    "gradient_curvature": f"WITH {LINES} SELECT point_counter, coalesce(round((lead(rho) OVER w - lag(rho) OVER w) / 2, 6), 0) AS curvature FROM lines WINDOW w AS (PARTITION BY scan_id, scanline_id ORDER BY vert_angle, point_counter)",
    "segment_stats": f"WITH {SEGS}, m AS (SELECT *, avg(z) OVER (PARTITION BY scan_id, segment_id) AS m_z, avg(rho) OVER (PARTITION BY scan_id, segment_id) AS m_rho FROM segs) SELECT scan_id, segment_id, count(*) AS n, {_statistics('z', 'rho')} FROM m GROUP BY 1, 2",
    "segment_labels": f"WITH {SHARES} SELECT * FROM shares",
    "segment_representatives": f"WITH {SEGS}, aim AS (SELECT scan_id, segment_id, {_TARGETS} FROM segs GROUP BY 1, 2) SELECT scan_id, segment_id, {_REPRESENT} FROM segs JOIN aim USING (scan_id, segment_id) GROUP BY 1, 2",
    "range_profile": f"WITH {PROFILE} SELECT scan_id, bin, round(profile_max, 6) AS profile_max, round(profile_std, 6) AS profile_std FROM profile",
    "expected_distance": f"WITH {PROFILE} SELECT point_counter, round(profile_max, 6) AS expected_value, round(profile_std, 6) AS expected_value_std FROM lines l LEFT JOIN profile p ON p.scan_id = l.scan_id AND p.bin = floor(l.rho / 5)::BIGINT + 1",
    "scanline_features": f"WITH {LINES}, wide3 AS (SELECT *, 3 AS k FROM lines),\n{_features('f_', 'wide3')} SELECT scan_id, point_counter, round(slope, 4) AS slope, round(slope_lstsq, 4) AS slope_lstsq, round(roughness, 4) AS roughness FROM f_shape",
    "break_segments": f"WITH {EXPECTED},\n{_bent('b_', 'expected', 2.0)},\n{_broken('b_bent')}",
    "knn_break_segments": f"WITH {KNN_EXPECTED},\n{_bent('b_', 'expected', 2.0)},\n{_broken('b_bent')}",
    "segmentation_sweep": f"WITH {EXPECTED},\n" + ",\n".join(_bent(f"b{i}_", "expected", m) for i, m in enumerate(MULTIPLIERS)) + f"""
SELECT scan_id, neighborhood_multiplier, std_multiplier, curvature_threshold, (1 + sum(flag) - arg_max(flag, (scanline_id, vert_angle, point_counter)))::BIGINT AS segments
FROM (SELECT *, ({_FLAG.format(std="std_multiplier", curvature="curvature_threshold")})::BIGINT AS flag
  FROM ({" UNION ALL ".join(f"SELECT *, {m}::DOUBLE AS neighborhood_multiplier FROM b{i}_bent" for i, m in enumerate(MULTIPLIERS))}) b,
  (SELECT unnest([1, 15, 25, 35, 50, 65, 75, 85, 100])::DOUBLE AS std_multiplier) s, (SELECT unnest([20, 30, 40, 50, 60, 70])::DOUBLE AS curvature_threshold) c)
GROUP BY ALL""",
    "impurity_sweep": f"WITH {KNN_EXPECTED},\n" + ",\n".join(_bent(f"b{i}_", "expected", m) for i, m in enumerate(MULTIPLIERS)) + f""",
flags AS (SELECT *, ({_FLAG.format(std="std_multiplier", curvature="curvature_threshold")})::BIGINT AS flag
  FROM ({" UNION ALL ".join(f"SELECT *, {m}::DOUBLE AS neighborhood_multiplier FROM b{i}_bent" for i, m in enumerate(MULTIPLIERS))}) b,
  (SELECT unnest([1, 15, 25, 35, 50, 65, 75, 85, 100])::DOUBLE AS std_multiplier) s, (SELECT unnest([20, 30, 40, 50, 60, 70])::DOUBLE AS curvature_threshold) c),
swept AS (SELECT *, 1 + sum(flag) OVER (PARTITION BY scan_id, neighborhood_multiplier, std_multiplier, curvature_threshold ORDER BY scanline_id, vert_angle, point_counter ROWS UNBOUNDED PRECEDING) - flag AS segment_id FROM flags),
lab AS (SELECT scan_id, neighborhood_multiplier, std_multiplier, curvature_threshold, segment_id, label, count(*) AS c FROM swept GROUP BY ALL),
gin AS (SELECT scan_id, neighborhood_multiplier, std_multiplier, curvature_threshold, segment_id, sum(c) AS n, round(1 - sum(c * c)::DOUBLE / (sum(c) * sum(c))::DOUBLE, 4) AS gini FROM lab GROUP BY ALL)
SELECT scan_id, neighborhood_multiplier, std_multiplier, curvature_threshold, {_IMPURITY} FROM gin GROUP BY ALL""",
    "radius_counts": f"WITH {NEAR} SELECT src, count(*) AS n, round(avg(dist), 6) AS mean_dist FROM near GROUP BY 1",
    "radius_counts_strict": f"WITH {PCD} SELECT q.point_counter AS src, count(*) AS n FROM pcd q JOIN pcd p ON p.scan_id = q.scan_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) < 0.25 GROUP BY 1",
    "neighbour_statistics": f"WITH {NEAR} SELECT src, count(*) AS n, "
    + ", ".join(
        f"round(avg({a}), 6) AS {a}_mean, round(stddev_pop({a}), 6) AS {a}_std, " + ", ".join(f"round(quantile_cont({a}::DOUBLE, {q}), 6) AS {a}_{t}" for t, q in (("perc2nd", 0.02), ("perc25th", 0.25), ("perc75th", 0.75), ("perc98th", 0.98)))
        for a in ("z", "red", "green", "vert_angle", "rho")
    )
    + " FROM near GROUP BY 1",
    "knn_mean_distance": f"""WITH {PCD},
d AS (SELECT q.point_counter AS src, min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)), 16) AS d FROM pcd q JOIN pcd p ON p.scan_id = q.scan_id GROUP BY 1)
SELECT src, round(list_sum(d[2:]) / len(d[2:]), 6) AS mean_dist, round(d[-1], 6) AS kth_dist FROM d WHERE len(d) > 1""",
    "voxels": f"WITH {PCD} SELECT scan_id, floor(x / 2)::BIGINT AS vx, floor(y / 2)::BIGINT AS vy, floor(z / 2)::BIGINT AS vz, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM pcd GROUP BY 1, 2, 3, 4",
    "voxel_pyramid": f"WITH {PCD}, cells AS (" + " UNION ALL ".join(
        f"SELECT {e}::DOUBLE AS edge, scan_id, " + ", ".join(f"floor(floor({c} / {b}::DOUBLE) / {r})::BIGINT AS v{c}" for c in "xyz") + ", x, y, z FROM pcd" for e, b, r in ((2.0, 0.5, 4), (1.0, 0.5, 2), (0.5, 0.5, 1), (0.3, 0.3, 1))
    ) + ") SELECT edge, scan_id, vx, vy, vz, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM cells GROUP BY 1, 2, 3, 4, 5",
    "voxel_sweep": f"WITH {PCD}, v AS (" + " UNION ALL ".join(
        f"SELECT {e}::DOUBLE AS edge, scan_id, " + ", ".join(f"floor(floor({c} / {b}::DOUBLE) / {r})::BIGINT AS v{c}" for c in "xyz") + ", count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pcd GROUP BY 1, 2, 3, 4, 5" for e, b, r in ((2.0, 0.5, 4), (1.0, 0.5, 2), (0.5, 0.5, 1), (0.3, 0.3, 1))
    ) + """),
near AS (SELECT edge, v.scan_id, vx, vy, vz, n, arg_min(point_counter, (round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 9), point_counter)) AS p FROM v JOIN pcd ON pcd.scan_id = v.scan_id
  AND abs(x - mx) <= 2 * edge AND abs(y - my) <= 2 * edge AND abs(z - mz) <= 2 * edge GROUP BY ALL)
SELECT edge, scan_id, count(*) AS voxels, sum(n)::BIGINT AS points, count(DISTINCT p) AS snapped, sum(p)::BIGINT AS ids FROM near GROUP BY 1, 2""",
    "voxel_snap": f"""WITH {PCD}, v AS (SELECT scan_id, floor(x / 2)::BIGINT AS vx, floor(y / 2)::BIGINT AS vy, floor(z / 2)::BIGINT AS vz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pcd GROUP BY 1, 2, 3, 4)
SELECT v.scan_id, vx, vy, vz, arg_min(point_counter, (round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 9), point_counter)) AS point_counter FROM v JOIN pcd p ON p.scan_id = v.scan_id GROUP BY 1, 2, 3, 4""",
    "neighbour_covariance": f"WITH {NEAR} SELECT src, count(*) AS n, round(avg(x), 9) AS mx, round(avg(y), 9) AS my, round(avg(z), 9) AS mz, "
    + ", ".join(f"round(covar_samp({a}, {b}), 9) + 0.0 AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    + " FROM near GROUP BY 1",
    "pca_normals": f"WITH {NEAR},\n{_surface('near')}\n{_SURFACE}",
    "radius_curvature": f"WITH {NEAR}, cov AS (SELECT scan_id, src, count(*) AS n, {_CELLS} FROM near GROUP BY 1, 2),\n{_axes('axes', 'cov', few=1)} SELECT src, n, round(curvature, 6) + 0.0 AS curvature FROM axes",
    "knn_normals": f"""WITH {PCD},
kth AS (SELECT q.scan_id, q.point_counter, max(d) AS far FROM (SELECT q.scan_id, q.point_counter, unnest(min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)), 16)) AS d FROM pcd q JOIN pcd p ON p.scan_id = q.scan_id GROUP BY 1, 2) q GROUP BY 1, 2),
pairs AS (SELECT q.scan_id, q.point_counter AS src, p.point_counter AS dst, p.x, p.y, p.z, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS dist, far
  FROM pcd q JOIN kth k ON k.scan_id = q.scan_id AND k.point_counter = q.point_counter JOIN pcd p ON p.scan_id = q.scan_id),
knn AS (SELECT * FROM pairs WHERE dist <= far QUALIFY row_number() OVER (PARTITION BY scan_id, src ORDER BY dist, (src <> dst)::INT, dst) <= 16),
{_surface('knn')}
{_SURFACE}""",
    "surroundings": f"WITH {NEAR},\n{_surface('near')},\naround AS (SELECT q.scan_id, q.src, {', '.join('p.' + a for a in _AROUND)} FROM surface q JOIN surface p ON p.scan_id = q.scan_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= 1)\nSELECT src, count(*) AS n, "
    + ", ".join(
        f"round(CASE WHEN count(*) > 2 THEN {v} ELSE 0 END, 5) + 0.0 AS {a}_{t}"
        for a in _AROUND
        for t, v in (("mean", f"avg({a})"), ("std", f"stddev_pop({a})"), *((t, f"quantile_cont({a}::DOUBLE, {q})") for t, q in (("perc2nd", 0.02), ("perc25th", 0.25), ("perc75th", 0.75), ("perc98th", 0.98))))
    )
    + " FROM around GROUP BY scan_id, src",
    "roughness_at_radii": f"WITH {PCD}, thinned AS (SELECT * FROM pcd QUALIFY row_number() OVER (ORDER BY point_counter) % 30 = 1),\nnear AS (SELECT q.scan_id, q.point_counter AS src, q.x AS ox, q.y AS oy, q.z AS oz, p.x, p.y, p.z, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS dist FROM thinned q JOIN thinned p ON p.scan_id = q.scan_id),\n"
    + ",\n".join(
        f"cov_{i}_ AS (SELECT scan_id, src, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {_CELLS} FROM near WHERE dist < {r} GROUP BY 1, 2),\n{_axes(f'axes_{i}_', f'cov_{i}_')}"
        for i, r in enumerate(_RADII)
    )
    + "\nSELECT src, "
    + ", ".join(f"round(abs((a{i}.ox - a{i}.mx) * a{i}.nx + (a{i}.oy - a{i}.my) * a{i}.ny + (a{i}.oz - a{i}.mz) * a{i}.nz), 4) + 0.0 AS roughness_{i}" for i in range(4))
    + " FROM axes_0_ a0 " + " ".join(f"JOIN axes_{i}_ a{i} USING (scan_id, src)" for i in range(1, 4)),
    "view_vectors": f"WITH {PCD}, c AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, z - avg(z) OVER w AS dz FROM pcd WINDOW w AS (PARTITION BY scan_id)), l AS (SELECT *, nullif(sqrt(dx * dx + dy * dy + dz * dz), 0) AS r FROM c) SELECT point_counter, "
    + ", ".join(f"coalesce(round(-d{c} / r, 6), 0) + 0.0 AS v{c}" for c in "xyz")
    + " FROM l",
    "label_left_join": f"WITH {PCD}, f AS (SELECT x, y, z, arg_min(label, (point_counter, label)) AS l FROM pcd WHERE red < 128 GROUP BY 1, 2, 3) SELECT point_counter, coalesce(l, 0) AS label FROM pcd LEFT JOIN f USING (x, y, z)",
    "label_unfold": f"WITH {SHARES} SELECT point_counter, coalesce(mode_label, 0) AS predicted FROM segs LEFT JOIN (SELECT * FROM shares WHERE n > 1) USING (scan_id, segment_id)",
    "drop_class_recode": f"WITH {PCD} SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code, count(*) AS n FROM pcd WHERE label <> 2 GROUP BY label",
    "class_weights": f"WITH {PCD}, c AS (SELECT label, count(*) AS n FROM pcd GROUP BY 1) SELECT label, n, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 6) AS weight FROM c",
    "stratified_sample": f"WITH {PCD} SELECT point_counter FROM pcd QUALIFY row_number() OVER (PARTITION BY scan_id, label ORDER BY point_counter) <= 300",
    "confusion_matrix": f"WITH {CONFUSION} SELECT truth, pred, n, coalesce(round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY truth), 0), 4), 0) AS share FROM conf",
    "classification_report": f"""WITH {CONFUSION},
t AS (SELECT truth, sum(n) AS support, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS hit FROM conf GROUP BY 1),
p AS (SELECT pred, sum(n) AS named FROM conf GROUP BY 1),
s AS (SELECT truth, support, hit, coalesce(hit::DOUBLE / nullif(named, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall FROM t JOIN p ON truth = pred),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM s),
r AS (
  SELECT truth::VARCHAR AS name, precision, recall, f1, support FROM f
  UNION ALL SELECT 'accuracy', sum(hit)::DOUBLE / sum(support), sum(hit)::DOUBLE / sum(support), sum(hit)::DOUBLE / sum(support), sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(support * precision) / sum(support), sum(support * recall) / sum(support), sum(support * f1) / sum(support), sum(support) FROM f)
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM r""",
    "impurity_report": f"WITH {SHARES} SELECT scan_id, {_IMPURITY} FROM shares GROUP BY 1",
    "describe_groups": f"WITH {PCD} SELECT scan_id, label, count(rho) AS n, round(avg(rho), 6) AS mean, round(stddev_samp(rho), 6) AS std, round(min(rho), 6) AS low, round(quantile_cont(rho, 0.25), 6) AS q25, round(quantile_cont(rho, 0.5), 6) AS q50, round(quantile_cont(rho, 0.75), 6) AS q75, round(max(rho), 6) AS high FROM pcd GROUP BY 1, 2",
    "pivot_margins": """WITH t AS (SELECT l_returnflag AS name, avg(l_quantity) FILTER (l_linestatus = 'F') AS "F", avg(l_quantity) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1),
s AS (SELECT *, coalesce("F", 0) + coalesce("O", 0) AS row_sum FROM t), u AS (SELECT * FROM s UNION ALL SELECT 'total', sum("F"), sum("O"), sum(row_sum) FROM s)
SELECT name, round("F", 6) AS "F", round("O", 6) AS "O", round(row_sum, 6) AS row_sum FROM u""",
    "drop_one_importance": """WITH r AS (SELECT o_custkey, CASE WHEN starts_with(o_orderpriority, '1') THEN 'none' ELSE o_orderpriority END AS drop_col, max(o_totalprice) AS f1 FROM orders GROUP BY 1, 2),
b AS (SELECT *, max(CASE WHEN drop_col = 'none' THEN f1 END) OVER (PARTITION BY o_custkey) AS base FROM r)
SELECT drop_col, count(*) AS n, round(avg(base - f1), 2) AS importance FROM b WHERE drop_col <> 'none' GROUP BY 1""",
    "linear_fits": f"WITH {PCD} SELECT scan_id, round(regr_slope(z, x), 6) + 0.0 AS slope, round(regr_intercept(z, x), 6) AS intercept, round(regr_r2(z, x), 6) AS r2, round(corr(z, x), 6) + 0.0 AS corr FROM pcd GROUP BY 1",
    "scaled_top_runs": """WITH r AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1),
g AS (SELECT *, abs((n - min(n) OVER ())::DOUBLE / nullif(max(n) OVER () - min(n) OVER (), 0) - (mean_price - min(mean_price) OVER ()) / nullif(max(mean_price) OVER () - min(mean_price) OVER (), 0)) AS gap FROM r)
SELECT o_custkey, n, round(mean_price, 6) AS mean_price, round(gap, 6) AS gap FROM g ORDER BY g.gap, o_custkey LIMIT 15""",
    "running_point_ids": f"WITH {PCD} SELECT point_counter, row_number() OVER (ORDER BY scan_id, point_counter) - 1 AS point_id FROM pcd",
    "file_point_ids": f"WITH {PCD} SELECT point_counter, row_number() OVER (ORDER BY scan_id, point_counter) - 1 AS point_id FROM pcd",
    "stride_rows": f"WITH {LINES}, r AS (SELECT *, row_number() OVER (ORDER BY scan_id, point_counter) AS r FROM lines WHERE scanline_id IN (1, 100, 1000, 2000, 3000, 4000)) SELECT point_counter, scanline_id FROM r WHERE (r - 1) % 30 = 0",
    "threshold_sweep": f"WITH {LINES} SELECT scan_id, count(*) AS n, t.threshold, 1 + count(*) FILTER (rho_diff > t.threshold) - arg_max((rho_diff > t.threshold)::BIGINT, (scanline_id, vert_angle, point_counter)) AS segments FROM lines, (VALUES (40.0::DOUBLE), (80.0::DOUBLE), (120.0::DOUBLE)) t(threshold) GROUP BY scan_id, t.threshold",
    "segment_table": f"WITH {RAISED}, aim AS (SELECT scan_id, segment_id, {_TARGETS} FROM segs GROUP BY 1, 2), near AS (SELECT scan_id, segment_id, {_REPRESENT} FROM segs JOIN aim USING (scan_id, segment_id) GROUP BY 1, 2), "
    + f"stats AS (SELECT scan_id, segment_id, {_statistics('z', 'rho')}, "
    + ", ".join(f"round(avg({a}), 6) + 0.0 AS {a}_mean, round(var_pop({a}), 6) + 0.0 AS {a}_var, round(median({a}), 6) + 0.0 AS {a}_median" for a in ("z", "rho"))
    + " FROM means GROUP BY 1, 2) SELECT * FROM near JOIN stats USING (scan_id, segment_id) JOIN shares USING (scan_id, segment_id)",
    "centred_by_median": f"WITH {PCD}, c AS (SELECT point_counter, x - median(x) OVER w AS x, y - median(y) OVER w AS y, z - median(z) OVER w - 0.5::DOUBLE AS z FROM pcd WINDOW w AS (PARTITION BY scan_id)) SELECT point_counter, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(sqrt(x * x + y * y + z * z), 6) AS rho FROM c",
    "nearest_result_report": f"""WITH {PCD}, v AS (SELECT scan_id, floor(x / 2)::BIGINT AS vx, floor(y / 2)::BIGINT AS vy, floor(z / 2)::BIGINT AS vz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pcd GROUP BY 1, 2, 3, 4),
snapped AS (SELECT v.scan_id, vx, vy, vz, arg_min(point_counter, (round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 9), point_counter)) AS point_counter FROM v JOIN pcd p ON p.scan_id = v.scan_id GROUP BY 1, 2, 3, 4),
three AS (SELECT p.scan_id, p.point_counter, p.x, p.y, p.z, p.label, (p.label + (p.point_counter % 5 = 0)::INT) % 6 AS pred FROM snapped s JOIN pcd p USING (scan_id, point_counter)),
firsts AS (SELECT scan_id, x, y, z, min(point_counter) AS point_counter FROM pcd GROUP BY ALL),
two AS (SELECT p.label, p.pred FROM three t JOIN firsts f ON f.scan_id = t.scan_id AND f.x = t.x AND f.y = t.y AND f.z = t.z JOIN pcd p ON p.point_counter = f.point_counter),
{_report("a_", "three")},
{_report("b_", "two")}
SELECT *, '3d' AS id FROM a_report UNION ALL SELECT *, '2d' FROM b_report""",
    "inner_unfold": f"WITH {SHARES} SELECT point_counter, mode_label AS predicted FROM segs JOIN (SELECT * FROM shares WHERE n > 1) USING (scan_id, segment_id)",
    "named_labels": f"WITH {PCD} SELECT CASE label WHEN 0 THEN 'unclassified' WHEN 1 THEN 'man-made objects' WHEN 2 THEN 'ground' WHEN 3 THEN 'tree trunk/branches' WHEN 4 THEN 'leaves' WHEN 5 THEN 'low vegetation' END AS label_name, 'S' || scan_id || '_L' || label AS key, count(*) AS n FROM pcd GROUP BY 1, 2",
    "chosen_columns": f"WITH {SEGS} SELECT scan_id, segment_id, count(*) AS points, round(stddev_pop(z), 6) + 0.0 AS z_std, round(stddev_pop(rho), 6) + 0.0 AS rho_std FROM segs GROUP BY 1, 2",
    "row_weights": f"WITH {PCD} SELECT point_counter, round((SELECT count(*) FROM pcd)::DOUBLE / ((SELECT count(DISTINCT label) FROM pcd) * count(*) OVER (PARTITION BY label)), 6) AS weight FROM pcd",
    "exact_sample": f"WITH {PCD} SELECT point_counter FROM pcd QUALIFY row_number() OVER (PARTITION BY label ORDER BY point_counter DESC) <= 50",
    "random_split": f"WITH {PCD} SELECT label, CASE WHEN ('0x' || md5('42:' || point_counter)[1:8])::BIGINT::DOUBLE / 4294967296.0::DOUBLE < 0.8::DOUBLE THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(point_counter) AS first_point FROM pcd GROUP BY 1, 2",
    "fold_roles": f"WITH {PCD} SELECT fold, scan_id, CASE WHEN scan_id % 2 = fold - 1 THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM pcd, (SELECT unnest([1, 2])::BIGINT AS fold) GROUP BY ALL",
    "summed_confusions": f"WITH {PCD} SELECT label AS truth, pred, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY label), 4) AS share FROM pcd GROUP BY 1, 2",
    "confusion_files": f"WITH {CONFUSION} SELECT truth, pred, n, coalesce(round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY truth), 0), 4), 0) AS share FROM conf",
    "scan_reports": f"WITH {PCD}, " + ", ".join(f"rows{i} AS (SELECT * FROM pcd WHERE scan_id = {i}), {_report(f'r{i}_', f'rows{i}')}" for i in range(4)) + " " + " UNION ALL ".join(f"SELECT *, '{i}' AS scan_id FROM r{i}_report" for i in range(4)),
    "three_reports": f"""WITH {SHARES},
told AS (SELECT scan_id, segment_id, arg_min(pred, (-c, pred)) AS pred FROM (SELECT scan_id, segment_id, pred, count(*) AS c FROM segs GROUP BY ALL) GROUP BY ALL),
everything AS (SELECT scan_id, segment_id, mode_label AS label, told.pred FROM shares JOIN told USING (scan_id, segment_id)),
sample AS (SELECT * FROM everything QUALIFY row_number() OVER (PARTITION BY label ORDER BY scan_id, segment_id) <= 50),
points AS (SELECT s.label, t.pred FROM segs s JOIN told t USING (scan_id, segment_id)),
{_report("a_", "sample")},
{_report("b_", "everything")},
{_report("c_", "points")}
SELECT *, 'sample' AS granularity FROM a_report UNION ALL SELECT *, 'segments' FROM b_report UNION ALL SELECT *, 'points' FROM c_report""",
    "percentage_error": f"WITH {PCD} SELECT count(*) AS n, round(100 * avg(abs(pred - label)::DOUBLE / abs(label)), 6) AS mape FROM pcd WHERE label <> 0",
    "correlation_matrix": f"WITH {PCD} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM pcd" for a in ("x", "y", "z", "rho") for b in ("x", "y", "z", "rho")),
    "label_ranking": f"WITH {PCD}, m AS (SELECT label, avg(rho) AS mean FROM pcd GROUP BY 1) SELECT label, round(mean, 6) AS mean, row_number() OVER (ORDER BY mean DESC, label) AS place FROM m",
    "layout_scans": f"WITH {PCD}, s AS (SELECT count(*) AS n, round(sum(x), 3) AS x, round(sum(z), 3) AS z, round(sum(round(red / 255.0::DOUBLE, 6)), 3) AS intensity, sum(label)::BIGINT AS label FROM pcd) "
    + " UNION ALL ".join(f"SELECT '{n}' AS layout, n, x, z, {'0.0::DOUBLE' if n == 'CLASSIFIED5' else 'intensity'} AS intensity, {'0' if n == 'RAW11' else 'label'}::BIGINT AS label FROM s" for n in ("RAW11", "ALL12", "ALL22", "LABELED12", "SCANLINE15", "POINT26", "CLASSIFIED13", "CLASSIFIED5")),
    "segment_file": f"WITH {SEGS}, m AS (SELECT *, avg(z) OVER (PARTITION BY scan_id, segment_id) AS m_z, avg(rho) OVER (PARTITION BY scan_id, segment_id) AS m_rho FROM segs) SELECT scan_id, segment_id, count(*) AS n, {_statistics('z', 'rho').replace(', 6)', ', 4)')} FROM m GROUP BY 1, 2",
    "parameter_join": f"WITH {SHARES} SELECT 'SM' || (25 + scan_id) || '_CT30_NM2' AS params, sum(n)::BIGINT AS n, round(avg(gini), 6) AS gini FROM shares GROUP BY 1",
    "partner_files": f"WITH {PCD} SELECT DISTINCT '/lab/Site_A_' || scan_id || '_labelled.asc' AS path, CASE WHEN scan_id <> 3 THEN '/seg/Site_A_' || scan_id || '_b.txt' END AS partner FROM pcd",
    "classified_points": f"WITH {SHARES} SELECT point_counter, round(x, 4) AS x, label, mode_label AS predicted FROM segs JOIN shares USING (scan_id, segment_id)",
}
