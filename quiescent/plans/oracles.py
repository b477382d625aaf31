"""DuckDB SQL that returns the rows of the query of the same name."""

from __future__ import annotations

from . import queries as Q
from .recordings import SQL

#: Rows of the sample view.
E = "e AS (SELECT user_id, event_id, event_type AS channel, ts, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
#: Events with latencies in seconds.
M = "m AS (SELECT user_id, event_id, event_type AS type, epoch_us(ts) / 1e6 AS latency, value FROM events)"
#: The recursion, sample by sample.
EMA = f"""RECURSIVE {E},
r AS (SELECT user_id, i, v::DOUBLE AS mu, 0.0::DOUBLE AS s FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.i, {Q.BETA} * r.mu + {1 - Q.BETA!r} * e.v,
  {Q.BETA} * r.s + {1 - Q.BETA!r} * pow(e.v - ({Q.BETA} * r.mu + {1 - Q.BETA!r} * e.v), 2) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1),
lab AS (SELECT user_id, i, mu, s, CASE WHEN s > {Q.THRESHOLD} THEN 1 ELSE 0 END AS z FROM r),
bsr AS (SELECT *, 1 - avg(z) OVER (PARTITION BY user_id ORDER BY i ROWS {Q.WINDOW - 1} PRECEDING) AS b FROM lab)"""


def _islands(src: str, keys: str, idx: str, tol: int, name: str) -> str:
    """CTEs to ranges of ``src``: (keys, start_idx, end_idx, n)."""
    return f"""{name}_l AS (SELECT *, CASE WHEN {idx} - lag({idx}) OVER (PARTITION BY {keys} ORDER BY {idx}) > {tol} THEN 1 ELSE 0 END AS brk FROM {src}),
{name}_g AS (SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY {idx}) AS g FROM {name}_l),
{name} AS (SELECT {keys}, min({idx}) AS start_idx, max({idx}) AS end_idx, count(*) AS n FROM {name}_g GROUP BY {keys}, g)"""


EPISODES = f"""{EMA},
inb AS (SELECT user_id, i FROM bsr WHERE b > 0.5 AND b < 1),
{_islands("inb", "user_id", "i", 2, "rng")},
eps AS (SELECT * FROM rng WHERE end_idx - start_idx >= 3)"""

SPANS = """sp AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE - DATE '1970-01-01' AS a, greatest(o_orderdate::DATE - DATE '1970-01-01', max(l_shipdate)::DATE - DATE '1970-01-01') AS b
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate)"""

#: Merged ranges of large samples, which several queries cut out.
BAD = f"""{E},
hi AS (SELECT user_id, i FROM e WHERE v > 120),
{_islands("hi", "user_id", "i", 2, "bad")}"""

TRIALS = f"{E}, t AS (SELECT *, (i - 1) // 8 AS trial, (i - 1) % 8 + 1 AS t FROM e)"


def _bins(measure: str, name: str) -> str:
    return f"""WITH {TRIALS},
b AS (SELECT *, min(v) OVER (PARTITION BY user_id) AS lo, max(v) OVER (PARTITION BY user_id) AS hi FROM t),
c AS (SELECT *, CASE WHEN hi > lo THEN CAST(floor((v - lo) / (hi - lo) * 49) AS BIGINT) + 1 ELSE 1 END AS bin FROM b),
p AS (SELECT *, count(*) OVER (PARTITION BY user_id, bin) / count(*) OVER (PARTITION BY user_id) AS p FROM c),
g AS (SELECT user_id, trial, {measure} AS x FROM p GROUP BY user_id, trial),
z AS (SELECT *, (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) AS z FROM g WINDOW w AS (PARTITION BY user_id))
SELECT user_id, trial, round(x, 6) AS {name}, round(z, 6) AS z, abs(z) > 1.5 AS reject FROM z"""


def _knn(dist: str, k: int = 5, pairs: str | None = None, with_sql: str = "") -> str:
    pairs = pairs or "SELECT q.id AS qid, p.id FROM p q, p WHERE q.id % 20 = 0 AND q.id <> p.id"
    return f"""WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label FROM embeddings){with_sql},
pairs AS ({pairs}),
d AS (SELECT qid, pairs.id, {dist} AS dist FROM pairs JOIN p a ON a.id = qid JOIN p b ON b.id = pairs.id),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d)
"""


L1 = "list_sum(list_transform(range(1, len(a.vec) + 1), lambda j: abs(a.vec[j] - b.vec[j])))"
L2 = "sqrt(list_sum(list_transform(range(1, len(a.vec) + 1), lambda j: pow(a.vec[j] - b.vec[j], 2))))"
COS = "1 - list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec))"
TOP = "SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM k WHERE rank <= 5"


def _axis(m: int, tables: int, seed: int) -> str:
    return "[" + ", ".join(" || ".join(f"CASE WHEN vec[{i + 1}] >= {t!r} THEN '1' ELSE '0' END" for i, t in bits) for bits in Q.AXIS.parameters(m, tables, seed)) + "]"


def _sign(m: int, tables: int, seed: int) -> str:
    return "[" + ", ".join(" || ".join(f"CASE WHEN list_dot_product(vec, {r}::DOUBLE[]) >= 0 THEN '1' ELSE '0' END" for r in bits) for bits in Q.SIGN.parameters(m, tables, seed)) + "]"


def _probed(key: str, m: int) -> str:
    """The key and those that differ in one bit."""
    return f"[{key}" + "".join(f", substr({key}, 1, {i - 1}) || CASE substr({key}, {i}, 1) WHEN '1' THEN '0' ELSE '1' END || substr({key}, {i + 1})" for i in range(1, m + 1)) + "]"


def _lsh(keys: str, probes_of: int = 0) -> tuple[str, str]:
    """``probes_of``: the bits of a key if queries look one bit around."""
    ctes = f""", h AS (SELECT id, vec, {keys} AS ks FROM p),
hb AS (SELECT id, vec, unnest(range(len(ks))) AS tbl, unnest(ks) AS key FROM h)"""
    q = "hb"
    if probes_of:
        ctes += f", hq AS (SELECT id, tbl, unnest({_probed('key', probes_of)}) AS key FROM hb WHERE id % 20 = 0)"
        q = "hq"
    return ctes, f"SELECT DISTINCT q.id AS qid, b.id FROM {q} q JOIN hb b USING (tbl, key) WHERE q.id % 20 = 0 AND q.id <> b.id"


def _slsh() -> str:
    y = Q.LAYERS
    ctes, _ = _lsh(_axis(y.m_out, y.l_out, y.seed))
    ctes += f""", big AS (SELECT tbl, key FROM hb GROUP BY tbl, key HAVING count(*) >= {y.alpha} * (SELECT count(*) FROM p)),
inn AS (SELECT id, tbl, key, unnest(range({y.l_in})) AS it, unnest({_sign(y.m_in, y.l_in, y.seed + 1)}) AS ik FROM hb JOIN big USING (tbl, key)),
inq AS (SELECT id, tbl, key, it, unnest({_probed('ik', y.m_in)}) AS ik FROM inn WHERE id % 20 = 0)"""
    pairs = """SELECT q.id AS qid, b.id FROM hb q JOIN hb b ON q.tbl = b.tbl AND q.key = b.key WHERE (q.tbl, q.key) NOT IN (SELECT tbl, key FROM big) AND q.id % 20 = 0 AND q.id <> b.id
UNION SELECT q.id, b.id FROM inq q JOIN inn b USING (tbl, key, it, ik) WHERE q.id <> b.id"""
    return _knn(L1, 5, pairs, ctes) + TOP


SEG = "s AS (SELECT label, vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)"
XCORR = f"""WITH {SEG},
pr AS (SELECT a.label, a.id AS a, b.id AS b, a.x AS xa, b.x AS xb FROM s a JOIN s b ON a.label = b.label AND a.id < b.id),
lg AS (SELECT label, a, b, xa, xb, unnest(range(1 - len(xb), len(xa))) AS lag FROM pr),
cc AS (SELECT label, a, b, xa, xb, list_sum(list_transform(range(1, len(xb) + 1), lambda j: CASE WHEN j + lag BETWEEN 1 AND len(xa) THEN xa[j + lag] * xb[j] ELSE 0 END)) AS r FROM lg),
mx AS (SELECT label, a, b, max(r) AS r, any_value(sqrt(list_dot_product(xa, xa) * list_dot_product(xb, xb))) AS nn FROM cc GROUP BY label, a, b)
"""

HALF = f"""{E}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e),
h AS (SELECT channel, user_id, avg(v) FILTER (i * 2 <= n) AS a, avg(v) FILTER (i * 2 > n) AS b FROM n GROUP BY channel, user_id)"""

PVAL = f"{E}, g AS (SELECT user_id, avg(v) AS m FROM e GROUP BY user_id), p AS (SELECT user_id, pow(rank() OVER (ORDER BY m DESC) / count(*) OVER (), 3) AS p FROM g)"


def _fdr(q: float, by: bool) -> str:
    c = "(SELECT sum(1.0 / k) FROM range(1, (SELECT count(*) FROM p) + 1) t(k))" if by else "1.0"
    return f"""WITH {PVAL}, o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p)
SELECT user_id, round(p, 6) AS p, coalesce(p <= (SELECT max(p) FROM o WHERE p <= i / m * {q} / {c}), false) AS significant FROM o"""


SURR = f"""{E}, s AS (SELECT event_id, channel, v FROM e WHERE channel IN ('click', 'view')),
x AS (SELECT s.*, replicate, row_number() OVER (PARTITION BY replicate ORDER BY event_id) AS k,
  row_number() OVER (PARTITION BY replicate ORDER BY md5(event_id || '|' || replicate)) AS kp FROM s, range(1, 21) r(replicate)),
pm AS (SELECT a.replicate, a.v, b.channel FROM x a JOIN x b ON a.replicate = b.replicate AND a.k = b.kp),
su AS (SELECT replicate, avg(v) FILTER (channel = 'click') - avg(v) FILTER (channel = 'view') AS surrogate FROM pm GROUP BY replicate),
ob AS (SELECT avg(v) FILTER (channel = 'click') - avg(v) FILTER (channel = 'view') AS observed FROM s)"""


def _t(equal: bool) -> str:
    se = "((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)" if equal else "v1 / n1 + v2 / n2"
    df = "n1 + n2 - 2" if equal else "pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))"
    return f"""WITH {E}, g AS (SELECT user_id, count(v) FILTER (channel = 'click') AS n1, count(v) FILTER (channel = 'view') AS n2, avg(v) FILTER (channel = 'click') AS m1, avg(v) FILTER (channel = 'view') AS m2,
 var_samp(v) FILTER (channel = 'click') AS v1, var_samp(v) FILTER (channel = 'view') AS v2 FROM e WHERE channel IN ('click', 'view') GROUP BY user_id)
SELECT user_id, round((m1 - m2) / nullif(sqrt({se}), 0), 6) AS t, round(CAST({df} AS DOUBLE), 6) AS df FROM g WHERE n1 > 1 AND n2 > 1"""


CHAN = f"{E}, c AS (SELECT user_id, channel, avg(v) AS v FROM e GROUP BY user_id, channel)"

ORACLES: dict[str, str] = {
    "bsr_episodes": f"WITH {EPISODES} SELECT user_id, start_idx, end_idx, n FROM eps",
    "aligned_events": f"""WITH {TRIALS}, m AS (SELECT user_id, t, avg(v) AS m FROM t GROUP BY user_id, t),
s AS (SELECT t.user_id, t.trial, lag, coalesce(round(sum(t.v * m.m), 9), 0) AS s FROM t CROSS JOIN (SELECT unnest(range(-2, 3)) AS lag) LEFT JOIN m ON m.user_id = t.user_id AND m.t = t.t - lag GROUP BY t.user_id, t.trial, lag)
SELECT user_id, trial, CAST(lag AS INTEGER) AS lag FROM s QUALIFY row_number() OVER (PARTITION BY user_id, trial ORDER BY s DESC, abs(lag), lag) = 1""",
    "vector_covariance": """WITH v AS (SELECT vec_id AS id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM v)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, count(*) AS n, round(sum(a.x * b.x) / (count(*) - 1), 6) AS cov FROM c a JOIN c b ON a.id = b.id AND a.i <= b.i GROUP BY a.i, b.i""",
    "late_ema": f"WITH {EMA} SELECT user_id, i, round(mu, 6) AS mu, round(s, 6) AS variance FROM r",
    "ema_variance": f"WITH {EMA} SELECT user_id, i, round(mu, 6) AS mu, round(s, 6) AS variance FROM r",
    "ema_variance_fold": f"WITH {EMA} SELECT user_id, i, round(s, 6) AS variance FROM r",
    "suppression_ratio": f"""WITH {E}, z AS (SELECT *, CASE WHEN v > 40 THEN 1 ELSE 0 END AS z, CASE WHEN v > 250 THEN 1 ELSE 0 END AS art FROM e)
SELECT user_id, i, CASE WHEN sum(art) OVER w = 0 THEN round(1 - avg(z) OVER w, 6) END AS bsr FROM z WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS 9 PRECEDING)""",
    "index_ranges": f"WITH {E}, h AS (SELECT user_id, i FROM e WHERE v > 40), {_islands('h', 'user_id', 'i', 2, 'r')} SELECT * FROM r",
    "bucketed_ranges": f"WITH {E}, h AS (SELECT user_id, i FROM e WHERE v > 40), {_islands('h', 'user_id', 'i', 2, 'r')} SELECT e.user_id, e.i, start_idx, round(v, 6) AS v FROM e JOIN r ON r.user_id = e.user_id AND e.i BETWEEN start_idx AND end_idx",
    "ranges_by_table_function": f"WITH {E}, h AS (SELECT user_id, i FROM e WHERE v > 40), {_islands('h', 'user_id', 'i', 2, 'r')} SELECT * FROM r",
    "short_quiet_relabelled": f"""WITH {E}, z AS (SELECT user_id, i, CASE WHEN v > 40 THEN 1 ELSE 0 END AS z FROM e),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, z ORDER BY i) AS g FROM z)
SELECT user_id, i, CASE WHEN z = 0 AND count(*) OVER (PARTITION BY user_id, z, g) < 3 THEN 1 ELSE z END AS z FROM g""",
    "channel_vote": f"""WITH {E}, c AS (SELECT date_trunc('hour', ts) AS h, channel, CASE WHEN max(v) > 100 THEN 1 ELSE 0 END AS z FROM e GROUP BY ALL)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, count(z) AS valid, CASE WHEN count(z) >= 3 THEN CASE WHEN sum(z) >= ceil(count(z) * 0.6) THEN 1 ELSE 0 END END AS z FROM c GROUP BY h""",
    "artifact_chunks": f"""WITH {E}, c AS (SELECT user_id, channel, (i - 1) // 10 AS chunk, max(abs(v)) AS p, stddev_samp(v) AS sd FROM e GROUP BY ALL)
SELECT user_id, chunk, bool_or(p > 200 OR coalesce(sd < 1e-4, false)) AS is_artifact FROM c GROUP BY user_id, chunk""",
    "artifact_union": f"""WITH {E}, c AS (SELECT user_id, (i - 1) // 5 + 1 AS epoch, max(v) > 200 OR min(v) < 1 AS d FROM e GROUP BY ALL)
SELECT user_id, (epoch - 1) // 4 AS block, round(avg(d::INT), 6) AS dirty FROM c GROUP BY ALL""",
    "burst_in_episode": f"""WITH {EPISODES}, pin AS (SELECT l.user_id, l.i, e.start_idx AS episode_start, e.end_idx AS episode_end FROM bsr l JOIN eps e ON l.user_id = e.user_id AND l.i BETWEEN e.start_idx AND e.end_idx WHERE l.z = 1),
{_islands("pin", "user_id, episode_start, episode_end", "i", 2, "bu")} SELECT * FROM bu""",
    "point_in_range": f"""WITH {E}, h AS (SELECT user_id, i FROM e WHERE channel = 'click'), {_islands("h", "user_id", "i", 3, "r")}
SELECT e.user_id, e.event_id, e.i, r.start_idx, r.end_idx FROM e JOIN r ON e.user_id = r.user_id AND e.i BETWEEN r.start_idx AND r.end_idx""",
    "merge_regions": f"""WITH {SPANS}, o AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM sp),
g AS (SELECT *, sum(CASE WHEN a > pb + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, b) AS g FROM o)
SELECT o_custkey, CAST(min(a) AS INT) AS a, CAST(max(b) AS INT) AS b, count(*) AS n FROM g GROUP BY o_custkey, g""",
    "redundant_ranges": f"""WITH {SPANS} SELECT x.o_custkey, x.o_orderkey, CAST(x.a AS INT) AS a, CAST(x.b AS INT) AS b FROM sp x WHERE EXISTS (SELECT 1 FROM sp y WHERE y.o_custkey = x.o_custkey AND y.o_orderkey <> x.o_orderkey
 AND y.a <= x.a AND y.b >= x.b AND (y.a < x.a OR y.b > x.b OR y.o_orderkey < x.o_orderkey))""",
    "redundant_ranges_mutual": f"""WITH {SPANS} SELECT x.o_custkey, x.o_orderkey, CAST(x.a AS INT) AS a, CAST(x.b AS INT) AS b FROM sp x WHERE EXISTS (SELECT 1 FROM sp y WHERE y.o_custkey = x.o_custkey AND y.o_orderkey <> x.o_orderkey
 AND y.a <= x.a AND y.b >= x.b)""",
    "excised_samples": f"""WITH {BAD}, k AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.user_id = e.user_id AND e.i BETWEEN b.start_idx AND b.end_idx))
SELECT user_id, event_id, i AS old_i, row_number() OVER (PARTITION BY user_id ORDER BY i) AS i FROM k""",
    "shifted_events": f"""WITH {BAD}, k AS (SELECT e.user_id, e.channel AS type, e.i, coalesce((SELECT sum(b.end_idx - b.start_idx + 1) FROM bad b WHERE b.user_id = e.user_id AND b.start_idx <= e.i), 0) AS gone FROM e
 WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.user_id = e.user_id AND e.i BETWEEN b.start_idx AND b.end_idx))
SELECT user_id, type, CAST(i - gone AS DOUBLE) AS latency, 0.0::DOUBLE AS duration FROM k
UNION ALL SELECT user_id, 'boundary', CAST(start_idx - 1 - coalesce(sum(end_idx - start_idx + 1) OVER (PARTITION BY user_id ORDER BY start_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 AS DOUBLE), CAST(end_idx - start_idx + 1 AS DOUBLE) FROM bad""",
    "kept_around_events": f"WITH {E} SELECT user_id, i, event_id FROM e WHERE EXISTS (SELECT 1 FROM e x WHERE x.user_id = e.user_id AND x.v > 150 AND e.i BETWEEN x.i - 2 AND x.i + 3)",
    "removed_around_events": f"WITH {E} SELECT user_id, i, event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = e.user_id AND x.v > 150 AND e.i BETWEEN x.i - 2 AND x.i + 3)",
    "hour_grid_flags": f"""WITH {E}, t0 AS (SELECT user_id, min(ts) AS t0 FROM e GROUP BY user_id), g AS (SELECT user_id, unnest(range(24)) AS hour FROM t0),
b AS (SELECT e.user_id, CAST(floor((epoch_us(ts) - epoch_us(t0)) / 1e6 / 3600) AS INT) AS hour, count(*) AS n FROM e JOIN t0 USING (user_id) WHERE v > 100 GROUP BY ALL)
SELECT user_id, CAST(hour AS INT) AS hour, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 1 ELSE 0 END AS flag FROM g LEFT JOIN b USING (user_id, hour)""",
    "top_n_per_hour": f"""WITH {E}, h AS (SELECT event_id, CAST(floor(epoch_us(ts) / 3600e6) AS INT) AS hour, ts FROM e), r AS (SELECT hour, event_id, row_number() OVER (PARTITION BY hour ORDER BY ts, event_id) AS rank FROM h)
SELECT hour, event_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""",
    "timeline_72h": """WITH o AS (SELECT o_custkey AS sid, o_orderkey AS name, CAST(round((epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey)) / 1e6 * 0.01) AS BIGINT) AS s, CAST(trunc(o_totalprice) AS BIGINT) AS n FROM orders)
SELECT sid, name, s AS start, least(s + n, 315360) AS "end" FROM o WHERE s < 315360""",
    "merged_timeline": f"""WITH {E}, d AS (SELECT user_id, (i - 1) // 20 * 15 + (i - 1) % 20 + 1 AS pos, (i - 1) // 20 AS seg, v FROM e),
t AS (SELECT user_id, pos, arg_max(v, seg) AS v FROM d GROUP BY ALL), g AS (SELECT user_id, unnest(range(1, max(pos) + 1)) AS i FROM d GROUP BY user_id)
SELECT g.user_id, g.i, coalesce(t.v, 0) AS v FROM g LEFT JOIN t ON t.user_id = g.user_id AND t.pos = g.i""",
    "segment_order": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS by_time, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS by_name FROM orders",
    "remaining_work": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "outcome_lookup": "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "offset_fallback": "SELECT c_custkey AS k, coalesce(s_acctbal, p_retailprice, 0) AS v FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN part ON p_partkey = c_custkey",
    "recording_durations": f"WITH {E} SELECT user_id AS rec_id, max(i) AS n_samples, count(DISTINCT channel) AS n_channels, max(i) / 200.0 AS seconds FROM e GROUP BY user_id",
    "moving_average": f"WITH {E} SELECT user_id, i, round(avg(v) OVER (PARTITION BY user_id ORDER BY i RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS avg FROM e",
    "last_known": f"WITH {E} SELECT user_id, i, last_value(CASE WHEN v < 80 THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS filled FROM e",
    "regular_epochs": f"WITH {E}, x AS (SELECT user_id, v, i, unnest(range(greatest(0, CAST(floor((i - 21) / 10) AS BIGINT) + 1), (i - 1) // 10 + 1)) AS k FROM e) SELECT user_id, k + 1 AS epoch, count(*) AS n, round(avg(v), 6) AS mean FROM x WHERE i - k * 10 <= 20 GROUP BY user_id, k",
    "prev_event_delay": f"""WITH {M}, d AS (SELECT *, latency - last_value(CASE WHEN type IN ('click', 'view') THEN latency END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY latency, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delay FROM m)
SELECT user_id, event_id, round(delay, 6) AS delay FROM d WHERE type = 'purchase'""",
    "event_context": f"""WITH {M}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY latency, event_id) AS k FROM m WHERE type = 'click'),
t AS (SELECT *, (SELECT count(*) FROM n WHERE n.user_id = m.user_id AND (n.latency, n.event_id) < (m.latency, m.event_id)) AS b FROM m WHERE type = 'purchase'),
x AS (SELECT *, unnest([-2, -1, 1]) AS position FROM t)
SELECT x.user_id, x.event_id AS target_id, position, n.event_id AS neighbour_id FROM x LEFT JOIN n ON n.user_id = x.user_id AND n.k = CASE WHEN position < 0 THEN b + position + 1 ELSE b + position END""",
    "select_events": "SELECT event_id, event_type AS type, value FROM events WHERE event_type IN ('click', 'purchase') AND value BETWEEN 10 AND 60 AND user_id NOT IN (1, 2, 3)",
    "rename_events": "SELECT CASE WHEN value BETWEEN 100 AND 1e9 THEN 'large' ELSE event_type END AS type, count(*) AS n FROM events GROUP BY 1",
    "event_type_counts": "SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1",
    "event_epoch_counts": "SELECT user_id, event_type AS type, count(*) AS n_events, count(DISTINCT epoch_us(ts) // 86400000000) AS n_epochs FROM events GROUP BY 1, 2",
    "event_hist": """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events), x AS (SELECT value, m - 2 * sd AS lo, 4 * sd / 20 AS step FROM events, s),
b AS (SELECT CAST(greatest(0, least(19, floor((value - lo) / step))) AS INT) AS bin, lo, step FROM x) SELECT bin, round(min(lo + bin * step), 6) AS lo, count(*) AS n FROM b GROUP BY bin""",
    "edge_events": f"""WITH {E}, a AS (SELECT user_id, i, CASE WHEN v > 60 THEN 1 ELSE 0 END AS g FROM e), d AS (SELECT *, g - lag(g) OVER w AS s FROM a WINDOW w AS (PARTITION BY user_id ORDER BY i)),
x AS (SELECT user_id, i, s, lead(CASE WHEN s < 0 THEN i END) OVER w AS nx, i - lag(i) OVER w AS gap FROM d WHERE s <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, 'chan1' AS type, CAST(i AS DOUBLE) AS latency, CASE WHEN s > 0 THEN CAST(nx - i AS DOUBLE) END AS duration, CASE WHEN s > 0 THEN 'leading' ELSE 'trailing' END AS edge FROM x WHERE gap IS NULL OR gap >= 2""",
    "event_locked_epochs": f"""WITH {E}, j AS (SELECT t.event_id AS ep, s.i - t.i AS t, s.v FROM e t JOIN e s ON s.user_id = t.user_id AND s.i BETWEEN t.i - 3 AND t.i + 4 WHERE t.v > 150),
f AS (SELECT *, count(*) OVER (PARTITION BY ep) AS n FROM j), b AS (SELECT t, v - avg(CASE WHEN t BETWEEN -3 AND -1 THEN v END) OVER (PARTITION BY ep) AS v FROM f WHERE n = 8)
SELECT CAST(t AS INT) AS t, count(*) AS n, round(avg(v), 6) AS erp, round(stddev_samp(v), 6) AS sd FROM b GROUP BY t""",
    "epoch_events": f"WITH {M} SELECT a.user_id, a.event_id AS epoch, b.event_id, round(b.latency - a.latency, 6) AS rel FROM m a JOIN m b ON a.user_id = b.user_id AND b.latency - a.latency BETWEEN -3600 AND 7200 WHERE a.type = 'purchase'",
    "original_latency": f"WITH {E} SELECT event_id, CAST(i + coalesce(sum(CASE WHEN v > 120 THEN floor(v) ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i), 0) AS DOUBLE) AS ur_latency FROM e",
    "epoch_moments": f"""WITH {TRIALS}, c AS (SELECT user_id, trial, v, avg(v) OVER (PARTITION BY user_id, trial) AS m FROM t),
g AS (SELECT user_id, trial, count(*) AS n, var_samp(v) AS variance, avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4 FROM c GROUP BY ALL)
SELECT user_id, trial, n, round(variance, 9) + 0.0 AS variance, round(CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) END, 9) + 0.0 AS skew, round(CASE WHEN m2 > 0 THEN m4 / (m2 * m2) END, 9) + 0.0 AS kurt FROM g""",
    "population_outliers": f"""WITH {TRIALS}, g AS (SELECT user_id, trial, var_samp(v) AS x FROM t GROUP BY ALL), f AS (SELECT * FROM g WHERE x IS NOT NULL), p AS (SELECT avg(x) AS m, stddev_samp(x) AS sd FROM f WHERE x <> 0)
SELECT user_id, trial, abs(x - m) > 2 * sd OR x < 1e-3 AS outlier FROM f, p""",
    "band_power_outliers": f"WITH {TRIALS}, g AS (SELECT user_id, trial, sum(v * v) AS x FROM t GROUP BY ALL) SELECT user_id, trial, x < 0.1 * (SELECT avg(x) FROM g) OR x > 3 * (SELECT avg(x) FROM g) AS outlier FROM g",
    "threshold_reject": f"WITH {TRIALS} SELECT user_id, trial, min(v) AS lo, max(v) AS hi, min(v) < 0.5 OR max(v) > 150 AS reject FROM t GROUP BY ALL",
    "joint_prob_reject": _bins("-sum(ln(p))", "jp"),
    "entropy_reject": _bins("-sum(p * ln(p))", "entropy"),
    "kurtosis_reject": f"""WITH {TRIALS}, c AS (SELECT user_id, trial, v, avg(v) OVER (PARTITION BY user_id, trial) AS m FROM t),
g AS (SELECT user_id, trial, avg(pow(v - m, 4)) / pow(var_samp(v), 2) - 3 AS x FROM c GROUP BY user_id, trial HAVING count(*) > 1),
z AS (SELECT *, (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) AS z FROM g WINDOW w AS (PARTITION BY user_id))
SELECT user_id, trial, round(x, 6) AS kurt, round(z, 6) AS z, abs(z) > 1.5 AS reject FROM z""",
    "trend_reject": f"""WITH {TRIALS}, w AS (SELECT user_id, trial, k, t - k AS x, v FROM t, range(4) r(k) WHERE t - k BETWEEN 1 AND 5),
g AS (SELECT user_id, trial, k, regr_slope(v, x) AS s, coalesce(regr_r2(v, x), 0) AS r2, var_pop(v) * 5 AS sst FROM w GROUP BY ALL HAVING count(*) = 5)
SELECT user_id, trial, round(max(abs(s)), 6) AS max_slope, bool_or(abs(s * 5) >= 80 AND 1 - sst * (1 - r2) / greatest(sst, 5 * 1000 * 1.1921e-07) > 0.5) AS reject FROM g GROUP BY ALL""",
    "robust_zscore": f"""WITH {E}, q AS (SELECT user_id, quantile_cont(v, 0.5) AS md, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM e GROUP BY user_id)
SELECT event_id, round((v - md) / nullif(iqr * 0.7413, 0), 6) AS z FROM e JOIN q USING (user_id)""",
    "median_abs_deviation": f"""WITH {E}, q AS (SELECT user_id, quantile_cont(v, 0.5) AS md FROM e GROUP BY user_id)
SELECT user_id, round(any_value(md), 6) AS med, round(quantile_cont(abs(v - md), 0.5), 6) AS mad FROM e JOIN q USING (user_id) GROUP BY user_id""",
    "quality_issues": f"""WITH {E}, g AS (SELECT user_id, list_filter([CASE WHEN count(*) < 65 THEN 'few' END, CASE WHEN max(v) > 300 THEN 'peak' END, CASE WHEN avg(v) > 55 THEN 'high' END], lambda x: x IS NOT NULL) AS l FROM e GROUP BY user_id)
SELECT user_id, array_to_string(l, ',') AS issues FROM g WHERE len(l) > 0""",
    "average_reference": f"WITH {CHAN} SELECT user_id, channel, round(CASE WHEN channel <> 'error' THEN v - avg(CASE WHEN channel <> 'error' THEN v END) OVER (PARTITION BY user_id) ELSE v END, 9) AS v FROM c",
    "common_reference": f"WITH {CHAN}, d AS (SELECT user_id, channel, v - avg(CASE WHEN channel IN ('click', 'view') THEN v END) OVER (PARTITION BY user_id) AS v FROM c) SELECT user_id, channel, round(v, 6) AS v FROM d WHERE channel NOT IN ('click', 'view')",
    "baseline_removed": f"WITH {TRIALS} SELECT event_id, round(v - avg(CASE WHEN t BETWEEN 1 AND 3 THEN v END) OVER (PARTITION BY user_id, trial), 6) AS v FROM t",
    "bipolar_montage": f"""WITH {CHAN}, w AS (SELECT user_id, max(CASE WHEN channel = 'click' THEN v END) AS a, max(CASE WHEN channel = 'view' THEN v END) AS b, max(CASE WHEN channel = 'purchase' THEN v END) AS d FROM c GROUP BY user_id)
SELECT user_id, 'click-view' AS channel, round(a - b, 6) AS v FROM w UNION ALL SELECT user_id, 'view-purchase', round(b - d, 6) FROM w""",
    "channel_envelope": f"WITH {TRIALS} SELECT user_id, t, max(v) AS upper, min(v) AS lower FROM t GROUP BY ALL",
    "standardized": f"WITH {E} SELECT event_id, round((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 6) AS z FROM e WINDOW w AS (PARTITION BY user_id)",
    "hazen_quantiles": """WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem),
p AS (SELECT *, unnest([0.05::DOUBLE, 0.25, 0.5, 0.9]) AS p FROM r), a AS (SELECT *, greatest(1, least(n, p * n + 0.5)) AS pos FROM p)
SELECT l_returnflag, l_linestatus, p, round(arg_min(v, r) + (arg_max(v, r) - arg_min(v, r)) * (any_value(pos) - floor(any_value(pos))), 6) AS q FROM a WHERE r = floor(pos) OR r = ceil(pos) GROUP BY l_returnflag, l_linestatus, p""",
    "median_ci": f"""WITH {E}, s AS (SELECT channel, list_sort(list(v)) AS l, count(*) AS n, median(v) AS md FROM e GROUP BY channel)
SELECT channel, round(md, 6) AS median, round(l[greatest(0, CAST(floor((n - 1.96 * sqrt(n)) / 2) AS BIGINT)) + 1], 6) AS lo, round(l[least(n - 1, CAST(ceil(1 + (n + 1.96 * sqrt(n)) / 2) AS BIGINT)) + 1], 6) AS hi, n FROM s""",
    "signal_stats": f"""WITH {E}, q AS (SELECT channel, quantile_cont(v, 0.05) AS p1, quantile_cont(v, 0.95) AS p2, avg(v) AS m FROM e GROUP BY channel), j AS (SELECT * FROM e JOIN q USING (channel))
SELECT channel, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5), 6) AS skew, round(avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2), 6) AS kurt,
 round(min(v), 6) AS lo, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS hi, round(avg(v) FILTER (v BETWEEN p1 AND p2), 6) AS trimmed_mean FROM j GROUP BY channel""",
    "rms_and_peak": f"WITH {E} SELECT user_id, round(sqrt(avg(v * v)), 6) AS rms, round(arg_max(v, abs(v)), 6) AS peak FROM e GROUP BY user_id",
    "amplitude_area": f"WITH {E}, n AS (SELECT user_id, (v + lead(v) OVER (PARTITION BY user_id ORDER BY i)) / 2 AS a FROM e WHERE i BETWEEN 5 AND 20) SELECT user_id, round(sum(a), 6) AS area FROM n GROUP BY user_id",
    "covariance": "SELECT l_returnflag, round(covar_samp(l_extendedprice, l_quantity), 3) AS cov, round(var_samp(l_quantity), 6) AS var_x, round(var_samp(l_extendedprice), 1) AS var_y, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY l_returnflag",
    "regression": f"WITH {E} SELECT user_id, round(regr_slope(v, i), 6) AS slope, round(regr_intercept(v, i), 6) AS intercept, round(regr_r2(v, i), 6) AS r2, CAST(regr_count(v, i) AS BIGINT) AS n FROM e GROUP BY user_id",
    "paired_t": f"WITH {HALF} SELECT channel, round(avg(a - b) / stddev_samp(a - b) * sqrt(count(a - b)), 6) AS t, count(a - b) - 1 AS df FROM h GROUP BY channel",
    "unpaired_t": _t(True),
    "welch_t": _t(False),
    "anova1": f"""WITH {E}, g AS (SELECT user_id, channel, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM e GROUP BY ALL), t AS (SELECT user_id, count(*) AS k, sum(n) AS nn, sum(n * m) / sum(n) AS gm, sum(n * s) AS ssw, sum(n * m * m) AS s2 FROM g GROUP BY user_id)
SELECT user_id, round(((s2 - nn * gm * gm) / (k - 1)) / nullif(ssw / (nn - k), 0), 6) AS f, k - 1 AS df1, CAST(nn - k AS BIGINT) AS df2 FROM t WHERE k > 1 AND nn > k""",
    "anova1_repeated": f"""WITH {CHAN}, k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k FROM c), f AS (SELECT user_id, channel, v, avg(v) OVER (PARTITION BY user_id) AS ms, avg(v) OVER (PARTITION BY channel) AS mc, avg(v) OVER () AS gm FROM k WHERE k = 5),
s AS (SELECT sum(pow(mc - gm, 2)) AS ssc, sum(pow(v - ms - mc + gm, 2)) AS sse, count(DISTINCT user_id) AS n, count(DISTINCT channel) AS c FROM f)
SELECT round((ssc / (c - 1)) / (sse / ((c - 1) * (n - 1))), 6) AS f, c - 1 AS df1, (c - 1) * (n - 1) AS df2 FROM s""",
    "anova2": """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY ALL),
d AS (SELECT *, sum(n * m) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a) AS ma, sum(n * m) OVER (PARTITION BY b) / sum(n) OVER (PARTITION BY b) AS mb, sum(n * m) OVER () / sum(n) OVER () AS gm FROM c),
s AS (SELECT sum(n * pow(ma - gm, 2)) AS r, sum(n * pow(mb - gm, 2)) AS cc, sum(n * pow(m - ma - mb + gm, 2)) AS i, sum(n * v) AS e, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb, sum(n) AS n FROM d),
x AS (SELECT 'rows' AS effect, r AS ss, ka - 1 AS df, * FROM s UNION ALL SELECT 'columns', cc, kb - 1, * FROM s UNION ALL SELECT 'interaction', i, (ka - 1) * (kb - 1), * FROM s)
SELECT effect, round(ss, 3) AS ss, df, round((ss / df) / (e / (n - ka * kb)), 4) AS f FROM x""",
    "rank_sum": f"""WITH {E}, d AS (SELECT user_id, channel, round(v) AS v FROM e WHERE channel IN ('click', 'view')),
r AS (SELECT user_id, channel, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2 AS r, pow(count(*) OVER (PARTITION BY user_id, v), 2) - 1 AS t FROM d),
g AS (SELECT user_id, sum(r) FILTER (channel = 'click') AS w, count(*) FILTER (channel = 'click') AS a, count(*) FILTER (channel = 'view') AS b, sum(t) AS t FROM r GROUP BY user_id)
SELECT user_id, round(w, 6) AS w, round((w - a * (a + b + 1) / 2) / nullif(sqrt(a * b / 12 * ((a + b + 1) - t / ((a + b) * (a + b - 1)))), 0), 6) AS z FROM g WHERE a > 0 AND b > 0""",
    "fdr_bh": _fdr(0.05, False),
    "fdr_by": _fdr(0.2, True),
    "permutation_differences": f"WITH {SURR} SELECT CAST(replicate AS INT) AS replicate, round(surrogate, 6) AS surrogate, round(observed, 6) AS observed FROM su, ob",
    "surrogate_pvalue": f"""WITH {SURR}, g AS (SELECT count(*) FILTER (surrogate <= observed) + 1 AS r, count(*) + 1 AS n FROM su, ob)
SELECT round(2 * least(1 - (r - 0.5) / n, (r - 0.5) / n), 6) AS p FROM g""",
    "surrogate_ci": f"WITH {SURR}, l AS (SELECT list_sort(list(surrogate)) AS l FROM su) SELECT round(l[3], 6) AS lo, round(l[18], 6) AS hi FROM l",
    "deterministic_split": """WITH u AS (SELECT c_custkey, CAST('0x' || substr(md5(c_custkey || '|0'), 1, 8) AS BIGINT) / 4294967296 AS u FROM customer)
SELECT c_custkey, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'dev' ELSE 'test' END AS part FROM u""",
    "sampled_queries": """WITH o AS (SELECT doc_id, toxic, md5(doc_id || '|0') AS h FROM labels), p AS (SELECT doc_id, toxic FROM o WHERE toxic = 1 ORDER BY h, doc_id LIMIT 20),
r AS (SELECT doc_id, toxic FROM o WHERE doc_id NOT IN (SELECT doc_id FROM p) ORDER BY h, doc_id LIMIT 30) SELECT * FROM p UNION ALL SELECT * FROM r""",
    "evoked_by_channel": f"WITH {TRIALS} SELECT channel, t, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(v) AS n FROM t GROUP BY ALL",
    "grand_average": f"WITH {TRIALS}, o AS (SELECT user_id, t, avg(v) AS m FROM t GROUP BY ALL) SELECT t, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(*) AS n FROM o GROUP BY t",
    "condition_comparison": f"""WITH {TRIALS}, o AS (SELECT user_id, t, avg(v) FILTER (channel = 'click') AS a, avg(v) FILTER (channel = 'view') AS b FROM t WHERE channel IN ('click', 'view') GROUP BY ALL)
SELECT t, round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b, round(avg(a - b), 9) AS difference, round(stddev_samp(a - b), 9) AS sd, round(avg(a - b) / nullif(stddev_samp(a - b), 0) * sqrt(count(a - b)), 9) AS t_stat, count(a - b) AS n FROM o GROUP BY t""",
    "block_average": f"WITH {E}, d AS (SELECT user_id, (i - 1) // 8 + 1 AS ep, (i - 1) % 8 + 1 AS t, v FROM e) SELECT user_id, t, round(sum(ep * 0.5 * v) / sum(ep * 0.5), 6) AS v FROM d GROUP BY ALL",
    "event_correlation": f"WITH {TRIALS}, p AS (SELECT *, max(v) OVER (PARTITION BY user_id, trial) AS peak FROM t) SELECT channel, t, round(corr(peak, v), 6) AS r, count(*) AS n FROM p GROUP BY ALL",
    "components_by_variance": f"WITH {E}, g AS (SELECT user_id, channel, var_samp(v) AS x FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x DESC NULLS LAST, channel) AS k FROM g) SELECT user_id, channel, round(x, 6) AS variance, CAST(k AS INT) AS rank FROM r WHERE x IS NOT NULL",
    "slowest_worker": f"WITH {E}, g AS (SELECT user_id, max(v) AS t, count(DISTINCT channel) AS w FROM e GROUP BY user_id) SELECT round(quantile_cont(t, 0.5), 6) AS median, max(w) AS workers, count(*) AS n FROM g",
    "knn_l1": _knn(L1) + TOP,
    "knn_euclidean": _knn(L2) + TOP,
    "knn_cosine": _knn(COS) + TOP,
    "lsh_knn": _knn(L1, 5, *reversed(_lsh(_axis(6, 8, 7)))) + TOP,
    "lsh_cosine_knn": _knn(COS, 5, *reversed(_lsh(_sign(*Q.COSINE[:2], 7), Q.COSINE[0]))) + TOP,
    "slsh_knn": _slsh(),
    "indexed_knn": _slsh(),
    "streamed_knn": _slsh(),
    "heavy_buckets": "WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)" + _lsh(_axis(6, 8, 7))[0] + " SELECT tbl, key, count(*) AS n FROM hb GROUP BY tbl, key HAVING count(*) >= 0.02 * (SELECT count(*) FROM p)",
    "candidate_counts": "WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)" + _lsh(_axis(6, 8, 7))[0] + ", c AS (" + _lsh(_axis(6, 8, 7))[1] + ") SELECT qid, count(*) AS comparisons FROM c GROUP BY qid",
    "knn_vote": _knn(L1) + "SELECT qid, CASE WHEN sum(CASE WHEN label = 1 THEN 5 ELSE 0 END) >= sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS pred FROM k JOIN p USING (id) WHERE rank <= 5 GROUP BY qid",
    "accuracy_recall_mcc": _knn(L1) + """, vt AS (SELECT qid, CASE WHEN sum(CASE WHEN label = 1 THEN 5 ELSE 0 END) >= sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS pred FROM k JOIN p USING (id) WHERE rank <= 5 GROUP BY qid),
c AS (SELECT count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn FROM vt JOIN p ON p.id = vt.qid),
n AS (SELECT *, sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS den FROM c)
SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE -2.0 END AS recall, CASE WHEN den > 0 THEN round((tp * tn - fp * fn) / den, 6) ELSE -2.0 END AS mcc FROM n""",
    "vector_norms": "WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT id, round(list_dot_product(v, v), 6) AS norm2, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM p",
    "pair_similarity_raw": XCORR + "SELECT label, a, b, round(r, 6) AS sim FROM mx",
    "pair_similarity_coeff": XCORR + "SELECT label, a, b, round(r / nn, 6) AS sim FROM mx",
    "normalized_segments": f"""WITH {SEG}, f AS (SELECT id, x, list_avg(x) AS m, list_stddev_samp(x) AS sd FROM s)
SELECT id AS burst_id, j AS pos, round((x[j + 1] - m) / sd, 6) AS x FROM f, range(64) t(j)""",
    "pair_vector_order": XCORR + "SELECT label, a, b, row_number() OVER (PARTITION BY label ORDER BY b, a) AS pos FROM mx",
    "nearest_episode_to_target": f"""WITH {SPANS}, d AS (SELECT *, (o_orderkey * 37) % 2000 AS np, CAST(CASE WHEN 9500 BETWEEN a AND b THEN 0 WHEN b < 9500 THEN b - 9500 ELSE a - 9500 END AS DOUBLE) AS distance FROM sp),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN np >= 1225 THEN 0 WHEN np >= 190 THEN 1 ELSE 2 END, abs(distance), o_orderkey) AS r FROM d)
SELECT o_custkey, o_orderkey, distance, CASE WHEN distance < 0 THEN 'before' WHEN distance > 0 THEN 'after' ELSE 'inside' END AS side FROM r WHERE r = 1""",
    "padded_segments": f"WITH {SEG} SELECT id AS burst_id, j AS pos, round(coalesce(CASE WHEN 2 * j + 1 <= len(x) THEN x[2 * j + 1] END, 0), 6) AS x FROM s, range(40) t(j)",
    "roi_wide": """WITH j AS (SELECT c_mktsegment, r_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_mktsegment, round(avg(c_acctbal) FILTER (r_name = 'AMERICA'), 6) AS america, round(avg(c_acctbal) FILTER (r_name = 'ASIA'), 6) AS asia, round(avg(c_acctbal) FILTER (r_name = 'EUROPE'), 6) AS europe, round(avg(c_acctbal) FILTER (r_name = 'MIDDLE EAST'), 6) AS middle_east FROM j WHERE r_name <> 'AFRICA' GROUP BY 1""",
    "colour_limits": f"WITH {CHAN}, l AS (SELECT channel, quantile_cont(v, 0.1) AS lo, max(v) AS hi FROM c GROUP BY channel) SELECT channel, user_id, round(v, 6) AS power, round(lo, 6) AS c_lo, round(hi, 6) AS c_hi FROM c JOIN l USING (channel)",
    "top_sources": f"WITH {E} SELECT user_id AS voxel, round(sum(v), 6) AS power FROM e GROUP BY user_id ORDER BY sum(v) DESC, user_id LIMIT 20",
    "name_parse": """WITH n AS (SELECT c_custkey, 'mgh_' || c_custkey || '_1_0_20000101' || CASE WHEN c_custkey % 2 = 0 THEN 'T' ELSE '_' END || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS name FROM customer)
SELECT c_custkey, 'mgh_' || c_custkey AS patient, regexp_replace(name, '^([^_]*)_', '\\1') AS short, 'mgh' AS hospital, c_custkey AS number, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS time FROM n""",
    "json_roundtrip": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "set_operations": """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'),
x AS (SELECT 'both' AS op, user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', user_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'first_only', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)),
o AS (SELECT unnest(['both', 'either', 'first_only']) AS op)
SELECT op, count(user_id) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM o LEFT JOIN x USING (op) GROUP BY op""",
}
ORACLES |= SQL
