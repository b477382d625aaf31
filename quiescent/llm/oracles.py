"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import math
from functools import cache

from . import fixity, urlfilter

OP2 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM iw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM dw, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s) WHERE len(w) >= n),
occ AS (SELECT d.doc_id, d.s, d.n, w.item_id FROM dwin d JOIN win w ON d.n = w.n AND d.win = w.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, LATERAL (SELECT unnest(range(s, s + n)) AS p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS sha FROM occ GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP10 = r"""
WITH m AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':0:' || md5(coalesce(text, ''))) AS k FROM documents),
d AS (SELECT doc_id, source, size, CAST('0x' || substr(k, 1, 9) AS BIGINT) AS h, CAST('0x' || substr(k, 10, 15) AS BIGINT) AS t FROM m),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS filled FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(filled) OVER f, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY filled / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(filled, coalesce(w * max(CASE WHEN level * w <= filled THEN level END) OVER (), filled)) AS target FROM l),
c AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
e AS (SELECT d.*, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source),
g AS (SELECT source, h, sum(size) AS n, min(before) AS lo, any_value(rest) AS rest FROM e GROUP BY source, h),
b AS (SELECT source, min(h) AS cut FROM g WHERE lo + n > rest GROUP BY source)
SELECT doc_id, size, source_size, target, CAST((copies + CASE WHEN h < b.cut OR (h = b.cut AND size > 0 AND before + size / 2.0 < rest) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM e LEFT JOIN b ON b.source IS NOT DISTINCT FROM e.source
"""

OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, row_number() OVER () AS pid, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT lang, pid, unnest(w) AS a1, generate_subscripts(w, 1) AS i FROM p),
t AS (SELECT lang, a1, lead(a1) OVER o AS a2, lead(a1, 2) OVER o AS a3 FROM s WINDOW o AS (PARTITION BY pid ORDER BY i)),
c1 AS (SELECT lang, a1, count(*) AS a FROM t GROUP BY ALL),
c2 AS (SELECT lang, a1, a2, count(*) AS a FROM t WHERE a2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT lang, a1, a2, a3, count(*) AS a FROM t WHERE a3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cut AS (SELECT x.lang, x.a1, x.a2, NULL AS a3, x.a, 1 AS k, l.a AS l, r.a AS r FROM c2 x JOIN c1 l ON l.lang = x.lang AND l.a1 = x.a1 JOIN c1 r ON r.lang = x.lang AND r.a1 = x.a2 WHERE x.a >= 10
  UNION ALL SELECT x.lang, x.a1, x.a2, x.a3, x.a, 1, l.a, r.a FROM c3 x JOIN c1 l ON l.lang = x.lang AND l.a1 = x.a1 JOIN c2 r ON r.lang = x.lang AND r.a1 = x.a2 AND r.a2 = x.a3
  UNION ALL SELECT x.lang, x.a1, x.a2, x.a3, x.a, 2, l.a, r.a FROM c3 x JOIN c2 l ON l.lang = x.lang AND l.a1 = x.a1 AND l.a2 = x.a2 JOIN c1 r ON r.lang = x.lang AND r.a1 = x.a3),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cut),
least_ AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, a1, a2, a3 ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a1, a2, a FROM c3 UNION ALL SELECT lang, a2, a3, a FROM c3),
longer AS (SELECT lang, a1, a2, max(a) AS b FROM inner_ GROUP BY lang, a1, a2),
kept AS (SELECT x.*, concat_ws(' ', x.a1, x.a2, x.a3) AS phrase FROM least_ x LEFT JOIN longer y ON x.a3 IS NULL AND x.lang = y.lang AND x.a1 = y.a1 AND x.a2 = y.a2 WHERE b IS NULL OR 100 * b < 50 * x.a),
size AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM c1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN size USING (lang) QUALIFY rank <= 2000
"""


def _grams(host: str, path: str) -> list[int]:
    out = []
    for text, salt in ((host, 0), (path, 517)):
        c = [ord(x) for x in f"^{text}$"]
        out += [(c[i] * 961 + c[i + 1] * 31 + c[i + 2] + salt) % urlfilter.BUCKETS for i in range(len(c) - 2)]
    return out


@cache
def url_model() -> list[float]:
    """The default model of :mod:`.urlfilter`, trained by plain loops."""
    ex = []
    for url, y in urlfilter.LABELLED:
        host, _, rest = url.partition("://")[2].partition("/")
        ex.append((float(y), _grams(host.lower(), "/" + rest)))
    ex.sort()
    w, b, n = [0.0] * urlfilter.BUCKETS, 0.0, len(ex)
    inv: list[dict[int, int]] = [{} for _ in w]
    for e, (_, g) in enumerate(ex):
        for j in g:
            inv[j][e] = inv[j].get(e, 0) + 1
    for _ in range(urlfilter.STEPS):
        r = [1 / (1 + math.exp(-(b + sum(w[j] for j in g) / len(g)))) - y for y, g in ex]
        w = [x - urlfilter.RATE * (sum(r[e] * (c / len(ex[e][1])) for e, c in inv[j].items()) / n + urlfilter.L2 * x) for j, x in enumerate(w)]
        b -= urlfilter.RATE / 20 * sum(r) / n
    return [*w, b]


def _op9() -> str:
    m = url_model()
    gram = "list_transform(range(1, len({0}) - 1), lambda i: (unicode({0}[i]) * 961 + unicode({0}[i + 1]) * 31 + unicode({0}[i + 2]) + {1}) % 1024)"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES {", ".join(map(str, urlfilter.RULES))}),
f AS (SELECT host, path, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(verdict, len(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM s) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
c AS (SELECT *, '^' || host || '$' AS ch, '^' || path || '$' AS cp FROM s),
g AS (SELECT page_id, host, path, list_concat({gram.format("ch", 0)}, {gram.format("cp", 517)}) AS g FROM c)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {m[-1]!r} + coalesce(list_sum(list_transform(g, lambda j: ({m[:-1]!r}::DOUBLE[])[j + 1])), 0) / greatest(len(g), 1) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM g LEFT JOIN f USING (host, path)
"""


def _tree(src: str, out: str) -> str:
    """CTEs of the levels of a manifest's trees: {out}1 .. {out}N, the root last."""
    sql = f"""{out}1 AS (SELECT file, offset_ // {fixity.RANGE_BYTES} AS node, sha256(string_agg(sha256(concat_ws(':', offset_, length, digest)), '' ORDER BY offset_)) AS hash FROM {src} GROUP BY ALL)"""
    for k in range(2, fixity.LEVELS + 2):
        up = f"node // {fixity.FANOUT}" if k <= fixity.LEVELS else "0"
        sql += f""",
{out}{k} AS (SELECT file, {up} AS node, sha256(string_agg(hash, '' ORDER BY c)) AS hash FROM (SELECT file, node AS c, hash, {up} AS node FROM {out}{k - 1}) GROUP BY ALL)"""
    return sql


def _op3() -> str:
    root, sha = f"{fixity.LEVELS + 1}", "sha256(record)"
    line = " || chr(13) || chr(10) || "
    head = line.join(["'WARC/1.0'", "'WARC-Type: response'", "'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>'", "'WARC-Target-URI: ' || coalesce(url, '')",
                      f"'WARC-Date: {fixity.DATE}'", f"'Content-Type: {fixity.CONTENT}'", "'Content-Length: ' || strlen(coalesce(html, ''))", "''", "coalesce(html, '')", "''", "''"])
    entries = "coalesce(sum(strlen(record)) OVER f, 0) AS offset_, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest, page_id, row_number() OVER f AS k, count(*) OVER (PARTITION BY file) AS n"
    order = "WINDOW f AS (PARTITION BY file ORDER BY tail, page_id NULLS FIRST, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return rf"""
WITH p AS (SELECT page_id, {head} AS record, count(*) FILTER (page_id IS NULL) OVER () AS nulls FROM pages),
rec AS (SELECT coalesce(CAST(floor(page_id / {fixity.PAGES_PER_FILE}) AS BIGINT), -1 - CAST('0x' || substr({sha}, 1, 8) AS BIGINT) % greatest(1, CAST(ceil(nulls / {fixity.PAGES_PER_FILE}.0) AS BIGINT))) AS file,
  page_id, record, 0 AS tail, {sha} AS mark FROM p),
m AS (SELECT file, {entries} FROM rec {order}),
a AS (SELECT file, CAST(offset_ AS BIGINT) AS offset_, length, digest, page_id FROM m),
rec2 AS (SELECT file, page_id, CASE WHEN mark LIKE '00%' THEN '#' || substr(record, 2) WHEN mark LIKE '01%' THEN repeat(' ', strlen(record)) ELSE record END AS record, tail, mark FROM rec
  UNION ALL SELECT DISTINCT file, NULL, '{fixity.TWIN}', 1, '' FROM rec WHERE file % 5 = 0),
m2 AS (SELECT file, {entries} FROM rec2 {order}),
b AS (SELECT file, CAST(offset_ AS BIGINT) AS offset_, length, digest, page_id FROM m2 WHERE NOT (file % 5 = 1 AND k = n)),
{_tree("a", "ta")},
{_tree("b", "tb")},
roots AS (SELECT file, ta{root}.hash AS root_a, tb{root}.hash AS root_b FROM ta{root} FULL JOIN tb{root} USING (file)),
d AS (SELECT file, offset_, a.length AS length_a, b.length AS length_b, a.digest AS digest_a, b.digest AS digest_b, coalesce(a.page_id, b.page_id) AS page_id,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'corrupt' END AS status
  FROM a FULL JOIN b USING (file, offset_) WHERE a.digest IS DISTINCT FROM b.digest OR a.length IS DISTINCT FROM b.length)
SELECT file, root_a, root_b, coalesce(status, 'intact') AS status, offset_ AS offset, length_a, length_b, digest_a, digest_b, page_id FROM roots LEFT JOIN d USING (file)
"""


ORACLES: dict[str, str] = {"op2_decontamination": OP2, "op3_fixity": _op3(), "op9_urlfilter": _op9(), "op10_mixing": OP10, "op13_collocations": OP13}
