"""DuckDB SQL of the operators' queries that SQL can express, over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


SUBSTRING_DEDUP = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WHITE}') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35), k AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS k FROM p),
g AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1), h AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM k JOIN g USING (k)),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
l AS (SELECT x.r, count(h.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (h.i IS NULL) AS kept FROM x LEFT JOIN h ON h.r = x.r AND h.i = x.i GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN l USING (r)"""

NGRAM_JOIN = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WHITE}') AS w FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 2), ' ') END AS g FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c.c >= 90 * (nx.n + ny.n - c.c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, b.y FROM reach JOIN b ON b.x = reach.y),
m AS (SELECT reach.x AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""

DECONTAMINATE = f"""WITH t AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS k FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM t WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
p AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
h AS (SELECT r, p.n, i, item FROM p JOIN q ON q.n = p.n AND q.k = p.k), c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)"""


def _strength(name: str, children: str, parent: str) -> str:
    return f"""{name} AS (SELECT least(greatest(CASE WHEN rho > 0 THEN round(1 / rho - 1, 6) ELSE 1000.0::DOUBLE END, 1.0), 1000.0) AS s FROM (SELECT (msb - msw) / nullif(msb + (n0 - 1) * msw, 0) AS rho FROM
(SELECT bt / nullif(df, 0) AS msb, coalesce(wi / nullif(total - g, 0), 0) AS msw, (total - sq) / nullif(df, 0) AS n0 FROM
(SELECT sum(n)::DOUBLE AS total, count(*) AS g, count(*) - count(DISTINCT {parent}) AS df, sum(n * (k / n - pk / pn) * (k / n - pk / pn)) AS bt, sum(n * (k / n) * (1 - k / n)) AS wi, sum(n * n / pn) AS sq FROM {children}))))"""


def url_filter(rules: list[tuple[str, str]], z: float = 1.645, least: float = 0.5) -> str:
    """The rules and the reputation of url_filter.filter_urls."""
    values = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in rules)
    bound = lambda t: f"round({t}.a / ({t}.a + {t}.b) - {z} * sqrt({t}.a / ({t}.a + {t}.b) * (1 - {t}.a / ({t}.a + {t}.b)) / ({t}.a + {t}.b + 1)), 6)"
    post = lambda m: f"k + s * {m} AS a, n - k + s * (1 - {m}) AS b"
    mean = "round(a / (a + b), 9) AS m"
    return f"""WITH p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) END AS rest FROM pages),
q AS (SELECT r, page_id, coalesce({_lower("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
rules(rule, h, p, v) AS (VALUES {values}),
m AS (SELECT r, arg_max(rule, (length(rule), rule)) AS rule, arg_max(v, (length(rule), rule)) AS v FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1),
b AS (SELECT q.*, rule, v, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM q LEFT JOIN m USING (r)),
o AS (SELECT host, domain, suffix, count(v) AS n, count(*) FILTER (v = 'allow') AS k FROM b GROUP BY ALL HAVING count(v) > 0),
dm AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM o GROUP BY ALL), sx AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM dm GROUP BY ALL),
al AS (SELECT coalesce(sum(n), 0)::BIGINT AS pn, coalesce(sum(k), 0)::BIGINT AS pk FROM sx),
{_strength("ss", "(SELECT sx.*, pn, pk, 1 AS one FROM sx, al)", "one")},
{_strength("sd", "(SELECT dm.*, sx.n AS pn, sx.k AS pk FROM dm JOIN sx USING (suffix))", "suffix")},
{_strength("sh", "(SELECT o.*, dm.n AS pn, dm.k AS pk FROM o JOIN dm USING (domain))", "domain")},
tp AS (SELECT (pk + 0.5) / (pn + 1.0) AS m0 FROM al), bs AS (SELECT suffix, {post("m0")} FROM sx, tp, ss), bd AS (SELECT domain, {post("x.m")} FROM dm JOIN (SELECT suffix, {mean} FROM bs) x USING (suffix), sd),
bh AS (SELECT host, {post("x.m")} FROM o JOIN (SELECT domain, {mean} FROM bd) x USING (domain), sh), un AS (SELECT s * m0 AS a, s * (1 - m0) AS b FROM tp, ss)
SELECT page_id, b.host, path, rule, coalesce(v, CASE WHEN coalesce({bound("bh")}, {bound("bd")}, {bound("bs")}, {bound("un")}) >= {least} THEN 'allow' ELSE 'block' END) AS verdict
FROM b LEFT JOIN bh ON bh.host = b.host LEFT JOIN bd ON bd.domain = b.domain LEFT JOIN bs ON bs.suffix = b.suffix CROSS JOIN un"""
