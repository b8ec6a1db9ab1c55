"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .quality_rules import MEASURES

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4
),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY 1, 2
"""

URL_FILTER = """
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
),
r AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

DEBRUIJN = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
often AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM often)),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
mark AS (
  SELECT p.doc_id, p.i, p.word, max(CASE WHEN hit.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM pos p LEFT JOIN hit ON hit.doc_id = p.doc_id AND hit.i = p.i
)
SELECT w.doc_id, CAST(len(any_value(w.w)) AS BIGINT) AS n_words, CAST(coalesce(sum(m.gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (WHERE m.gone = 0), '')) AS kept_sha256
FROM w LEFT JOIN mark m ON m.doc_id = w.doc_id GROUP BY w.doc_id
"""


def _div(expression: str) -> str:
    return expression.replace(" div ", " // ")


def quality_rules_sql(weights: tuple[int, int] = (100, 25), widen: int = 3) -> str:
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, CAST({_div(x.expression)} AS BIGINT) AS v FROM st WHERE n_words > 0" for m, x in MEASURES.items())
    slack = " ".join(f"WHEN '{m}' THEN {x.slack}" for m, x in MEASURES.items())
    lows = ", ".join(f"max(CASE WHEN measure = '{m}' THEN low END) AS low_{m}" for m, x in MEASURES.items() if x.lower)
    highs = ", ".join(f"max(CASE WHEN measure = '{m}' THEN high END) AS high_{m}" for m in MEASURES)
    blended = f"""
tl AS (SELECT lang, measure, CAST(sum(n) AS HUGEINT) AS t FROM sk GROUP BY ALL), ta AS (SELECT measure, CAST(sum(n) AS HUGEINT) AS t FROM sk GROUP BY ALL), gr AS (SELECT DISTINCT lang, source, measure FROM sk),
part AS (
  SELECT k.lang, source, k.measure, bucket, k.n * tl.t * ta.t AS n FROM sk k JOIN tl ON tl.lang IS NOT DISTINCT FROM k.lang AND tl.measure = k.measure JOIN ta ON ta.measure = k.measure
  UNION ALL SELECT gr.lang, gr.source, gr.measure, bucket, {weights[0]} * k.n * ta.t FROM gr JOIN sk k ON k.lang IS NOT DISTINCT FROM gr.lang AND k.measure = gr.measure JOIN ta ON ta.measure = gr.measure
  UNION ALL SELECT gr.lang, gr.source, gr.measure, bucket, {weights[1]} * k.n * tl.t FROM gr JOIN sk k ON k.measure = gr.measure JOIN tl ON tl.lang IS NOT DISTINCT FROM gr.lang AND tl.measure = gr.measure
),
mix AS (SELECT lang, source, measure, bucket, sum(n) AS n FROM part GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM mix),
quart AS (SELECT lang, source, measure, min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS q3 FROM run GROUP BY ALL),
lim AS (SELECT lang, source, measure, q1 - (q3 - q1) * {widen} - CASE measure {slack} END AS low, q3 + (q3 - q1) * {widen} + CASE measure {slack} END AS high FROM quart),
own AS (SELECT lang, source, {lows}, {highs} FROM lim GROUP BY lang, source)"""
    fits = " AND ".join([f"{_div(x.expression)} <= high_{m}" for m, x in MEASURES.items()] + [f"{_div(x.expression)} >= low_{m}" for m, x in MEASURES.items() if x.lower])
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
tri AS (SELECT *, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS r FROM tri),
cov AS (SELECT doc_id, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM rep),
again AS (SELECT doc_id, sum(c) AS n FROM cov GROUP BY 1),
line AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
st AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN line ON line.doc_id = d.doc_id LEFT JOIN again ON again.doc_id = d.doc_id
),
vals AS ({values}),
sk AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n FROM vals GROUP BY ALL),{blended}
SELECT st.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(CASE WHEN n_words > 0 THEN {fits} END, false) AS kept
FROM st LEFT JOIN own ON own.lang IS NOT DISTINCT FROM st.lang AND own.source IS NOT DISTINCT FROM st.source
"""

FILTER_AUDIT = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
),
f AS (
  SELECT part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask,
    CASE WHEN quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic
  FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || x.f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(f) WHERE NOT contains(o, x.f)
),
step AS (
  SELECT o, s, 1 << (ascii(substr(o, s, 1)) - 65) AS own, list_sum([1 << (ascii(substr(o, k, 1)) - 65) FOR k IN range(1, s)]) AS before
  FROM orders, range(1, 6) r(s) WHERE length(o) = 5
),
run AS (
  SELECT part, o, s, own, sum(CASE WHEN mask & (own + coalesce(before, 0)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0) <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, step GROUP BY 1, 2, 3, 4
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM run
"""


def merkle_sql(levels: int = 6, top_levels: int = 3) -> str:
    """For at most 8 ** ``levels`` leaves a language and 8 ** ``top_levels`` languages."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    tampered = f"CASE WHEN crc % 3 = 0 THEN {_LOWER.format(text='text')} ELSE text END"
    parts = [f"""
WITH c AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, flatten([[ascii(b), -1, -1, -1, -1, -1, -1, -1, -1] FOR b IN string_split(CAST(doc_id AS VARCHAR), '')])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) AS crc FROM documents
),
t AS (SELECT *, {tampered} AS altered FROM c),
x AS (SELECT doc_id, lang, {leaf('text')} AS d, {leaf('altered')} AS a FROM t),
n0 AS (SELECT doc_id, lang, d, a, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM x)"""]

    def climb(n: str, tree: str, depth: int) -> None:
        for k in range(depth):
            run = f"PARTITION BY {tree}, i // 8 ORDER BY i ROWS BETWEEN"
            parts.append(f"""
{n}s{k} AS (SELECT {tree}, i, c, d, CASE WHEN c > 1 THEN coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS b, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS e FROM {n}{k}),
{n}{k + 1} AS (SELECT {tree}, i // 8 AS i, CASE WHEN max(c) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (max(c) + 7) // 8 AS c FROM {n}s{k} GROUP BY {tree}, i // 8)""")

    climb("n", "lang", levels)
    parts.append(f"""
m0 AS (SELECT 0 AS tree, lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS c FROM n{levels})""")
    climb("m", "tree", top_levels)
    joins, proof, fold = [], [], "n0.a"
    for n, depth, place, tree in (("n", levels, "n0.i", "{s}.lang IS NOT DISTINCT FROM n0.lang"), ("m", top_levels, "m0.i", "true")):
        if n == "m":
            joins.append("JOIN m0 ON m0.lang IS NOT DISTINCT FROM n0.lang")
        for k in range(depth):
            s = f"{n}s{k}"
            joins.append(f"JOIN {s} ON {tree.format(s=s)} AND {s}.i = {place} // {8**k}")
            proof.append(f"coalesce({s}.b || {s}.e, '')")
            fold = f"CASE WHEN {s}.b IS NULL THEN {fold} ELSE sha256({s}.b || {fold} || {s}.e) END" if k == 0 and n == "n" else f"(SELECT CASE WHEN {s}.b IS NULL THEN h ELSE sha256({s}.b || h || {s}.e) END FROM (SELECT {fold} AS h))"
    return ",".join(parts) + f""",
r AS (
  SELECT n0.doc_id, n0.d AS leaf, m0.d AS subroot, (SELECT d FROM m{top_levels}) AS root, sha256({' || '.join(proof)}) AS proof_sha256, {fold} AS folded_root
  FROM n0 {' '.join(joins)}
)
SELECT *, folded_root = root AS verified FROM r
"""
