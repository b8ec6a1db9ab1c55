"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

from .queries import BROKEN, K, P, WIDTH

#: Utterances and their speakers, and the embeddings' counterpart.
UTT = "utt AS (SELECT CAST(user_id AS VARCHAR) AS speaker_id, CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR) || '.wav' AS path FROM events)"
EMB = "emb AS (SELECT CAST(label AS VARCHAR) AS speaker_id, CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) || '.wav' AS path, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
SEP = "chr(31)"


def _digest(*parts: str) -> str:
    return "sha256('2026'" + "".join(f" || {SEP} || {p}" for p in parts) + ")"


def _neighbours(source: str, name: str = "tr", only: str = "true") -> str:
    nexts = lambda by: ", ".join(f"lead(path, {k}) OVER ({by} ORDER BY d, path) AS p{k}, lead(speaker_id, {k}) OVER ({by} ORDER BY d, path) AS s{k}" for k in range(1, WIDTH + 1))
    spread = lambda t: " UNION ALL ".join(f"SELECT path, speaker_id, p{k} AS op, s{k} AS os FROM {t}" for k in range(1, WIDTH + 1))
    cut = lambda t, target, where: f"SELECT least(path, op) AS l, greatest(path, op) AS r, CASE WHEN path < op THEN speaker_id ELSE os END AS ls, CASE WHEN path < op THEN os ELSE speaker_id END AS rs, {target} AS target FROM ({spread(t)}) WHERE op IS NOT NULL AND {where}"
    return f"""
{name}_p AS (SELECT DISTINCT speaker_id, path, {_digest("'neighbour'", "path")} AS d FROM {source} WHERE {only}),
{name}_g AS (SELECT path, speaker_id, {nexts("PARTITION BY speaker_id")} FROM {name}_p),
{name}_i AS (SELECT path, speaker_id, {nexts("")} FROM {name}_p),
{name} AS ({cut(f"{name}_g", 1, "true")} UNION ALL {cut(f"{name}_i", 0, "os <> speaker_id")})"""


def _scores(only: str = "true", name: str = "sc", t: str = "tr") -> str:
    return f"""{_neighbours("emb", t, only)},
{name} AS (SELECT l, r, target, round(coalesce(list_cosine_similarity(a.v, b.v), 0), 6) AS score FROM {t} JOIN emb a ON a.path = l JOIN emb b ON b.path = r)"""


def _points(name: str = "pt", scores: str = "sc") -> str:
    return f"""{name}_s AS (SELECT score, count(*) FILTER (WHERE target = 1) AS p, count(*) FILTER (WHERE target = 0) AS n FROM {scores} GROUP BY 1),
{name} AS (
  SELECT score AS threshold, sum(n) OVER w / (SELECT sum(n) FROM {name}_s) AS far, ((SELECT sum(p) FROM {name}_s) - sum(p) OVER w) / (SELECT sum(p) FROM {name}_s) AS frr, false AS is_anchor FROM {name}_s WINDOW w AS (ORDER BY score DESC)
  UNION ALL SELECT nextafter(max(score), CAST('infinity' AS DOUBLE)), 0.0, 1.0, true FROM {name}_s
)"""


def _eer(points: str = "pt", name: str = "e") -> str:
    return f"""{name}_x AS (SELECT threshold, far FROM {points} WHERE far = frr ORDER BY threshold DESC LIMIT 1),
{name}_a AS (SELECT * FROM {points} WHERE far < frr ORDER BY threshold LIMIT 1),
{name}_b AS (SELECT * FROM {points} WHERE far > frr ORDER BY threshold DESC LIMIT 1),
{name}_n AS (SELECT * FROM {points} WHERE NOT is_anchor ORDER BY abs(far - frr), (far + frr) / 2, threshold DESC LIMIT 1),
{name}_w AS (SELECT (a.frr - a.far) / ((b.far - b.frr) - (a.far - a.frr)) AS w FROM {name}_a a, {name}_b b),
{name} AS (SELECT coalesce((SELECT far FROM {name}_x), (SELECT a.far + w * (b.far - a.far) FROM {name}_a a, {name}_b b, {name}_w)) AS eer,
  coalesce((SELECT threshold FROM {name}_x), (SELECT a.threshold + w * (b.threshold - a.threshold) FROM {name}_a a, {name}_b b, {name}_w)) AS eer_threshold)"""


SPLIT = f"""{UTT},
spk AS (SELECT DISTINCT speaker_id, sha256('2026|' || speaker_id) AS ranking_sha256 FROM utt),
num AS (SELECT count(*) AS s FROM spk),
split AS (SELECT speaker_id, CASE WHEN rk < s - 2 * (s // 10) THEN 'train' WHEN rk < s - s // 10 THEN 'validation' ELSE 'final_test' END AS split, ranking_sha256
  FROM (SELECT *, row_number() OVER (ORDER BY ranking_sha256, speaker_id) - 1 AS rk FROM spk), num),
lab AS (SELECT speaker_id, row_number() OVER (ORDER BY CAST(speaker_id AS BIGINT), speaker_id) - 1 AS label FROM split WHERE split = 'train'),
man AS (SELECT path AS relative_audio_path, utt.speaker_id, CAST(CASE WHEN split = 'train' THEN label ELSE -1 END AS INTEGER) AS speaker_label, split AS final_split
  FROM utt JOIN split USING (speaker_id) LEFT JOIN lab USING (speaker_id))"""

INDEX = f"""{SPLIT},
idx0 AS (SELECT *, row_number() OVER (PARTITION BY final_split ORDER BY CAST(speaker_id AS BIGINT), speaker_id, relative_audio_path) - 1 AS manifest_row_index FROM man),
idx AS (SELECT *, final_split || '/shard_' || lpad(CAST(manifest_row_index // 512 AS VARCHAR), 5, '0') || '.pt' AS shard_path, CAST(manifest_row_index % 512 AS INTEGER) AS within_shard_index FROM idx0)"""

QUOTA = lambda purpose, total: f"""spk AS (SELECT speaker_id, {_digest(f"'{purpose}'", "speaker_id")} AS d FROM (SELECT DISTINCT speaker_id FROM utt)),
num AS (SELECT count(*) AS s, {total} AS t FROM spk),
quota AS (SELECT speaker_id, t // s + CASE WHEN row_number() OVER (ORDER BY d, speaker_id) - 1 < t % s THEN 1 ELSE 0 END AS quota FROM spk, num)"""  # noqa: E731
TOTAL = "5 * count(*) + count(*) // 2"

GENUINE = f"""{QUOTA("genuine-quota", TOTAL)}, p AS (SELECT DISTINCT * FROM utt),
pr AS (SELECT a.speaker_id AS s, a.path AS l, b.path AS r, {_digest("'genuine'", "a.speaker_id", "a.path", "b.path")} AS d FROM p a JOIN p b ON a.speaker_id = b.speaker_id AND a.path < b.path),
gen AS (SELECT s, l, r, d FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, l, r) AS n FROM pr) rk JOIN quota ON quota.speaker_id = s WHERE n <= quota)"""

SPEAKER_PAIRS = f"""{QUOTA("negative-participation", f"2 * ({TOTAL})").replace("spk AS", "ispk AS").replace("FROM spk", "FROM ispk").replace("num AS", "inum AS").replace(", num)", ", inum)").replace("quota AS", "iquota AS")},
im AS (SELECT min(quota) AS least, count(*) AS n, sum(quota) - min(quota) * count(*) AS extra FROM iquota),
ir AS (SELECT speaker_id, quota, least, n, extra, unnest(range(CASE WHEN quota > least THEN 0 ELSE 1 END, least + 1)) AS round FROM iquota, im),
ik AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY {_digest("'negative-speaker'", "CAST(round AS VARCHAR)", "speaker_id")}, speaker_id) - 1 AS rank FROM ir),
ie AS (SELECT *, CAST(CASE WHEN round = 0 THEN rank ELSE extra + (round - 1) * n + rank END AS BIGINT) AS e, CASE WHEN quota > least THEN round ELSE round - 1 END AS turn FROM ik),
ib AS (SELECT y.round FROM ie x JOIN ie y ON y.e = x.e + 1 WHERE x.e % 2 = 0 AND y.rank = 0 AND x.speaker_id = y.speaker_id),
ip AS (SELECT CASE WHEN rank < 2 AND round IN (SELECT round FROM ib) THEN e + 1 - 2 * rank ELSE e END AS e, speaker_id, turn FROM ie),
sp AS (SELECT e // 2 AS position, max(speaker_id) FILTER (WHERE e % 2 = 0) AS speaker_a, max(speaker_id) FILTER (WHERE e % 2 = 1) AS speaker_b, max(turn) FILTER (WHERE e % 2 = 0) AS turn_a, max(turn) FILTER (WHERE e % 2 = 1) AS turn_b FROM ip GROUP BY 1)"""

IMPOSTORS = f"""jz AS (SELECT speaker_id, path, row_number() OVER (PARTITION BY speaker_id ORDER BY {_digest("'impostor'", "path")}, path) - 1 AS place, count(*) OVER (PARTITION BY speaker_id) AS n FROM (SELECT DISTINCT * FROM utt)),
jn AS (SELECT DISTINCT speaker_id, n FROM jz),
jm AS (SELECT position, lo, hi, row_number() OVER (PARTITION BY lo, hi ORDER BY position) - 1 AS m, count(*) OVER (PARTITION BY lo, hi) AS t FROM (SELECT position, least(speaker_a, speaker_b) AS lo, greatest(speaker_a, speaker_b) AS hi FROM sp)),
jp AS (SELECT DISTINCT lo AS s, hi AS o, t FROM jm UNION ALL SELECT DISTINCT hi, lo, t FROM jm),
jb AS (SELECT s, o, coalesce(sum(t) OVER (PARTITION BY s ORDER BY {_digest("'impostor'", "'partner'", "s", "o")}, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM jp),
jc AS (SELECT position, lo, hi, (x.b + m) % p.n AS i, (y.b + m + m // lcm(p.n, q.n) - t // lcm(p.n, q.n) + q.n * (t + 1)) % q.n AS j
  FROM jm JOIN jb x ON x.s = lo AND x.o = hi JOIN jb y ON y.s = hi AND y.o = lo JOIN jn p ON p.speaker_id = lo JOIN jn q ON q.speaker_id = hi),
imp AS (SELECT position, least({{'path': u.path, 's': lo}}, {{'path': v.path, 's': hi}}) AS l, greatest({{'path': u.path, 's': lo}}, {{'path': v.path, 's': hi}}) AS r
  FROM jc JOIN jz u ON u.speaker_id = lo AND u.place = i JOIN jz v ON v.speaker_id = hi AND v.place = j)"""


def _permuted(x: str, size: str, *key: str) -> str:
    """Place of x in the keyed permutation of 0 to ``size`` - 1; ``ls`` and ``rs`` are the sides of the grid."""
    drawn = lambda v: "CAST('0x' || substr(" + _digest(*key, "CAST(op AS VARCHAR)", f"CAST({v} AS VARCHAR)") + ", 1, 15) AS BIGINT)"
    left, right = "(st // rs)", "(st % rs)"
    return f"""-1 - list_reduce(list_prepend(CAST({x} AS BIGINT), flatten([CAST([0, 1, 2, 3, 4] AS BIGINT[]) FOR w IN range(16)])), lambda st, op: CASE WHEN st < 0 THEN st WHEN op = 4 THEN CASE WHEN st < {size} THEN -1 - st ELSE st END
  WHEN op % 2 = 0 THEN ({left} + {drawn(right)}) % ls * rs + {right} ELSE {left} * rs + ({right} + {drawn(left)}) % rs END)"""


def _pk(source: str, by: str = "", name: str = "pk") -> str:
    """P x K batches of ``source`` (``by``, speaker_id, path)."""
    g, on = (f"{by}, ", f" AND z.{by} = {name}_rows.{by}") if by else ("", "")
    return f"""{name}_rows AS (SELECT {g}speaker_id, path, row_number() OVER (PARTITION BY {g}speaker_id ORDER BY {_digest("'0'", "'row'", "path")}, path) - 1 AS place FROM {source}),
{name}_spk AS (SELECT {g}speaker_id, n, row_number() OVER ({f"PARTITION BY {by}" if by else ""} ORDER BY {_digest("'0'", "'speaker'", "speaker_id")}, speaker_id) - 1 AS r FROM (SELECT {g}speaker_id, count(*) AS n FROM {source} GROUP BY ALL)),
{name}_tot AS (SELECT {g}count(*) AS s, CAST(ceil(sum(n) / {P * K}.0) AS BIGINT) * {P} AS seats FROM {name}_spk {f"GROUP BY {by}" if by else ""}),
{name}_seat AS (SELECT {f"{name}_spk." if by else ""}{g}speaker_id, n, s, r, unnest(range(0, CASE WHEN r < seats THEN (seats - 1 - r) // s + 1 ELSE 0 END)) AS e FROM {name}_spk {f"JOIN {name}_tot ON {name}_tot.{by} = {name}_spk.{by}" if by else f", {name}_tot"}),
{name}_take AS (SELECT {g}speaker_id, n, e * s + r AS q, k, e * {K} + k AS t FROM {name}_seat, (SELECT unnest(range(0, {K})) AS k)),
{name} AS (SELECT {f"z.{by}, " if by else ""}q // {P} AS batch_id, CAST(q % {P} * {K} + k AS INTEGER) AS slot, z.speaker_id, path, t // n AS cycle FROM {name}_take z JOIN {name}_rows ON {name}_rows.speaker_id = z.speaker_id AND {name}_rows.place = t % n{on})"""


PK = f"""{UTT},
{_pk("utt")},
rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY turn, speaker_id) - 1 AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, speaker_id ORDER BY slot) AS turn FROM pk))"""

#: Windows from the top down: a block is halved if both halves have units of P speakers or lie behind the last window.
HYBRID = f"""WITH RECURSIVE {INDEX}, hx AS (SELECT shard_path, speaker_id, relative_audio_path AS path FROM idx WHERE final_split = 'train'),
hs AS (SELECT shard_path, (row_number() OVER (ORDER BY {_digest("'0'", "'shard'", "shard_path")}, shard_path) - 1) // 2 AS base FROM (SELECT DISTINCT shard_path FROM hx)),
hq AS (SELECT speaker_id, path, shard_path, base, row_number() OVER (PARTITION BY speaker_id ORDER BY base, {_digest("'0'", "'row'", "path")}, path) - 1 AS q, count(*) OVER (PARTITION BY speaker_id) AS n FROM hx JOIN hs USING (shard_path)),
hm AS (SELECT speaker_id, path, shard_path, base, unit, q - least(unit * {K}, n - {K}) AS place FROM (
  SELECT *, q // {K} AS unit FROM hq UNION ALL SELECT *, (n - 1) // {K} FROM hq WHERE n % {K} <> 0 AND q >= n - {K} AND q // {K} < (n - 1) // {K})),
hu AS (SELECT speaker_id, unit, max(base) AS base FROM hm GROUP BY 1, 2),
hl AS (SELECT unnest(range(0, 1 + CASE WHEN m = 0 THEN 0 ELSE length(bin(m)) END)) AS level FROM (SELECT max(base) AS m FROM hs)),
ha AS (SELECT level, base >> level AS block FROM hu, hl GROUP BY 1, 2 HAVING count(DISTINCT speaker_id) >= {P} UNION ALL SELECT level, (m >> level) + 1 FROM hl, (SELECT max(base) AS m FROM hs)),
hh AS (SELECT level + 1 AS level, block // 2 AS block FROM ha GROUP BY 1, 2 HAVING count(*) = 2),
hb AS (SELECT max(level) AS level, CAST(0 AS BIGINT) AS block FROM hl UNION ALL SELECT hb.level - 1, 2 * hb.block + half FROM hb JOIN hh ON hh.level = hb.level AND hh.block = hb.block, (VALUES (0), (1)) v(half)),
hw AS (SELECT DISTINCT hs.base, hb.block << hb.level AS shard_window FROM hs JOIN hb ON hs.base >> hb.level = hb.block WHERE NOT EXISTS (SELECT 1 FROM hh WHERE hh.level = hb.level AND hh.block = hb.block)),
hv AS (SELECT shard_window, speaker_id, unit, row_number() OVER (PARTITION BY shard_window, speaker_id ORDER BY unit) - 1 AS nth FROM hu JOIN hw USING (base)),
hz AS (SELECT shard_window, speaker_id, count(*) AS units FROM hv GROUP BY 1, 2),
ht AS (SELECT shard_window, able, batches, coalesce(CAST(sum(batches) OVER (ORDER BY shard_window ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS first_batch FROM (SELECT shard_window, count(*) AS able, CAST(ceil(sum(units) / {P}.0) AS BIGINT) AS batches FROM hz GROUP BY 1)),
hr AS (SELECT speaker_id, row_number() OVER (ORDER BY {_digest("'0'", "'speaker'", "speaker_id")}, speaker_id) - 1 AS circle, count(*) OVER () AS everyone FROM (SELECT DISTINCT speaker_id FROM hv)),
hp AS (SELECT *, row_number() OVER (PARTITION BY shard_window ORDER BY (circle - first_batch * {P} % everyone + everyone) % everyone) - 1 AS place FROM hz JOIN ht USING (shard_window) JOIN hr USING (speaker_id)),
he AS (SELECT *, e * able + place AS seat FROM (SELECT *, unnest(range(0, (batches * {P} - 1 - place) // able + 1)) AS e FROM hp)),
hybrid AS (SELECT he.shard_window, first_batch + seat // {P} AS batch_id, CAST(seat % {P} * {K} + hm.place AS INTEGER) AS slot, he.speaker_id, path, e // units AS cycle, shard_path
  FROM he JOIN hv ON hv.shard_window = he.shard_window AND hv.speaker_id = he.speaker_id AND hv.nth = e % units JOIN hm ON hm.speaker_id = hv.speaker_id AND hm.unit = hv.unit)
"""

IDENTITY = lambda rows: f"""SELECT coalesce(CAST(sum(n) AS BIGINT), 0) AS n_rows, sha256(coalesce(string_agg(h, chr(10) ORDER BY p), '')) AS identity FROM
  (SELECT substr(p, 1, 3) AS p, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY p)) AS h FROM
    (SELECT substr(d, 1, 6) AS p, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY d)) AS h FROM (SELECT sha256(j) AS d FROM ({rows})) GROUP BY 1) GROUP BY 1)"""  # noqa: E731


def _json(**fields: str) -> str:
    """Compact JSON of a row: names in order, values of text quoted (names that end with ``_n``: numbers)."""
    parts = [f"\"{k.removesuffix('_n')}\":" + (f"' || {v} || '" if k.endswith("_n") else f"\"' || {v} || '\"") for k, v in sorted(fields.items())]
    return "'{" + ",".join(parts) + "}'"


def _rounds(purpose: str, rounds: str, drawn: bool) -> str:
    """Impostor pairs ``made`` of rounds in which speakers pair up in the order of a digest."""
    place = "CAST('0x' || substr(" + _digest("'impostor'", "CAST(round AS VARCHAR)", "speaker_id") + ", 1, 15) AS BIGINT)" if drawn else "round"
    return f"""owned AS (SELECT speaker_id, path, row_number() OVER (PARTITION BY speaker_id ORDER BY {_digest("'impostor'", "path")}, path) - 1 AS place FROM (SELECT DISTINCT * FROM utt)),
sizes AS (SELECT speaker_id, count(*) AS n FROM owned GROUP BY 1),
turns AS (SELECT speaker_id, n, unnest(range(0, {rounds})) AS round FROM sizes),
turned AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY {_digest(f"'{purpose}'", "CAST(round AS VARCHAR)", "speaker_id")}, speaker_id) - 1 AS rank FROM turns),
picked AS (SELECT round, rank, turned.speaker_id, path FROM (SELECT *, {place} % n AS place FROM turned) turned JOIN owned ON owned.speaker_id = turned.speaker_id AND owned.place = turned.place),
sides AS (SELECT round, min({{'path': path, 's': speaker_id}}) AS l, max({{'path': path, 's': speaker_id}}) AS r FROM picked GROUP BY round, rank // 2 HAVING count(*) = 2),
made AS (SELECT l.path AS l, r.path AS r, l.s AS ls, r.s AS rs, min(round) AS round FROM sides GROUP BY 1, 2, 3, 4)"""


CENTROIDS = f"""{EMB},
dim AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(0, len(v))) AS k FROM emb),
mean AS (SELECT label, k, avg(x) AS m FROM dim GROUP BY 1, 2),
cen AS (SELECT label AS class, k AS dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS w FROM mean),
head AS (SELECT class, list(w ORDER BY dim) AS w FROM cen GROUP BY 1),
cosine AS (SELECT vec_id, label, class, least(greatest(list_cosine_similarity(v, w), 1e-7 - 1), 1 - 1e-7) AS c FROM emb, head),
aam AS (SELECT vec_id, label, class, 30.0 * CASE WHEN label <> class THEN c WHEN c > cos(pi() - 0.2) THEN c * cos(0.2) - sqrt(1 - c * c) * sin(0.2) ELSE c - sin(pi() - 0.2) * 0.2 END AS logit FROM cosine)"""

_BROKEN = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in BROKEN)
_R = lambda *cs: ", ".join(f"round({c}, 9) AS {c}" for c in cs)

_E = lambda text, c="relative_audio_path": f"ends_with({c}, '{text}')"
#: The index with what ``index_rules`` bends; i: offset, b: bins, g: group, l: label.
BENT = f"""bx AS (SELECT *, within_shard_index + CASE WHEN {_E("77.wav")} THEN 1 ELSE 0 END AS i, CASE WHEN {_E("5.wav")} THEN 81 ELSE 80 END AS b, CASE WHEN {_E("3.wav")} THEN 'other' ELSE 'train' END AS g,
  CASE WHEN {_E("8.wav")} THEN 1000000 ELSE speaker_label END AS l FROM idx),
nl AS (SELECT count(*) AS c FROM lab),
b3 AS (SELECT *, CAST(manifest_row_index // 512 AS BIGINT) * 512 + i AS rr FROM bx),
lr AS (SELECT count(*) AS n FROM bx, nl WHERE CASE WHEN final_split = 'train' THEN l < 0 OR l >= c ELSE l <> -1 END),
cov AS (SELECT count(DISTINCT CASE WHEN l >= 0 AND l < c THEN l END) <> any_value(c) AS gap FROM bx, nl WHERE final_split = 'train')"""
_STATES = f"""pl AS (SELECT shard_path AS shard, relative_audio_path AS a, speaker_id AS b, speaker_label AS c, final_split AS d, within_shard_index AS e FROM idx),
stx AS (SELECT * FROM pl WHERE NOT ends_with(a, '777.wav') AND shard <> 'validation/shard_00000.pt' UNION ALL SELECT 'final_test/shard_99999.pt', a, b, c, d, e FROM pl WHERE shard = 'final_test/shard_00000.pt'),
pg AS (SELECT shard, count(*) AS n, list((a, b, c, d, e) ORDER BY a) AS r FROM pl GROUP BY 1), sg AS (SELECT shard, count(*) AS n, list((a, b, c, d, e) ORDER BY a) AS r FROM stx GROUP BY 1),
states AS (SELECT coalesce(pg.shard, sg.shard) AS shard, coalesce(pg.n, 0) AS planned, coalesce(sg.n, 0) AS stored, CASE WHEN sg.n IS NULL THEN 'missing' WHEN pg.n IS NULL THEN 'unexpected' WHEN pg.r = sg.r THEN 'valid' ELSE 'different' END AS state FROM pg FULL JOIN sg ON pg.shard = sg.shard)"""
_CACHE = f"""cfg AS (SELECT sha256('{{"feature_bins":80,"feature_frames":301,"shard_size":512}}') AS h),
ci AS (SELECT final_split, count(*) AS n_rows, count(DISTINCT shard_path) AS n_shards, count(DISTINCT speaker_id) AS n_speakers FROM idx GROUP BY 1),
ch AS ({" UNION ALL ".join(f"SELECT '{x}' AS final_split, identity FROM ({IDENTITY('SELECT ' + _json(relative_audio_path='relative_audio_path', speaker_id='speaker_id', speaker_label_n='speaker_label', final_split='final_split', manifest_row_index_n='manifest_row_index', shard_path='shard_path', within_shard_index_n='within_shard_index') + f" AS j FROM idx WHERE final_split = '{x}'")})" for x in ("train", "validation", "final_test"))}),
cid AS (SELECT 'fbank-cache' AS kind, final_split, n_rows, n_shards, n_speakers, identity AS index_identity, h AS config_sha256 FROM ci JOIN ch USING (final_split), cfg),
cache AS (SELECT *, sha256({_json(kind="kind", final_split="final_split", n_rows_n="n_rows", n_shards_n="n_shards", n_speakers_n="n_speakers", index_identity="index_identity", config_sha256="config_sha256")}) AS identity_sha256 FROM cid)"""
_counted = lambda *rules: "SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule FROM {q}" for r, q in rules) + ") GROUP BY 1"

ORACLE_SQL = {
    "index_rules": f"""WITH {INDEX}, {BENT} SELECT * FROM (
  SELECT 1 AS version, 'offset_range' AS rule, count(*) AS n FROM bx WHERE i >= 512 UNION ALL SELECT 1, 'label_range', n FROM lr UNION ALL SELECT 1, 'file_name_group', count(*) FROM bx WHERE g = 'other' UNION ALL SELECT 1, 'feature_metadata', count(*) FROM bx WHERE b <> 80
  UNION ALL SELECT 2, 'offset_range', count(*) FROM bx WHERE i >= 512 UNION ALL SELECT 2, 'label_range', n FROM lr UNION ALL SELECT 2, 'file_name_group', count(*) FROM bx WHERE g = 'other' UNION ALL SELECT 2, 'feature_metadata', count(*) FROM bx WHERE b <> 80
  UNION ALL SELECT 2, 'offset_of_row', count(*) FROM bx WHERE i <> manifest_row_index % 512 UNION ALL SELECT 2, 'label_coverage', count(*) FROM cov WHERE gap
  UNION ALL SELECT 3, 'offset_range', count(*) FROM bx WHERE i >= 512 UNION ALL SELECT 3, 'label_range', n FROM lr UNION ALL SELECT 3, 'label_coverage', count(*) FROM cov WHERE gap
  UNION ALL SELECT 3, 'shard_of_row', count(*) FROM b3 WHERE rr // 512 <> manifest_row_index // 512 UNION ALL SELECT 3, 'offset_of_row', count(*) FROM b3 WHERE i <> rr % 512
  UNION ALL SELECT 3, 'gapless_rows', count(*) FROM (SELECT final_split FROM b3 GROUP BY 1 HAVING min(rr) <> 0 OR max(rr) <> count(*) - 1 OR count(DISTINCT rr) <> count(*))) WHERE n > 0""",
    "normalised_index": f"""WITH {INDEX} SELECT relative_audio_path, speaker_label, CASE final_split WHEN 'train' THEN 'train' WHEN 'final_test' THEN 'test' ELSE '' END AS filename_group, '' AS duplicate_group, CASE WHEN final_split = 'final_test' THEN 'v2' ELSE '' END AS manifest_version, -1 AS manifest_row_index FROM idx""",
    "shard_contract": """WITH v AS (SELECT vec_id, 'train/shard_' || lpad(CAST(vec_id // 512 AS VARCHAR), 5, '0') || '.pt' AS key FROM embeddings)
SELECT DISTINCT 'finite_features' AS rule, key FROM v WHERE vec_id % 900 = 7 UNION ALL SELECT DISTINCT 'feature_shape', key FROM v WHERE vec_id % 900 = 7 UNION ALL SELECT DISTINCT 'identifiers', key FROM v WHERE vec_id % 700 = 3""",
    "shard_states": f"WITH {INDEX}, {_STATES} SELECT * FROM states",
    "plan_state": f"""WITH {INDEX}, {_STATES}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE state = 'valid') AS valid, count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'different') AS conflicts FROM states WHERE state <> 'unexpected')
SELECT *, CASE WHEN conflicts > 0 THEN NULL WHEN total > 0 AND missing = 0 THEN 'complete' WHEN valid > 0 THEN 'resume' ELSE 'new' END AS plan FROM c""",
    "concat_shards": f"WITH {INDEX} SELECT relative_audio_path, row_number() OVER (ORDER BY shard_path, within_shard_index) - 1 AS position FROM idx",
    "saved_scores": f"WITH {EMB},{_scores()} SELECT l || ' ' || r AS trial_id, target, score FROM sc",
    "saved_json": f"WITH {SPLIT} SELECT {_json(relative_audio_path='relative_audio_path', speaker_id='speaker_id', speaker_label_n='speaker_label', final_split='final_split')} AS line FROM man",
    "published_package": f"""WITH {INDEX} SELECT 'speaker_split' AS "table", count(*) AS n_rows, 'created' AS first, 'verified_existing' AS second FROM split UNION ALL SELECT 'speaker_to_label', count(*), 'created', 'verified_existing' FROM lab
UNION ALL SELECT 'manifest', count(*), 'created', 'verified_existing' FROM man UNION ALL SELECT 'feature_index', count(*), 'created', 'verified_existing' FROM idx""",
    "saved_csv": f"""WITH {SPLIT}, l0 AS (SELECT row_number() OVER (ORDER BY relative_audio_path) - 1 AS p, relative_audio_path || ',' || speaker_id || ',' || speaker_label || ',' || final_split AS line FROM man),
l1 AS (SELECT p // 1024 AS p, sha256(string_agg(sha256(line), chr(10) ORDER BY p)) AS h FROM l0 GROUP BY p // 1024),
l2 AS (SELECT p // 1024 AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h FROM l1 GROUP BY p // 1024), l3 AS (SELECT p // 1024 AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h FROM l2 GROUP BY p // 1024),
l4 AS (SELECT p // 1024 AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h FROM l3 GROUP BY p // 1024)
SELECT (SELECT count(*) FROM l0) AS n_lines, (SELECT CAST(sum(strlen(line) + 1) AS BIGINT) FROM l0) AS n_bytes, (SELECT sha256(string_agg(h, chr(10) ORDER BY p)) FROM l4) AS identity, CAST(0 AS BIGINT) AS n_differences, CAST(1 AS BIGINT) AS n_reversed""",
    "snapshots": """WITH d AS (SELECT event_id AS n, sha256('{"modified":' || user_id || ',"path":"' || user_id || '/' || event_id || '","size":' || event_id || '}') AS d FROM events),
x AS (SELECT n, [CAST(CAST('0x' || substr(d, 1 + 16 * k, 16) AS UBIGINT) AS HUGEINT) FOR k IN range(0, 4)] AS l FROM d),
s AS (SELECT state, count(*) AS c, sum(l[1]) % 18446744073709551616 AS a, sum(l[2]) % 18446744073709551616 AS b, sum(l[3]) % 18446744073709551616 AS e, sum(l[4]) % 18446744073709551616 AS f
  FROM x, (VALUES ('whole'), ('merged'), ('removed')) v(state) WHERE state <> 'removed' OR n % 7 <> 0 GROUP BY 1)
SELECT state, c AS n_rows, sha256(concat_ws('|', c, a, b, e, f)) AS identity FROM s""",
    "stored_index": f"""WITH {INDEX}, sh AS (SELECT shard_path AS shard, final_split = 'train' AS later, count(*) AS n_rows FROM idx GROUP BY 1, 2),
sp AS (SELECT *, (row_number() OVER (PARTITION BY later ORDER BY shard) - 1) // 40 AS pack FROM sh)
SELECT shard, CAST(pack AS INTEGER) AS pack, CAST(coalesce(sum(n_rows) OVER (PARTITION BY later, pack ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row, n_rows FROM sp""",
    "stored_totals": f"""WITH {INDEX}, sh AS (SELECT final_split = 'train' AS later, count(DISTINCT shard_path) AS n, count(*) AS c FROM idx GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_shards, CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum((n + 39) // 40) AS BIGINT) AS n_files FROM sh""",
    "stored_shards": f"""WITH {INDEX}, p AS (SELECT *, row_number() OVER (ORDER BY shard_path, within_shard_index) - 1 AS position FROM idx)
SELECT relative_audio_path, shard_path, within_shard_index, position FROM p WHERE regexp_matches(shard_path, '_0000[01][.]')""",
    "cache_identity": f"WITH {INDEX}, {_CACHE} SELECT * FROM cache",
    "identity_contract": f"""WITH {INDEX}, {_CACHE} {_counted(("field_n_shards", "cache WHERE n_shards <> 1"), ("self_hash", "cache WHERE final_split = 'train'"))}""",
    "trial_identity": f"""WITH {UTT},{_neighbours("utt")}, ends AS (SELECT s, count(*) AS n FROM (SELECT ls AS s FROM tr UNION ALL SELECT rs FROM tr) GROUP BY 1),
ti AS ({IDENTITY("SELECT " + _json(left_audio_path="l", right_audio_path="r", left_speaker_id="ls", right_speaker_id="rs", target_n="target") + " AS j FROM tr")}), mi AS ({IDENTITY("SELECT " + _json(path="path", speaker_id="speaker_id") + " AS j FROM utt")}),
one AS (SELECT 'verification-trials' AS kind, (SELECT count(*) FROM tr WHERE target = 1) AS genuine, (SELECT count(*) FROM tr WHERE target = 0) AS impostor, (SELECT count(*) FROM ends) AS n_speakers, (SELECT min(n) FROM ends) AS least_endpoints, (SELECT max(n) FROM ends) AS most_endpoints, ti.identity AS trials_identity, mi.identity AS manifest_identity FROM ti, mi)
SELECT *, sha256({_json(kind="kind", genuine_n="genuine", impostor_n="impostor", n_speakers_n="n_speakers", least_endpoints_n="least_endpoints", most_endpoints_n="most_endpoints", trials_identity="trials_identity", manifest_identity="manifest_identity")}) AS identity_sha256 FROM one""",
    "score_alignment": f"""WITH {EMB},{_scores()}, k AS (SELECT * FROM sc WHERE NOT ends_with(l, '77.wav')) {_counted(
        ("missing_score", "sc WHERE ends_with(l, '77.wav') OR ends_with(l, '31.wav')"), ("known_trial", "k WHERE ends_with(l, '31.wav')"), ("target_of_trial", "k WHERE ends_with(l, '5.wav')"), ("unique_score", "k WHERE ends_with(l, '9.wav')"))}""",
    "input_guards": f"""WITH e AS (SELECT vec_id, label FROM embeddings) {_counted(("embedding_dimension", "e WHERE vec_id % 50 = 0"), ("label_range", "e WHERE label < 0 OR label >= 9"), ("relative_length", "e WHERE vec_id % 101 = 0"))}""",
    "checkpoint_contract": f"""WITH u AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1) {_counted(
        ("cursor_steps", "u WHERE u % 10 = 0"), ("scheduler_steps", "u WHERE u % 10 = 0"), ("cursor_range", "u WHERE n % 40 > 32"), ("sampler_state", "u WHERE u % 8 <> u % 7"), ("final_test_untouched", "u WHERE u % 90 = 0"), ("stopping_rule", "u WHERE u % 60 = 0"))}""",
    "duration_totals": f"WITH {SPLIT} SELECT final_split, count(*) AS n_rows, printf('%.1f', round(sum(30 + CAST(speaker_id AS BIGINT) % 10) / 10.0, 1)) AS total FROM man GROUP BY 1",
    "lineage_contract": f"""WITH {UTT}, m AS (SELECT * FROM utt WHERE NOT ends_with(path, '77.wav')), p AS (SELECT * FROM utt WHERE NOT ends_with(path, '5.wav')),
d AS (SELECT path FROM p WHERE path NOT IN (SELECT path FROM m) UNION ALL SELECT path FROM m WHERE path NOT IN (SELECT path FROM p))
{_counted(("same_paths", "d"), ("declared_rows", "(SELECT count(*) AS c FROM m) WHERE c <> 1"), ("declared_speakers", "(SELECT count(DISTINCT speaker_id) AS c FROM m) WHERE c <> 1"), ("external_check", "(SELECT 1)"))}""",
    "provenance_contract": f"""WITH {UTT} {_counted(("unique_path_ignoring_case", "utt WHERE ends_with(path, '7.wav')"), ("unique_path", "utt WHERE ends_with(path, '77.wav')"))}""",
    "train_guard": f"""WITH {INDEX} {_counted(("train_split", "idx WHERE final_split <> 'train'"), ("train_shard_path", "idx WHERE NOT regexp_full_match(shard_path, 'train/shard_[0-9]{5,}.pt')"), ("train_label", "idx WHERE speaker_label < 0 OR speaker_label >= 100"))}""",
    "sampler_contract": f"""WITH {INDEX}, t AS (SELECT speaker_id, speaker_label + CASE WHEN {_E("77.wav")} THEN 1 ELSE 0 END AS l FROM idx WHERE final_split = 'train'),
g AS (SELECT count(*) AS n, min(l) AS lo, max(l) AS hi FROM (SELECT DISTINCT l FROM t))
SELECT 'one_label_per_speaker' AS rule, speaker_id AS key, '' AS detail FROM t GROUP BY speaker_id HAVING count(DISTINCT l) > 1
UNION ALL SELECT 'one_speaker_per_label', CAST(l AS VARCHAR), '' FROM t GROUP BY l HAVING count(DISTINCT speaker_id) > 1 UNION ALL SELECT 'contiguous_labels', 'labels', '' FROM g WHERE lo <> 0 OR hi <> n - 1""",
    "bound_files": f"""WITH d AS (SELECT doc_id, text FROM documents) {_counted(("bound_hash", "d WHERE (doc_id % 10 = 1 OR text IS NULL) AND doc_id % 25 <> 0"), ("bound_names", "d WHERE doc_id % 25 = 0"), ("no_final_test", "d WHERE doc_id % 40 = 3 AND doc_id % 25 <> 0"))}""",
    "absolute_roots": "SELECT 'no_absolute_root' AS rule, count(*) AS n FROM pages WHERE coalesce(contains(html, 'example.org'), true) HAVING count(*) > 0",
    "config_contract": "SELECT 'config' AS rule, count(*) FILTER (WHERE p_size IS DISTINCT FROM 10) + count(*) FILTER (WHERE p_brand IS DISTINCT FROM 'Brand#4') AS n FROM part",
    "inference": "SELECT vec_id, CAST(d AS INTEGER) AS dim, round(CAST(CAST(CAST(embedding[d + 1] AS DOUBLE) * 2 - embedding[d + 33] AS FLOAT) AS DOUBLE), 5) + 0.0 AS value FROM embeddings, (SELECT unnest(range(0, 32)) AS d)",
    "artifact_reuse": f"""WITH e AS (SELECT vec_id FROM embeddings) {_counted(("binding", "e WHERE vec_id % 70 = 0 AND vec_id % 100 <> 0"), ("missing_embedding", "e WHERE vec_id % 100 = 0 AND vec_id % 90 <> 1"), ("unexpected_embedding", "e WHERE vec_id % 90 = 1 AND vec_id % 100 <> 0"))}""",
    "full_batches": f"WITH {UTT}, r AS (SELECT path, row_number() OVER (ORDER BY {_digest("'0'", 'path')}, path) - 1 AS n FROM utt) SELECT n // 32 AS batch_id, CAST(n % 32 AS INTEGER) AS slot, path FROM r WHERE n // 32 BETWEEN 2 AND (SELECT count(*) // 32 - 1 FROM utt)",
    "trial_scores": f"WITH {EMB},{_scores()} SELECT l AS left_audio_path, r AS right_audio_path, target, score FROM sc",
    "eer_trials": f"""WITH {EMB},{_scores()}, {_points()}, {_eer()}
SELECT (SELECT count(*) FROM sc WHERE target = 1) AS n_genuine, (SELECT count(*) FROM sc WHERE target = 0) AS n_impostor, {_R("eer", "eer_threshold")},
  round(e_n.threshold, 9) AS empirical_threshold, round(e_n.far, 9) AS empirical_far, round(e_n.frr, 9) AS empirical_frr FROM e, e_n""",
    "operating_points": f"WITH {EMB},{_scores()}, {_points()} SELECT {_R('threshold', 'far', 'frr')}, is_anchor FROM pt",
    "empirical_errors_grid": f"""WITH {EMB},{_scores()},
grid AS (SELECT DISTINCT round(unnest(quantile_cont(score, {[k / 100 for k in range(0, 101, 5)]})), 9) AS threshold FROM sc)
SELECT threshold, round(avg(CASE WHEN target = 0 THEN CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END END), 9) AS far,
  round(avg(CASE WHEN target = 1 THEN CASE WHEN score < threshold THEN 1.0 ELSE 0.0 END END), 9) AS frr FROM grid, sc GROUP BY 1""",
    "score_summary_by_target": f"""WITH {EMB},{_scores()} SELECT target, count(*) AS "count", round(min(score), 6) AS minimum, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS standard_deviation,
  round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3, round(max(score), 6) AS maximum FROM sc GROUP BY 1""",
    "evaluation_report": f"""WITH {EMB},{_scores()}, {_points()}, {_eer()},
g AS (SELECT target, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median FROM sc GROUP BY 1),
i AS ({IDENTITY("SELECT " + _json(left_audio_path="l", right_audio_path="r", target_n="target") + " AS j FROM sc")})
SELECT a.n AS n_genuine, b.n AS n_impostor, round(e.eer, 9) AS eer, round(e.eer_threshold, 9) AS eer_threshold, a.mean AS genuine_mean, a.median AS genuine_median, b.mean AS impostor_mean, b.median AS impostor_median, i.identity AS trials_identity
FROM e, i, (SELECT * FROM g WHERE target = 1) a, (SELECT * FROM g WHERE target = 0) b""",
    "generalization_gap": f"""WITH {EMB},{_scores("vec_id % 2 = 1", "sc1", "t1")}, {_points("pt1", "sc1")}, {_eer("pt1", "e1")},{_scores("vec_id % 2 = 0", "sc0", "t0")}, {_points("pt0", "sc0")}, {_eer("pt0", "e0")}
SELECT round(e1.eer - e0.eer, 9) AS gap FROM e1, e0""",
    "speaker_split": f"WITH {SPLIT} SELECT * FROM split",
    "train_labels": f"WITH {SPLIT} SELECT * FROM lab",
    "portable_manifest": f"WITH {SPLIT} SELECT * FROM man",
    "split_counts": f"WITH {SPLIT} SELECT final_split, count(*) AS n_rows, count(DISTINCT speaker_id) AS n_speakers FROM man GROUP BY 1",
    "split_overlap": f"""WITH {SPLIT} SELECT (SELECT count(*) FROM (SELECT speaker_id FROM man GROUP BY 1 HAVING count(DISTINCT final_split) > 1)) AS shared_speakers,
  (SELECT count(*) FROM (SELECT relative_audio_path FROM man GROUP BY 1 HAVING count(DISTINCT final_split) > 1)) AS shared_paths""",
    "contract_violations": f"""WITH {UTT}, u AS (SELECT path, speaker_id FROM utt UNION ALL SELECT * FROM (VALUES {_BROKEN})),
x AS (SELECT *, string_split(path, '/') AS parts FROM u)
SELECT 'portable_path' AS rule, path AS key, '' AS detail FROM x WHERE NOT (path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, chr(92)) AND NOT contains(path, ':') AND len(parts) = 2 AND NOT list_has_any(parts, ['..', '', '.']))
UNION ALL SELECT 'parent_is_speaker', path, '' FROM x WHERE coalesce(parts[-2], '') <> speaker_id
UNION ALL SELECT 'wav_suffix', path, '' FROM x WHERE NOT ends_with(lower(path), '.wav')
UNION ALL SELECT 'empty_speaker', path, '' FROM x WHERE speaker_id = ''
UNION ALL SELECT 'unique_path', path, CAST(count(*) AS VARCHAR) FROM x GROUP BY path HAVING count(*) > 1
UNION ALL SELECT 'unique_path_ignoring_case', lower(path), CAST(count(DISTINCT path) AS VARCHAR) FROM x GROUP BY lower(path) HAVING count(DISTINCT path) > 1""",
    "manifest_invariants": f"""WITH {SPLIT} SELECT 'row_split_is_speaker_split' AS rule, count(*) AS n FROM man WHERE final_split <> 'validation' AND ends_with(relative_audio_path, '7.wav') HAVING count(*) > 0""",
    "provenance_diff": """SELECT doc_id AS key, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""",
    "case_collisions": "SELECT lower(p_name) AS folded, count(*) AS n_rows, count(DISTINCT p_name) AS n_spellings FROM part GROUP BY 1 HAVING count(*) > 1",
    "canonical_identity": f"""WITH {UTT} {IDENTITY("SELECT '{\"path\":\"' || path || '\",\"speaker_id\":\"' || speaker_id || '\"}' AS j FROM utt")}""",
    "package_identities": f"""WITH {INDEX}, parts AS (
  SELECT 'speaker_split' AS "table", * FROM ({IDENTITY("SELECT " + _json(speaker_id="speaker_id", split="split", ranking_sha256="ranking_sha256") + " AS j FROM split")})
  UNION ALL SELECT 'speaker_to_label', * FROM ({IDENTITY("SELECT " + _json(speaker_id="speaker_id", label_n="label") + " AS j FROM lab")})
  UNION ALL SELECT 'manifest', * FROM ({IDENTITY("SELECT " + _json(relative_audio_path="relative_audio_path", speaker_id="speaker_id", speaker_label_n="speaker_label", final_split="final_split") + " AS j FROM man")})
  UNION ALL SELECT 'feature_index', * FROM ({IDENTITY("SELECT " + _json(relative_audio_path="relative_audio_path", speaker_id="speaker_id", speaker_label_n="speaker_label", final_split="final_split", manifest_row_index_n="manifest_row_index", shard_path="shard_path", within_shard_index_n="within_shard_index") + " AS j FROM idx")}))
SELECT * FROM parts""",
    "shard_index": f"WITH {INDEX} SELECT relative_audio_path, speaker_id, speaker_label, final_split, manifest_row_index, shard_path, within_shard_index FROM idx",
    "shard_payload_sizes": f"WITH {INDEX} SELECT final_split, shard_path, count(*) AS n_rows, count(DISTINCT speaker_id) AS n_speakers, min(within_shard_index) AS first, max(within_shard_index) AS last FROM idx GROUP BY 1, 2",
    "index_shard_alignment": f"WITH {INDEX} SELECT final_split, count(*) AS n_rows, count(*) FILTER (WHERE NOT ends_with(shard_path, '/shard_00000.pt')) AS n_agree FROM idx GROUP BY 1",
    "cache_completeness": f"""WITH {INDEX}, left_over AS (SELECT * FROM idx WHERE NOT ends_with(relative_audio_path, '77.wav')),
r AS (SELECT final_split, count(*) AS n, count(DISTINCT shard_path) AS s FROM left_over GROUP BY 1),
t AS (SELECT final_split, shard_path, count(*) AS m, max(shard_path) OVER (PARTITION BY final_split) AS top FROM left_over GROUP BY 1, 2),
v AS (SELECT 'number_of_shards' AS rule FROM r WHERE s <> ceil(n / 512.0) UNION ALL SELECT 'rows_of_shard' FROM t JOIN r USING (final_split) WHERE m <> CASE WHEN shard_path = top THEN (n - 1) % 512 + 1 ELSE 512 END)
SELECT rule, count(*) AS n FROM v GROUP BY 1""",
    "genuine_quota": f"WITH {UTT}, {QUOTA('genuine-quota', TOTAL)} SELECT * FROM quota",
    "genuine_trials": f"WITH {UTT}, {GENUINE} SELECT l AS left_audio_path, r AS right_audio_path, s AS left_speaker_id, s AS right_speaker_id, 1 AS target FROM gen",
    "impostor_speaker_pairs": f"WITH {UTT}, {SPEAKER_PAIRS} SELECT position, speaker_a, speaker_b FROM sp",
    "impostor_trials": f"WITH {UTT}, {SPEAKER_PAIRS}, {IMPOSTORS} SELECT l.path AS left_audio_path, r.path AS right_audio_path, l.s AS left_speaker_id, r.s AS right_speaker_id, 0 AS target, position FROM imp",
    "balanced_trials": f"""WITH {UTT}, {GENUINE}, {SPEAKER_PAIRS}, {IMPOSTORS},
all_t AS (SELECT l AS left_audio_path, r AS right_audio_path, s AS left_speaker_id, s AS right_speaker_id, 1 AS target, s, d, 0 AS position FROM gen UNION ALL SELECT l.path, r.path, l.s, r.s, 0, '', '', position FROM imp)
SELECT 'trial-' || lpad(CAST(row_number() OVER (ORDER BY target DESC, s, d, position) - 1 AS VARCHAR), 5, '0') AS trial_id, left_audio_path, right_audio_path, left_speaker_id, right_speaker_id, target FROM all_t""",
    "paired_rounds": f"WITH {UTT}, {_rounds('negative-speaker', '6', False)} SELECT l AS left_audio_path, r AS right_audio_path, ls AS left_speaker_id, rs AS right_speaker_id, 0 AS target, round FROM made",
    # Twice the first number of rounds: later rounds change nothing in earlier ones, and the first ones are taken.
    "legacy_trials": f"""WITH {UTT}, p AS (SELECT DISTINCT * FROM utt),
po AS (SELECT speaker_id AS s, path, row_number() OVER (PARTITION BY speaker_id ORDER BY {_digest("'genuine'", "path")}, path) - 1 AS place, count(*) OVER (PARTITION BY speaker_id) AS n FROM p),
pz AS (SELECT DISTINCT s, n * (n - 1) // 2 AS z FROM po),
pg AS (SELECT *, (z + ls - 1) // ls AS rs FROM (SELECT *, CAST(ceil(sqrt(z)) AS BIGINT) AS ls FROM pz)),
pk AS (SELECT *, unnest(range(0, least(100, z))) AS k FROM pg),
pn AS (SELECT s, {_permuted("k", "z", "'genuine'", "s")} AS x FROM pk),
pj AS (SELECT s, x, CAST(floor((1 + sqrt(1 + 8 * x)) / 2) AS BIGINT) AS j FROM pn),
gen AS (SELECT pj.s, least(u.path, v.path) AS l, greatest(u.path, v.path) AS r FROM pj JOIN po u ON u.s = pj.s AND u.place = x - j * (j - 1) // 2 JOIN po v ON v.s = pj.s AND v.place = j), need AS (SELECT count(*) AS c FROM gen),
{_rounds('negative-speaker', "(SELECT CAST(2 * (ceil(c / greatest(1, (SELECT count(*) // 2 FROM sizes))) + 2) AS BIGINT) FROM need)", True)},
imp AS (SELECT *, row_number() OVER (ORDER BY round, {_digest("'impostor'", "'order'", "l", "r")}) AS n FROM made),
all_t AS (SELECT 1 AS target, l, r, s AS ls, s AS rs FROM gen UNION ALL SELECT 0, l, r, ls, rs FROM imp WHERE n <= (SELECT c FROM need))
SELECT row_number() OVER (ORDER BY {_digest("'mixed'", "l", "r")}, l, r) - 1 AS trial_id, target, l AS left_audio_path, r AS right_audio_path, ls AS left_speaker_id, rs AS right_speaker_id FROM all_t""",
    "neighbour_trials": f"WITH {UTT},{_neighbours('utt')} SELECT l AS left_audio_path, r AS right_audio_path, ls AS left_speaker_id, rs AS right_speaker_id, target FROM tr",
    "trial_participation": f"""WITH {UTT},{_neighbours("utt")}, ends AS (SELECT ls AS speaker_id, target FROM tr UNION ALL SELECT rs, target FROM tr WHERE target = 0)
SELECT speaker_id, count(*) FILTER (WHERE target = 1) AS genuine_trials, count(*) FILTER (WHERE target = 0) AS impostor_endpoints FROM ends GROUP BY 1""",
    "trial_validity": f"""WITH {UTT},{_neighbours("utt")}, bent AS (SELECT *, CASE WHEN ends_with(l, '7.wav') THEN 1 - target ELSE target END AS t FROM tr),
v AS (SELECT 'target_is_same_speaker' AS rule FROM bent WHERE (t = 1) <> (ls = rs)
  UNION ALL SELECT 'balanced_targets' FROM (SELECT count(*) FILTER (WHERE t = 1) AS g, count(*) FILTER (WHERE t = 0) AS i FROM bent) WHERE g <> i
  UNION ALL SELECT 'unique_pair' FROM (SELECT l, r FROM bent GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'unique_id' FROM (SELECT target, l, r FROM bent GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'represented_speaker' FROM (SELECT DISTINCT speaker_id FROM utt) u WHERE NOT EXISTS (SELECT 1 FROM bent WHERE ls = u.speaker_id OR rs = u.speaker_id))
SELECT rule, count(*) AS n FROM v GROUP BY 1""",
    "random_batches": f"WITH {UTT}, r AS (SELECT path, row_number() OVER (ORDER BY {_digest("'0'", 'path')}, path) - 1 AS n FROM utt) SELECT n // 32 AS batch_id, CAST(n % 32 AS INTEGER) AS slot, path FROM r",
    "pk_batches": f"WITH {PK} SELECT * FROM pk",
    "hybrid_batches": HYBRID + "SELECT * FROM hybrid",
    "batch_exposure": HYBRID + "SELECT speaker_id, count(DISTINCT batch_id) AS exposure, max(cycle) AS queue_cycles FROM hybrid GROUP BY 1",
    "batch_shards": HYBRID + "SELECT batch_id, count(DISTINCT shard_path) AS n_shards FROM hybrid GROUP BY 1",
    "epoch_stats": f"""WITH {PK}, a AS (SELECT path, count(*) AS n FROM pk GROUP BY 1), b AS (SELECT speaker_id, count(DISTINCT batch_id) AS e, max(cycle) AS c FROM pk GROUP BY 1)
SELECT (SELECT count(DISTINCT batch_id) FROM pk) AS batches, (SELECT count(*) FROM pk) AS logical_selections, (SELECT count(*) FROM a) AS unique_selected,
  CAST((SELECT sum(n - 1) FROM a) AS BIGINT) AS repeated_selections, CAST((SELECT sum(c) FROM b) AS BIGINT) AS queue_cycles, (SELECT min(e) FROM b) AS min_exposure, (SELECT max(e) FROM b) AS max_exposure""",
    "round_robin": f"WITH {PK} SELECT batch_id, slot, speaker_id, path, position FROM rr",
    "microbatches": f"WITH {PK} SELECT batch_id, CAST(position // {P} AS BIGINT) AS microbatch, count(*) AS n_rows, count(DISTINCT speaker_id) AS n_speakers, count(DISTINCT speaker_id) = count(*) AS distinct_speakers FROM rr GROUP BY 1, 2",
    "collated_batches": f"WITH {PK} SELECT batch_id, string_agg(path, ' ' ORDER BY slot) AS paths, string_agg(speaker_id, ' ' ORDER BY slot) AS speakers FROM pk GROUP BY 1",
    "class_centroids": f"WITH {CENTROIDS} SELECT class, CAST(dim AS INTEGER) AS dim, round(w, 6) AS weight FROM cen",
    "softmax_logits": f"WITH {CENTROIDS} SELECT vec_id, class, round(30.0 * c, 5) AS logit FROM cosine",
    "aam_logits": f"WITH {CENTROIDS} SELECT vec_id, class, round(logit, 5) AS logit FROM aam",
    "cross_entropy": f"""WITH {CENTROIDS}, m AS (SELECT vec_id, max(logit) AS m FROM aam GROUP BY 1)
SELECT aam.vec_id, round(ln(sum(exp(logit - m))) + any_value(m) - max(CASE WHEN label = class THEN logit END), 5) AS loss FROM aam JOIN m USING (vec_id) GROUP BY 1""",
    "cosine_lr": """WITH s AS (SELECT unnest(range(0, CAST(ceil(count(*) / 32.0) AS BIGINT))) AS step, CAST(ceil(count(*) / 32.0) AS BIGINT) - 1 AS h FROM events),
f AS (SELECT step, 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, step / CAST(greatest(1, h) AS DOUBLE)))) AS factor FROM s)
SELECT step, round(factor, 9) AS factor, round(0.001 * factor, 12) AS learning_rate FROM f""",
    "early_stopping": """WITH RECURSIVE d AS (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch, round(avg(value), 6) AS value FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY epoch) AS i FROM d),
f AS (
  SELECT event_type, 0 AS i, CAST('infinity' AS DOUBLE) AS best, -1 AS best_epoch, 0 AS bad, -1 AS stopped, 0 AS n FROM (SELECT DISTINCT event_type FROM d)
  UNION ALL SELECT f.event_type, f.i + 1, CASE WHEN value < best - 1e-4 THEN value ELSE best END, CASE WHEN value < best - 1e-4 THEN epoch ELSE best_epoch END,
    CASE WHEN value < best - 1e-4 THEN 0 ELSE bad + 1 END, CASE WHEN value >= best - 1e-4 AND bad + 1 >= 2 THEN epoch ELSE -1 END, f.n + 1
  FROM f JOIN o ON o.event_type = f.event_type AND o.i = f.i + 1 WHERE stopped < 0
)
SELECT event_type, best, best_epoch, stopped AS stopped_epoch, n AS epochs_run FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY i DESC) AS z FROM f) WHERE z = 1""",
    "mean_var_norm": f"""WITH {CENTROIDS}, spread AS (SELECT label, k, sqrt(var_pop(x) + 1e-10) AS s FROM dim GROUP BY 1, 2)
SELECT vec_id, CAST(dim.k AS INTEGER) AS dim, round((x - m) / s, 5) AS value FROM dim JOIN mean ON mean.label = dim.label AND mean.k = dim.k JOIN spread ON spread.label = dim.label AND spread.k = dim.k""",
    "mean_norm": f"WITH {CENTROIDS} SELECT vec_id, CAST(dim.k AS INTEGER) AS dim, round(x - m, 6) AS value FROM dim JOIN mean ON mean.label = dim.label AND mean.k = dim.k",
    "framing": """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events),
f AS (SELECT user_id, value, unnest(range(greatest(0, CAST(ceil((p - 4) / 2.0) AS BIGINT)), p // 2 + 1)) AS frame FROM p)
SELECT user_id, frame, count(*) AS n, round(avg(value), 6) AS mean FROM f GROUP BY 1, 2 HAVING count(*) = 5""",
    "max_difference": f"""WITH {CENTROIDS}, e AS (SELECT x, abs(round(x, 4) - x) AS d FROM dim)
SELECT count(*) AS n, round(max(d), 6) AS max_abs_diff, bool_and(d <= 1e-6 + 1e-5 * abs(x)) AS all_close FROM e""",
    "norm_and_delta": f"""WITH {CENTROIDS} SELECT round(sqrt(sum(x * x / 4)), 4) AS norm, round(max(abs(x / 2)), 4) AS max_delta, round(sum(abs(x / 2)), 4) AS sum_delta, CAST(0 AS BIGINT) AS n_bad FROM dim""",
}

ORACLE_SQL["legacy_ids"] = f"""WITH lt AS ({ORACLE_SQL["legacy_trials"]}), s AS (SELECT count(*) AS n, min(trial_id) AS lo, max(trial_id) AS hi FROM lt WHERE trial_id % 1000 <> 999)
SELECT 'contiguous_ids' AS rule, 'trials' AS key, CAST(n AS VARCHAR) AS detail FROM s WHERE lo <> 0 OR hi <> n - 1"""

#: The WAV tree: one file a user, its events' values round and round.
_TREE = """wv AS (SELECT user_id AS u, greatest(-32768, least(32767, CAST(floor(value) AS BIGINT))) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS m FROM events),
wu AS (SELECT u, CAST(u AS VARCHAR) AS s, CAST(u AS VARCHAR) || '/0.wav' AS path, sum(x * (48000 // m + CASE WHEN k < 48000 % m THEN 1 ELSE 0 END)) AS total FROM wv GROUP BY u)"""
ORACLE_SQL |= {
    "wav_headers": f"WITH {_TREE} SELECT path, s AS speaker_id, 16000 AS sample_rate, 1 AS num_channels, 48000 AS num_samples, 2 AS sample_width FROM wu",
    "audio_contract": f"WITH {_TREE} SELECT 'audio_contract' AS rule, path AS key, 'sample_rate=8000' AS detail FROM wu WHERE u % 10 = 3",
    "wav_samples": f"WITH {_TREE} SELECT path, 48000 AS n, CAST(total AS BIGINT) AS total FROM wu",
    "wav_features": f"WITH {_TREE} SELECT path, 301 AS frames, 80 AS bins, true AS whole FROM wu",
    "wav_changes": f"WITH {_TREE} SELECT path, 'modified' AS change FROM wu WHERE u % 10 = 4 UNION ALL SELECT s || '/1.wav', 'added' FROM wu WHERE u % 10 = 5",
    "dataset_identity": f"""WITH {_TREE}, d AS (SELECT sha256('{{"path":"' || path || '","size":96044}}') AS d FROM wu), l AS (SELECT [CAST(CAST('0x' || substr(d, 1 + 16 * k, 16) AS UBIGINT) AS HUGEINT) FOR k IN range(0, 4)] AS l FROM d),
s AS (SELECT count(*) AS n, sha256(concat_ws('|', count(*), sum(l[1]) % 18446744073709551616, sum(l[2]) % 18446744073709551616, sum(l[3]) % 18446744073709551616, sum(l[4]) % 18446744073709551616)) AS h FROM l)
SELECT n AS n_files, n AS n_speakers, CAST(3 * n AS DOUBLE) AS seconds, 16000 AS sample_rate, 1 AS num_channels, h AS listing_sha256,
  sha256('{{"listing_sha256":"' || h || '","n_files":' || n || ',"n_speakers":' || n || ',"num_channels":1,"sample_rate":16000,"seconds":' || CAST(3 * n AS VARCHAR) || '.0}}') AS identity_sha256 FROM s""",
    "created_package": f"WITH {_TREE}, {UTT.replace('FROM events', 'FROM (SELECT DISTINCT user_id, 0 AS event_id FROM events)')}, {SPLIT.removeprefix(UTT + ',')} SELECT 'created' AS first, 'verified_existing' AS second, final_split, count(*) AS n_rows FROM man GROUP BY 3",
    "built_cache": ORACLE_SQL["cache_identity"],
    "read_manifest": ORACLE_SQL["portable_manifest"],
    "exact_write": f"WITH {UTT} SELECT state, (SELECT count(*) FROM utt) AS n_rows FROM (VALUES ('1 created'), ('2 unchanged'), ('3 refused')) v(state)",
    "config_files": "SELECT event_type, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY 1",
    "first_batch": "SELECT rule, key FROM (VALUES ('feature_shape', '1'), ('finite_features', '1'), ('feature_shape', '2')) v(rule, key) WHERE EXISTS (SELECT 1 FROM embeddings)",
    "canonical_pairs": f"WITH {UTT},{_neighbours('utt')} SELECT l AS low, r AS high, count(*) AS n FROM tr GROUP BY 1, 2",
    "shortest_floats": "SELECT event_id, power, CAST(value * CASE power WHEN 0 THEN 1.0::DOUBLE WHEN 14 THEN 1e14 ELSE 1e-7 END AS VARCHAR) AS text FROM events, (VALUES (0), (14), (-7)) v(power)",
    "checkpoint_store": "SELECT u AS next_epoch, CAST(n % 32 AS BIGINT) AS position, CAST(u * 32 + n % 32 AS BIGINT) AS optimizer_steps, 1 AS versions_before FROM (SELECT 2 AS u, count(*) AS n FROM events)",
    "final_once": f"WITH {EMB},{_scores()} SELECT count(*) FILTER (WHERE target = 1) AS n_genuine, count(*) FILTER (WHERE target = 0) AS n_impostor, 'refused' AS again FROM sc",
    "fed_batches": f"WITH {PK} SELECT batch_id, count(*) AS n_rows, min(path) AS first, true AS ascending FROM pk GROUP BY 1",
}
