"""DuckDB SQL for the queries of the catalogue. Where there is none, tests hold the query against brute force."""

from __future__ import annotations

from ..functions import vocabulary as V
from .listings import COLUMNS, LISTINGS, ORDER

ROW = "l_orderkey, " + ", ".join(ORDER)
TIE = ", ".join(ORDER)
L = f"l AS ({LISTINGS})"

_ENRICH = f"""{L},
e0 AS (SELECT *, CASE WHEN price_m2 > 0 THEN price_m2::DOUBLE WHEN price > 0 AND square_m2 > 0 THEN price / square_m2 END AS pm2, lower(trim(coalesce(finish_type, ''))) AS fin, lower(trim(coalesce(furniture, ''))) AS fur,
  lower(trim(coalesce(seller_type, ''))) AS st, photo_count::INT AS ph FROM l),
e AS (SELECT *, CASE WHEN fin = 'черновая' THEN 'rough' WHEN fin IN ('чистовая', 'предчистовая') THEN 'finished' ELSE 'unknown' END AS finish,
  coalesce(floor_total >= floor AND (floor = 1 OR floor = floor_total), false) AS extreme,
  requires_manual_review = 'True' OR pm2 IS NULL OR rooms IS NULL AS excluded,
  CASE WHEN owner_name = 'Хозяин' THEN 'owner' WHEN regexp_matches(st, 'owner|хозя|собствен') THEN 'owner' WHEN regexp_matches(st, 'agent|риел|агент|company|компан') THEN 'agent' WHEN owner_name <> '' THEN 'agent' ELSE 'unknown' END AS seller_class FROM e0),
w AS (SELECT *, list_filter([CASE WHEN pm2 IS NULL THEN 'нет_price_m2' END, CASE WHEN rooms IS NULL THEN 'нет_rooms' END, CASE WHEN square_m2 IS NULL THEN 'нет_square_m2' END, CASE WHEN fin = '' THEN 'finish_type_неизвестен' END,
  CASE WHEN ph <= 0 THEN 'нет_фото' WHEN ph < 5 THEN 'мало_фото' END, CASE WHEN requires_manual_review = 'True' THEN 'есть_red_flag' END,
  CASE seller_class WHEN 'agent' THEN 'риелтор_или_агентство' WHEN 'unknown' THEN 'продавец_не_определён' END], lambda x: x IS NOT NULL) AS warn,
  greatest(0, least(100, 40.0 + CASE fin WHEN 'чистовая' THEN 20 WHEN 'предчистовая' THEN 10 WHEN 'черновая' THEN -15 ELSE 0 END
  + least(15, 5 * len(premium_markers::JSON::VARCHAR[])) + CASE WHEN fur NOT IN ('', 'нет', '—', '-') THEN 8 ELSE 0 END + CASE WHEN fur = 'полностью' THEN 5 ELSE 0 END
  + CASE l_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END + CASE WHEN ph >= 10 THEN 10 WHEN ph >= 5 THEN 6 WHEN ph >= 1 THEN 2 ELSE -10 END - CASE WHEN requires_manual_review = 'True' THEN 15 ELSE 0 END))::DOUBLE AS quality FROM e)"""


def _ladder(pool: str, targets: str, own: bool) -> str:
    """Rows of targets with level, size, median, mad and floor numbers by pairs. own: targets may be in the pool."""
    other = "AND p.id <> t.id" if own else ""
    ends = "count(pm2) AS n, quantile_cont(pm2, 0.25) AS a, quantile_cont(pm2, 0.75) AS b"
    edges = f"fe AS (SELECT finish, {ends} FROM pool GROUP BY finish),\nte AS (SELECT tid, n, a, b FROM t LEFT JOIN fe USING (finish)),\nta AS (SELECT tid, n, a, b FROM t, edge)"
    if own:
        ends = ends.replace("pm2", "p.pm2")
        edges = (
            f"te AS (SELECT t.tid, {ends} FROM t LEFT JOIN pool p ON p.finish = t.finish AND p.id <> t.id GROUP BY t.tid),\n"
            f"ta AS (SELECT t.tid, {ends} FROM t LEFT JOIN pool p ON p.id <> t.id GROUP BY t.tid)"
        )
    seg = lambda x: f"CASE WHEN coalesce({x}.n, 0) < 8 THEN 'комфорт' WHEN t.pm2 <= {x}.a THEN 'эконом' WHEN t.pm2 >= {x}.b THEN 'бизнес' ELSE 'комфорт' END"
    km = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(p.latitude) - radians(t.latitude)) / 2), 2) + cos(radians(t.latitude)) * cos(radians(p.latitude)) * pow(sin((radians(p.longitude) - radians(t.longitude)) / 2), 2))))"
    return f"""{_ENRICH},
pool0 AS (SELECT * FROM w WHERE {pool} AND NOT excluded),
edge AS (SELECT count(*) AS n, quantile_cont(pm2, 0.25) AS a, quantile_cont(pm2, 0.75) AS b FROM pool0),
pool AS (SELECT p.*, CASE WHEN n < 8 THEN 'комфорт' WHEN pm2 <= a THEN 'эконом' WHEN pm2 >= b THEN 'бизнес' ELSE 'комфорт' END AS seg FROM pool0 p, edge),
city AS (SELECT rooms, median(pm2) AS med FROM pool GROUP BY rooms),
tt AS (SELECT *, row_number() OVER () AS tid FROM w WHERE {targets}),
t AS (SELECT * FROM tt WHERE pm2 IS NOT NULL {'AND NOT excluded' if own else ''}),
{edges},
ts AS (SELECT t.*, {seg('te')} AS seg, {seg('ta')} AS price_segment FROM t JOIN te USING (tid) JOIN ta USING (tid)),
pairs AS (SELECT t.tid, t.extreme AS t_extreme, p.pm2, p.extreme, t.complex_id = p.complex_id AS l1, t.street = p.street AND t.seg = p.seg AS l3, {km} AS km, p.pm2 BETWEEN c.med * (1 - 0.3::DOUBLE) AND c.med * (1 + 0.3::DOUBLE) AS band
  FROM ts t JOIN pool p ON t.finish = p.finish AND t.rooms = p.rooms {other} LEFT JOIN city c ON c.rooms = t.rooms),
counts AS (SELECT tid, count(*) FILTER (WHERE l1) AS n1, count(*) FILTER (WHERE l3) AS n3, count(*) FILTER (WHERE km <= 1) AS n4, count(*) FILTER (WHERE km <= 3 AND band) AS n5, count(*) AS n6,
  count(*) FILTER (WHERE km <= 1) AS near, count(*) FILTER (WHERE km <= 3) AS far FROM pairs GROUP BY tid),
lev AS (SELECT *, CASE WHEN n1 >= 3 THEN '1-2' WHEN n3 >= 3 THEN '3' WHEN n4 >= 3 THEN '4' WHEN n5 >= 3 THEN '5' ELSE '6' END AS level FROM counts),
rows AS (SELECT p.*, level FROM pairs p JOIN lev USING (tid) WHERE CASE level WHEN '1-2' THEN l1 WHEN '3' THEN l3 WHEN '4' THEN km <= 1 WHEN '5' THEN km <= 3 AND band ELSE true END),
st AS (SELECT tid, any_value(level) AS level, count(*) AS size, median(pm2) AS med, mad(pm2) AS mad, count(*) FILTER (WHERE extreme) AS ne, median(pm2) FILTER (WHERE extreme) AS me, count(*) FILTER (WHERE NOT extreme) AS nn, median(pm2) FILTER (WHERE NOT extreme) AS mn FROM rows GROUP BY tid),
wide AS (SELECT finish, rooms, count(*) FILTER (WHERE extreme) AS ne, median(pm2) FILTER (WHERE extreme) AS me, count(*) FILTER (WHERE NOT extreme) AS nn, median(pm2) FILTER (WHERE NOT extreme) AS mn FROM pool GROUP BY ALL),
j AS (SELECT tt.*, st.level, st.size, st.med, st.mad, ts.price_segment AS ps,
  CASE WHEN NOT tt.extreme THEN 1.0::DOUBLE WHEN st.ne >= 30 AND st.nn >= 30 AND st.mn > 0 THEN greatest(0.9, least(1.0, 0.75::DOUBLE * st.me / st.mn + 0.25::DOUBLE * 0.95))
    WHEN wide.ne >= 30 AND wide.nn >= 30 AND wide.mn > 0 THEN greatest(0.9, least(1.0, 0.75::DOUBLE * wide.me / wide.mn + 0.25::DOUBLE * 0.95)) ELSE 0.95 END::DOUBLE AS factor
  FROM tt LEFT JOIN st USING (tid) LEFT JOIN ts USING (tid) LEFT JOIN wide ON wide.finish = tt.finish AND wide.rooms = tt.rooms),
k AS (SELECT *, med * factor AS corrected, (med * factor - pm2) / (med * factor) AS diff,
  floor(greatest(0, least(1, 0.35::DOUBLE * least(1.0::DOUBLE, ln(1 + size::DOUBLE) / ln(31::DOUBLE)) + 0.65::DOUBLE * CASE level WHEN '1-2' THEN 1.0 WHEN '3' THEN 0.9 WHEN '4' THEN 0.78 WHEN '5' THEN 0.62 WHEN '6' THEN 0.42 ELSE 0 END::DOUBLE)) * 1000 + 0.5) / 1000 AS bench,
  greatest(0::DOUBLE, least(1::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * len(list_filter(warn, lambda x: x NOT IN ('риелтор_или_агентство', 'продавец_не_определён'))) - 0.25::DOUBLE * len(list_filter(warn, lambda x: x IN ('нет_price_m2', 'нет_rooms'))))) AS data FROM j),
m AS (SELECT *, floor((0.72::DOUBLE * bench + 0.28::DOUBLE * data) * 1000 + 0.5) / 1000 AS conf FROM k),
s AS (SELECT *, CASE WHEN pm2 IS NULL THEN 'insufficient_numeric_data' {"WHEN excluded THEN CASE WHEN requires_manual_review = 'True' THEN 'excluded_manual_review' ELSE 'excluded_installment' END" if own else ''} WHEN med IS NULL THEN 'no_comparables' ELSE 'scored' END AS status,
  CASE WHEN conf >= 0.75 THEN 0.1 WHEN conf >= 0.55 THEN 0.13 ELSE 0.18 END::DOUBLE AS lo, CASE WHEN conf >= 0.75 THEN -0.07 WHEN conf >= 0.55 THEN -0.1 ELSE -0.15 END::DOUBLE AS hi FROM m)"""


_SCORE = _ladder("l_orderkey % 100 <> 0", "l_orderkey % 100 = 0", False)
_WHOLE = _ladder("true", "false", False)
# the pool that is scored against itself has one row for each id
_ONCE = f"l AS (SELECT * FROM ({LISTINGS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC NULLS LAST, {TIE}) = 1)"
_SELF = _ladder("true", "l_orderkey % 100 = 0", True).replace(L, _ONCE)
_LEVEL = "CASE status WHEN 'scored' THEN level WHEN 'no_comparables' THEN 'none' END AS cohort_level, CASE status WHEN 'scored' THEN size WHEN 'no_comparables' THEN 0 END::BIGINT AS cohort_size"
_VERDICT = f"CASE WHEN status <> 'scored' THEN '{V.TOO_LITTLE}' WHEN requires_manual_review = 'True' THEN '{V.BY_HAND}' WHEN diff >= lo THEN '{V.FIND}' WHEN diff <= hi THEN '{V.OVERPRICED}' ELSE '{V.FAIR}' END AS verdict"

_REASON = """CASE WHEN price IS NULL OR price <= 0 THEN 'no_valid_price' WHEN square_m2 IS NULL OR square_m2 <= 0 THEN 'no_valid_square' WHEN rooms IS NULL THEN 'no_rooms'
  WHEN trim(storage) <> '' AND lower(trim(storage)) <> 'live' THEN 'not_live (storage=' || lower(trim(storage)) || ')' END"""
_CLEAN = f"{L}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC NULLS LAST, {TIE}) AS rn FROM l), c AS (SELECT *, CASE WHEN rn > 1 THEN 'duplicate_id' ELSE {_REASON} END AS drop_reason FROM r)"
_SELLER = "lower(trim(coalesce(owner_name, ''))) || chr(1) || lower(trim(coalesce(seller_type, '')))"


def _fold(source: str, group: str, order: str) -> str:
    """The greedy fold over the rows of source as a recursive CTE: (row columns, kept, rn)."""
    return f"""o AS (SELECT *, {_SELLER} AS s, coalesce(price, 0) AS pr, row_number() OVER (PARTITION BY {group} ORDER BY scraped_at DESC NULLS LAST, {order}) AS rn, dense_rank() OVER (ORDER BY {group}) AS g FROM {source}),
f AS (SELECT g, rn, true AS kept, [struct_pack(p := pr, s := s)] AS alive FROM o WHERE rn = 1
  UNION ALL SELECT o.g, o.rn, len(list_filter(alive, lambda x: x.p > 0 AND o.pr > 0 AND x.s <> o.s AND abs(x.p - o.pr) / greatest(x.p, o.pr) > 0.03)) > 0,
  CASE WHEN len(list_filter(alive, lambda x: x.p > 0 AND o.pr > 0 AND x.s <> o.s AND abs(x.p - o.pr) / greatest(x.p, o.pr) > 0.03)) > 0 THEN list_append(alive, struct_pack(p := o.pr, s := o.s)) ELSE alive END
  FROM f JOIN o ON o.g = f.g AND o.rn = f.rn + 1)"""


_CLUSTER = f"""{L}, k AS (SELECT *, lower(street) AS ks, house_num AS kh, floor AS kf, coalesce(rooms, '') AS kr, house_num <> '' AND square_m2 IS NOT NULL AS has FROM l),
g AS (SELECT *, CASE WHEN square_m2 - lag(square_m2) OVER win > 1.0 THEN 1 ELSE 0 END AS gap FROM k WHERE has WINDOW win AS (PARTITION BY ks, kh, kf, kr ORDER BY square_m2, {TIE})),
cl AS (SELECT *, sum(gap) OVER (PARTITION BY ks, kh, kf, kr ORDER BY square_m2, {TIE} ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g)"""

_EVENTS = """ev AS (SELECT user_id || '-' || event_type AS id, value AS price, ts, event_id, props FROM events),
known AS (SELECT * FROM ev WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1),
cur AS (SELECT * FROM ev WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1)"""
_CHANGES = f"""WITH {_EVENTS} SELECT id, price, 'new' AS reason, NULL::DOUBLE AS old_price FROM cur WHERE id NOT IN (SELECT id FROM known)
UNION ALL SELECT id, cur.price, 'price_drop', known.price FROM cur JOIN known USING (id) WHERE cur.price < known.price"""
_REGISTRY = """SELECT user_id::VARCHAR AS id, value AS price, event_id FROM events
QUALIFY value < coalesce(min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE)"""
_FENCE = """v AS (SELECT rooms, price AS x FROM l WHERE price IS NOT NULL), li AS (SELECT rooms, list_sort(list(x)) AS s, count(*) AS n FROM v GROUP BY rooms HAVING count(*) >= 8),
q AS (SELECT *, greatest(1, least(n - 1, (n + 1) // 4)) AS j1, greatest(1, least(n - 1, 3 * (n + 1) // 4)) AS j3 FROM li),
z AS (SELECT rooms, n, (s[j1] * (4 - ((n + 1) - 4 * j1)) + s[j1 + 1] * ((n + 1) - 4 * j1)) / 4 AS q1, (s[j3] * (4 - (3 * (n + 1) - 4 * j3)) + s[j3 + 1] * (3 * (n + 1) - 4 * j3)) / 4 AS q3 FROM q)"""

_OLD = f"""{_ENRICH},
o AS (SELECT *, CASE WHEN fin = 'черновая' THEN 'rough' ELSE 'finished' END AS f2, requires_manual_review = 'True' AS review, coalesce(floor = 1 OR floor = floor_total, false) AND floor_total IS NOT NULL AS ends FROM w),
po AS (SELECT * FROM o WHERE l_orderkey % 100 <> 0 AND NOT review),
tt AS (SELECT *, row_number() OVER () AS tid FROM o WHERE l_orderkey % 100 = 0),
t AS (SELECT * FROM tt WHERE pm2 IS NOT NULL AND NOT review),
city AS (SELECT rooms, median(pm2) AS med FROM po GROUP BY rooms),
pairs AS (SELECT t.tid, p.pm2, t.complex_id = p.complex_id AS l1,
  2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(p.latitude) - radians(t.latitude)) / 2), 2) + cos(radians(t.latitude)) * cos(radians(p.latitude)) * pow(sin((radians(p.longitude) - radians(t.longitude)) / 2), 2)))) AS km,
  p.pm2 BETWEEN c.med * (1 - 0.3::DOUBLE) AND c.med * (1 + 0.3::DOUBLE) AS band FROM t JOIN po p ON t.f2 = p.f2 AND t.rooms = p.rooms LEFT JOIN city c ON c.rooms = t.rooms),
lev AS (SELECT tid, CASE WHEN count(*) FILTER (WHERE l1) >= 3 THEN '1-2' WHEN count(*) FILTER (WHERE km <= 1) >= 3 THEN '4' WHEN count(*) FILTER (WHERE km <= 3 AND band) >= 3 THEN '5' ELSE '6' END AS level FROM pairs GROUP BY tid),
rows AS (SELECT p.*, level FROM pairs p JOIN lev USING (tid) WHERE CASE level WHEN '1-2' THEN l1 WHEN '4' THEN km <= 1 WHEN '5' THEN km <= 3 AND band ELSE true END),
found AS (SELECT tid, any_value(level) AS level, count(*) AS size, median(pm2) AS med FROM rows GROUP BY tid),
scored AS (SELECT tt.*, found.level, found.size, found.med, found.med * CASE WHEN ends THEN 0.95::DOUBLE ELSE 1.0 END AS base FROM tt LEFT JOIN found USING (tid))"""

def _baseline() -> str:
    """The stages of the pool builder one after the other: counts by stage and reason of what each drops, and of what is kept."""
    cluster = _CLUSTER.removeprefix(f"{L}, ").replace("FROM l)", "FROM k1)")
    photo = _fold("h", "photo_set_hash", TIE).replace("o AS (", "o1 AS (", 1).replace("f AS (", "f1 AS (", 1).replace("FROM o WHERE", "FROM o1 o WHERE").replace("FROM f JOIN o ON", "FROM f1 f JOIN o1 o ON")
    address = _fold("cl", "ks, kh, kf, kr, cluster", f"square_m2, {TIE}").replace("o AS (", "o2 AS (", 1).replace("f AS (", "f2 AS (", 1).replace("FROM o WHERE", "FROM o2 o WHERE").replace("FROM f JOIN o ON", "FROM f2 f JOIN o2 o ON")
    own = "id, " + ", ".join(c.rsplit(" AS ", 1)[-1] for c in COLUMNS[1:])

    def sane(n: int, value: str, low: float, high: float, label: str, stage: str) -> str:
        fence = _FENCE.replace("v AS", f"v{n} AS").replace("li AS", f"li{n} AS").replace("q AS", f"q{n} AS").replace("z AS", f"z{n} AS").replace("FROM l ", f"FROM b{n} ").replace("FROM v ", f"FROM v{n} ").replace("FROM li)", f"FROM li{n})").replace("FROM q)", f"FROM q{n})").replace("price AS x", "x AS x").replace("price IS", "x IS")
        return f"""x{n} AS (SELECT *, {value} AS x FROM k{n}), t{n} AS (SELECT *, CASE WHEN x IS NULL THEN 'no_valid_{label}_for_sanity_check' WHEN x < {low} THEN '{label}_too_low_hard' WHEN x > {high} THEN '{label}_too_high_hard' END AS why FROM x{n}),
b{n} AS (SELECT * FROM t{n} WHERE why IS NULL), {fence},
g{n} AS (SELECT b.*, coalesce(x < q1 - (q3 - q1) * 3 OR x > q3 + (q3 - q1) * 3, false) AS out FROM b{n} b LEFT JOIN z{n} z USING (rooms)),
k{n + 1} AS (SELECT {own} FROM g{n} WHERE NOT out),
d{n} AS (SELECT '{stage}' AS stage, why AS reason FROM t{n} WHERE why IS NOT NULL UNION ALL SELECT '{stage}', '{label}_outlier_iqr' FROM g{n} WHERE out)"""

    return f"""WITH RECURSIVE {_CLEAN}, k0 AS (SELECT {own} FROM c WHERE drop_reason IS NULL),
h AS (SELECT * FROM k0 WHERE trim(photo_set_hash) <> ''), {photo},
k1 AS (SELECT {own} FROM k0 WHERE trim(photo_set_hash) = '' UNION ALL SELECT {own} FROM o1 JOIN f1 USING (g, rn) WHERE kept),
{cluster}, {address},
k2 AS (SELECT {own} FROM k WHERE NOT has UNION ALL SELECT {own} FROM o2 JOIN f2 USING (g, rn) WHERE kept),
k3 AS (SELECT * FROM k2 WHERE NOT coalesce(floor > floor_total, false)),
{sane(3, "coalesce(price_m2::DOUBLE, CASE WHEN price <> 0 AND square_m2 <> 0 THEN price / square_m2 END)", V.PRICE_M2_BOUNDS[0], V.PRICE_M2_BOUNDS[1], "price_m2", "price_sanity")},
{sane(4, "square_m2::DOUBLE", V.AREA_BOUNDS[0], V.AREA_BOUNDS[1], "square_m2", "square_sanity")},
every AS (SELECT 'stage1' AS stage, regexp_extract(drop_reason, '^\\w+') AS reason FROM c WHERE drop_reason IS NOT NULL
UNION ALL SELECT 'photo_dedup', 'duplicate_photo_set_hash' FROM o1 JOIN f1 USING (g, rn) WHERE NOT kept UNION ALL SELECT 'address_layout_dedup', 'duplicate_address_layout' FROM o2 JOIN f2 USING (g, rn) WHERE NOT kept
UNION ALL SELECT 'floor_integrity', 'floor_gt_floor_total' FROM k2 WHERE floor > floor_total UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4
UNION ALL SELECT CASE WHEN requires_manual_review = 'True' THEN 'stage2_exclusion' ELSE 'kept' END, CASE WHEN requires_manual_review = 'True' THEN 'requires_manual_review' ELSE 'kept' END FROM k5)
SELECT stage, reason, count(*) AS n FROM every GROUP BY ALL"""


SQL = {
    "q_hard_clean": f"WITH {_CLEAN} SELECT {ROW}, CASE WHEN drop_reason IS NOT NULL THEN 'stage1' END AS drop_stage, drop_reason FROM c",
    "q_drop_reasons": f"WITH {_CLEAN} SELECT coalesce(regexp_extract(drop_reason, '^\\w+'), 'kept') AS reason, count(*) AS n FROM c GROUP BY 1",
    "q_dedup_freshest": f"WITH {_CLEAN} SELECT {ROW} FROM c WHERE rn = 1",
    "q_incoming_soft": f"""WITH {_CLEAN} SELECT id, {TIE}, to_json(list_filter([CASE WHEN price IS NULL OR price <= 0 THEN 'invalid_or_missing_price' END, CASE WHEN square_m2 IS NULL OR square_m2 <= 0 THEN 'invalid_or_missing_square' END,
  CASE WHEN rooms IS NULL THEN 'missing_rooms' END, CASE WHEN trim(storage) <> '' AND lower(trim(storage)) <> 'live' THEN 'not_live_storage:' || lower(trim(storage)) END, CASE WHEN trim(full_description) = '' THEN 'no_description' END], lambda x: x IS NOT NULL))::VARCHAR AS incoming_data_warnings FROM c WHERE rn = 1""",
    "q_photo_hash": "SELECT l_orderkey, sha256(array_to_string(list_sort(list('https://host/' || l_partkey || '-' || l_linenumber)), '|')) AS photo_set_hash, count(*) AS photo_count FROM lineitem GROUP BY l_orderkey",
    "q_photo_dedup": f"""WITH RECURSIVE {L}, h AS (SELECT * FROM l WHERE trim(photo_set_hash) <> ''), {_fold('h', 'photo_set_hash', TIE)}
SELECT {ROW}, CASE WHEN NOT kept THEN 'duplicate_photo_set_hash' END AS drop_reason, CASE WHEN kept AND rn > 1 THEN '{V.OTHER_SELLER}' END AS baseline_warning FROM o JOIN f USING (g, rn)
UNION ALL SELECT {ROW}, NULL, NULL FROM l WHERE trim(photo_set_hash) = ''""",
    "q_different_listing": f"""WITH {L}, x AS (SELECT *, {_SELLER} AS s FROM l WHERE photo_set_hash <> '')
SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS o_l_linenumber, a.l_extendedprice, b.l_extendedprice AS o_l_extendedprice,
  coalesce(a.price > 0 AND b.price > 0 AND abs(a.price - b.price) / greatest(a.price, b.price) > 0.03 AND a.s <> b.s, false) AS different FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""",
    "q_addr_clusters": f"WITH {_CLUSTER} SELECT {ROW}, cluster FROM cl UNION ALL SELECT {ROW}, NULL FROM k WHERE NOT has",
    "q_addr_dedup": f"""WITH RECURSIVE {_CLUSTER}, {_fold('cl', 'ks, kh, kf, kr, cluster', f'square_m2, {TIE}')}
SELECT {ROW}, NOT kept AS dropped, CASE WHEN kept AND rn > 1 THEN '{V.OTHER_SELLER}' END AS baseline_warning FROM o JOIN f USING (g, rn) UNION ALL SELECT {ROW}, false, NULL FROM k WHERE NOT has""",
    "q_floor_integrity": f"WITH {L} SELECT {ROW}, coalesce(floor > floor_total, false) AS dropped FROM l",
    "q_hard_bounds": f"WITH {L} SELECT {ROW}, CASE WHEN square_m2 IS NULL THEN 'no_valid_square_m2_for_sanity_check' WHEN square_m2 < 12 THEN 'square_m2_too_low_hard' WHEN square_m2 > 45 THEN 'square_m2_too_high_hard' ELSE 'kept' END AS reason FROM l",
    "q_iqr_exclusive": f"WITH {L}, {_FENCE} SELECT rooms, n, q1, q3, q1 - (q3 - q1) * 3 AS low, q3 + (q3 - q1) * 3 AS high FROM z",
    "q_iqr_filter": f"""WITH {L.replace('l AS', 'l0 AS')}, l AS (SELECT * REPLACE (price / square_m2 AS price) FROM l0), {_FENCE}
SELECT {ROW}, coalesce(price < q1 - (q3 - q1) * 3 OR price > q3 + (q3 - q1) * 3, false) AS dropped FROM l LEFT JOIN z USING (rooms)""",
    "q_segments": f"WITH {_WHOLE} SELECT {ROW}, seg AS segment FROM pool",
    "q_city_median": f"WITH {_WHOLE} SELECT rooms, med AS city_median FROM city",
    "q_robust_stats": f"WITH {L} SELECT coalesce(trim(finish_type), '-') AS flag, count(*) AS size, median(price / square_m2) AS median, mad(price / square_m2) AS mad FROM l WHERE price / square_m2 IS NOT NULL GROUP BY 1",
    "q_floor_factor": f"""WITH {_WHOLE} SELECT rooms, finish, ne AS n_extreme, nn AS n_normal, round(CASE WHEN ne >= 30 AND nn >= 30 AND mn > 0 THEN greatest(0.9, least(1.0, 0.75::DOUBLE * me / mn + 0.25::DOUBLE * 0.95)) ELSE 0.95 END::DOUBLE, 9) AS factor FROM wide""",
    "q_seller_class": f"""WITH {_ENRICH} SELECT {ROW}, seller_class, CASE WHEN owner_name = 'Хозяин' THEN 1.0 WHEN seller_class = 'owner' THEN CASE WHEN is_identity_confirmed = 'True' THEN 1.0 ELSE 0.85 END WHEN regexp_matches(st, 'агент') THEN 0.9 WHEN owner_name <> '' THEN 0.8 ELSE 0.35 END::DOUBLE AS seller_confidence,
  CASE WHEN owner_name = 'Хозяин' THEN 'owner_name=Хозяин' WHEN seller_class = 'owner' THEN 'seller_type указывает на владельца' WHEN regexp_matches(st, 'агент') THEN 'seller_type указывает на агентство/риелтора' WHEN owner_name <> '' THEN 'указано конкретное имя вместо ''Хозяин''' ELSE 'маркер владельца/риелтора не определён' END AS seller_reason FROM e""",
    "q_finish_bucket": f"WITH {_ENRICH} SELECT finish, extreme, rooms, excluded, count(*) AS n FROM e GROUP BY ALL",
    "q_warnings": f"WITH {_ENRICH} SELECT {ROW}, array_to_string(warn, ';') AS data_warnings FROM w",
    "q_quality": f"WITH {_ENRICH} SELECT {ROW}, quality FROM w",
    "q_haversine_pairs": f"""WITH {L} SELECT {ROW}, round(1000 * 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(51.1) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(51.1)) * pow(sin((radians(71.4) - radians(longitude)) / 2), 2)))), 3) AS metres FROM l""",
    "q_radius_join": f"WITH {_SCORE}, d AS (SELECT * FROM tt JOIN lev USING (tid)) SELECT {ROW}, sum(near)::BIGINT AS near, sum(far)::BIGINT AS far FROM d WHERE far > 0 GROUP BY {ROW}",
    "q_cohort_ladder": f"WITH {_SCORE} SELECT {ROW}, {_LEVEL}, CASE WHEN status = 'scored' THEN med END AS base_price_m2 FROM s",
    "q_score": f"""WITH {_SCORE} SELECT {ROW}, status, {_VERDICT}, CASE WHEN status = 'scored' THEN ps END AS price_segment, {_LEVEL}, round(corrected, 6) AS base_price_m2_corrected, round(diff, 6) AS diff_pct,
  CASE WHEN status = 'scored' AND mad > 0 THEN round(greatest(-10, least(10, 0.6745::DOUBLE * (pm2 - med) / mad)), 6) END AS robust_z, CASE status WHEN 'scored' THEN round(bench, 6) WHEN 'no_comparables' THEN 0 END::DOUBLE AS benchmark_confidence, round(data, 6) AS data_confidence,
  round(quality, 6) AS quality_evidence_score, CASE WHEN status = 'scored' THEN round(greatest(0, least(100, 0.65::DOUBLE * greatest(0, least(100, 50 + 500 * diff)) + 0.25::DOUBLE * quality + 0.1::DOUBLE * (100 * (0.72::DOUBLE * bench + 0.28::DOUBLE * data)))), 6) END AS price_quality_score,
  CASE WHEN status = 'scored' THEN CASE WHEN diff >= 0.1 AND quality >= 55 THEN 'сильное цена/качество' WHEN diff >= 0.05 THEN 'хорошее цена/качество' WHEN diff <= -0.1 THEN 'слабое цена/качество' ELSE 'обычное цена/качество' END
    || CASE WHEN ph < 5 THEN '; качество не подтверждено фото' ELSE '' END || CASE WHEN fin = '' THEN '; состояние не подтверждено текстом' ELSE '' END END AS price_quality_label, array_to_string(warn, ';') AS data_warnings FROM s""",
    "q_verdict_hist": f"WITH {_SCORE} SELECT verdict, cohort_level, count(*) AS n FROM (SELECT {_VERDICT}, {_LEVEL} FROM s) GROUP BY ALL",
    "q_score_self": f"WITH {_SELF} SELECT {ROW}, status, {_LEVEL}, CASE WHEN status = 'scored' THEN ps END AS price_segment, CASE WHEN status = 'scored' THEN round(diff, 6) END AS diff_pct FROM s",
    "q_overlay_join": f"""WITH {_EVENTS} SELECT c.id, c.event_id AS row_id, coalesce(CASE WHEN c.event_id % 3 <> 0 THEN c.price END, k.price) AS price, coalesce(nullif(CASE WHEN c.event_id % 2 = 0 THEN '' ELSE c.props END, ''), k.props, CASE WHEN c.event_id % 2 = 0 THEN '' ELSE c.props END) AS props, k.event_id AS detail_id
FROM (SELECT * FROM ev WHERE event_id % 2 = 1) c LEFT JOIN known k USING (id)""",
    "q_upsert": f"""WITH {_EVENTS}, li AS (SELECT id, CASE WHEN event_id % 5 <> 0 THEN price END AS price, ts, event_id FROM cur)
SELECT k.id, CASE WHEN li.price IS NOT NULL THEN li.price ELSE k.price END AS price, CASE WHEN li.price IS NOT NULL THEN li.ts ELSE k.ts END AS ts, k.event_id FROM known k LEFT JOIN li USING (id)
UNION ALL SELECT id, price, ts, event_id FROM li WHERE id NOT IN (SELECT id FROM known)""",
    "q_new_ids": f"WITH {_EVENTS} SELECT id, price FROM cur WHERE id NOT IN (SELECT id FROM known)",
    "q_price_drops": f"WITH {_EVENTS} SELECT id, known.price AS old_price, cur.price AS new_price, round(known.price - cur.price, 6) AS price_drop FROM cur JOIN known USING (id) WHERE cur.price < known.price",
    "q_state_replace": _CHANGES,
    "q_semi_anti": "SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer",
    "q_registry": _REGISTRY,
    "q_registry_known": """WITH o AS (SELECT user_id, min(value) AS m FROM events WHERE event_id % 4 = 0 GROUP BY user_id), n AS (SELECT e.*, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events e WHERE event_id % 4 <> 0)
SELECT n.user_id::VARCHAR AS id, value AS price, event_id FROM n LEFT JOIN o USING (user_id) WHERE value < least(coalesce(m, 'inf'::DOUBLE), coalesce(b, 'inf'::DOUBLE))""",
    "q_page_title": "SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) AS title, (CASE WHEN page_id % 2 = 0 THEN page_id % 50 + 1 ELSE 1 END)::BIGINT AS pages FROM pages",
    "q_page_links": """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages)
SELECT page_id, href, try_cast(nullif(regexp_replace(label, '[^0-9]', '', 'g'), '') AS BIGINT) AS number FROM h WHERE href <> ''""",
    "q_page_digits": "SELECT page_id, try_cast(nullif(regexp_extract(url, '/(\\d+)(#|$)', 1), '') AS BIGINT) AS number FROM pages",
    "q_json_props": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "q_llm_cache_join": """WITH r AS (SELECT doc_id, text, quality FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT doc_id, quality, sha256('2' || chr(10) || 'extract' || chr(10) || text) AS hash FROM r)
SELECT doc_id, hash, CASE WHEN doc_id % 2 = 0 THEN quality END::BIGINT AS result, quality IS NOT NULL AND doc_id % 2 = 0 AS hit FROM n""",
    "q_red_flags": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'чистовая' END AS finish_type, CASE doc_id % 3 WHEN 0 THEN '["залив"]' WHEN 1 THEN '["требует_капремонта"]' ELSE '[]' END AS red_flags, doc_id % 3 = 0 AS excluded FROM documents""",
    "q_notification_rows": f"""WITH {_SCORE}, v AS (SELECT *, {_VERDICT}, {_LEVEL} FROM s) SELECT id, 'new' AS reason, 'fast_track' AS source, '2026-01-01T00:00:00+00:00' AS sent_at, verdict, cohort_level, cohort_size::VARCHAR AS cohort_size, seller_class, array_to_string(warn, ';') AS data_warnings, '' AS url, title
FROM v WHERE price > 0 AND (verdict = '{V.FIND}' OR verdict = '{V.BY_HAND}' AND diff >= 0.1)""",
    "q_baseline": _baseline(),
    "q_old_score": f"""WITH {_OLD} SELECT {ROW}, CASE WHEN review THEN 'excluded_manual_review' WHEN pm2 IS NULL THEN 'no_price_m2' WHEN med IS NULL THEN 'no_comparables' ELSE 'scored' END AS status,
  level AS cohort_level, size::BIGINT AS cohort_size, round((base - pm2) / base, 6) AS diff_pct FROM scored""",
    "q_stream_registry": _REGISTRY,
    "q_stream_diff": _CHANGES,
}
