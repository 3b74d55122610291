"""DuckDB SQL for the queries of ``lectern.plans.queries``: the model tables as common table expressions."""

from __future__ import annotations

SEGMENTS = """
ev AS (SELECT event_id // 100 AS rec_id, epoch_us(ts) AS us, value FROM events),
bd AS (SELECT rec_id, min(us) AS lo, max(us) AS hi FROM ev GROUP BY rec_id),
raw0 AS (SELECT ev.rec_id, coalesce((us - lo)::DOUBLE / nullif((hi - lo)::DOUBLE, 0::DOUBLE), 0::DOUBLE) * 900::DOUBLE AS start_s, value FROM ev JOIN bd USING (rec_id)),
raw AS (SELECT rec_id, start_s, start_s + value / 20 AS end_s FROM raw0),
ra AS (SELECT *, start_s - max(end_s) OVER (PARTITION BY rec_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM raw),
rb AS (SELECT *, sum(CASE WHEN gap < 0.3::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM ra),
segments AS (SELECT rec_id, min(start_s) AS start_s, max(end_s) AS end_s FROM rb GROUP BY rec_id, island),
recordings AS (SELECT rec_id, greatest(905::DOUBLE, max(end_s)) AS duration_s FROM segments GROUP BY rec_id)"""

SPEECH = """
nb AS (SELECT s.*, duration_s, start_s - lag(end_s, 1, 0::DOUBLE) OVER w AS l, coalesce(lead(start_s) OVER w, duration_s) - end_s AS r
       FROM segments s JOIN recordings USING (rec_id) WINDOW w AS (PARTITION BY rec_id ORDER BY start_s, end_s)),
speech AS (SELECT rec_id, start_s, end_s FROM nb WHERE NOT (end_s - start_s < 1.5::DOUBLE AND least(l, r) >= 1.5::DOUBLE AND l + r >= 4::DOUBLE))"""

GAPS = """
gp AS (SELECT rec_id, duration_s, s.start_s, s.end_s, lag(s.end_s) OVER w AS pe, lead(s.start_s) OVER w AS ns
       FROM recordings LEFT JOIN {segs} s USING (rec_id) WINDOW w AS (PARTITION BY rec_id ORDER BY s.start_s, s.end_s)),
gaps0 AS (
  SELECT rec_id, coalesce(pe, 0::DOUBLE) AS start_s, start_s AS end_s, CASE WHEN pe IS NULL THEN 'intro' ELSE 'inside' END AS place FROM gp WHERE start_s IS NOT NULL
  UNION ALL SELECT rec_id, end_s, duration_s, 'outro' FROM gp WHERE ns IS NULL AND start_s IS NOT NULL
  UNION ALL SELECT rec_id, 0::DOUBLE, duration_s, 'all' FROM gp WHERE start_s IS NULL),
gaps AS (SELECT * FROM gaps0 WHERE end_s - start_s >= 0.5::DOUBLE OR place = 'all')"""

MUSIC = """
music AS (SELECT vec_id // 14 AS rec_id, ((vec_id % 14) * 64 + i - 1)::INTEGER AS sec, abs(embedding[i]::DOUBLE) + CASE WHEN ((vec_id % 14) * 64 + i - 1) % 97 < 12 THEN 0.35::DOUBLE ELSE 0::DOUBLE END AS prob
          FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
touched AS (SELECT DISTINCT rec_id, unnest(range(floor(start_s)::BIGINT, ceil(end_s)::BIGINT))::INTEGER AS sec FROM speech),
series AS (SELECT music.*, touched.sec IS NOT NULL AS speech FROM music LEFT JOIN touched USING (rec_id, sec))"""

FRAMES = """
frames AS (SELECT l_orderkey // 375 AS rec_id, (row_number() OVER (PARTITION BY l_orderkey // 375 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount) - 1) * 0.6::DOUBLE AS t_s,
           round(20 * log10(l_discount + 1e-9::DOUBLE), 6) AS db, l_discount * l_discount AS power FROM lineitem)"""

FRAMES_IN = "fi AS (SELECT f.rec_id, f.db, f.power, s.start_s, s.end_s FROM frames f JOIN speech s ON s.rec_id = f.rec_id AND f.t_s >= s.start_s AND f.t_s < s.end_s)"

LEVELS = f"""{FRAMES_IN}, sl AS (SELECT rec_id, median(l) AS speech_db FROM (SELECT rec_id, 20 * log10(sqrt(avg(power)) + 1e-9::DOUBLE) AS l FROM fi GROUP BY rec_id, start_s) GROUP BY rec_id),
    pz AS (SELECT rec_id, end_s AS a, lead(start_s) OVER (PARTITION BY rec_id ORDER BY start_s, end_s) AS b FROM speech),
    pl AS (SELECT rec_id, median(m) AS bg FROM (SELECT f.rec_id, median(f.db) AS m FROM frames f JOIN pz ON pz.rec_id = f.rec_id AND f.t_s >= a AND f.t_s < b WHERE b - a >= 0.3::DOUBLE GROUP BY f.rec_id, a) GROUP BY rec_id),
    po AS (SELECT rec_id, quantile_cont(db, 0.1) AS p10 FROM frames GROUP BY rec_id),
    lv AS (SELECT rec_id, coalesce(speech_db, -30::DOUBLE) AS speech_db, coalesce(bg, p10) AS background_db FROM recordings LEFT JOIN sl USING (rec_id) LEFT JOIN pl USING (rec_id) LEFT JOIN po USING (rec_id))"""

KINDS = """
gf AS (SELECT g.rec_id, g.start_s, quantile_cont(f.db, 0.95) AS peak, 20 * log10(sqrt(avg(power)) + 1e-9::DOUBLE) AS rms FROM gaps g JOIN frames f ON f.rec_id = g.rec_id AND f.t_s >= g.start_s AND f.t_s < g.end_s GROUP BY 1, 2),
    gs AS (SELECT rec_id, start_s, unnest(range(floor(start_s)::BIGINT, greatest(ceil(end_s), floor(start_s) + 1)::BIGINT))::INTEGER AS sec FROM gaps),
    gm AS (SELECT rec_id, start_s, avg((prob >= 0.3::DOUBLE)::INTEGER) AS ms FROM gs JOIN music USING (rec_id, sec) GROUP BY 1, 2),
    kinds AS (SELECT rec_id, start_s, end_s, place, CASE WHEN coalesce(ms, 0) >= 0.5 THEN 'музыка' WHEN coalesce(peak, -120) < -50 OR coalesce(peak, -120) < background_db + 12 THEN 'тишина'
           WHEN coalesce(rms, -120) < speech_db - 10 THEN 'тихие звуки' ELSE 'шум/другое' END AS kind
    FROM gaps LEFT JOIN gf USING (rec_id, start_s) LEFT JOIN gm USING (rec_id, start_s) LEFT JOIN lv USING (rec_id))"""

UNDER = """
ma AS (SELECT *, (prob >= 0.3::DOUBLE)::INTEGER AS r FROM series), mb AS (SELECT *, min(r) OVER w AS core FROM ma WINDOW w AS (PARTITION BY rec_id ORDER BY sec ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    mc AS (SELECT *, (max(core) OVER w) * r = 1 AND speech AS m FROM mb WINDOW w AS (PARTITION BY rec_id ORDER BY sec ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    md AS (SELECT *, m OR (lag(m, 1, false) OVER w AND lead(m, 1, false) OVER w) AS f FROM mc WINDOW w AS (PARTITION BY rec_id ORDER BY sec)),
    me AS (SELECT rec_id, sec, sec - row_number() OVER (PARTITION BY rec_id ORDER BY sec) AS island FROM md WHERE f),
    mf AS (SELECT rec_id, min(sec)::DOUBLE AS start_s, least((max(sec) + 1)::DOUBLE, any_value(duration_s)) AS end_s FROM me JOIN recordings USING (rec_id) GROUP BY rec_id, island HAVING count(*) >= 2),
    under AS (SELECT * FROM mf WHERE NOT (end_s - start_s <= 4 AND EXISTS (SELECT 1 FROM kinds k WHERE k.rec_id = mf.rec_id AND kind = 'музыка' AND (abs(mf.start_s - k.end_s) <= 1 OR abs(k.start_s - mf.end_s) <= 1))))"""

BAD = """
bad AS (SELECT rec_id, start_s, end_s, [CASE WHEN place = 'all' THEN 'нет речи' ELSE kind END] AS reasons FROM kinds
        WHERE (place IN ('intro', 'outro', 'all') AND end_s - start_s >= 3::DOUBLE) OR (place = 'inside' AND (end_s - start_s > 7::DOUBLE OR (kind = 'музыка' AND end_s - start_s >= 2::DOUBLE)))
        UNION ALL SELECT rec_id, start_s, end_s, ['музыка под речью'] FROM under)"""


def merged(source: str, name: str) -> str:
    """Cuts merged by merge_gap and min_keep; ``source`` has rec_id, start_s, end_s, reasons."""
    return f"""
{name}a AS (SELECT *, start_s - max(end_s) OVER (PARTITION BY rec_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM {source}),
{name}b AS (SELECT *, sum(CASE WHEN gap <= 1::DOUBLE OR gap < 8::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM {name}a),
{name}c AS (SELECT *, row_number() OVER (PARTITION BY rec_id, island ORDER BY start_s, end_s) AS rn FROM {name}b),
{name}d AS (SELECT rec_id, island, start_s, end_s, CASE WHEN rn > 1 AND gap > 1::DOUBLE THEN list_append(reasons, 'короткий кусок между вырезами') ELSE reasons END AS reasons FROM {name}c),
{name} AS (SELECT rec_id, min(start_s) AS start_s, max(end_s) AS end_s, list_sort(list_distinct(flatten(list(reasons)))) AS reasons FROM {name}d GROUP BY rec_id, island)"""


CUTS = (
    merged("bad", "mg")
    + """,
cuts AS (SELECT * FROM (SELECT rec_id, CASE WHEN start_s <= 1 THEN 0::DOUBLE ELSE round_even(start_s, 0) END AS start_s,
                CASE WHEN end_s >= duration_s - 1 THEN duration_s ELSE floor(end_s) END AS end_s, reasons FROM mg JOIN recordings USING (rec_id)) WHERE end_s > start_s)"""
)

GAPS_OF_SEGMENTS = GAPS.format(segs="segments")
GAPS_OF_SPEECH = GAPS.format(segs="speech")
HEARD = ",".join([SEGMENTS, SPEECH, GAPS_OF_SPEECH, MUSIC, FRAMES, LEVELS, KINDS])
BASE = ",".join([HEARD, UNDER, BAD, CUTS])

BACKGROUND = """
bg0 AS (SELECT *, sum(prob) OVER (PARTITION BY rec_id ORDER BY sec ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9::DOUBLE AS mean, (prob >= 0.1::DOUBLE / 2)::INTEGER AS loud FROM series),
bg1 AS (SELECT *, lag(loud, 1, 0) OVER w AS b1, lag(loud, 2, 0) OVER w AS b2, lag(loud, 3, 0) OVER w AS b3, lag(loud, 4, 0) OVER w AS b4,
               loud AS f1, lead(loud, 1, 0) OVER w AS f2, lead(loud, 2, 0) OVER w AS f3, lead(loud, 3, 0) OVER w AS f4 FROM bg0 WINDOW w AS (PARTITION BY rec_id ORDER BY sec)),
bg2 AS (SELECT rec_id, sec, b1 + b1 * b2 + b1 * b2 * b3 + b1 * b2 * b3 * b4 AS back, f1 + f1 * f2 + f1 * f2 * f3 + f1 * f2 * f3 * f4 AS fore FROM bg1),
bg3 AS (SELECT rec_id, sec, sec - row_number() OVER (PARTITION BY rec_id ORDER BY sec) AS island FROM bg0 WHERE round(mean, 12) >= 0.1::DOUBLE AND speech),
bg4 AS (SELECT rec_id, min(sec) AS a, max(sec) + 1 AS b FROM bg3 GROUP BY rec_id, island HAVING count(*) >= 10),
background AS (SELECT bg4.rec_id, (a - x.back)::DOUBLE AS start_s, least((b + coalesce(y.fore, 0))::DOUBLE, duration_s) AS end_s FROM bg4
               JOIN bg2 x ON x.rec_id = bg4.rec_id AND x.sec = a LEFT JOIN bg2 y ON y.rec_id = bg4.rec_id AND y.sec = b JOIN recordings r ON r.rec_id = bg4.rec_id)"""

WORDS = """
ln AS (SELECT doc_id AS rec_id, l.i - 1 AS line, l.t AS t FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda t, i: {'i': i, 't': t})) AS l FROM documents)),
wd AS (SELECT rec_id, line, p.i AS k, p.w AS word FROM (SELECT rec_id, line, unnest(list_transform(list_filter(regexp_split_to_array(t, '[ \\t\\r]+'), lambda w: w <> ''), lambda w, i: {'i': i, 'w': w})) AS p FROM ln)),
we AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY line, k) - 1 AS word_no FROM wd),
words AS (SELECT rec_id, word_no, 0.5::DOUBLE + 0.4::DOUBLE * word_no + 1::DOUBLE * line AS start_s, 0.5::DOUBLE + 0.4::DOUBLE * word_no + 1::DOUBLE * line + 0.3::DOUBLE AS end_s, word FROM we),
wrec AS (SELECT rec_id, max(end_s) + 2::DOUBLE AS duration_s FROM words GROUP BY rec_id)"""

CATALOG = """
lb AS (SELECT doc_id AS page_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id),
catalog AS (SELECT (page_id + 2)::INTEGER AS "row", right(md5(substr(regexp_extract(html, '<title>([^<]*)</title>', 1), 1, 12)), 11) AS id, url AS link,
            CASE WHEN quality = 1 AND page_id % 3 = 0 THEN '0:10-0:20' ELSE '' END AS cuts, CASE WHEN quality = 0 AND page_id % 5 = 0 THEN '?' ELSE '' END AS note,
            coalesce(toxic = 1, false) OR page_id % 17 = 0 AS red FROM pages LEFT JOIN lb USING (page_id)),
firsts AS (SELECT id, min("row") AS first_row FROM catalog GROUP BY id),
cat AS (SELECT * FROM catalog JOIN firsts USING (id))"""


def fmt(t: str, down: bool = False) -> str:
    s = f"(CASE WHEN {t} > 0 THEN {'floor' if down else 'round_even'}({t}{'' if down else ', 0'}) ELSE 0 END)::BIGINT"
    return f"(CASE WHEN {s} >= 3600 THEN printf('%d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) ELSE printf('%d:%02d', {s} // 60, {s} % 60) END)"


TIMECODES = f"""
tc AS (SELECT rec_id, string_agg((CASE WHEN start_s <= 0 THEN 'start' ELSE {fmt('start_s')} END) || '-' || (CASE WHEN end_s >= duration_s THEN 'end' ELSE {fmt('end_s', True)} END), ', ' ORDER BY start_s, end_s) AS t
       FROM cuts JOIN recordings USING (rec_id) GROUP BY rec_id)"""

KEPT = """
kp AS (SELECT rec_id, duration_s, c.start_s, c.end_s, greatest(0::DOUBLE, coalesce(max(c.end_s) OVER (PARTITION BY rec_id ORDER BY c.start_s, c.end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS t,
       max(c.end_s) OVER (PARTITION BY rec_id) AS top FROM recordings LEFT JOIN cuts c USING (rec_id)),
kept AS (SELECT * FROM (SELECT rec_id, t AS start_s, coalesce(start_s, duration_s) AS end_s FROM kp UNION ALL SELECT DISTINCT rec_id, top, duration_s FROM kp WHERE start_s IS NOT NULL) WHERE end_s - start_s > 0.05::DOUBLE)"""

ITEM_LOG = """
facts AS (SELECT user_id AS item, epoch_us(ts) // 3600 AS t, event_id AS seq,
          CASE event_type WHEN 'view' THEN 'row' WHEN 'click' THEN CASE WHEN value < 15 THEN 'found' ELSE 'music' END WHEN 'signup' THEN 'analysed' WHEN 'purchase' THEN 'cut' WHEN 'error' THEN 'failed' END AS kind,
          CASE event_type WHEN 'view' THEN CASE WHEN value <= 60 THEN value > 5 END WHEN 'signup' THEN value > 10 WHEN 'error' THEN value < 150 END AS flag FROM events),
fa AS (SELECT *, count(*) FILTER (kind IN ('found', 'analysed', 'cut')) OVER w AS era, max(CASE WHEN kind = 'row' THEN (t, seq) END) OVER w AS row_at, max(CASE WHEN kind IN ('analysed', 'cut') THEN (t, seq) END) OVER w AS reached_at,
       max(CASE WHEN kind = 'music' THEN (t, seq) END) OVER w AS music_at, lead(t) OVER (PARTITION BY item ORDER BY t, seq) AS next_at
       FROM facts WHERE item IS NOT NULL AND t IS NOT NULL AND kind IS NOT NULL WINDOW w AS (PARTITION BY item ORDER BY t, seq)),
fb AS (SELECT fa.*, r.flag AS inside, d.kind AS reached, d.flag AS fits, coalesce(music_at > reached_at, false) AS music,
       count(*) FILTER (fa.kind = 'failed') OVER e AS attempt, count(*) FILTER (fa.kind = 'failed' AND NOT coalesce(fa.flag, false)) OVER e > 0 AS hopeless
       FROM fa LEFT JOIN facts r ON r.item = fa.item AND r.seq = fa.row_at[2] LEFT JOIN facts d ON d.item = fa.item AND d.seq = fa.reached_at[2] WINDOW e AS (PARTITION BY fa.item, era ORDER BY fa.t, fa.seq)),
fc AS (SELECT *, CASE WHEN hopeless OR attempt > 4 THEN 'error' WHEN reached = 'cut' THEN CASE WHEN music THEN 'recut' ELSE 'cut' END WHEN reached = 'analysed' THEN CASE WHEN fits THEN 'done' ELSE 'unfit' END
       WHEN inside IS NULL THEN 'waits' WHEN inside THEN 'queued' ELSE 'out' END AS state, t + 1000000 * (2 ** attempt)::BIGINT AS due FROM fb),
item_log AS (
  SELECT item, t AS "at", 'state' AS what, state, attempt::INTEGER AS attempt FROM (SELECT *, lag(state) OVER (PARTITION BY item ORDER BY t, seq) AS before FROM fc) WHERE state IS DISTINCT FROM before
  UNION ALL SELECT item, due, 'retry', state, attempt::INTEGER FROM fc WHERE kind = 'failed' AND state <> 'error' AND (next_at IS NULL OR next_at > due))"""
