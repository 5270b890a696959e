"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

DAY = 86_400
HALF_DAY_MICROS = 43_200_000_000

FRAMES = """
frames AS (
  SELECT user_id AS stream_id, event_id AS frame_id, ts,
         CASE WHEN event_type IN ('view', 'click') THEN 'video'
              WHEN event_type IN ('purchase', 'signup') THEN 'audio' ELSE 'data' END AS media,
         event_type = 'view' AS is_key,
         value AS size,
         epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS pts,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id))::DOUBLE * 1e-6::DOUBLE AS t
  FROM events)"""

VIDEO = FRAMES + """,
video AS (
  SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, frame_id) AS rn
  FROM frames WHERE media = 'video')"""

COMMANDS = """
commands AS (
  SELECT user_id AS stream_id, event_id, ts,
         CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' ELSE 'update' END AS action
  FROM events WHERE event_type IN ('signup', 'error', 'purchase')),
judged AS (
  SELECT *, coalesce(last_value(CASE WHEN action <> 'update' THEN action END IGNORE NULLS) OVER (
    PARTITION BY stream_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'start', false) AS active
  FROM commands)"""

OUTCOME = """
SELECT stream_id, event_id, action,
       CASE action WHEN 'start' THEN CASE WHEN active THEN 'already_running' ELSE 'started' END
                   WHEN 'stop' THEN CASE WHEN active THEN 'stopped' ELSE 'not_running' END
                   ELSE CASE WHEN active THEN 'updated' ELSE 'not_found' END END AS outcome
FROM judged"""

SESSIONS = COMMANDS + """,
accepted AS (
  SELECT stream_id, event_id, ts, action,
         lead(ts) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS stop_ts
  FROM judged WHERE (action = 'start' AND NOT active) OR (action = 'stop' AND active)),
sessions AS (
  SELECT stream_id, event_id AS session_id, ts AS start_ts, stop_ts
  FROM accepted WHERE action = 'start')"""

# The same by (stream, method): even commands are of one method, odd ones of the other.
METHOD_SESSIONS = """
commands AS (
  SELECT user_id AS stream_id, event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'mp4' ELSE 'hls' END AS method,
         CASE event_type WHEN 'signup' THEN 'start' ELSE 'stop' END AS action
  FROM events WHERE event_type IN ('signup', 'error')),
judged AS (
  SELECT *, coalesce(lag(action) OVER (PARTITION BY stream_id, method ORDER BY ts, event_id) = 'start', false) AS active
  FROM commands),
accepted AS (
  SELECT *, lead(ts) OVER (PARTITION BY stream_id, method ORDER BY ts, event_id) AS stop_ts
  FROM judged WHERE (action = 'start') <> active),
sessions AS (
  SELECT stream_id, method, event_id AS session_id, ts AS start_ts, stop_ts
  FROM accepted WHERE action = 'start')"""

INTERVAL = VIDEO + f""",
picks AS (
  SELECT stream_id, min_by(frame_id, rn) AS frame_id, min_by(t, rn) AS t, min(rn) AS rn
  FROM video WHERE t >= {DAY} GROUP BY stream_id
  UNION ALL
  SELECT * FROM (
    SELECT v.stream_id, min_by(v.frame_id, v.rn), min_by(v.t, v.rn), min(v.rn)
    FROM picks p JOIN video v ON v.stream_id = p.stream_id AND v.t - floor(p.t) >= {DAY} AND v.rn > p.rn
    GROUP BY v.stream_id))"""

PERCENT = VIDEO + """,
totals AS (SELECT stream_id, floor(max(t)) AS d FROM frames GROUP BY stream_id),
share AS (SELECT v.stream_id, frame_id, t, rn, (t / d) * 100 AS pct FROM video v JOIN totals USING (stream_id)),
picks AS (
  SELECT stream_id, min_by(frame_id, rn) AS frame_id, min_by(t, rn) AS t, min_by(pct, rn) AS pct, min(rn) AS rn
  FROM share WHERE pct - 0 >= 10 GROUP BY stream_id
  UNION ALL
  SELECT * FROM (
    SELECT v.stream_id, min_by(v.frame_id, v.rn), min_by(v.t, v.rn), min_by(v.pct, v.rn), min(v.rn)
    FROM picks p JOIN share v ON v.stream_id = p.stream_id AND v.pct - p.pct >= 10 AND v.rn > p.rn
    GROUP BY v.stream_id))"""

GAPS = f"""
marked AS (
  SELECT user_id AS stream_id, event_id AS frame_id, ts,
         coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > {HALF_DAY_MICROS}, false)::INT AS gap
  FROM events),
numbered AS (
  SELECT *, (sum(gap) OVER (PARTITION BY stream_id ORDER BY ts))::BIGINT AS session_no FROM marked)"""

SEGMENTS = FRAMES + f""",
routed AS (SELECT *, CASE media WHEN 'video' THEN 0 ELSE 1 END AS out_index FROM frames WHERE media <> 'data'),
grid AS (
  SELECT *, max(CASE WHEN is_key OR first THEN floor(t / {DAY}) END) OVER (
    PARTITION BY stream_id ORDER BY t, frame_id) AS g
  FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, frame_id) = 1 AS first FROM routed)),
cut AS (
  SELECT *, dense_rank() OVER (PARTITION BY stream_id ORDER BY g) - 1 AS segment_no FROM grid)"""

#: Commands by the lives of their task, which end when none comes for three days.
ENDED = COMMANDS + f""",
gaps AS (
  SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY stream_id ORDER BY ts, event_id)
                     > {3 * DAY * 1_000_000}, false)::INT AS gap
  FROM commands),
numbered AS (
  SELECT stream_id, event_id, ts, action, sum(gap) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS life FROM gaps),
lives AS (
  SELECT *, coalesce(last_value(CASE WHEN action <> 'update' THEN action END IGNORE NULLS) OVER (
    PARTITION BY stream_id, life ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'start', false) AS active
  FROM numbered)"""

BY_FIRST = f"""WITH {SESSIONS}, {FRAMES},
inside AS (
  SELECT f.stream_id, s.session_id, f.frame_id, f.media, f.ts, ((f.pts::HUGEINT * 2 * 90000 + 1000000) // 2000000)::BIGINT AS ticks,
         CASE e.event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS i
  FROM frames f JOIN events e ON e.event_id = f.frame_id
  JOIN sessions s ON f.stream_id = s.stream_id AND f.ts >= s.start_ts AND (s.stop_ts IS NULL OR f.ts < s.stop_ts)
  WHERE f.media <> 'data'),
chosen AS (
  SELECT stream_id, session_id, arg_min(i, (ts, frame_id)) FILTER (WHERE media = 'video') AS v,
         arg_min(i, (ts, frame_id)) FILTER (WHERE media = 'audio') AS a
  FROM inside GROUP BY stream_id, session_id)
SELECT stream_id, session_id, frame_id, CASE media WHEN 'video' THEN 0 ELSE 1 END AS out_index, ticks AS pts, ticks AS dts
FROM inside JOIN chosen USING (stream_id, session_id)
WHERE v IS NOT NULL AND i = CASE media WHEN 'video' THEN v ELSE a END"""

LAYOUT = """
entries AS (
  SELECT user_id, ts::DATE AS ver, event_type, event_id,
         CAST(json_extract_string(props, '$.k') AS INT) AS k,
         row_number() OVER (PARTITION BY user_id, ts::DATE, event_type ORDER BY ts DESC, event_id DESC) AS back
  FROM events),
layout AS (
  SELECT user_id AS task_id, ver, event_type AS id, 'rtmp://h/live/' || (k % 3) AS url,
         100 + k % 4 AS width, 50 + k % 2 AS height, k % 5 AS x, 0 AS y, k % 2 AS z, k
  FROM entries WHERE back = 1)"""

DIFF = """
versions AS (SELECT task_id, ver, lag(ver) OVER (PARTITION BY task_id ORDER BY ver) AS prev
             FROM (SELECT DISTINCT task_id, ver FROM layout)),
pairs AS (
  SELECT v.task_id, v.ver, l.id, l.url, l.width, l.height, l.x, l.y, l.z, true AS is_new
  FROM versions v JOIN layout l ON l.task_id = v.task_id AND l.ver = v.ver
  UNION ALL
  SELECT v.task_id, v.ver, l.id, l.url, l.width, l.height, l.x, l.y, l.z, false
  FROM versions v JOIN layout l ON l.task_id = v.task_id AND l.ver = v.prev),
changes AS (
  SELECT p.task_id, p.ver, p.id,
         CASE WHEN bool_and(NOT is_new) THEN 'removed' WHEN bool_and(is_new) THEN 'added'
              WHEN count(DISTINCT (width, height, x, y, z)) > 1 THEN 'updated' ELSE 'unchanged' END AS change
  FROM pairs p JOIN versions v ON v.task_id = p.task_id AND v.ver = p.ver
  WHERE v.prev IS NOT NULL GROUP BY p.task_id, p.ver, p.id)"""

REQUESTS = """
asked AS (
  SELECT event_id AS req_id, ts, event_id % 2 = 0 AS live,
         CASE WHEN event_id % 2 = 0 THEN 'rtmp://h/live/u' || user_id
              ELSE '/data/vod/u' || user_id || '.mp4' END AS stream_url,
         CAST(json_extract_string(props, '$.k') AS INT) AS k,
         CAST(floor(value) AS INT) - 20 AS param
  FROM events),
screenshot AS (
  SELECT *, CASE k % 5 WHEN 0 THEN 'interval' WHEN 1 THEN 'percentage' WHEN 2 THEN 'immediate'
                       WHEN 3 THEN 'specific_time' ELSE 'bogus' END AS method,
         CASE WHEN k % 10 < 6 THEN 'start' WHEN k % 10 < 9 THEN 'stop' ELSE 'pause' END AS action
  FROM asked),
screenshot_message AS (
  SELECT *, CASE
    WHEN k % 11 = 0 THEN 'Missing fields: Missing method'
    WHEN action = 'pause' THEN 'Invalid action. Valid actions are ''start'' or ''stop''.'
    WHEN action = 'stop' THEN 'Screenshot task stopped successfully.'
    WHEN method IN ('percentage', 'specific_time') AND live
      THEN 'Percentage and specific time screenshot are not supported for streams.'
    WHEN method = 'immediate' AND NOT live THEN 'Immediate screenshot is only supported for streams.'
    WHEN method = 'bogus' THEN 'Invalid screenshot method.'
    WHEN method = 'interval' AND param <= 0 THEN 'Interval must be positive.'
    WHEN method = 'percentage' AND (param < 1 OR param > 100) THEN 'Percentage must be between 1 and 100.'
    WHEN method = 'specific_time' AND param < 0 THEN 'time_second must be non-negative.'
    ELSE 'Screenshot task started.' END AS message
  FROM screenshot),
screenshot_verdict AS (
  SELECT *, CASE WHEN message LIKE 'Screenshot task st%' THEN 1000 ELSE 2001 END AS code
  FROM screenshot_message),
recording AS (
  SELECT *, CASE WHEN k % 5 < 2 THEN 'mp4' WHEN k % 5 < 4 THEN 'hls' ELSE 'bogus' END AS method,
         CASE WHEN k % 10 < 6 THEN 'start' WHEN k % 10 < 9 THEN 'stop' ELSE 'pause' END AS action
  FROM asked),
recording_message AS (
  SELECT *, CASE
    WHEN k % 11 = 0 THEN 'Missing fields: Missing method'
    WHEN action = 'pause' THEN 'Invalid action. Valid actions are ''start'' or ''stop''.'
    WHEN action = 'stop' THEN 'Recording task stopped successfully.'
    WHEN k % 3 = 2 THEN 'Filename must end with .mp4 or .m3u8.'
    WHEN NOT live THEN 'Recording is only supported for streams.'
    WHEN method = 'bogus' THEN 'Invalid recording method.'
    ELSE 'Recording task started.' END AS message
  FROM recording),
recording_verdict AS (
  SELECT *, CASE WHEN message LIKE 'Recording task st%' THEN 1000 ELSE 2001 END AS code
  FROM recording_message)"""


def _responses(job: str, title: str) -> str:
    return f"""WITH {REQUESTS},
standing AS (
  SELECT *, coalesce(last_value(action) OVER (
    PARTITION BY stream_url, method ORDER BY ts, req_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'start', false) AS active
  FROM {job}_verdict WHERE code = 1000)
SELECT req_id, code, message FROM {job}_verdict WHERE code <> 1000
UNION ALL
SELECT req_id, CASE WHEN (action = 'start') = active THEN 2001 ELSE 1000 END,
       CASE WHEN action = 'start' AND active
              THEN 'A {job} task with the same stream URL and method is already running.'
            WHEN action = 'stop' AND NOT active THEN 'No running {job} task found for this stream.'
            ELSE message END
FROM standing"""


MIX = LAYOUT + """,
mix AS (
  SELECT task_id, ver, task_id * 100000 + date_diff('day', DATE '1970-01-01', ver) AS req_id,
         CAST(sum(k) % 10 AS INT) AS h,
         CAST(count(*) FILTER (WHERE k % 9 <> 0 AND k % 7 <> 0) AS INT) AS n_streams
  FROM layout GROUP BY task_id, ver),
mix_message AS (
  SELECT *, CASE
    WHEN h = 9 THEN 'Invalid action. Valid actions are ''start'' or ''stop''.'
    WHEN h % 3 = 2 AND n_streams = 0 THEN 'Missing fields: ''streams'''
    WHEN h % 3 = 2 THEN 'Mixing task updated successfully'
    WHEN h = 0 THEN 'Missing required fields: ''resolution''.'
    WHEN h = 1 THEN 'Mixing is only supported for RTMP streams.'
    WHEN h = 6 THEN 'Resolution requires both ''width'' and ''height''.'
    WHEN h = 4 THEN 'Resolution dimensions must be positive integers.'
    WHEN h = 3 OR n_streams = 0 THEN 'Failed to parse mixing parameters.'
    ELSE 'Mixing task started.' END AS message
  FROM mix)"""

# A start is refused while its task runs, an update while it does not; nothing ends a mix.
MIX_ANSWERS = MIX + """,
mix_asked AS (
  SELECT *, message LIKE 'Mixing task %' AS valid, h <> 9 AND h % 3 <> 2 AS starts FROM mix_message),
mix_standing AS (
  SELECT *, coalesce(bool_or(valid AND starts) OVER (
    PARTITION BY task_id ORDER BY ver ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS active
  FROM mix_asked),
mix_answers AS (
  SELECT *, valid AND starts <> active AS accepted,
         CASE WHEN NOT valid THEN message
              WHEN starts AND active THEN 'A mixing task with the same RTMP URL is already running.'
              WHEN NOT starts AND NOT active THEN 'No running task found for the given URL.'
              ELSE message END AS answer
  FROM mix_standing)"""

ASKED_LAYOUT = MIX_ANSWERS.replace("layout AS", "all_entries AS").replace("FROM layout", "FROM all_entries") + """,
layout AS (
  SELECT e.* FROM all_entries e JOIN mix_answers a ON a.task_id = e.task_id AND a.ver = e.ver AND a.accepted
  WHERE k % 9 <> 0 AND k % 7 <> 0)"""

MEDIA_KIND = """
SELECT CASE WHEN starts_with(url, 'rtmp://') THEN 'live' ELSE 'file' END AS kind,
       lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '\\.[^.]*$')) AS suffix,
       count(*) AS n
FROM urls GROUP BY ALL"""

FIRST = "SELECT stream_id, frame_id, t FROM video WHERE rn <= {n}"
AT_TIME = f"""
SELECT stream_id, arg_min(frame_id, rn) AS frame_id, min(t) AS t
FROM video WHERE t >= {10 * DAY} GROUP BY stream_id"""

ORACLE: dict[str, str] = {
    "frames_base": f"WITH {FRAMES} SELECT * FROM frames",
    "packet_frames": """
SELECT user_id AS stream_id, event_id AS frame_id,
       (CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type = 'error' THEN 2 ELSE 1 END)::INT AS stream_index,
       CASE WHEN event_type IN ('view', 'click') THEN 'video' WHEN event_type = 'error' THEN 'data' ELSE 'audio' END AS media,
       epoch_us(ts) * 9 // 100 AS pts, (epoch_us(ts) * 9 // 100)::DOUBLE * (1::DOUBLE / 90000) AS t
FROM events""",
    "packet_gap_sessions": f"""
WITH ticked AS (SELECT user_id AS stream_id, epoch_us(ts) * 9 // 100 AS pts FROM events),
marked AS (
  SELECT *, coalesce(pts - lag(pts) OVER (PARTITION BY stream_id ORDER BY pts) > {HALF_DAY_MICROS * 9 // 100}, false)::INT AS gap
  FROM ticked),
numbered AS (SELECT *, (sum(gap) OVER (PARTITION BY stream_id ORDER BY pts))::BIGINT AS session_no FROM marked)
SELECT stream_id, session_no, min(pts) AS start_ts, max(pts) AS last_ts, count(*) AS n
FROM numbered GROUP BY stream_id, session_no""",
    "written_frames": f"""WITH RECURSIVE {INTERVAL}
SELECT p.stream_id, p.frame_id, p.t, e.value AS size FROM picks p JOIN events e ON e.event_id = p.frame_id""",
    "probe_streams": f"""WITH {FRAMES}
SELECT stream_id, min(frame_id) FILTER (WHERE media = 'video') AS video_index,
       min(frame_id) FILTER (WHERE media = 'audio') AS audio_index
FROM frames GROUP BY stream_id HAVING count(*) FILTER (WHERE media = 'video') > 0""",
    "media_inventory": f"WITH urls AS (SELECT url FROM pages) {MEDIA_KIND}",
    "media_inventory_requests": f"WITH {REQUESTS}, urls AS (SELECT stream_url AS url FROM asked) {MEDIA_KIND}",
    "url_basename": "SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages",
    "json_or_default": f"""WITH {REQUESTS}
SELECT req_id, CASE WHEN k % 11 = 0 THEN 'none' ELSE method END AS method,
       regexp_extract(stream_url, '[^/]*$') AS output_dir
FROM screenshot""",
    "rescale_ts": f"""WITH {FRAMES}
SELECT stream_id, frame_id, ((pts::HUGEINT * 2 * 90000 + 1000000) // 2000000)::BIGINT AS pts_out FROM frames""",
    "route_media": f"""WITH {FRAMES}
SELECT stream_id, frame_id, media, CASE media WHEN 'video' THEN 0 ELSE 1 END AS out_index
FROM frames WHERE media <> 'data'""",
    "route_media_by_index": """
WITH indexed AS (
  SELECT user_id AS stream_id, event_id AS frame_id,
         CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3
                         WHEN 'signup' THEN 4 ELSE 5 END AS stream_index
  FROM events),
chosen AS (
  SELECT stream_id, min(stream_index) FILTER (WHERE stream_index IN (2, 3)) AS v,
         min(stream_index) FILTER (WHERE stream_index IN (4, 5)) AS a
  FROM indexed GROUP BY stream_id)
SELECT stream_id, frame_id, stream_index, CASE WHEN stream_index = v THEN 0 ELSE 1 END AS out_index
FROM indexed JOIN chosen USING (stream_id) WHERE v IS NOT NULL AND stream_index IN (v, a)""",
    "name_frames": f"""WITH RECURSIVE {INTERVAL},
counted AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, frame_id) - 1 AS frame_no FROM picks)
SELECT stream_id, frame_id, frame_no, 'u' || stream_id || '/shot_' || frame_no || '.png' AS path FROM counted""",
    "screenshot_task": f"""WITH {VIDEO}, kept AS ({AT_TIME})
SELECT stream_id, frame_id, 0::BIGINT AS frame_no, 'screenshots/frame_0.png' AS path FROM kept""",
    "sample_interval": f"WITH RECURSIVE {INTERVAL} SELECT stream_id, frame_id, t FROM picks",
    "sample_percentage": f"WITH RECURSIVE {PERCENT} SELECT stream_id, frame_id, t, pct FROM picks",
    "sample_immediate": f"WITH {VIDEO} {FIRST.format(n=1)}",
    "sample_immediate_drain": f"WITH {VIDEO} {FIRST.format(n=4)}",
    "sample_at_time": f"WITH {VIDEO} {AT_TIME}",
    "sample_at_times": f"""WITH {VIDEO},
wanted AS (
  SELECT stream_id, unnest([0, {DAY}, 1000000, 2550000])::INT AS at
  FROM (SELECT DISTINCT user_id AS stream_id FROM events))
SELECT w.stream_id, w.at, v.frame_id, v.t
FROM wanted w ASOF JOIN video v ON w.stream_id = v.stream_id AND v.t >= w.at""",
    "command_outcome": f"WITH {COMMANDS} {OUTCOME}",
    "sessions": f"WITH {SESSIONS} SELECT * FROM sessions",
    "record_sessions": f"""WITH {SESSIONS}
SELECT s.stream_id, s.session_id, e.event_id AS frame_id, e.ts
FROM events e JOIN sessions s ON e.user_id = s.stream_id
 AND e.ts >= s.start_ts AND (s.stop_ts IS NULL OR e.ts < s.stop_ts)""",
    "record_methods": f"""WITH {METHOD_SESSIONS}
SELECT s.stream_id, s.method, s.session_id, e.event_id AS frame_id, e.ts
FROM events e JOIN sessions s ON e.user_id = s.stream_id
 AND e.ts >= s.start_ts AND (s.stop_ts IS NULL OR e.ts < s.stop_ts)""",
    "recording_methods_task": f"""WITH {METHOD_SESSIONS}, {FRAMES},
recorded AS (
  SELECT s.method, s.session_id, f.*, (pts::HUGEINT * 2 * 90000 + 1000000) // 2000000 AS ticks,
         bool_or(f.media = 'video') OVER (PARTITION BY s.stream_id, s.session_id) AS shown
  FROM frames f JOIN sessions s ON f.stream_id = s.stream_id
   AND f.ts >= s.start_ts AND (s.stop_ts IS NULL OR f.ts < s.stop_ts))
SELECT stream_id, method, session_id, frame_id, CASE media WHEN 'video' THEN 0 ELSE 1 END AS out_index,
       ticks::BIGINT AS pts, ticks::BIGINT AS dts
FROM recorded WHERE shown AND media <> 'data'""",
    "recording_task": f"""WITH {SESSIONS}, {FRAMES},
scaled AS (SELECT *, ((pts::HUGEINT * 2 * 90000 + 1000000) // 2000000)::BIGINT AS ticks FROM frames)
SELECT s.stream_id, s.session_id, f.frame_id, CASE f.media WHEN 'video' THEN 0 ELSE 1 END AS out_index,
       f.ticks AS pts, f.ticks AS dts
FROM scaled f JOIN sessions s ON f.stream_id = s.stream_id
 AND f.ts >= s.start_ts AND (s.stop_ts IS NULL OR f.ts < s.stop_ts)
WHERE f.media <> 'data' AND EXISTS (
  SELECT 1 FROM scaled v JOIN sessions r ON v.stream_id = r.stream_id
   AND v.ts >= r.start_ts AND (r.stop_ts IS NULL OR v.ts < r.stop_ts)
  WHERE v.media = 'video' AND v.stream_id = f.stream_id)""",
    "recording_rates": f"""WITH {SESSIONS}, {FRAMES},
numbered AS (
  SELECT stream_id, frame_id, ts, media, row_number() OVER (PARTITION BY stream_id, media ORDER BY ts, frame_id) - 1 AS n
  FROM frames WHERE media <> 'data'),
recorded AS (
  SELECT s.session_id, f.*, count(*) FILTER (f.media = 'video') OVER (PARTITION BY f.stream_id) AS videos,
         count(*) FILTER (f.media = 'video') OVER (PARTITION BY f.stream_id, s.session_id) AS here
  FROM numbered f JOIN sessions s ON f.stream_id = s.stream_id
   AND f.ts >= s.start_ts AND (s.stop_ts IS NULL OR f.ts < s.stop_ts)),
ticked AS (
  SELECT stream_id, session_id, frame_id, CASE media WHEN 'video' THEN 0 ELSE 1 END AS out_index,
         CASE WHEN media = 'audio' THEN n * 1024 WHEN here > 1 THEN n
              ELSE n * CASE stream_id % 3 WHEN 0 THEN 3600 WHEN 1 THEN 3000 ELSE 3003 END END AS ticks,
         CASE WHEN media = 'video' AND here > 1 AND stream_id % 3 = 2 THEN 1001 ELSE 1 END AS tb_num,
         CASE WHEN media = 'audio' THEN 44100 WHEN here < 2 THEN 90000
              ELSE CASE stream_id % 3 WHEN 0 THEN 25 WHEN 1 THEN 30 ELSE 30000 END END AS tb_den
  FROM recorded WHERE videos > 0)
SELECT stream_id, session_id, frame_id, out_index, ticks::BIGINT AS pts, ticks::BIGINT AS dts,
       tb_num::BIGINT AS tb_num, tb_den::BIGINT AS tb_den
FROM ticked""",
    "active_task_profile": f"""WITH {SESSIONS},
edges AS (
  SELECT start_ts AS ts, 1 AS d FROM sessions
  UNION ALL SELECT stop_ts, -1 FROM sessions WHERE stop_ts IS NOT NULL),
running AS (SELECT ts, (sum(sum(d)) OVER (ORDER BY ts))::BIGINT AS active FROM edges GROUP BY ts)
SELECT ts, active, active > 3 AS over_limit FROM running""",
    "gap_sessions": f"""WITH {GAPS}
SELECT stream_id, session_no, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS n
FROM numbered GROUP BY stream_id, session_no""",
    "until_timeout": f"WITH {GAPS} SELECT stream_id, frame_id, ts FROM numbered WHERE session_no = 0",
    "assign_segments": f"WITH {SEGMENTS} SELECT stream_id, frame_id, segment_no FROM cut",
    "segment_manifest": f"""WITH {SEGMENTS}
SELECT stream_id, segment_no, format('out_{{:03d}}.ts', segment_no) AS file_name,
       min(t) AS start_t, max(t) AS end_t, max(t) - min(t) AS duration, count(*) AS n
FROM cut GROUP BY stream_id, segment_no""",
    "interleave": f"""WITH {SEGMENTS}
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pts, out_index, frame_id) - 1 AS seq,
       frame_id, out_index
FROM routed""",
    "estimate_frame_rate": f"""WITH {VIDEO}
SELECT stream_id, CASE WHEN max(t) > min(t) THEN (count(*) - 1)::DOUBLE / (max(t) - min(t)) END AS fps
FROM video GROUP BY stream_id""",
    "saved_counts": f"""WITH RECURSIVE {PERCENT},
{INTERVAL.removeprefix(VIDEO + ",").replace("picks", "interval_picks")},
kept AS (
  SELECT stream_id, 'interval' AS method FROM interval_picks
  UNION ALL SELECT stream_id, 'percentage' FROM picks
  UNION ALL SELECT stream_id, 'immediate' FROM video WHERE rn = 1
  UNION ALL SELECT stream_id, 'specific_time' FROM ({AT_TIME}))
SELECT stream_id, method, count(*) AS n FROM kept GROUP BY stream_id, method""",
    "layout_diff": f"WITH {LAYOUT}, {DIFF} SELECT * FROM changes",
    "layout_replay": f"""WITH {LAYOUT}, {DIFF},
marked AS (
  SELECT l.*, coalesce(c.change, 'added') IN ('added', 'updated') AS taken
  FROM layout l LEFT JOIN changes c USING (task_id, ver, id))
SELECT task_id, ver, id, width, height, x, y, z,
       last_value(CASE WHEN taken THEN url END IGNORE NULLS) OVER (
         PARTITION BY task_id, id ORDER BY ver ROWS UNBOUNDED PRECEDING) AS url_effective
FROM marked""",
    "paint_order": f"""WITH {LAYOUT}
SELECT task_id, ver, id, z, row_number() OVER (PARTITION BY task_id, ver ORDER BY z, id) - 1 AS layer
FROM layout""",
    "explode_streams": f"""WITH {LAYOUT}
SELECT task_id * 100000 + date_diff('day', DATE '1970-01-01', ver) AS req_id,
       (row_number() OVER (PARTITION BY task_id, ver ORDER BY id) - 1)::INT AS pos,
       id, url, width, height, x, y, z
FROM layout WHERE k % 9 <> 0 AND k % 7 <> 0""",
    "mix_task": f"WITH {ASKED_LAYOUT}, {DIFF} SELECT * FROM changes",
    "mix_on_clock": f"""WITH {FRAMES},
ends AS (SELECT stream_id, media, (max(pts) * 3 + 99999999999) // 100000000000 AS last
         FROM frames GROUP BY stream_id, media),
ticks AS (SELECT stream_id, media, unnest(range(last + 1)) AS n FROM ends)
SELECT k.stream_id, k.media, (k.n * 100000)::DOUBLE / 3 AS tick, f.frame_id
FROM ticks k ASOF JOIN (SELECT *, pts * 3 AS thirds FROM frames) f
  ON k.stream_id = f.stream_id AND k.media = f.media AND f.thirds <= k.n * 100000000000""",
    "validate_screenshot": f"WITH {REQUESTS} SELECT req_id, code, message FROM screenshot_verdict",
    "validate_recording": f"WITH {REQUESTS} SELECT req_id, code, message FROM recording_verdict",
    "validate_mix": f"""WITH {MIX}
SELECT req_id, CASE WHEN message LIKE 'Mixing task %' THEN 1000 ELSE 2001 END AS code, message, n_streams
FROM mix_message""",
    "request_outcomes": f"""WITH {REQUESTS}
SELECT code, message, count(*) AS n FROM screenshot_verdict GROUP BY code, message""",
    "mix_responses": f"""WITH {MIX_ANSWERS}
SELECT req_id, CASE WHEN accepted THEN 1000 ELSE 2001 END AS code, answer AS message FROM mix_answers""",
    "screenshot_responses": _responses("screenshot", "Screenshot"),
    "recording_responses": _responses("recording", "Recording"),
    "stream_sample_interval": f"WITH RECURSIVE {INTERVAL} SELECT stream_id, frame_id, t FROM picks",
    "stream_sample_first": f"WITH {VIDEO} {FIRST.format(n=1)}",
    "stream_gap_sessions": f"""WITH {GAPS}
SELECT stream_id, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS n
FROM numbered GROUP BY stream_id, session_no""",
    "stream_segments": """
SELECT user_id AS stream_id, date_trunc('day', ts)::TIMESTAMP AS window_start,
       date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, count(*) AS n
FROM events GROUP BY ALL""",
    "stream_commands": f"WITH {COMMANDS} {OUTCOME}",
    "stream_layout": f"WITH {LAYOUT}, {DIFF} SELECT * FROM changes",
    "stream_layout_ended": f"""WITH {LAYOUT}, {DIFF}
SELECT * FROM changes UNION ALL
SELECT task_id, NULL::DATE, id, 'removed' FROM layout l
WHERE ver = (SELECT max(ver) FROM layout m WHERE m.task_id = l.task_id)""",
    "stream_commands_ended": f"""WITH {ENDED}
SELECT stream_id, event_id, action,
       CASE action WHEN 'start' THEN CASE WHEN active THEN 'already_running' ELSE 'started' END
                   WHEN 'stop' THEN CASE WHEN active THEN 'stopped' ELSE 'not_running' END
                   ELSE CASE WHEN active THEN 'updated' ELSE 'not_found' END END AS outcome
FROM lives UNION ALL
SELECT stream_id, NULL, 'end', 'stopped' FROM lives
WHERE action <> 'update' GROUP BY stream_id, life HAVING arg_max(action, (ts, event_id)) = 'start'""",
    "recording_by_first_packets": BY_FIRST,
    "stream_recording": BY_FIRST,
}

# What is written is what the job gives.
ORACLE |= {"written_recording": ORACLE["recording_task"], "written_segments": ORACLE["segment_manifest"]}
ORACLE["stream_manifest"] = ORACLE["segment_manifest"]
ORACLE["stream_packet_frames"] = ORACLE["packet_frames"]
ORACLE["stream_task_states"] = f"""WITH {COMMANDS}
SELECT stream_id, coalesce(arg_max(action, (ts, event_id)) FILTER (WHERE action <> 'update') = 'start', false) AS active
FROM commands GROUP BY stream_id"""
_SOUND = f"""WITH sound AS (SELECT * FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0), {
    SESSIONS.replace("FROM events", "FROM sound")
}, {FRAMES.replace("FROM events", "FROM sound")},
inside AS (
  SELECT s.stream_id, s.session_id, f.frame_id, f.media,
         bool_or(f.media = 'video') OVER (PARTITION BY s.stream_id) AS shown
  FROM frames f JOIN sessions s ON f.stream_id = s.stream_id
   AND f.ts >= s.start_ts AND (s.stop_ts IS NULL OR f.ts < s.stop_ts)),
lost AS (
  SELECT CASE WHEN event_id % 13 <> 0 THEN user_id END AS stream_id, event_id, event_type
  FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0)"""
ORACLE["recording_of_damaged"] = f"""{_SOUND}
SELECT 'mp4' AS part, stream_id, frame_id AS number, session_id FROM inside WHERE shown AND media <> 'data'
UNION ALL SELECT 'unplaced/packets', stream_id, event_id, NULL FROM lost
UNION ALL SELECT 'unplaced/commands', stream_id, event_id, NULL FROM lost
WHERE event_type IN ('signup', 'error', 'purchase')"""
ORACLE["sample_registered"] = f"""WITH {VIDEO},
keyed AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, frame_id) AS nth FROM video WHERE is_key)
SELECT stream_id, frame_id, t FROM keyed WHERE nth = 1"""
ORACLE["validate_damaged"] = f"""
SELECT req_id, CASE WHEN req_id % 5 = 0 THEN code ELSE 2002 END AS code,
       CASE WHEN req_id % 5 = 0 THEN message ELSE 'Invalid JSON' END AS message
FROM ({ORACLE["validate_screenshot"]})"""
