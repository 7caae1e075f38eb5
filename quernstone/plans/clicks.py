"""Shapes of web-analytics queries (fixed values: a public benchmark's, on other columns) on events and pages: counts, distinct users, minutes, LIKE, top tens with tie-breaks."""

from __future__ import annotations

from .base import text

text("click_q01", "SELECT count(*) AS total FROM events")
text("click_q02", "SELECT count(*) AS total FROM events WHERE event_type <> 'view'")
text("click_q03", "SELECT round(sum(value), 2) AS s, count(*) AS c, round(avg(user_id), 6) AS a FROM events")
text("click_q04", "SELECT round(avg(user_id), 6) AS a FROM events")
text("click_q05", "SELECT count(DISTINCT user_id) AS u FROM events")
text("click_q06", "SELECT count(DISTINCT props) AS p FROM events")
text("click_q07", "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM events")
text("click_q08", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type ORDER BY n DESC, event_type")
text("click_q09", "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10")
text("click_q10", """SELECT event_type, round(sum(value), 2) AS s, count(*) AS c, round(avg(value), 6) AS a, count(DISTINCT user_id) AS u
FROM events GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10""")
text("click_q11", "SELECT props, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY props ORDER BY u DESC, props LIMIT 10")
text("click_q12", "SELECT event_type, props, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY event_type, props ORDER BY u DESC, event_type, props LIMIT 10")
text("click_q13", "SELECT props, count(*) AS c FROM events WHERE props <> '' GROUP BY props ORDER BY c DESC, props LIMIT 10")
text("click_q14", "SELECT user_id, count(*) AS c FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10")
text("click_q15", "SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10")
text("click_q16", "SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type ORDER BY user_id, event_type LIMIT 10")
text("click_q17", """SELECT user_id, CAST(minute(ts) AS BIGINT) AS m, event_type, count(*) AS c FROM events
GROUP BY user_id, minute(ts), event_type ORDER BY c DESC, user_id, m, event_type LIMIT 10""")
text("click_q18", "SELECT event_id, user_id FROM events WHERE user_id = 42 ORDER BY event_id")
text("click_q19", "SELECT count(*) AS c FROM pages WHERE url LIKE '%example%'")
text("click_q20", "SELECT url, count(*) AS c FROM pages WHERE url LIKE '%/en/%' AND url <> '' GROUP BY url ORDER BY c DESC, url LIMIT 10")
text("click_q21", "SELECT page_id, url FROM pages WHERE url LIKE 'https%' AND url NOT LIKE '%?%' ORDER BY url, page_id LIMIT 10")
text("click_q22", "SELECT event_id, ts FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 10")
text("click_q23", "SELECT event_id, ts, event_type FROM events WHERE event_type <> '' ORDER BY event_type, ts, event_id LIMIT 10")
text("click_q24", """SELECT host, round(avg(strlen), 6) AS l, count(*) AS c, min(url) AS least FROM (
  SELECT regexp_replace(url, '^https?://(?:www\\\\.)?([^/]+)/.*$', '$1') AS host, CAST(octet_length(url) AS BIGINT) AS strlen, url FROM pages) t
GROUP BY host HAVING count(*) > 2 ORDER BY c DESC, host LIMIT 25""", """SELECT host, round(avg(strlen), 6) AS l, count(*) AS c, min(url) AS least FROM (
  SELECT regexp_replace(url, '^https?://(?:www\\.)?([^/]+)/.*$', '\\1', 'g') AS host, strlen(url) AS strlen, url FROM pages) t
GROUP BY host HAVING count(*) > 2 ORDER BY c DESC, host LIMIT 25""")
text("click_q25", "SELECT " + ", ".join(f"CAST(sum(user_id + {k}) AS BIGINT) AS s{k}" for k in range(30)) + " FROM events")
text("click_q26", """SELECT event_type, user_id, count(*) AS c, round(sum(value), 2) AS s, round(avg(value), 6) AS a FROM events WHERE value > 10
GROUP BY event_type, user_id ORDER BY c DESC, event_type, user_id LIMIT 10""")
text("click_q27", "SELECT 1 AS one, url, count(*) AS c FROM pages GROUP BY url ORDER BY c DESC, url LIMIT 10")
text("click_q28", """SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, count(*) AS c FROM events GROUP BY user_id, user_id - 1, user_id - 2 ORDER BY c DESC, user_id LIMIT 10""")
text("click_q29", """SELECT props, count(*) AS c FROM events WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-20' AND event_type = 'click'
GROUP BY props ORDER BY c DESC, props LIMIT 10 OFFSET 5""")
text("click_q30", """SELECT CASE WHEN event_type = 'click' AND value > 100 THEN props ELSE '' END AS src, count(*) AS c FROM events
GROUP BY CASE WHEN event_type = 'click' AND value > 100 THEN props ELSE '' END ORDER BY c DESC, src LIMIT 10""")
text("click_q31", """SELECT CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) AS m, count(*) AS c FROM events WHERE ts >= DATE '2024-01-14' AND ts < DATE '2024-01-16'
GROUP BY date_trunc('MINUTE', ts) ORDER BY m LIMIT 20""", """SELECT date_trunc('minute', ts) AS m, count(*) AS c FROM events WHERE ts >= DATE '2024-01-14' AND ts < DATE '2024-01-16'
GROUP BY date_trunc('minute', ts) ORDER BY m LIMIT 20""")
