"""Registry of queries over the given tables, each with its SQL; and the SQL pieces they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: The SQL side states the view of sources/tables_view.py on its own.
REQUESTS = """r0 AS (
SELECT e.event_id AS line_id, e.ts AS ts,
  concat('10.', CAST(e.user_id % 4 AS VARCHAR), '.', CAST(e.user_id % 7 AS VARCHAR), '.', CAST(e.user_id AS VARCHAR)) AS ip,
  concat('10.', CAST(e.user_id % 4 AS VARCHAR), '.') AS ip_prefix,
  concat('GET /', e.event_type, '/item', CAST(e.event_id % 40 AS VARCHAR), '?src=', CASE WHEN e.event_id % 5 = 0 THEN 'mail' ELSE 'web' END, ' HTTP/1.1') AS request,
  CASE WHEN e.event_type = 'error' THEN '500' WHEN e.event_id % 17 = 0 THEN '404' WHEN e.event_type = 'signup' THEN '201' ELSE '200' END AS status,
  CAST(floor(e.value * 1000) AS BIGINT) AS bytes,
  CASE WHEN e.event_id % 3 = 0 THEN '-' ELSE p.url END AS referer,
  CASE (e.user_id + CASE WHEN e.event_id % 23 = 0 THEN 1 ELSE 0 END) % 6
    WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)'
    WHEN 1 THEN 'Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)'
    WHEN 2 THEN 'Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36'
    WHEN 3 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1'
    WHEN 4 THEN 'curl/8.4.0' ELSE 'SiteCrawler/1.0' END AS user_agent
FROM (SELECT *, event_id % greatest((SELECT count(*) FROM pages), 1) AS page_no FROM events) e LEFT JOIN pages p ON p.page_id = e.page_no),
r AS (SELECT r0.*, date_trunc('hour', ts) AS interval_start,
  CAST(date_diff('hour', (SELECT date_trunc('hour', min(ts)) FROM events), date_trunc('hour', ts)) AS BIGINT) AS interval_no,
  concat(ip, ' - - [', strftime(ts, '%d/%b/%Y:%H:%M:%S'), ' +0000] "', request, '" ', status, ' ', CAST(bytes AS VARCHAR), ' "', referer, '" "', user_agent, '"') AS line,
  list_filter(string_split(translate(user_agent, '(),[]:;/\\?&', '           '), ' '), lambda t: t <> '') AS ua_tokens
 FROM r0)"""

SYMBOLS = r"'(),[]:;/\?&', '           '"


def over_requests(rest: str) -> str:
    """A statement over r: rest starts with further named queries (', x AS (...)') or with SELECT."""
    return f"WITH {REQUESTS}{rest}" if rest.startswith(",") else f"WITH {REQUESTS} {rest}"
