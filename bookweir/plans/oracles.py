"""The same results in DuckDB SQL, computed from the tables by other means.

Page queries are checked against the columns the pages were rendered from, or
against patterns over the raw text; limiters against row-by-row recursion.
"""

from __future__ import annotations

from bookweir.operators.metrics import BYTES_BOUNDS, SECONDS_BOUNDS
from bookweir.sources.tables import BOOK_PAGE_COLUMNS, CRAWL_LOG_COLUMNS, REQUEST_COLUMNS, REQUEST_URL_COLUMNS

SNAPSHOT = "TIMESTAMP '2024-01-20 00:00:00'"

LOG = f"log AS (SELECT {', '.join(CRAWL_LOG_COLUMNS)}, concat_ws(' ', event_type, repeat(props, 30)) AS body FROM events)"
_OK = "(exception_class IS NULL AND http_status BETWEEN 200 AND 299)"
RESULTS = f"""{LOG}, results AS (SELECT *,
  CASE WHEN {_OK} THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN {_OK} THEN NULL WHEN exception_class IS NOT NULL THEN exception_class
    ELSE 'HTTP_' || http_status END AS error_code,
  CASE WHEN {_OK} OR exception_class IS NOT NULL THEN NULL
    ELSE 'HTTP ' || http_status || ': ' || substring(body, 1, 200) END AS error_message,
  epoch_us(ts) AS us, CAST(round(response_time_ms * 1000) AS BIGINT) AS took_us
  FROM log)"""
# Rendered pages with the columns they were made of.
BOOK_PAGES = f"""bp AS (SELECT {', '.join(BOOK_PAGE_COLUMNS)}, p_partkey AS k, p_name, p_brand, p_type, p_size, s_name
  FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier))"""
# What the book of each page must be, by kind.
_STRUCTURED = """SELECT page_id, source, kind, p_name AS title, p_brand AS authors,
  CASE WHEN kind = 0 THEN CAST(k AS VARCHAR) ELSE '' END AS isbn,
  CASE WHEN kind = 0 THEN s_name ELSE '' END AS publisher, '' AS description,
  CASE WHEN kind = 0 THEN CAST(p_size % 6 AS DOUBLE) END AS rating,
  CASE WHEN kind = 0 THEN CAST(p_size AS BIGINT) END AS rating_count,
  'https://img.example.com/' || k || '.png' AS cover_image_url, url AS source_url
  FROM bp WHERE kind IN (0, 2)"""
_BY_SELECTORS = """SELECT page_id, source, kind,
  CASE WHEN kind IN (0, 2) THEN 'shop' ELSE p_name END AS title,
  CASE WHEN kind IN (1, 3) THEN p_brand ELSE '' END AS authors,
  CAST(NULL AS VARCHAR) AS isbn, CAST(NULL AS VARCHAR) AS publisher,
  CASE WHEN kind = 3 THEN 'A long description of ' || p_name || ' by ' || p_brand ELSE '' END AS description,
  CAST(NULL AS DOUBLE) AS rating, CAST(NULL AS BIGINT) AS rating_count,
  CASE WHEN kind = 3 THEN 'https://books.example.com/img/cover' || k || '.png' END AS cover_image_url,
  CAST(NULL AS VARCHAR) AS source_url
  FROM bp WHERE kind <> 5"""
BOOKS = f"""{BOOK_PAGES}, structured AS ({_STRUCTURED}), by_selectors AS ({_BY_SELECTORS}),
  books AS (SELECT * FROM structured UNION ALL
    SELECT * FROM by_selectors WHERE kind NOT IN (0, 2))"""
_BOOK_COLUMNS = (
    "page_id, source, title, authors, isbn, publisher, description, rating, rating_count, cover_image_url, source_url"
)
PAGE_RESULTS = f"""{BOOKS}, page_results AS (SELECT page_id, kind, page_id % 50 = 7 AS empty,
  CASE WHEN page_id % 13 = 0 THEN 'failed' ELSE 'success' END AS status FROM bp)"""
REQUESTS = f"""urls AS (SELECT {', '.join(REQUEST_URL_COLUMNS)} FROM events),
  requests AS (SELECT request_id, list(url ORDER BY event_id) AS urls, {', '.join(REQUEST_COLUMNS)}
    FROM urls GROUP BY request_id),
  tasks AS (SELECT request_id, source, priority, metadata, pos - 1 AS pos, urls[pos] AS url
    FROM (SELECT *, unnest(range(1, len(urls) + 1)) AS pos FROM requests))"""


def _unescaped(text: str) -> str:
    for entity, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{entity};?', '{char}', 'g')"
    return text


def _element_text(text: str) -> str:
    return f"trim({_unescaped(text)}, chr(32) || chr(9) || chr(10) || chr(13))"


# Raw pages without script, style and comment contents.
_BARE = r"regexp_replace(regexp_replace(html, '(?s)<(script|style)([^>]*)>.*?</(script|style)>', '<\1\2></\1>', 'g'), '(?s)<!--.*?-->', '', 'g')"
PAGES = f"bare AS (SELECT page_id, url, {_BARE} AS html, html AS raw FROM pages)"
LINKS = f"""{PAGES}, found AS (SELECT page_id, url AS page_url, unnest(range(len(hrefs))) AS pos,
    unnest(hrefs) AS href, unnest(texts) AS text
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs,
    regexp_extract_all(html, '(?s)<a href="[^"]*"[^>]*>(.*?)</a>', 1) AS texts FROM bare)),
  links AS (SELECT page_id, pos, regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || {_unescaped('href')} AS url,
    {_element_text('text')} AS text, href FROM found WHERE href <> '')"""


def _bucket(name: str, rows: str, key: str, hours_num: int, hours_den: int, burst: int) -> str:
    """Recursive audit of `rows` by `key`: hours_num tokens per hours_den hours.

    Levels are whole units: a token is 3600 * hours_den * 1e6, a microsecond adds hours_num.
    """
    one = 3600 * hours_den * 1_000_000
    full = burst * one
    return f"""{name}_rows AS (SELECT *, epoch_us(ts) AS at_us, {key} AS bucket_key,
    row_number() OVER (PARTITION BY {key} ORDER BY ts, log_id) AS rn FROM {rows}),
  {name}_walk AS (
    SELECT bucket_key, rn, log_id, at_us, CAST({full} AS BIGINT) AS level FROM {name}_rows WHERE rn = 1
    UNION ALL
    SELECT r.bucket_key, r.rn, r.log_id, r.at_us,
      least({full}, CASE WHEN w.level >= {one} THEN w.level - {one} ELSE w.level END
        + CAST((r.at_us - w.at_us) * {hours_num} AS BIGINT))
    FROM {name}_walk w JOIN {name}_rows r ON r.bucket_key = w.bucket_key AND r.rn = w.rn + 1),
  {name} AS (SELECT log_id, bucket_key, level >= {one} AS admitted,
    CASE WHEN level >= {one} THEN 0.0 ELSE ({one} - level) / {float(hours_num)} / 1e6 END AS delay_seconds,
    (CASE WHEN level >= {one} THEN level - {one} ELSE level END) / {float(one)} AS tokens_after
  FROM {name}_walk)"""


AUDIT = f"WITH RECURSIVE {LOG}, {_bucket('audit', 'log', 'domain', 1, 8, 2)}"
_AUDIT_RESULT = f"""{AUDIT} SELECT log_id, bucket_key AS domain, admitted,
  round(delay_seconds, 3) AS delay_seconds, round(tokens_after, 6) AS tokens_after FROM audit"""
_INNER_BUCKET = _bucket("inner_audit", "log", "source || domain", 1, 8, 2)
_OUTER_BUCKET = _bucket("outer_audit", "passed", "source", 2, 1, 3)

ADAPTIVE = f"""WITH RECURSIVE {LOG}, timed AS (SELECT log_id, domain, response_time_ms / 1000 AS seconds,
    CASE WHEN http_status = 200 THEN 0.0 ELSE 1.0 END AS error,
    row_number() OVER (PARTITION BY domain ORDER BY ts, log_id) AS rn FROM log),
  rolled AS (SELECT *, avg(seconds) OVER recent AS avg_rt, avg(error) OVER recent AS avg_err FROM timed
    WINDOW recent AS (PARTITION BY domain ORDER BY rn ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
  walk AS (
    SELECT domain, rn, log_id, avg_rt, avg_err, CAST(1.0 AS DOUBLE) AS factor FROM rolled WHERE rn = 1
    UNION ALL
    SELECT r.domain, r.rn, r.log_id, r.avg_rt, r.avg_err,
      CASE WHEN r.rn < 10 THEN w.factor ELSE CAST(0.7 AS DOUBLE) * w.factor + CAST(0.3 AS DOUBLE)
        * (least(1.0, 5.0 / greatest(r.avg_rt, 0.1)) + 1.0 - r.avg_err / CAST(0.1 AS DOUBLE)) / 2 END
    FROM walk w JOIN rolled r ON r.domain = w.domain AND r.rn = w.rn + 1),
  adapted AS (SELECT *, CASE WHEN rn < 10 THEN 10.0 ELSE greatest(0.1, 10.0 * factor) END AS rate FROM walk)"""
_ADAPTIVE_RESULT = (
    f"{ADAPTIVE} SELECT log_id, round(factor, 6) AS adaptation_factor, round(CAST(rate AS DOUBLE), 6) AS current_rate FROM adapted"
)


def _histogram(with_clause: str, rows: str, value: str, labels: str, bounds: list) -> str:
    edges = ", ".join(f"('{b}', CAST({b} AS DOUBLE))" for b in bounds)
    return f"""{with_clause}, v AS (SELECT {labels}, {value} AS v FROM {rows}),
  edges(le, edge) AS (VALUES {edges}, ('+Inf', CAST('inf' AS DOUBLE)))
  SELECT {labels}, round(CAST(sum(v) AS DOUBLE), 3) AS sum, count(*) AS count, le,
    count(*) FILTER (WHERE v <= edge) AS bucket
  FROM v, edges WHERE v IS NOT NULL GROUP BY ALL"""


def _windows(with_clause: str, slide_seconds: int) -> str:
    step = slide_seconds * 1_000_000
    return f"""{with_clause}, placed AS (SELECT source, status,
    (us // {step} - unnest(range({300 // slide_seconds}))) * {step} AS start_us FROM results),
  counted AS (SELECT start_us, start_us + 300000000 AS end_us, source, status, count(*) AS requests
    FROM placed GROUP BY ALL)
  SELECT start_us, end_us, source, status, requests, round(requests / 300.0::DOUBLE, 9) AS rate FROM counted"""


def _metric(name: str, labels: list[str], value: str, rows: str) -> str:
    cells = [label if label in labels else f"CAST(NULL AS VARCHAR) AS {label}" for label in ("source", "status", "error_type")]
    return f"""SELECT '{name}' AS metric, {', '.join(cells)}, CAST(NULL AS VARCHAR) AS le, CAST({value} AS DOUBLE) AS value
  FROM {rows} GROUP BY {', '.join(labels)}"""


def _metric_histogram(name: str, labels: list[str], value: str, bounds: list) -> str:
    cells = [label if label in labels else f"CAST(NULL AS VARCHAR) AS {label}" for label in ("source", "status", "error_type")]
    parts = [(f"'{b}'", f"count(*) FILTER (WHERE {value} <= {b})") for b in bounds]
    parts += [("'+Inf'", "count(*)"), ("'sum'", f"sum({value})"), ("'count'", "count(*)")]
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS metric, {', '.join(cells)}, {le} AS le, CAST({cell} AS DOUBLE) AS value
  FROM typed GROUP BY {', '.join(labels)}"""
        for le, cell in parts
    )


_COUNTERS = " UNION ALL ".join(
    [
        _metric("requests_total", ["source", "status"], "count(*)", "typed"),
        _metric("success_total", ["source"], "count(*)", "(SELECT * FROM typed WHERE status = 'success')"),
        _metric("failure_total", ["source", "error_type"], "count(*)", "(SELECT * FROM typed WHERE status = 'failed')"),
        _metric("books_extracted_total", ["source"], "count(*)", "(SELECT * FROM typed WHERE has_book)"),
        _metric_histogram("request_duration_seconds", ["source", "status"], "response_time_ms / 1000", SECONDS_BOUNDS),
        _metric_histogram("data_size_bytes", ["source"], "data_size_bytes", BYTES_BOUNDS),
    ]
)

# The white space that text cleaning collapses, spelled out.
_SPACES = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _cleaned(text: str) -> str:
    out = f"regexp_replace({text}, '{_SPACES}+', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        out = f"replace({out}, '{entity}', '{char}')"
    out = rf"regexp_replace({out}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')"
    return f"regexp_replace({out}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


_TAGS = "html head meta title style script body nav ul li a div article h1 p b br footer".split()
_TAG_COUNTS = " UNION ALL ".join(
    f"SELECT page_id, '{tag}' AS tag, len(regexp_extract_all(html, '<{tag}[ >/]')) AS n FROM bare" for tag in _TAGS
)
_LIMIT_ROWS = "limits(limit_key, rps, burst) AS (VALUES ('d0.example.com', 2.0, 3), ('d1.example.com', 1.0, 2), ('d2.example.com', 5.0, 5), ('d3.example.com', 8.0, 10))"

_REFERENCE = """CASE log_id % 10
  WHEN 0 THEN 'https://' || domain || '/c' || log_id
  WHEN 1 THEN 'https://' || domain || '/b/y' || log_id
  WHEN 2 THEN url || '?z=' || log_id
  WHEN 3 THEN url || '?q=1#s'
  WHEN 4 THEN 'https://g.example.org/' || log_id
  WHEN 5 THEN 'https://' || domain || '/abs//' || log_id
  WHEN 6 THEN 'http://x.example.org/a/../b'
  WHEN 7 THEN 'mailto:a@example.org'
  WHEN 8 THEN url || '?q=1#f'
  ELSE 'https://' || domain || '/' || log_id || '/' END"""

_OUT_OF_RANGE = """concat_ws('|',
  CASE WHEN page_id % 8 > 5 THEN 'rating out of range' END,
  CASE WHEN rating_count < 0 THEN 'rating_count out of range' END,
  CASE WHEN page_id % 9 = 0 THEN 'review_count out of range' END,
  CASE WHEN page_id % 7 = 0 THEN 'price out of range' END,
  CASE WHEN page_id % 6 = 5 THEN 'confidence_score out of range' END,
  CASE WHEN page_id % 10 = 0 THEN 'source_url is no http url' END)"""


def _first(column: str) -> str:
    return f"arg_min({column}, rn) FILTER (WHERE {column} IS NOT NULL AND CAST({column} AS VARCHAR) <> '')"


_AVERAGES = "round(avg_rt, 9) AS avg_response_time, round(avg_err, 9) AS avg_error_rate"

_ORACLES: dict[str, str] = {
    "crawl_pages": "SELECT page_id, url, html, CAST(strlen(html) AS BIGINT) AS data_size_bytes FROM pages",
    "request_expand": f"WITH {REQUESTS} SELECT request_id, pos, url, source, priority, metadata FROM tasks",
    "request_validate": f"""WITH {REQUESTS} SELECT request_id, url, source, priority, concat_ws('|',
  CASE WHEN url NOT LIKE 'https://%' THEN 'url is no http url' END,
  CASE WHEN source = 'elsewhere' THEN 'unknown source' END,
  CASE WHEN priority NOT BETWEEN 1 AND 10 THEN 'priority out of range' END) AS reasons FROM tasks""",
    "request_summary": f"""WITH {REQUESTS} SELECT request_id, 'batch_' || count(*) AS job_id, count(*) AS task_count,
  'started' AS status, 'Started scraping ' || count(*) || ' URLs from ' || source AS message, source, priority,
  string_agg(source || '_' || request_id || '_' || pos, '|' ORDER BY pos) AS task_ids
  FROM tasks GROUP BY request_id, source, priority""",
    "results_json": f"""WITH {RESULTS} SELECT '{{"log_id":' || log_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN us % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00","source":"' || source || '","status":"'
  || status || '","error_code":' || CASE WHEN error_code IS NULL THEN 'null' ELSE '"' || error_code || '"' END
  || ',"payload":"' || lower(hex(encode(source))) || '"}}' AS json FROM results""",
    "source_catalog": f"""WITH {LOG}, sources(source, enabled) AS (VALUES ('goodreads', true), ('amazon', true),
  ('google_books', true), ('openlibrary', true), ('unknown', false))
  SELECT s.source, enabled, count(log_id) AS rows FROM sources s LEFT JOIN log USING (source) GROUP BY ALL""",
    "stream_results": f"WITH {RESULTS} SELECT log_id, source, status FROM results",
    "fetch_outcome": f"WITH {RESULTS} SELECT log_id, http_status, exception_class, status FROM results",
    "error_fields": f"WITH {RESULTS} SELECT log_id, error_code, error_message FROM results",
    "payload_size": f"""WITH {RESULTS} SELECT log_id, CAST(strlen(body) AS BIGINT) AS data_size_bytes,
  round(took_us / 1000.0::DOUBLE, 6) AS response_time_ms FROM results""",
    "completed_results": f"WITH {RESULTS} SELECT log_id, job_id, source, url, status FROM results WHERE status <> 'failed'",
    "failed_results": f"""WITH {RESULTS} SELECT log_id, job_id, source, url, status, error_code
  FROM results WHERE status = 'failed'""",
    "final_status": f"""WITH {PAGE_RESULTS} SELECT page_id,
  CASE WHEN status = 'success' AND NOT empty AND title IS NULL THEN 'partial' ELSE status END AS status, title
  FROM page_results LEFT JOIN (SELECT b.page_id, b.title FROM books b JOIN page_results p USING (page_id)
    WHERE p.status = 'success' AND NOT p.empty) USING (page_id)""",
    "attach_context": f"""WITH {REQUESTS} SELECT request_id, pos, url,
  CASE WHEN pos IN (0, 2) THEN 'job_' || substring(url, 1, 20)
    ELSE 'batch_' || (epoch_ms({SNAPSHOT}) + request_id * 1000) || '_' || pos END AS job_id,
  CASE WHEN request_id % 4 <> 0 AND pos < 2 THEN source ELSE 'unknown' END AS source FROM tasks""",
    "result_ids": f"""WITH {RESULTS} SELECT log_id, source || '_' || (us // 1000) AS result_id,
  sha256(source || '|' || us || '|' || log_id) AS result_key FROM results""",
    "limit_lookup": f"""WITH {LOG}, {_LIMIT_ROWS} SELECT log_id, domain, CAST(coalesce(rps, 10) AS DOUBLE) AS requests_per_second,
  CAST(coalesce(burst, 1) AS INTEGER) AS burst_size FROM log LEFT JOIN limits ON limit_key = domain""",
    "limit_lookup_suffix": f"""WITH {LOG}, {_LIMIT_ROWS} SELECT log_id, 'www.' || domain AS domain,
  CAST(coalesce(rps, 10) AS DOUBLE) AS requests_per_second, CAST(coalesce(burst, 1) AS INTEGER) AS burst_size
  FROM log LEFT JOIN limits ON limit_key = domain""",
    "results_with_books": f"""WITH {PAGE_RESULTS} SELECT page_id, status, title
  FROM page_results LEFT JOIN (SELECT page_id, title FROM books WHERE page_id % 50 <> 7) USING (page_id)""",
    "descendant_select": f"""WITH {PAGES}, navs AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<nav[^>]*>(.*?)</nav>', 1)) AS nav FROM bare)
  SELECT page_id, {_unescaped('href')} AS href, {_element_text('text')} AS text FROM (SELECT page_id,
  unnest(regexp_extract_all(nav, '<a href="([^"]*)"', 1)) AS href,
  unnest(regexp_extract_all(nav, '(?s)<a href="[^"]*"[^>]*>(.*?)</a>', 1)) AS text FROM navs)""",
    "descendant_cover": f"WITH {BOOK_PAGES} SELECT page_id, '../img/cover' || k || '.png' AS src FROM bp WHERE kind = 3",
    "outcomes_union": f"WITH {RESULTS} SELECT status, count(*) AS total_tasks FROM results GROUP BY status",
    "queue_take": f"WITH {LOG} SELECT log_id, priority FROM log ORDER BY priority, log_id LIMIT 1234",
    "queue_rest": f"WITH {LOG} SELECT log_id, priority FROM log ORDER BY priority, log_id OFFSET 1234",
    "queue_rest_ties": f"""WITH {LOG}, ranked AS (SELECT priority, row_number() OVER (ORDER BY priority) AS rn FROM log)
  SELECT priority, count(*) AS tasks FROM ranked WHERE rn > 321 GROUP BY priority""",
    "job_validate": f"""WITH {LOG} SELECT log_id, concat_ws('|', CASE WHEN log_id % 11 = 0 THEN 'urls missing' END,
  CASE WHEN log_id % 5 = 4 THEN 'unknown job_type' END, CASE WHEN log_id % 7 = 0 THEN 'unknown source' END,
  CASE WHEN log_id % 13 NOT BETWEEN 1 AND 10 THEN 'priority out of range' END,
  CASE WHEN log_id % 12 > 10 THEN 'max_retries out of range' END,
  CASE WHEN log_id % 400 NOT BETWEEN 5 AND 300 THEN 'timeout_seconds out of range' END) AS reasons FROM log""",
    "result_validate": f"""WITH {LOG} SELECT log_id, concat_ws('|', CASE WHEN log_id % 9 = 0 THEN 'job_id missing' END,
  CASE WHEN log_id % 10 = 0 THEN 'source missing' END, CASE WHEN log_id % 8 = 0 THEN 'unknown status' END,
  CASE WHEN log_id % 5 > 3 THEN 'confidence_score out of range' END) AS reasons FROM log""",
    "queue_depth": f"""WITH {RESULTS}, state AS (SELECT CASE WHEN us > epoch_us({SNAPSHOT}) THEN 'pending'
  WHEN us + took_us > epoch_us({SNAPSHOT}) THEN 'running' WHEN status = 'success' THEN 'completed' ELSE 'failed' END AS s
  FROM results) SELECT count(*) FILTER (WHERE s = 'pending') AS pending_tasks,
  count(*) FILTER (WHERE s = 'running') AS running_tasks, count(*) FILTER (WHERE s = 'completed') AS completed_tasks,
  count(*) FILTER (WHERE s = 'failed') AS failed_tasks FROM state""",
    "job_lifecycle": f"""WITH {RESULTS}, seen AS (SELECT *, ts < {SNAPSHOT} OR log_id % 97 < 20 AS done FROM results),
  jobs AS (SELECT job_id, count(*) FILTER (WHERE done AND status = 'success') AS completed_count,
  count(*) FILTER (WHERE done AND status = 'failed') AS failed_count, count(*) AS total_count,
  min(us) FILTER (WHERE done) AS started_us, max(us) FILTER (WHERE done) AS last_us FROM seen GROUP BY job_id)
  SELECT job_id, CASE WHEN completed_count + failed_count = 0 THEN 'pending'
    WHEN completed_count + failed_count < total_count THEN 'running'
    WHEN completed_count = 0 THEN 'failed' ELSE 'completed' END AS status,
  round((completed_count + failed_count) / total_count::DOUBLE, 6) AS progress,
  completed_count, failed_count, total_count, started_us,
  CASE WHEN completed_count + failed_count >= total_count THEN last_us END AS completed_us FROM jobs""",
    "run_stats": f"""WITH {RESULTS}, run AS (SELECT (max(us) - min(us)) / 1e6 AS up, count(*) AS n,
  count(*) FILTER (WHERE status = 'success') AS good FROM results)
  SELECT round(up, 6) AS uptime_seconds, n AS total_requests, good AS successful_requests, n - good AS failed_requests,
  round(good / greatest(1.0::DOUBLE, n), 6) AS success_rate, round(n / greatest(1.0::DOUBLE, up), 9) AS requests_per_second FROM run""",
    "job_status": f"""WITH {RESULTS} SELECT job_id, count(*) AS total_tasks,
  count(*) FILTER (WHERE status = 'success') AS completed_tasks, count(*) FILTER (WHERE status = 'failed') AS failed_tasks,
  round(count(*) FILTER (WHERE status = 'success') / count(*)::DOUBLE, 6) AS success_rate FROM results GROUP BY job_id""",
    "job_performance": f"""WITH {RESULTS} SELECT job_id, round(avg(response_time_ms), 4) AS average_response_time_ms,
  round((max(us + took_us) - min(us)) / 1e6, 4) AS total_duration_seconds,
  arg_max(error_code, us::HUGEINT * 10000000000 + log_id) FILTER (WHERE error_code IS NOT NULL) AS last_error,
  count(error_code) AS error_count FROM results GROUP BY job_id""",
    "requests_total": f"WITH {RESULTS} SELECT source, status, count(*) AS value FROM results GROUP BY ALL",
    "duration_histogram": _histogram(f"WITH {RESULTS}", "results", "response_time_ms / 1000", "source, status", SECONDS_BOUNDS),
    "success_total": f"WITH {RESULTS} SELECT source, count(*) AS value FROM results WHERE status = 'success' GROUP BY ALL",
    "failure_total": f"""WITH {RESULTS} SELECT source, error_code AS error_type, count(*) AS value
  FROM results WHERE status = 'failed' GROUP BY ALL""",
    "books_extracted": f"WITH {BOOKS} SELECT source, count(*) AS value FROM books GROUP BY ALL",
    "size_histogram": _histogram(f"WITH {RESULTS}", "results", "data_size_bytes", "source", BYTES_BOUNDS),
    "active_requests": f"""WITH {RESULTS}, edges AS (SELECT us AS at_us, 1 AS o, 0 AS c FROM results UNION ALL
  SELECT us + took_us, 0, 1 FROM results), instants AS (SELECT at_us, sum(o) AS o, sum(c) AS c FROM edges GROUP BY at_us)
  SELECT at_us, CAST(sum(o) OVER (ORDER BY at_us) - coalesce(sum(c) OVER (ORDER BY at_us ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS BIGINT) AS active FROM instants""",
    "queue_size_over_time": f"""WITH {RESULTS}, edges AS (SELECT us AS at_us, -1 AS n FROM results UNION ALL
  SELECT min(us), count(*) FROM results GROUP BY job_id), instants AS (SELECT at_us, sum(n) AS n FROM edges GROUP BY at_us)
  SELECT at_us, CAST(sum(n) OVER (ORDER BY at_us) AS BIGINT) AS queue_size FROM instants""",
    "throughput_gauges": f"""WITH {RESULTS}, run AS (SELECT (max(us) - min(us)) / 1e6 AS up, count(*) AS n,
  count(*) FILTER (WHERE status = 'success') AS good FROM results)
  SELECT 'uptime_seconds' AS metric, round(up, 9) AS value FROM run UNION ALL
  SELECT 'requests_per_second', round(n / greatest(1.0::DOUBLE, up), 9) FROM run UNION ALL
  SELECT 'success_rate', round(good / greatest(1.0::DOUBLE, n), 9) FROM run""",
    "request_rate_5m": _windows(f"WITH {RESULTS}", 60),
    "dom_nodes": f"WITH {PAGES} SELECT * FROM ({_TAG_COUNTS}) WHERE n > 0",
    "css_select": f"""WITH {LINKS} SELECT page_id, 'a' AS tag, text FROM links WHERE href LIKE '%th%' UNION ALL
  SELECT page_id, 'div', {_element_text('t')} FROM (SELECT page_id,
    unnest(regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1)) AS t FROM bare) UNION ALL
  SELECT page_id, 'h1', {_element_text('t')} FROM (SELECT page_id,
    unnest(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '(?s)<h1>(.*?)</h1>', 1)) AS t FROM bare)""",
    "css_combinators": f"""WITH {LINKS}, ends AS (SELECT page_id, max(pos) AS last FROM links GROUP BY page_id)
  SELECT page_id, 'a' AS tag, text FROM links JOIN ends USING (page_id) WHERE pos % 2 = 0 OR (pos = last AND pos > 0) UNION ALL
  SELECT page_id, 'div', {_element_text("regexp_extract(html, '(?s)</nav>[ ]*<div class=\"ad\">(.*?)</div>', 1)")}
  FROM bare WHERE regexp_matches(html, '(?s)</nav>[ ]*<div class="ad">') UNION ALL
  SELECT page_id, 'h1', {_element_text("regexp_extract(html, '(?s)</nav>.*<article><h1>(.*?)</h1>', 1)")}
  FROM bare WHERE regexp_matches(html, '(?s)</nav>.*<article><h1>')""",
    "first_per_page": f"WITH {LINKS} SELECT page_id, {_unescaped('href')} AS href, text FROM links WHERE pos = 0",
    "resolve_urls": f"""WITH {LINKS}, {BOOK_PAGES}, {LOG}
  SELECT 'link' AS kind, page_id AS id, url FROM links UNION ALL
  SELECT 'image', page_id, CASE kind WHEN 3 THEN 'https://books.example.com/img/cover' || k || '.png'
    ELSE 'https://books.example.com/b/a.png' END FROM bp WHERE kind IN (3, 4) UNION ALL
  SELECT 'canonical', page_id, 'https://books.example.com/c/' || k FROM bp WHERE kind = 3 UNION ALL
  SELECT 'reference', log_id, {_REFERENCE} FROM log""",
    "extract_links": f"WITH {LINKS} SELECT page_id, pos, url, text, '' AS title FROM links",
    "stream_links": f"WITH {LINKS} SELECT page_id, pos, url, text, '' AS title FROM links",
    "extract_links_in_nav": f"WITH {LINKS} SELECT page_id, url, text FROM links WHERE href LIKE '/%'",
    "extract_images": f"""WITH {BOOK_PAGES} SELECT page_id, CASE kind WHEN 3 THEN 'https://books.example.com/img/cover' || k || '.png'
  ELSE 'https://books.example.com/b/a.png' END AS url, CASE kind WHEN 3 THEN 'x' ELSE 'none' END AS alt, '' AS title
  FROM bp WHERE kind IN (3, 4)""",
    "extract_metadata": f"""WITH {BOOK_PAGES}
  SELECT 'pages' AS input, page_id, 'title' AS key, {_element_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS value
    FROM pages UNION ALL
  SELECT 'books', page_id, 'title', CASE WHEN kind IN (0, 2) THEN 'shop' ELSE p_name END FROM bp WHERE kind < 4 UNION ALL
  SELECT 'books', page_id, 'keywords', p_type FROM bp WHERE kind = 3 UNION ALL
  SELECT 'books', page_id, 'og:title', p_name FROM bp WHERE kind = 3 UNION ALL
  SELECT 'books', page_id, 'canonical_url', 'https://books.example.com/c/' || k FROM bp WHERE kind = 3""",
    "clean_documents": f"""WITH given AS (SELECT 'document' AS input, doc_id AS id,
    replace(replace(text, ' ', concat(' ', chr(10))), '.', concat('&amp;lt;', chr(7))) AS text FROM documents UNION ALL
    SELECT 'page', page_id, html FROM pages), done AS (SELECT input, id, text, {_cleaned('text')} AS cleaned FROM given)
  SELECT input, id, cleaned, CAST(length(text) - length(cleaned) AS BIGINT) AS chars_removed FROM done""",
    "json_ld": f"""WITH {BOOK_PAGES} SELECT page_id, CAST(0 AS BIGINT) AS pos, 'Book' AS type,
  CASE kind WHEN 0 THEN p_name ELSE 'ignored' END AS name, CASE kind WHEN 0 THEN CAST(k AS VARCHAR) END AS isbn,
  CASE kind WHEN 0 THEN CAST(p_size AS BIGINT) END AS rating_count FROM bp WHERE kind IN (0, 1)""",
    "microdata": f"""WITH {BOOK_PAGES}, m AS (SELECT * FROM bp WHERE kind = 2)
  SELECT page_id, CAST(0 AS BIGINT) AS pos, '@type' AS key, 'http://schema.org/Book' AS value FROM m UNION ALL
  SELECT page_id, 0, '@context', 'http://schema.org' FROM m UNION ALL SELECT page_id, 0, 'name', p_name FROM m UNION ALL
  SELECT page_id, 0, 'author', p_brand FROM m UNION ALL
  SELECT page_id, 0, 'image', 'https://img.example.com/' || k || '.png' FROM m UNION ALL
  SELECT page_id, 0, 'url', url FROM m""",
    "structured_items": f"""WITH {BOOK_PAGES} SELECT page_id, CAST(0 AS BIGINT) AS pos,
  CASE kind WHEN 2 THEN 'http://schema.org/Book' ELSE 'Book' END AS type,
  CASE kind WHEN 1 THEN 'ignored' ELSE p_name END AS name FROM bp WHERE kind < 3""",
    "parse_report": "SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_length, html IS NOT NULL AS parsed FROM pages",
    "link_rollup": f"""WITH {LINKS}, l AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain FROM links)
  SELECT 'page' AS scope, CAST(page_id AS VARCHAR) AS key, count(*) AS links, count(DISTINCT url) AS others FROM l GROUP BY page_id
  UNION ALL SELECT 'target', url, count(*), count(DISTINCT page_id) FROM l GROUP BY url
  UNION ALL SELECT 'domain', domain, count(*), count(DISTINCT page_id) FROM l GROUP BY domain""",
    "books_structured": f"WITH {BOOKS} SELECT {_BOOK_COLUMNS} FROM structured",
    "books_html": f"WITH {BOOKS} SELECT {_BOOK_COLUMNS} FROM by_selectors",
    "books": f"WITH {BOOKS} SELECT {_BOOK_COLUMNS} FROM books",
    "book_defaults": f"""WITH {BOOKS} SELECT page_id, CAST(page_id AS VARCHAR) AS id, NULL::VARCHAR AS reading_status,
  NULL::DOUBLE AS reading_progress, NULL::BIGINT AS current_page, '' AS collections, '' AS tags, NULL::VARCHAR AS notes,
  '{{}}' AS custom_fields, epoch_us({SNAPSHOT}) AS last_scraped_us, source AS primary_source, source AS sources, false AS is_owned,
  1.0::DOUBLE AS confidence_score, 0.0::DOUBLE AS data_completeness, epoch_us({SNAPSHOT}) AS created_us,
  epoch_us({SNAPSHOT}) AS updated_us FROM books""",
    "book_validate": f"WITH {BOOKS} SELECT page_id, {_OUT_OF_RANGE} AS reasons FROM books",
    "book_completeness": f"""WITH {BOOKS} SELECT page_id,
  round((CASE kind WHEN 0 THEN 9 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 5 ELSE 1 END) / 28.0::DOUBLE, 6) AS completeness FROM books""",
    "book_consolidate": f"""WITH {BOOKS}, timed AS (SELECT *, CAST(page_id % 499 AS VARCHAR) AS book_key,
    {SNAPSHOT} + to_minutes(page_id * 37 % 1000) AS created_at FROM books),
  ranked AS (SELECT *, row_number() OVER (ORDER BY created_at, page_id) AS rn FROM timed)
  SELECT book_key, arg_min(source, rn) AS primary_source, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources,
  count(*) AS copies, min(epoch_us(created_at)) AS created_us, {_first('title')} AS title,
  coalesce({_first('authors')}, '') AS authors, {_first('publisher')} AS publisher, {_first('rating')} AS rating,
  {_first('description')} AS description, {_first('cover_image_url')} AS cover_image_url FROM ranked GROUP BY book_key""",
    "book_consolidate_linked": f"""WITH {BOOKS}, keyed AS (SELECT page_id AS k, source, title, publisher,
    {SNAPSHOT} + to_minutes(page_id * 37 % 1000) AS created_at,
    CASE WHEN page_id % 7 <> 0 THEN '9780' || lpad(CAST(page_id // 2 AS VARCHAR), 9, '0') END AS isbn13,
    CASE WHEN page_id % 5 <> 0 THEN 'https://books.example.com/c/' || ((page_id + 1) // 2) END AS link FROM books),
  tied AS (SELECT *, coalesce(lag(k) OVER (ORDER BY k) = k - 1 AND
    CASE WHEN k % 2 = 1 THEN lag(isbn13) OVER (ORDER BY k) = isbn13 ELSE lag(link) OVER (ORDER BY k) = link END, false) AS on_from FROM keyed),
  runs AS (SELECT *, sum(CASE WHEN on_from THEN 0 ELSE 1 END) OVER (ORDER BY k) AS run,
    row_number() OVER (ORDER BY created_at, k) AS rn FROM tied)
  SELECT CASE WHEN count(isbn13) > 0 THEN 'isbn' WHEN count(link) > 0 THEN 'url' ELSE 'page' END AS key_kind,
  coalesce(min(isbn13), min(link), CAST(min(k) AS VARCHAR)) AS book_key, arg_min(source, rn) AS primary_source,
  array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, count(*) AS copies, min(epoch_us(created_at)) AS created_us,
  {_first('title')} AS title, {_first('publisher')} AS publisher FROM runs GROUP BY run""",
    "book_search_indexed": f"""WITH {BOOKS}, asked(query, wanted) AS (VALUES ('Anvil', NULL), ('brand#2', 'amazon'), ('#3', NULL), ('no such book', NULL)),
  hits AS (SELECT query, page_id, title, row_number() OVER (PARTITION BY query ORDER BY title, page_id) AS rn
    FROM asked JOIN books ON (wanted IS NULL OR source = wanted)
      AND (contains(lower(title), lower(query)) OR contains(lower(authors), lower(query))))
  SELECT query, page_id, title FROM hits WHERE rn <= 10""",
    "book_search": f"""WITH {BOOKS} SELECT page_id, title FROM books WHERE contains(lower(title), 'anvil')
  OR contains(lower(authors), 'anvil') ORDER BY title, page_id LIMIT 10""",
    "book_search_source": f"""WITH {BOOKS} SELECT page_id, title FROM books WHERE source = 'amazon'
  AND (contains(lower(title), 'brand#2') OR contains(lower(authors), 'brand#2')) ORDER BY title, page_id LIMIT 10""",
    "domain_key": f"""WITH {LOG} SELECT log_id, CASE log_id % 6 WHEN 0 THEN domain WHEN 1 THEN 'user:pw@' || domain || ':8080'
  WHEN 2 THEN '' WHEN 5 THEN domain ELSE 'default' END AS domain_key FROM log""",
    "token_bucket": _AUDIT_RESULT,
    "nested_limits": f"""WITH RECURSIVE {LOG}, {_INNER_BUCKET},
  passed AS (SELECT log.* FROM log JOIN inner_audit USING (log_id) WHERE admitted), {_OUTER_BUCKET}
  SELECT log_id, false AS admitted, round(delay_seconds, 3) AS delay_seconds, 'inner' AS blocked_by
    FROM inner_audit WHERE NOT admitted UNION ALL
  SELECT log_id, admitted, round(delay_seconds, 3), CASE WHEN NOT admitted THEN 'outer' END FROM outer_audit""",
    "limiter_stats": f"""{AUDIT} SELECT bucket_key AS domain, count(*) FILTER (WHERE admitted) AS total_requests,
  count(*) FILTER (WHERE NOT admitted) AS blocked_requests,
  round(count(*) FILTER (WHERE admitted) / count(*)::DOUBLE, 6) AS success_rate,
  round(arg_max(tokens_after, (ts, log_id)), 6) AS tokens_available,
  round(0.125 / 3600, 6) AS requests_per_second, 2 AS burst_size FROM audit JOIN log USING (log_id) GROUP BY bucket_key""",
    "delay_histogram": _histogram(
        f"{AUDIT}, held AS (SELECT bucket_key AS domain, delay_seconds FROM audit WHERE delay_seconds > 0)",
        "held", "delay_seconds", "domain", SECONDS_BOUNDS,
    ),
    "rolling_response": f"""WITH {LOG}, rolled AS (SELECT log_id, source, avg(response_time_ms / 1000) OVER recent AS avg_rt,
    avg(CASE WHEN http_status = 200 THEN 0.0 ELSE 1.0 END) OVER recent AS avg_err FROM log
    WINDOW recent AS (PARTITION BY source ORDER BY ts, log_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
  SELECT log_id, source, {_AVERAGES} FROM rolled""",
    "adaptive_rate": _ADAPTIVE_RESULT,
    "adaptive_stats": f"""{ADAPTIVE}, last AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rn DESC) AS back FROM adapted)
  SELECT domain, round(factor, 6) AS adaptation_factor, round(CAST(rate AS DOUBLE), 6) AS current_rate, {_AVERAGES}
  FROM last WHERE back = 1""",
    "stream_request_rate": _windows(f"WITH {RESULTS}", 10),
    "stream_late_rows": f"""WITH {LOG}, landed AS (SELECT log_id, source, epoch_us(ts) AS us,
    (epoch_us(ts) + CASE WHEN log_id % 10 = 3 THEN 777600000000 ELSE 0 END) // 604800000000 AS week FROM log),
  weeks AS (SELECT week, max(us) AS latest FROM landed GROUP BY week),
  seen AS (SELECT week, max(latest) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM weeks)
  SELECT source, count(*) AS requests, count(*) FILTER (WHERE us < seen - 86400000000) AS late
  FROM landed JOIN seen USING (week) GROUP BY source""",
    "stream_counters": f"""WITH {RESULTS}, typed AS (SELECT *, error_code AS error_type,
    status = 'success' AND log_id % 6 <> 5 AS has_book FROM results)
  SELECT metric, source, status, error_type, le, round(value, 3) AS value FROM ({_COUNTERS})""",
    "stream_token_bucket": _AUDIT_RESULT,
    "stream_token_bucket_runs": _AUDIT_RESULT,
    "stream_adaptive": _ADAPTIVE_RESULT,
    "stream_extract": f"""SELECT page_id, url,
  {_element_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title FROM pages""",
}
_REASONS = """concat_ws('|', CASE WHEN t.url NOT LIKE 'https://%' THEN 'url is no http url' END,
  CASE WHEN t.source = 'elsewhere' THEN 'unknown source' END,
  CASE WHEN priority NOT BETWEEN 1 AND 10 THEN 'priority out of range' END)"""
_ORACLES["scrape_batch"] = f"""WITH {REQUESTS}, {LOG}, {BOOKS}, checked AS (SELECT request_id, pos, {_REASONS} AS reasons FROM tasks t),
  got AS (SELECT log_id // 5 AS request_id, log_id % 5 AS pos, {_OK} AS ok, http_status, exception_class, title
    FROM log LEFT JOIN books ON page_id = log_id % (SELECT count(*) FROM part))
  SELECT request_id, pos, CASE WHEN reasons <> '' THEN 'rejected' WHEN NOT ok THEN 'failed' WHEN title IS NULL THEN 'partial'
    ELSE 'success' END AS status,
  CASE WHEN reasons = '' AND NOT ok THEN coalesce(exception_class, 'HTTP_' || http_status) END AS error_code,
  CASE WHEN reasons = '' AND ok THEN title END AS title, reasons FROM checked JOIN got USING (request_id, pos)"""
# Raw pages made well-formed: what the tree rules imply is written out, markup inside scripts is masked.
_WHOLE = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', '', 'g'),
  '(<script>var t=")<(/p)>', '\1' || chr(1) || '\2' || chr(2)), '(<br>[^<]*)(<p>|</article>)', '\1</b></p>\2', 'g')"""
_ORACLES["dom_intervals"] = f"""WITH whole AS (SELECT page_id, {_WHOLE} AS html FROM pages),
  closed AS (SELECT page_id, html || CASE WHEN contains(html, '</html>') THEN '' ELSE '</body></html>' END AS html FROM whole),
  cut AS (SELECT page_id, regexp_extract_all(html, '<[^>]*>') AS tags, string_split_regex(html, '<[^>]*>') AS texts FROM closed),
  tokens AS (SELECT page_id, unnest(range(1, len(tags) + 1)) AS i, unnest(tags) AS mark, unnest(texts[2:]) AS after FROM cut),
  named AS (SELECT page_id, i, regexp_extract(mark, '^</?([a-z0-9]+)', 1) AS tag, mark LIKE '</%' AS closing,
    regexp_extract(mark, '^<[a-z0-9]+ +([a-z]+)="', 1) AS attr, {_unescaped("""regexp_extract(mark, '="([^"]*)"', 1)""")} AS value,
    replace(replace({_unescaped('after')}, chr(1), '<'), chr(2), '>') AS after FROM tokens),
  steps AS (SELECT *, tag IN ('meta', 'br') AS void, CASE WHEN tag IN ('meta', 'br') THEN 0 WHEN closing THEN -1 ELSE 1 END AS step FROM named),
  deep AS (SELECT *, sum(step) OVER w + CASE WHEN closing OR void THEN 1 ELSE 0 END AS depth,
    sum(CASE WHEN closing THEN 0 ELSE 1 END) OVER w - 1 AS pre,
    sum(CASE WHEN closing OR void THEN 1 ELSE 0 END) OVER w - 1 AS post,
    coalesce(sum(length(after)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
    FROM steps WINDOW w AS (PARTITION BY page_id ORDER BY i)),
  text_of AS (SELECT page_id, string_agg(after, '' ORDER BY i) AS page_text FROM named GROUP BY page_id),
  opens AS (SELECT *, row_number() OVER (PARTITION BY page_id, depth ORDER BY i) AS nth FROM deep WHERE NOT closing AND NOT void),
  closes AS (SELECT *, row_number() OVER (PARTITION BY page_id, depth ORDER BY i) AS nth FROM deep WHERE closing),
  elements AS (SELECT o.page_id, o.i, o.depth, o.pre, c.post, o.tag, o.attr, o.value, o.begins AS start, c.begins AS stop
    FROM opens o JOIN closes c USING (page_id, depth, nth) UNION ALL
    SELECT page_id, i, depth, pre, post, tag, attr, value, begins, begins FROM deep WHERE void)
  SELECT e.page_id, CAST(e.pre AS BIGINT) AS node_id, CAST(p.pre AS BIGINT) AS parent_id, CAST(e.pre AS INTEGER) AS pre,
  CAST(e.post AS INTEGER) AS post, e.tag, CASE WHEN e.attr = '' THEN '' ELSE e.attr || '=' || e.value END AS attrs,
  trim(substring(page_text, CAST(e.start AS BIGINT) + 1, CAST(e.stop - e.start AS BIGINT)), chr(32) || chr(9) || chr(10) || chr(13)) AS text
  FROM elements e JOIN text_of USING (page_id)
  ASOF LEFT JOIN (SELECT page_id, i, depth + 1 AS depth, pre FROM opens) p ON e.page_id = p.page_id AND e.depth = p.depth AND e.i > p.i"""
_ORACLES["active_peak"] = f"""WITH series AS ({_ORACLES["active_requests"]})
  SELECT max(active) AS peak, arg_max(at_us, active * 10000000000000000::HUGEINT - at_us) AS first_us FROM series"""


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
