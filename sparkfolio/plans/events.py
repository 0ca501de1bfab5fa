"""Queries: event logs, limits, windows, dashboards, notes, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import streaming
from ..functions.text import normalized_url
from ..operators import logs, sinks
from ..sources.corpus import Corpus
from .registry import query


def _requests(c: Corpus) -> DataFrame:
    return c.table("events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))


@query("SELECT event_id AS id, user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def rate_limit_tumbling(c: Corpus) -> DataFrame:
    return logs.tumbling_limit(_requests(c), 2, 86400).select("id", "key", "allowed")


@query("""WITH RECURSIVE r AS (SELECT event_id AS id, user_id::VARCHAR AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  w AS (SELECT id, key, ts, k, true AS allowed, [ts] AS accepted FROM r WHERE k = 1
    UNION ALL SELECT id, key, ts, k, len(recent) < 2, CASE WHEN len(recent) < 2 THEN list_append(recent, ts) ELSE recent END
      FROM (SELECT r.id, r.key, r.ts, r.k, list_filter(w.accepted, lambda a: a >= r.ts - INTERVAL 1 DAY) AS recent FROM w JOIN r ON r.key = w.key AND r.k = w.k + 1))
  SELECT id, key, epoch_us(ts) AS us, allowed FROM w""")
def rate_limit_sliding(c: Corpus) -> DataFrame:
    return streaming.sliding_limit(_requests(c), 2, 86400.0).select("id", "key", F.unix_micros("ts").alias("us"), "allowed")


_ROUTES = [
    ("GET", "/api/v1/live"), ("GET", "/api/v1/health"), ("GET", "/api/v1/ready"), ("GET", "/api/v1/metrics/info"), ("GET", "/health"), ("POST", "/api/v1/investigations"), ("POST", "/api/v1/investigations//"), ("GET", "/api/v1/investigations"),
    ("POST", "/api/v2/investigations"), ("POST", "/api/v1/investigations/1/retrieve"), ("POST", "/api/v1/investigations/1/retrieve/"), ("GET", "/api/v1/investigations/1/retrieve"), ("POST", "/api/v1/copilot/1/chat"), ("GET", "/api/v1/papers"), ("POST", "/api/v1/export"), ("GET", "/api/v1/export"),
]


@query(f"""WITH r AS (SELECT event_id, {[m for m, _ in _ROUTES]}[(event_id % 16 + 1)::INT] AS m, {[p for _, p in _ROUTES]}[(event_id % 16 + 1)::INT] AS p FROM events)
  SELECT event_id, CASE WHEN m = 'POST' AND p = '/api/v1/export' THEN 3 WHEN p IN ('/api/v1/live', '/api/v1/health', '/api/v1/ready', '/api/v1/metrics/info') THEN NULL WHEN m = 'POST' AND rtrim(p, '/') LIKE '%/retrieve' THEN 5
    WHEN m = 'POST' AND rtrim(p, '/') = '/api/v1/investigations' THEN 10 WHEN contains(p, '/copilot') AND contains(p, '/chat') THEN 20 ELSE 120 END AS allowed FROM r""")
def rate_limit_policy(c: Corpus) -> DataFrame:
    k = (F.col("event_id") % len(_ROUTES) + 1).cast("int")
    method, path = (F.element_at(F.array(*[F.lit(r[i]) for r in _ROUTES]), k) for i in (0, 1))
    return c.table("events").select("event_id", logs.policy(method, path, {("post", "/api/v1/export"): 3}).alias("allowed"))


@query("SELECT event_type, (epoch(ts)::BIGINT // 86400) * 86400 AS start_s, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows_tumbling(c: Corpus) -> DataFrame:
    return logs.windowed(c.table("events"), 86_400)


@query("SELECT event_type, (epoch(ts)::BIGINT // 43200 - k) * 43200 AS start_s, count(*) AS events, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def windows_sliding(c: Corpus) -> DataFrame:
    return logs.windowed(c.table("events"), 86_400, 43_200)


@query("""WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w >= INTERVAL 6 HOURS)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id, epoch_us(min(ts)) // 1000000 AS start_s, count(*) AS events FROM s GROUP BY user_id, k""")
def windows_session(c: Corpus) -> DataFrame:
    return logs.sessions(c.table("events"), "6 hours").select("user_id", F.unix_timestamp("start").alias("start_s"), "events")


_LOG = "l AS (SELECT user_id AS execution_id, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'completed' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'started' END AS kind, ts, event_id AS id FROM events)"


@query(f"""WITH {_LOG}, p AS (SELECT *, lead(ts) OVER w AS e, lead(kind) OVER w AS k FROM l WINDOW w AS (PARTITION BY execution_id, stage ORDER BY ts, id))
  SELECT execution_id, stage, row_number() OVER (PARTITION BY execution_id, stage ORDER BY ts, id) AS attempt, CASE WHEN k IN ('completed', 'failed') THEN k ELSE 'running' END AS status, CASE WHEN k IN ('completed', 'failed') THEN epoch_us(e) // 1000 - epoch_us(ts) // 1000 END AS duration_ms FROM p WHERE kind = 'started'""")
def stage_attempts(c: Corpus) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "completed").when(k % 7 == 0, "failed").otherwise("started")
    log = c.table("events").select(F.col("user_id").alias("execution_id"), F.col("event_type").alias("stage"), kind.alias("kind"), "ts", k.alias("id"))
    return logs.stage_attempts(log).drop("started_at")


@query("SELECT event_type, count(*) AS count, round(sum(value), 4) AS sum, count_if(value <= 10)::BIGINT AS le_10, count_if(value <= 50)::BIGINT AS le_50, count_if(value <= 100)::BIGINT AS le_100 FROM events GROUP BY 1")
def metrics_histogram(c: Corpus) -> DataFrame:
    return logs.metrics(c.table("events"), ["event_type"], "value", [10, 50, 100])


@query("SELECT 'events_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_exposition(c: Corpus) -> DataFrame:
    return logs.exposition(c.table("events").groupBy("event_type").agg(F.count("*").alias("n")), "events_total", ["event_type"], "n")


@query("SELECT user_id, event_id AS id, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS active FROM events")
def active_requests(c: Corpus) -> DataFrame:
    e = c.table("events").select("user_id", "ts", F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("delta"))
    return logs.running_active(e, "user_id").select("user_id", "id", "active")


@query("SELECT user_id, count(*) AS runs, round(avg(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END), 4) AS average, count_if(event_type <> 'error')::BIGINT AS ok, count_if(event_type = 'error')::BIGINT AS failed, round(100 * count_if(event_type <> 'error') / count(*))::BIGINT AS percent FROM events GROUP BY 1")
def execution_dashboard(c: Corpus) -> DataFrame:
    runs = c.table("events").select("user_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("duration"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return logs.dashboard(runs, "user_id")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_of_investigations(c: Corpus) -> DataFrame:
    o = c.table("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return logs.recent(o, 20, [F.desc("o_orderdate"), F.col("o_orderkey")], 40).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("SELECT conv_id, turn FROM conversations WHERE (role ILIKE '%the%' OR text ILIKE '%the%') AND role = 'user'")
def search_notes(c: Corpus) -> DataFrame:
    notes = c.table("conversations").where("role = 'user'").select("conv_id", "turn", F.col("role").alias("title"), F.col("text").alias("content"))
    return logs.searched_notes(notes, " The ").select("conv_id", "turn")


@query("""WITH a AS (SELECT event_id AS id, event_type, user_id, ts, value FROM events WHERE event_id % 4 <> 0) SELECT event_type, user_id, max_by(id, {'t': ts, 'i': id}) AS id FROM a GROUP BY 1, 2""")
def latest_artifacts(c: Corpus) -> DataFrame:
    k = F.col("event_id")
    a = c.table("events").select(k.alias("id"), "event_type", "user_id", F.col("ts").alias("created_at"), F.when(k % 4 == 0, "draft").otherwise("ready").alias("status"), F.col("props").alias("payload"))
    return sinks.latest_ready(a, ["event_type", "user_id"]).select("event_type", "user_id", "id")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_fields(c: Corpus) -> DataFrame:
    return c.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://', ''), '/+$', '') AS url FROM pages")
def normalized_urls(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", normalized_url(F.col("url")).alias("url"))


@query("SELECT event_id, 'a=1,b=' || (event_id % 3) || ',c=3' AS merged FROM events")
def update_metadata(c: Corpus) -> DataFrame:
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("old"))
    new = F.create_map(F.lit("b"), (F.col("event_id") % 3).cast("string"), F.lit("c"), F.lit("3"))
    entries = F.array_sort(F.map_entries(logs.merged_metadata(old, new)))
    return c.table("events").select("event_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("merged"))
