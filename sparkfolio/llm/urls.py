"""URL filters: captures against dated lists of hosts, as the lists stood when each capture was fetched. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import table

#: What stands between the user, if there is one, and the port or path; an IPv6 address with its brackets.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[]+)"
#: Hosts that are addresses: these have no domains above them.
ADDRESS = r"^(\[.*|[0-9.]+)$"


def host_of(url: Column) -> Column:
    """Host in lower case without a final dot; null where the URL has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def suffixes(host: Column, lengths: list[int]) -> Column:
    """array<struct<depth, pattern>>: of the host and the domains above it those of the lengths, the most specific first, with how
    many characters stand before each; of an address only itself. Work goes by the lengths, so a host of any length is looked at whole."""
    n = F.length(host)
    alone = host.rlike(ADDRESS)
    fits = lambda k: (k == n) | (~alone & (k < n) & (F.substr(host, n - k, F.lit(1)) == "."))
    ends = F.filter(F.array(*map(F.lit, sorted(lengths, reverse=True))).cast("array<int>"), fits)
    return F.transform(ends, lambda k: F.struct((n - k).alias("depth"), F.substr(host, n - k + 1).alias("pattern")))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, spans array<struct<since,until,action>>: list entries (pattern, action, at) as intervals of validity.

    An entry holds from its time until the pattern's next one; actions are block, allow and remove (the pattern is on no list).
    Of entries at the same time the first in the order block, allow, remove holds; repeated entries change nothing. Entries
    without pattern or time are void. One row a pattern, with an interval for each change of its own state: that grows with how
    often a single pattern is listed and removed, not with the list.
    """
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    clean = entries.select(F.lower(F.col("pattern")).alias("pattern"), "action", F.col("at").cast("timestamp").alias("at"), rank.alias("_rank")).where("pattern is not null and at is not null")
    at_once = clean.groupBy("pattern", "at").agg(F.min_by("action", "_rank").alias("action"))
    until = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    spans = at_once.withColumn("until", until).where(F.col("action").isin("block", "allow"))
    return spans.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("since"), "until", "action"))).alias("spans"))


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (with url and fetched_at) with host, matched_pattern, matched_action, kept; columns of these names that captures
    has are replaced, all others stay.

    The most specific pattern that is active at fetched_at decides: block drops the capture, allow keeps it. Without an active
    pattern, a host or a fetch time it is kept; repeated rows are judged each; an empty table gives an empty one. Entries are
    matched to distinct hosts first, so a host with a third of all captures meets the lists once, and written as a table with
    a row for each host that has any; captures meet it as an as-of join on the host and the time in each of its intervals.
    The planner broadcasts that table if its size allows it; else both sides are shuffled plainly, and adaptive execution
    can split a host's captures, since nothing needs them together. A host of any length meets every domain above it that is
    on a list: the driver gets the distinct lengths of patterns, of which there are at most the root of twice all their characters.
    """
    added = ["host", "matched_pattern", "matched_action", "kept"]
    own = [F.col(f"`{c}`") for c in captures.columns if c not in added]
    rows = captures.select(F.struct(*own).alias("_row"), F.col("fetched_at"), host_of(F.col("url").cast("string")).alias("host"))
    hosts = rows.select(F.col("host").alias("_host")).where("_host is not null").distinct()
    spans = intervals(entries)
    lengths = [r.n for r in spans.select(F.length("pattern").alias("n")).distinct().collect()]
    candidates = hosts.select("_host", F.explode(suffixes(F.col("_host"), lengths)).alias("_s")).select("_host", F.col("_s.depth").alias("_depth"), F.col("_s.pattern").alias("_pattern"))
    found = candidates.join(spans, F.col("_pattern") == F.col("pattern"))
    by_host = table(found.groupBy("_host").agg(F.sort_array(F.collect_list(F.struct("_depth", "pattern", "spans"))).alias("_lists")))
    at = F.col("fetched_at").cast("timestamp")

    def active(span: Column) -> Column:
        return (at >= span["since"]) & (span["until"].isNull() | (at < span["until"]))

    hits = F.transform(F.col("_lists"), lambda x: F.struct(x["pattern"].alias("pattern"), F.get(F.filter(x["spans"], active), F.lit(0))["action"].alias("action")))
    first = F.get(F.filter(hits, lambda x: x["action"].isNotNull()), F.lit(0))
    joined = rows.join(by_host, F.col("host") == F.col("_host"), "left").withColumn("_hit", first)
    return joined.withColumns(
        {"matched_pattern": F.col("_hit.pattern"), "matched_action": F.col("_hit.action"), "kept": ~F.coalesce(F.col("_hit.action") == "block", F.lit(False))}
    ).select("_row.*", *added)


def page_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, fetched_at. The table has no times: a page is taken as fetched at an hour of 2024 that follows from its id."""
    hours = F.pmod(F.col("page_id") * 37, F.lit(8760))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + hours * 3600).alias("fetched_at"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """pattern, action, at: dated entries for the hosts of pages and the domains above them, made up from a hash of their names.

    A third of the hosts are blocked at some time; half of these are removed 60 days later and a quarter blocked again 120
    days after that; a tenth of the domains directly above are blocked, and their allowed hosts make exceptions.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()

    def number(name: Column) -> Column:
        return F.conv(F.substring(F.md5(name.cast("binary")), 1, 7), 16, 10).cast("long")

    crc = number(F.col("host"))
    start = F.lit(1704067200) + F.pmod(crc, F.lit(300)) * 86400
    parent = F.when(F.col("host").rlike(ADDRESS), F.col("host")).otherwise(F.substring_index("host", ".", -3))

    def entry(when: Column, pattern: Column, action: str, at: Column) -> Column:
        return F.when(when, F.struct(pattern.alias("pattern"), F.lit(action).alias("action"), F.timestamp_seconds(at).alias("at")))

    hash_parent = number(parent)
    made = F.array(
        entry(crc % 3 == 0, F.col("host"), "block", start),
        entry(crc % 6 == 0, F.col("host"), "remove", start + 60 * 86400),
        entry(crc % 12 == 0, F.col("host"), "block", start + 180 * 86400),
        entry(hash_parent % 10 == 0, parent, "block", F.lit(1704067200) + F.pmod(hash_parent, F.lit(200)) * 86400),
        entry((hash_parent % 10 == 0) & (crc % 3 == 1), F.col("host"), "allow", start),
    )
    return hosts.select(F.explode(F.array_compact(made)).alias("e")).select("e.*").distinct()


SQL = r"""
WITH p AS (SELECT page_id, url, epoch_ms((1704067200 + ((page_id * 37) % 8760) * 3600) * 1000) AS fetched_at,
        nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[]+)', 1)), '\.+$', ''), '') AS host FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
lab AS (SELECT host, CASE WHEN regexp_matches(host, '^(\[.*|[0-9.]+)$') THEN [host] ELSE string_split(host, '.') END AS l FROM h),
up AS (SELECT host, array_to_string(CASE WHEN len(l) > 3 THEN l[len(l) - 2:] ELSE l END, '.') AS parent, l FROM lab),
crc AS (SELECT host, parent, ('0x' || substr(md5(host), 1, 7))::BIGINT AS c, ('0x' || substr(md5(parent), 1, 7))::BIGINT AS cp FROM up),
e AS (
  SELECT host AS pattern, 'block' AS action, 1704067200 + (c % 300) * 86400 AS moment FROM crc WHERE c % 3 = 0
  UNION SELECT host, 'remove', 1704067200 + (c % 300 + 60) * 86400 FROM crc WHERE c % 6 = 0
  UNION SELECT host, 'block', 1704067200 + (c % 300 + 180) * 86400 FROM crc WHERE c % 12 = 0
  UNION SELECT parent, 'block', 1704067200 + (cp % 200) * 86400 FROM crc WHERE cp % 10 = 0
  UNION SELECT host, 'allow', 1704067200 + (c % 300) * 86400 FROM crc WHERE cp % 10 = 0 AND c % 3 = 1),
o AS (SELECT pattern, moment, min_by(action, CASE action WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END) AS action FROM e GROUP BY pattern, moment),
iv AS (SELECT pattern, action, epoch_ms(moment * 1000) AS since, epoch_ms(lead(moment) OVER (PARTITION BY pattern ORDER BY moment) * 1000) AS until FROM o),
cand AS (SELECT host, i AS depth, array_to_string(l[i:], '.') AS pattern FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM lab)),
hit AS (SELECT p.page_id, p.url, p.fetched_at, min_by(iv.pattern, c.depth) AS pattern, min_by(iv.action, c.depth) AS action
  FROM p JOIN cand c ON c.host = p.host JOIN iv ON iv.pattern = c.pattern AND iv.action <> 'remove' AND p.fetched_at >= iv.since AND (iv.until IS NULL OR p.fetched_at < iv.until)
  GROUP BY ALL)
SELECT p.page_id, p.url, epoch_ms(p.fetched_at) // 1000 AS fetched_s, p.host, hit.pattern AS matched_pattern, hit.action AS matched_action, NOT coalesce(hit.action = 'block', false) AS kept
FROM p LEFT JOIN hit ON hit.page_id = p.page_id
"""
