"""Queries over pages, orders, events and the other tables: links, catalog, rules, roll-ups, time series and regimes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import html_anchors, html_title, plain_html
from siltstone.operators import claims, events, ingest, notes, quant, rules, series, states


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def html_extract(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    text = plain_html(F.col("html"))
    return p.select("page_id", html_title(F.col("html")).alias("title"), F.length(text).cast("long").alias("n_chars"), F.sha1(text).alias("text_sha1"))


def _entities(e: str) -> str:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
        e = f"replace({e}, '{a}', '{b}')"
    return e


_squeeze = lambda e: f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
_plain = lambda e: _squeeze(_entities(f"regexp_replace(regexp_replace(regexp_replace({e}, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs')"))
_TITLE = _squeeze(_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
_HTML = f"SELECT page_id, {_TITLE} AS title, length({_plain('html')}) AS n_chars, sha1({_plain('html')}) AS text_sha1 FROM pages"


def _anchors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html_anchors(F.col("html"))).alias("a")).select("page_id", "a.target", "a.text")


def link_inventory(spark, sf_dir):
    return _anchors(spark, sf_dir)


_ANCHORS = f"""SELECT DISTINCT page_id, regexp_extract(a, '(?is)href=["'']([^"'']*)["'']', 1) AS target, {_plain('a')} AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href=["''][^"'']*["''][^>]*>.*?</a>')) AS a FROM pages)"""


def _resolved(spark, sf_dir) -> DataFrame:
    """Links by the first part of a page's path; the last page of a name holds it."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.lower(F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1))).alias("alias"))
    names = p.groupBy("alias").agg(F.max("page_id").alias("path"))
    links = _anchors(spark, sf_dir).select(F.col("page_id").alias("src"), F.lower("target").alias("target")).distinct()
    return notes.resolved_links(links, names)


_RESOLVED = f"""n AS (SELECT '/' || lower(regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1)) AS target, max(page_id) AS path FROM pages GROUP BY 1), a AS ({_ANCHORS}), r AS (SELECT l.src, l.target, n.path FROM (SELECT DISTINCT page_id AS src, lower(target) AS target FROM a) l LEFT JOIN n USING (target))"""


def page_backlinks(spark, sf_dir):
    b = notes.backlinks(_resolved(spark, sf_dir))
    return b.select("path", "n_sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


_BACKLINKS = f"WITH {_RESOLVED} SELECT path, count(*) AS n_sources, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS sources FROM (SELECT DISTINCT path, src FROM r WHERE path IS NOT NULL AND path <> src) GROUP BY path"


def broken_links(spark, sf_dir):
    return notes.broken_links(_resolved(spark, sf_dir)).groupBy("src").agg(F.count("*").alias("n_broken"), F.min("target").alias("first_target"))


_BROKEN = f"WITH {_RESOLVED} SELECT src, count(*) AS n_broken, min(target) AS first_target FROM (SELECT DISTINCT src, target FROM r WHERE path IS NULL) GROUP BY src"


def orphan_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), "url")
    return notes.orphans(pages, notes.backlinks(_resolved(spark, sf_dir)))


_ORPHANS = f"WITH {_RESOLVED} SELECT page_id AS path, url FROM pages WHERE page_id NOT IN (SELECT path FROM r WHERE path IS NOT NULL AND path <> src)"


def title_scoring(spark, sf_dir):
    """Titles, first text words and address stems of pages as candidates, each with its worth."""
    p = table(spark, sf_dir, "pages")
    stem = F.initcap(F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)/?$", 1), "[-_]+", " "))
    first = F.array_join(F.slice(F.split(plain_html(F.col("html")), " "), 1, 8), " ")
    rows = p.select("page_id", stem.alias("filename"), F.explode(F.create_map(F.lit("frontmatter_title"), html_title(F.col("html")), F.lit("first_line"), first, F.lit("filename"), stem)).alias("label", "value"))
    return ingest.best_titles(rows, "page_id").select("page_id", "title", F.col("score").cast("long").alias("score"), "label")


def freshness_lint(spark, sf_dir):
    """Orders as notes: the priority is the kind, which sets the threshold; the last order is the present."""
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate").alias("as_of"))
    days = F.regexp_extract("o_orderpriority", r"^(\d)", 1).cast("int") * 300
    age = notes.age_days(F.col("o_orderdate"), F.col("as_of"))
    rows = o.crossJoin(F.broadcast(last)).withColumns({"age": age, "state": notes.freshness(age, days)})
    return rows.groupBy("o_orderpriority", "state").agg(F.count("*").alias("n"), F.max("age").alias("oldest"))


_FRESH = "SELECT o_orderpriority, CASE WHEN age > days THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n, max(age) AS oldest FROM (SELECT o_orderpriority, CAST(regexp_extract(o_orderpriority, '^([0-9])', 1) AS INT) * 300 AS days, CAST(floor((epoch((SELECT max(o_orderdate) FROM orders)) - epoch(o_orderdate)) / 86400) AS BIGINT) AS age FROM orders) GROUP BY ALL"


def state_diff(spark, sf_dir):
    """Users per event type in the last week and the one before it."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.to_date(F.max("ts")).alias("as_of"))
    rows = e.crossJoin(F.broadcast(last)).withColumn("age", F.datediff("as_of", F.to_date("ts")))
    return states.set_diff(rows, "event_type", "user_id", F.col("age").between(7, 13), F.col("age") < 7)


_STATE_DIFF = """WITH e AS (SELECT event_type, user_id, date_diff('day', CAST(ts AS DATE), (SELECT CAST(max(ts) AS DATE) FROM events)) AS age FROM events), g AS (SELECT event_type, user_id, bool_or(age BETWEEN 7 AND 13) AS was, bool_or(age < 7) AS now FROM e WHERE age < 14 GROUP BY ALL)
SELECT event_type, count(*) FILTER (WHERE was AND now) AS n_carried, count(*) FILTER (WHERE NOT was AND now) AS n_added, count(*) FILTER (WHERE was AND NOT now) AS n_removed FROM g GROUP BY event_type"""

_PHRASES = [("alpha", "red"), ("alpha", "part 12"), ("beta", "green part"), ("gamma", "part 7"), ("gamma", "part 70 special edition")]


def subject_resolution(spark, sf_dir):
    subjects = table(spark, sf_dir, "part").select(F.col("p_name").alias("subject")).distinct()
    phrases = spark.createDataFrame(_PHRASES, "title string, phrase string")
    return states.resolve_subjects(subjects, phrases).withColumn("score", F.col("score").cast("long"))


_lab = lambda e: f"array_to_string(regexp_extract_all(lower({e}), '[a-z0-9]+'), ' ')"
_SUBJECTS = f"""WITH s AS (SELECT DISTINCT p_name AS subject, {_lab('p_name')} AS s FROM part), p AS (SELECT title, phrase, {_lab('phrase')} AS p FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PHRASES)}) v(title, phrase)),
m AS (SELECT subject, title, phrase, CASE WHEN s = p THEN 1000 + length(p) WHEN contains(s, p) THEN 600 + length(p) WHEN contains(p, s) THEN 400 + length(s) ELSE 0 END AS score FROM s, p WHERE list_has_any(string_split(s, ' '), string_split(p, ' ')))
SELECT subject, title, score FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, title, phrase) AS k FROM m WHERE score > 0) WHERE k = 1"""


def _observations(spark, sf_dir) -> DataFrame:
    """Daily revenue by region as series."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    n, r = (table(spark, sf_dir, t) for t in ("nation", "region"))
    # nation and region are fixed tables of 25 and 5 rows
    places = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(places, c.c_nationkey == F.col("n_nationkey"))
    return rows.groupBy(F.col("r_name").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("value"))


def _panel(spark, sf_dir) -> DataFrame:
    # one row a day and region, which the panel and returns read several times
    return series.panel(_observations(spark, sf_dir).cache())


def market_panel(spark, sf_dir):
    return _panel(spark, sf_dir)


_OBS = "o AS (SELECT r_name AS series_id, CAST(o_orderdate AS DATE) AS date, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"
_PANEL = f"{_OBS}, g AS (SELECT * FROM (SELECT DISTINCT date FROM o), (SELECT DISTINCT series_id FROM o)), p AS (SELECT g.series_id, g.date, last_value(value IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS value FROM g LEFT JOIN o USING (series_id, date))"
_RETURNS = f"{_PANEL}, q AS (SELECT series_id, date, ln(value) - lag(ln(value)) OVER (PARTITION BY series_id ORDER BY date) AS ret FROM p), d AS (SELECT date FROM q WHERE ret IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(DISTINCT series_id) FROM o)), t AS (SELECT q.* FROM q JOIN d USING (date))"


def panel_returns(spark, sf_dir):
    return series.returns(_panel(spark, sf_dir)).select("series_id", "date", F.round("ret", 6).alias("ret"))


def rolling_features(spark, sf_dir):
    out = series.rolling(series.returns(_panel(spark, sf_dir)), "series_id", "date", "ret").where("v21 is not null")
    return out.select("series_id", "date", *[F.round(c, 6).alias(c) for c in ("m5", "m21", "v21")])


_ROLLING = f"WITH {_RETURNS}, w AS (SELECT series_id, date, count(*) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS n, avg(ret) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5, avg(ret) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS m21, stddev_samp(ret) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS v21 FROM t) SELECT series_id, date, round(m5, 6) AS m5, round(m21, 6) AS m21, round(v21, 6) AS v21 FROM w WHERE n = 21"
_BRIDGE = [("risk", "AMERICA"), ("risk", "EUROPE"), ("defense", "ASIA"), ("energy", "MIDDLE EAST"), ("hardware", "ASIA"), ("hardware", "AFRICA")]


def _bridge(spark) -> DataFrame:
    return spark.createDataFrame(_BRIDGE, "composite string, series_id string")


def composite_returns(spark, sf_dir):
    return series.composites(series.returns(_panel(spark, sf_dir)), _bridge(spark)).select("composite", "date", F.round("ret", 6).alias("ret"))


_COMPOSITES = f"WITH {_RETURNS} SELECT composite, date, round(avg(ret), 6) AS ret FROM t JOIN (VALUES {', '.join(map(str, _BRIDGE))}) b(composite, series_id) USING (series_id) GROUP BY ALL"


def _runs(spark, sf_dir) -> DataFrame:
    return series.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


_RUNS = "m AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m), u AS (SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, run)"


def event_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


def run_transitions(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    labels = table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()
    return series.leave_probabilities(series.transitions(runs, "user_id", "event_type"), labels).select("label", "next_label", F.round("p", 6).alias("p"))


_TRANSITIONS = f"WITH {_RUNS}, x AS (SELECT event_type AS label, lead(event_type) OVER (PARTITION BY user_id ORDER BY run) AS next_label FROM u), c AS (SELECT label, next_label, count(*) AS n FROM x WHERE next_label IS NOT NULL GROUP BY ALL), l AS (SELECT DISTINCT event_type AS label FROM events), k AS (SELECT a.label, b.label AS next_label, coalesce(n, 0) + 1 AS k FROM l a JOIN l b ON a.label <> b.label LEFT JOIN c ON c.label = a.label AND c.next_label = b.label) SELECT label, next_label, round(k / sum(k) OVER (PARTITION BY label), 6) AS p FROM k"


def duration_hazards(spark, sf_dir):
    h = series.hazards(_runs(spark, sf_dir), "event_type")
    return h.select("label", "n", *[F.round(c, 6).alias(c) for c in ("pmf", "survival", "hazard")])


_HAZARDS = f"WITH {_RUNS}, c AS (SELECT event_type AS label, n, count(*) AS k FROM u GROUP BY ALL), g AS (SELECT label, unnest(range(1, max(n) + 1)) AS n FROM c GROUP BY label), f AS (SELECT g.label, g.n, coalesce(k, 0) + 1 AS k FROM g LEFT JOIN c ON c.label = g.label AND c.n = g.n), p AS (SELECT label, n, k / sum(k) OVER (PARTITION BY label) AS pmf FROM f), v AS (SELECT *, sum(pmf) OVER (PARTITION BY label ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS survival FROM p) SELECT label, n, round(pmf, 6) AS pmf, round(survival, 6) AS survival, round(least(greatest(pmf / greatest(survival, 1e-9), 0.02), 0.95), 6) AS hazard FROM v"


def horizon_stats(spark, sf_dir):
    s = series.horizon_stats(table(spark, sf_dir, "events"), ["event_type"], "value")
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p_up", "p05", "p10", "median", "p90", "p95", "shortfall")])


_HORIZON = "WITH q AS (SELECT event_type, count(*) AS n, avg(value) AS mean, avg(CAST(value > 0 AS INT)) AS p_up, " + ", ".join(f"quantile_cont(value, {p}::DOUBLE) AS {n}" for p, n in ((0.05, "p05"), (0.1, "p10"), (0.5, "median"), (0.9, "p90"), (0.95, "p95"))) + " FROM events GROUP BY event_type), s AS (SELECT event_type, avg(value) AS shortfall FROM events JOIN q USING (event_type) WHERE value <= p05 GROUP BY event_type) SELECT event_type, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "p_up", "p05", "p10", "median", "p90", "p95", "shortfall")) + " FROM q JOIN s USING (event_type)"


def daily_event_log(spark, sf_dir):
    return events.daily(table(spark, sf_dir, "events"), "ts", "event_type").select("day", "event_type", "n", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


_DAILY = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY ALL"


def iso_week_review(spark, sf_dir):
    return events.weekly(table(spark, sf_dir, "events"), "ts", "event_type")


_WEEKLY = "SELECT isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, CAST(date_trunc('week', ts) AS DATE) AS starts, event_type, count(*) AS n FROM events GROUP BY ALL"


def commands_touched(spark, sf_dir):
    return events.commands_touched(table(spark, sf_dir, "events"), "ts", "event_type")


_TOUCHED = "SELECT CAST(ts AS DATE) AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS commands FROM events GROUP BY 1"


def observation_merge(spark, sf_dir):
    """Days' sums by user from the first and the second half of a day; the second wins."""
    e = table(spark, sf_dir, "events")
    half = lambda late: e.where(F.hour("ts") >= 12 if late else F.hour("ts") < 12).groupBy(F.col("user_id").alias("series_id"), F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 4).alias("value"))
    return series.merged(half(False), half(True))


_MERGE = "WITH h AS (SELECT user_id AS series_id, CAST(ts AS DATE) AS date, hour(ts) >= 12 AS late, round(sum(value), 4) AS value FROM events GROUP BY ALL) SELECT series_id, date, max_by(value, CAST(late AS INT)) AS value FROM h GROUP BY ALL"


def latest_two_per_key(spark, sf_dir):
    out = claims.latest_per_key(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return out.select("o_custkey", "o_orderkey", F.col("recency").cast("long").alias("recency"))


_LATEST = "SELECT o_custkey, o_orderkey, recency FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS recency FROM orders) WHERE recency <= 2"


def props_json_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"))
    return e.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count("k").alias("n_k"), F.max("k").alias("max_k"))


_PROPS = "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(json_extract(props, '$.k')) AS n_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY event_type"

_CONTEXTS = [("global", None, ["research", "writing"]), ("report", "report", ["writing", "research"]), ("decide", "decide", ["research"])]
#: Fields of rules that parts stand for, each by a remainder of the part's number or size.
_STATUS, _STRENGTHS, _BASES = ["active", "active", "draft", "superseded", "reviewed"], ["hard", "default", "soft"], ["declared", "observed", "learned-from-postmortem", "unknown"]
_SCOPE_OF, _APPLIES_TO = [["global"], ["report"], ["report", "decide"], ["watch"]], [["global"], ["writing"], ["research", "writing"], ["trading"]]
_SCHEMA_OF = ["constitution", "preference", "bias", "anti-pattern", "communication-style", "mode"]


def rule_resolution(spark, sf_dir):
    """Parts as rules: which are left in three contexts, with their class and place. They name each other by path, file and title."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, by: F.get(F.array(*[F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values]), (by % len(values)).cast("int"))
    title = F.concat("p_name", F.lit(" "), k.cast("string"))
    text = lambda number: number.cast("string")
    conflicts = F.when(k % 5 == 0, F.array(text(F.floor(k / 2)), F.concat(F.lit(" WIKI/self/"), text(k + 3), F.lit(".md")))).when(k % 5 == 1, F.array(F.lit("none such"))).otherwise(F.array().cast("array<string>"))
    supersedes = F.when(k % 7 == 0, F.array(F.concat(text(k + 1), F.lit(".md")), F.concat(F.lit("small ring "), text(k - k % 50)))).otherwise(F.array().cast("array<string>"))
    rows = p.select(
        F.concat(F.lit("wiki/self/"), text(k), F.lit(".md")).alias("path"), title.alias("title"), pick(_STATUS, k).alias("status"), (size % 5 + 1).cast("int").alias("priority"), pick(_STRENGTHS, size).alias("strength"),
        pick(_SCOPE_OF, k).alias("scope"), pick(_APPLIES_TO, size).alias("applies"), pick(_BASES, F.floor(k / 3)).alias("basis"), pick(_SCHEMA_OF, F.floor(k / 2)).alias("schema"), conflicts.alias("conflicts_with"), supersedes.alias("supersedes"), k.alias("seq"),
    )
    contexts = spark.createDataFrame(_CONTEXTS, "context string, command string, applicability array<string>")
    return rules.resolve(rows, contexts)[0].select("context", "path", "kind", F.col("place").cast("long").alias("place"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def _pick(values, by: str) -> str:
    return "[" + ", ".join(_list(v) if isinstance(v, list) else f"'{v}'" for v in values) + f"][CAST({by} AS BIGINT) % {len(values)} + 1]"


_RULE_SQL = f"""WITH r AS (SELECT 'wiki/self/' || p_partkey || '.md' AS path, p_name || ' ' || p_partkey AS title, {_pick(_STATUS, 'p_partkey')} AS status, p_size % 5 + 1 AS priority, {_pick(_STRENGTHS, 'p_size')} AS strength, {_pick(_SCOPE_OF, 'p_partkey')} AS scope, {_pick(_APPLIES_TO, 'p_size')} AS applies, {_pick(_BASES, 'p_partkey // 3')} AS basis, {_pick(_SCHEMA_OF, 'p_partkey // 2')} AS schema,
CASE p_partkey % 5 WHEN 0 THEN [CAST(p_partkey // 2 AS VARCHAR), ' WIKI/self/' || (p_partkey + 3) || '.md'] WHEN 1 THEN ['none such'] ELSE []::VARCHAR[] END AS cw, CASE WHEN p_partkey % 7 = 0 THEN [(p_partkey + 1) || '.md', 'small ring ' || (p_partkey - p_partkey % 50)] ELSE []::VARCHAR[] END AS sp, p_partkey AS seq FROM part),
x(context, command, ap) AS (VALUES {', '.join(f"('{c}', {'NULL' if k is None else repr(k)}, {_list(a)})" for c, k, a in _CONTEXTS)}),
m AS (SELECT r.*, x.*, CASE strength WHEN 'hard' THEN 3 WHEN 'soft' THEN 1 ELSE 2 END AS s, CASE WHEN list_contains(scope, command) THEN 2 WHEN list_contains(scope, 'global') THEN 1 ELSE 0 END AS cs, CASE WHEN list_has_any(list_filter(ap, lambda a: a <> 'global'), applies) THEN 2 WHEN list_contains(applies, 'global') THEN 1 ELSE 0 END AS aps, CASE basis WHEN 'learned-from-postmortem' THEN 3 WHEN 'observed' THEN 2 ELSE 1 END AS b, list_distinct([lower(title), replace(lower(title), ' ', '-'), lower(path), split_part(lower(path), '/', 3), split_part(split_part(lower(path), '/', 3), '.', 1)]) AS keys FROM r, x WHERE status NOT IN ('inactive', 'obsolete', 'retired', 'superseded') AND (command IS NULL OR command = 'global' OR list_contains(scope, 'global') OR list_contains(scope, command)) AND (list_contains(applies, 'global') OR list_has_any(ap, applies))),
f AS (SELECT context, path, seq, unnest(x) AS ref, generate_subscripts(x, 1) AS i FROM (SELECT *, list_concat(cw, sp) AS x FROM m)), u AS (SELECT context, key, min_by(path, seq) AS q FROM (SELECT context, path, seq, unnest(keys) AS key FROM m) GROUP BY ALL), t AS (SELECT f.context, f.path AS p, u.q FROM f JOIN u ON u.context = f.context AND u.key = lower(trim(f.ref))),
l AS (SELECT DISTINCT t.context, CASE WHEN a.priority <> b.priority THEN CASE WHEN a.priority > b.priority THEN q ELSE p END WHEN a.s <> b.s THEN CASE WHEN a.s > b.s THEN q ELSE p END WHEN a.cs <> b.cs THEN CASE WHEN a.cs > b.cs THEN q ELSE p END WHEN a.aps <> b.aps THEN CASE WHEN a.aps > b.aps THEN q ELSE p END WHEN a.b <> b.b THEN CASE WHEN a.b > b.b THEN q ELSE p END WHEN a.title <= b.title THEN q ELSE p END AS loser FROM t JOIN m a ON a.context = t.context AND a.path = p JOIN m b ON b.context = t.context AND b.path = q WHERE p <> q),
k AS (SELECT context, path, title, priority, s, CASE WHEN schema IN ('bias', 'anti-pattern') THEN 'bias_check' WHEN strength = 'hard' THEN 'hard_rule' ELSE 'soft_preference' END AS kind FROM m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.context = m.context AND l.loser = m.path))
SELECT context, path, kind, row_number() OVER (PARTITION BY context, kind ORDER BY priority DESC, s DESC, title) AS place FROM k"""


def memory_due(spark, sf_dir):
    """Which roll-ups are due on the day of the last event, for four states of the two scopes."""
    as_of = table(spark, sf_dir, "events").agg(F.max("ts").alias("as_of"))
    day, week = F.date_format("as_of", "yyyy-MM-dd"), events.week_key(F.col("as_of"))
    rows = as_of.select("as_of", F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(x).alias("exists"), c.alias("captured_key"), p.alias("pending_key")) for s, x, c, p in (("daily", True, day, F.lit(None).cast("string")), ("daily", True, F.lit("2000-01-01"), F.lit(None).cast("string")), ("weekly", False, week, F.lit(None).cast("string")), ("weekly", True, F.lit("2000-W01"), week))])).alias("s")).select("as_of", "s.*")
    return events.due(rows, F.col("as_of")).select("scope", "key", "captured_key", "pending", "due")


_DUE = "WITH a AS (SELECT strftime(max(ts), '%Y-%m-%d') AS d, isoyear(max(ts)) || '-W' || lpad(CAST(week(max(ts)) AS VARCHAR), 2, '0') AS w FROM events) SELECT 'daily' AS scope, d AS key, d AS captured_key, false AS pending, false AS due FROM a UNION ALL SELECT 'daily', d, '2000-01-01', false, true FROM a UNION ALL SELECT 'weekly', w, w, false, true FROM a UNION ALL SELECT 'weekly', w, '2000-W01', true, false FROM a"


def _factors(spark, sf_dir):
    return quant.factor_model(series.returns(_panel(spark, sf_dir)).cache())


def factor_pca(spark, sf_dir):
    return quant.transmission(_factors(spark, sf_dir)[0], spark)


def _regimes(spark, sf_dir):
    model, rows = _factors(spark, sf_dir)
    rows = rows.cache()
    labels, _ = quant.mixture_regimes(quant.features(rows, len(model.components)))
    return model, rows, labels.cache()


def regime_gmm(spark, sf_dir):
    _, _, labels = _regimes(spark, sf_dir)
    return labels.groupBy("regime").agg(F.count("*").alias("n_dates"), F.avg(F.array_max("posterior")).alias("mean_posterior"))


def regime_models(spark, sf_dir):
    _, rows, labels = _regimes(spark, sf_dir)
    return quant.regime_models(rows, labels)


def _simulation(spark: SparkSession, sf_dir: str):
    """Paths from the panel's regimes by seed, over `simulate`'s own number of paths and horizons; the regimes are fitted once."""
    model, rows, labels = _regimes(spark, sf_dir)
    fitted = sorted((r.asDict() for r in quant.regime_models(rows, labels).collect()), key=lambda r: r["regime"])
    place = {r["regime"]: i for i, r in enumerate(fitted)}
    number = F.create_map(*[x for k, v in place.items() for x in (F.lit(k), F.lit(v))])
    labelled = labels.withColumn("label", number[F.col("regime")]).withColumn("all", F.lit(0))
    runs = series.runs(labelled, "all", ["date"], "label")
    held = sorted((r["label"], r["n"], r["hazard"]) for r in series.hazards(runs, "label").collect())
    hazard = [np.array([h for label, _, h in held if label == i]) for i in range(len(fitted))]
    leave = np.zeros((len(fitted), len(fitted)))
    known = spark.createDataFrame([(i,) for i in range(len(fitted))], "label int")
    for r in series.leave_probabilities(series.transitions(runs, "all", "label"), known).collect():
        leave[r["label"], r["next_label"]] = r["p"]
    last = labels.orderBy(F.desc("date")).first()
    posterior = np.array(last["posterior"])[[r["regime"] for r in fitted]]
    now = series.current_run(labelled, "date", "label").first()["n"]
    return lambda seed: quant.simulate(spark, model, fitted, hazard, leave, posterior, now, seed=seed)


def scenario_paths(spark: SparkSession, sf_dir: str, seed: int = 11) -> DataFrame:
    """Simulated paths from the panel's regimes."""
    return _simulation(spark, sf_dir)(seed)


def monte_carlo_paths(spark, sf_dir):
    return scenario_paths(spark, sf_dir)


def _path_stats(paths: DataFrame) -> DataFrame:
    """Statistics of paths, which are read twice for them and so are simulated once and held."""
    return series.horizon_stats(paths.select("horizon", "series_id", "ret").cache(), ["horizon", "series_id"], "ret")


def scenario_summary(spark, sf_dir):
    return _path_stats(scenario_paths(spark, sf_dir))


def scenario_diff(spark, sf_dir):
    paths = _simulation(spark, sf_dir)
    return quant.run_diff(_path_stats(paths(1)), _path_stats(paths(2)))


def archetype_kmeans(spark, sf_dir):
    return quant.archetypes(scenario_paths(spark, sf_dir).cache())


def dated(query, sql: str, column: str):
    """Dates as text on both sides, as clients read date types differently."""

    def as_text(spark, sf_dir):
        return query(spark, sf_dir).withColumn(column, F.col(column).cast("string"))

    return as_text, f"SELECT * REPLACE (CAST({column} AS VARCHAR) AS {column}) FROM ({sql})"


QUERIES = {
    "html_extract": (html_extract, _HTML), "link_inventory": (link_inventory, _ANCHORS), "page_backlinks": (page_backlinks, _BACKLINKS), "broken_links": (broken_links, _BROKEN), "orphan_pages": (orphan_pages, _ORPHANS),
    "title_scoring": (title_scoring, None), "freshness_lint": (freshness_lint, _FRESH), "state_diff": (state_diff, _STATE_DIFF), "subject_resolution": (subject_resolution, _SUBJECTS),
    "market_panel": dated(market_panel, f"WITH {_PANEL} SELECT series_id, date, value FROM p", "date"), "panel_returns": dated(panel_returns, f"WITH {_RETURNS} SELECT series_id, date, round(ret, 6) AS ret FROM t", "date"), "rolling_features": dated(rolling_features, _ROLLING, "date"),
    "composite_returns": dated(composite_returns, _COMPOSITES, "date"), "event_runs": (event_runs, f"WITH {_RUNS} SELECT * FROM u"), "run_transitions": (run_transitions, _TRANSITIONS), "duration_hazards": (duration_hazards, _HAZARDS),
    "horizon_stats": (horizon_stats, _HORIZON), "daily_event_log": dated(daily_event_log, _DAILY, "day"), "iso_week_review": dated(iso_week_review, _WEEKLY, "starts"), "commands_touched": dated(commands_touched, _TOUCHED, "day"), "observation_merge": dated(observation_merge, _MERGE, "date"),
    "latest_two_per_key": (latest_two_per_key, _LATEST), "props_json_extract": (props_json_extract, _PROPS), "rule_resolution": (rule_resolution, _RULE_SQL), "memory_due": (memory_due, _DUE),
    "factor_pca": (factor_pca, None), "regime_gmm": (regime_gmm, None), "regime_models": (regime_models, None), "monte_carlo_paths": (monte_carlo_paths, None), "scenario_summary": (scenario_summary, None), "scenario_diff": (scenario_diff, None), "archetype_kmeans": (archetype_kmeans, None),
}
