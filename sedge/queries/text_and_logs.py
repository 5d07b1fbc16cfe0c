"""Queries of log analytics, text, change lists, messages, and key-driven tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import logs, sheets, text
from ..session import table
from ..sources import config
from ..storage import shared_dir
from ..streaming import streams

# Views: access-log lines, messages, diffs, commits, files and key sheets made of the given tables.
_PATHS = "array('/index.html', '/app.js', '/api/list', '/img/a.PNG?x=1', '/docs/a page', '/data.json5', '/')"


def log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.selectExpr(f"""CASE WHEN event_id % 13 = 5 THEN concat('broken ', event_id) ELSE concat('10.0.', user_id % 50, '.', user_id % 7, ' - - [', date_format(ts, 'dd/'),
        CASE WHEN event_id % 29 = 3 THEN 'Foo' ELSE element_at(array('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'), month(ts)) END, date_format(ts, '/yyyy:HH:mm:ss'), ' +0800] "GET ',
        element_at({_PATHS}, cast(event_id % 7 + 1 as int)), ' HTTP/1.1" ', CASE WHEN event_type = 'error' THEN '500' ELSE '200' END, ' ', event_id) END AS value""")


_LOG = """lines AS (SELECT CASE WHEN event_id % 13 = 5 THEN 'broken ' || event_id ELSE '10.0.' || (user_id % 50) || '.' || (user_id % 7) || ' - - [' || strftime(ts, '%d/') ||
    CASE WHEN event_id % 29 = 3 THEN 'Foo' ELSE ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(ts)] END || strftime(ts, '/%Y:%H:%M:%S') || ' +0800] "GET ' ||
    ['/index.html', '/app.js', '/api/list', '/img/a.PNG?x=1', '/docs/a page', '/data.json5', '/'][event_id % 7 + 1] || ' HTTP/1.1" ' || CASE WHEN event_type = 'error' THEN '500' ELSE '200' END || ' ' || event_id END AS value FROM events),
w AS (SELECT string_split(value, ' ') AS w FROM lines WHERE contains(value, '"')),
parsed AS (SELECT w[1] AS ip, substr(w[4], 9, 4) || '-' || lpad(CAST(greatest(1, coalesce(list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], substr(w[4], 5, 3)), 1)) AS VARCHAR), 2, '0') || '-' || substr(w[4], 2, 2) || ' ' || substr(w[4], 14, 8) AS visit_time,
    ltrim(w[6], '"') AS method, array_to_string(w[7:-4], ' ') AS url, CAST(w[-2] AS INTEGER) AS status FROM w),
v AS (SELECT * FROM parsed WHERE status = 200 AND NOT regexp_matches(lower(url), '\\.(""" + "|".join(x[1:] for x in logs.STATIC) + """)'))"""


def log_parse(spark, sf_dir):
    return logs.parse_lines(log_lines(spark, sf_dir))


def log_visits(spark, sf_dir):
    return logs.newest_first(logs.visits(logs.page_views(log_parse(spark, sf_dir))))


def log_total_ips(spark, sf_dir):
    return log_visits(spark, sf_dir).agg(F.count("*").alias("total_ips"), F.sum("visits").alias("total_visits"))


def stream_log_visits(spark, sf_dir):
    """The same counts from a stream of the lines, in micro-batches until the input is used up."""
    return streams.log_visits_stream(spark, log_lines(spark, sf_dir))


def messages(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 700 AS uid", "ts", "concat('user', user_id) AS sender", """concat(CASE WHEN event_id % 5 = 0 THEN 'note' ELSE 'build' END, '|', event_type, '|', CASE event_id % 4 WHEN 0 THEN '2026-02-30' WHEN 1 THEN '2026-13-40' WHEN 2 THEN date_format(ts, 'yyyy-MM-dd') ELSE 'soon' END) AS body""")


_MSG = """msg AS (SELECT event_id, event_id % 700 AS uid, ts, 'user' || user_id AS sender, CASE WHEN event_id % 5 = 0 THEN 'note' ELSE 'build' END || '|' || event_type || '|' ||
    CASE event_id % 4 WHEN 0 THEN '2026-02-30' WHEN 1 THEN '2026-13-40' WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE 'soon' END AS body FROM events)"""


def command_parse(spark, sf_dir):
    ok, name, day = T.command_fields(F.col("body"), "build")
    return messages(spark, sf_dir).select("event_id", ok.alias("ok"), name.alias("name"), day.cast("string").alias("day"))


def contains_lookup(spark, sf_dir):
    texts = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("_"), (F.col("user_id") % 9).cast("string")).alias("word"))
    names = table(spark, sf_dir, "nation").crossJoin(F.broadcast(spark.createDataFrame([("click",), ("view",), ("purchase",)], "t string"))).select((F.col("n_nationkey") * 3 + F.length("t")).alias("pos"), F.concat("n_name", F.lit("_"), "t", F.lit("_"), (F.col("n_nationkey") % 9).cast("string")).alias("project"))
    return text.first_containing(texts, "word", names, "project", "pos")


def stream_dedup(spark, sf_dir):
    return streams.dedup_stream(spark, messages(spark, sf_dir).select("uid", "sender"), "uid").select("uid")


def recent_view(spark, sf_dir):
    """Messages of five mailboxes whose ids come back after a few or after many others."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS mailbox", "event_id * 7919 % (300 + event_id % 7 * 150) AS uid")


def stream_dedup_recent(spark, sf_dir):
    """Messages whose id is not among the last ones of their mailbox: more than 150 remembered, and the 30 oldest go."""
    rows = recent_view(spark, sf_dir)
    with streams.keyed_state(spark):
        # One batch, as the order of files within a stream is not stated.
        return streams.drain(streams.dedup_recent(streams.as_stream(spark, rows, 1 << 30), "mailbox", "uid", "event_id", most=150, drop=30))


def stream_tumbling(spark, sf_dir):
    """Events by hour and type from a stream, all windows kept."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    found = streams.drain(streams.tumbling_counts(streams.as_stream(spark, rows), "ts", "1 hour", "2 hours", "event_type"), "complete")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


def diff_view(spark, sf_dir):
    """Every document as a diff: its lines get a mark by their place."""
    marks = "element_at(array('+', '-', '+++ ', ' ', '@@'), cast(i % 5 + 1 as int))"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"array_join(transform(split(text, '\\n'), (x, i) -> concat({marks}, x)), '\\n') AS diff")


def diff_added_lines(spark, sf_dir):
    return text.added_lines(diff_view(spark, sf_dir), "doc_id", "diff")


def after_marker(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.after_marker(F.col("text"), "the ").alias("tail"))


def size_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat((F.col("o_custkey") % 500).cast("string"), F.element_at(F.array(*map(F.lit, ("mb", "KB", "b", "", " kb", "xb", "m", "K"))), (F.col("o_orderkey") % 8 + 1).cast("int"))).alias("size"))
    return o.withColumn("bytes", T.parse_size(F.col("size"))).withColumn("shown", T.format_mb(F.col("bytes")))


def sheet_names(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "/"), F.lit(" :"), "p_type", F.lit("*"), "p_brand").alias("title"))
    t = t.withColumn("title", F.when(F.col("p_partkey") % 17 == 0, "  ").otherwise(F.substring("title", 1, 24)))
    return text.sheet_names(t, "title", "p_partkey")


def unique_names(spark, sf_dir):
    f = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")), F.lit("<"), (F.col("c_nationkey") % 5).cast("string"), F.lit(">.b3dm")).alias("name"))
    return text.unique_names(f, "name", "c_custkey")


def split_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.split_list(F.col("text")).alias("items"))
    return d.select("doc_id", F.size("items").cast("bigint").alias("n_items"), F.element_at("items", -1).alias("last_item"))


def uri_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_uri(F.col("url")).alias("uri"))


def file_view(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('data/', s_nationkey, '/tile', s_suppkey % 40, '.b3dm') AS path").dropDuplicates(["path"]).select("path")


def uri_resolve(spark, sf_dir):
    refs = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN concat('data/', c_nationkey, '/tile', c_custkey % 45, '.b3dm') WHEN 1 THEN concat(c_nationkey, '/TILE', c_custkey % 45, '.b3dm') ELSE concat('old/tile', c_custkey % 45, '.b3dm') END AS uri")
    return text.resolve_uris(refs, file_view(spark, sf_dir))


def commit_view(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    commits = o.selectExpr("o_orderkey AS commit_id", "o_orderdate AS ts", "concat('dev', o_custkey % 20) AS author", "concat(o_orderpriority, ' change') AS message")
    files = li.selectExpr("l_orderkey AS commit_id", "element_at(array('M', 'A', 'D', 'R100', 'R'), cast(l_linenumber % 5 + 1 as int)) AS status", "concat(CASE WHEN l_linenumber % 5 = 3 THEN 'gone.js\\t' ELSE '' END, CASE WHEN l_suppkey % 3 = 0 THEN 'public/static/' ELSE 'src/' END, l_partkey % 60, '.js') AS path")
    return commits, files


def changeset_keep(spark, sf_dir):
    return text.changed_files(commit_view(spark, sf_dir)[1], "public/static/", "public/")


def changeset_report(spark, sf_dir):
    return text.change_report(*commit_view(spark, sf_dir), "1998-01-01")


def _listing(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('static/', p_partkey % 90, '.js') AS path")


def keep_anti(spark, sf_dir):
    return text.drop_listed(_listing(spark, sf_dir), changeset_keep(spark, sf_dir), "path")


def keep_semi(spark, sf_dir):
    return text.keep_listed(_listing(spark, sf_dir), changeset_keep(spark, sf_dir), "path")


def sheet_view(spark, sf_dir):
    """A key sheet with blanks, padding and repeats."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS row_no", "CASE WHEN c_custkey % 19 = 0 THEN '  ' ELSE concat(' t', c_nationkey % 6, ' ') END AS target", "CASE WHEN c_custkey % 23 = 0 THEN null ELSE concat('layer ', c_nationkey) END AS layer", "CASE WHEN c_custkey % 29 = 0 THEN '' ELSE c_mktsegment END AS feature")


def key_rows(spark, sf_dir):
    return sheets.key_rows(sheet_view(spark, sf_dir), ["target", "layer", "feature"])


def first_wins(spark, sf_dir):
    return text.first_of(key_rows(spark, sf_dir), ["target", "layer", "feature"], "row_no")


def coded(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS smid", "c_mktsegment AS layer", "CASE WHEN c_custkey % 4 = 0 THEN null WHEN c_custkey % 4 = 1 THEN ' ' ELSE 'old' END AS code")
    return c, sheets.sequence_codes(c.where("smid % 3 <> 0").drop("code"), "layer", "smid", F.concat(F.lit("K "), "layer"))


def seq_code(spark, sf_dir):
    return coded(spark, sf_dir)[1]


def seq_code_update(spark, sf_dir):
    whole, codes = coded(spark, sf_dir)
    return sheets.update_from(whole, codes, "smid", "code")


def blank_audit(spark, sf_dir):
    return sheets.blank_audit(seq_code_update(spark, sf_dir), ["layer"], "code")


def history_top_n(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", (F.col("user_id") % 5).cast("string")).alias("project"), "ts")
    return text.newest(e, "project", "ts", 50, "event_id").select("event_id", "project", F.col("place").cast("bigint").alias("place"))


def history_snapshot(spark, sf_dir):
    """A history file, read back, with the later builds added: the newest ten of each project stay."""
    builds = table(spark, sf_dir, "events").selectExpr("cast(event_id as string) AS id", "concat('p', user_id % 20) AS project", "event_type AS build_type", "CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status", "ts AS started_at", "cast(NULL as string) AS message", "event_id % 2 AS later")
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    config.write_history(builds.where("later = 0"), path)
    found = config.append_history(config.read_history(spark, path), builds.where("later = 1").drop("later"), 10)
    return found.select("id", "project", "build_type", "status", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def log_append(spark, sf_dir):
    """Two runs that add to one log, and the log as it is then."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("message"))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    for part in (0, 1):
        logs.append_log(o.where(F.col("o_orderkey") % 2 == part), path)
    return spark.read.text(path)


def stamped_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.stamped_name("PKG", F.col("o_orderdate"), F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "-full").otherwise("-patch")).alias("folder"))


QUERIES = {f.__name__: f for f in (log_parse, log_visits, log_total_ips, stream_log_visits, command_parse, contains_lookup, stream_dedup, stream_dedup_recent, stream_tumbling, diff_added_lines, after_marker, size_parse, sheet_names, unique_names, split_list, uri_strip, uri_resolve, changeset_keep, changeset_report, keep_anti, keep_semi, key_rows, first_wins, seq_code, seq_code_update, blank_audit, history_top_n, history_snapshot, log_append, stamped_names)}

_VISITS = "SELECT ip, count(*) AS visits, min(visit_time) AS first_time, max(visit_time) AS last_time FROM v GROUP BY ip"
_FILES = """f AS (SELECT l_orderkey AS commit_id, ['M', 'A', 'D', 'R100', 'R'][l_linenumber % 5 + 1] AS status, CASE WHEN l_linenumber % 5 = 3 THEN 'gone.js' || chr(9) ELSE '' END || CASE WHEN l_suppkey % 3 = 0 THEN 'public/static/' ELSE 'src/' END || (l_partkey % 60) || '.js' AS path FROM lineitem)"""
_KEEP = f"WITH {_FILES}, k AS (SELECT DISTINCT substr(p, 8) AS path FROM (SELECT split_part(path, chr(9), -1) AS p FROM f WHERE status[1] IN ('M', 'A', 'R')) WHERE starts_with(p, 'public/static/'))"
_SHEET = """s AS (SELECT c_custkey AS row_no, CASE WHEN c_custkey % 19 = 0 THEN '  ' ELSE ' t' || (c_nationkey % 6) || ' ' END AS target, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 'layer ' || c_nationkey END AS layer, CASE WHEN c_custkey % 29 = 0 THEN '' ELSE c_mktsegment END AS feature FROM customer),
kr AS (SELECT row_no, trim(target) AS target, trim(layer) AS layer, trim(feature) AS feature FROM s WHERE trim(target) <> '' AND trim(layer) <> '' AND trim(feature) <> '')"""
_CODED = """c AS (SELECT c_custkey AS smid, c_mktsegment AS layer, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN ' ' ELSE 'old' END AS code FROM customer),
n AS (SELECT smid, layer, replace('K ' || layer || '_' || row_number() OVER (PARTITION BY layer ORDER BY smid), ' ', '') AS code FROM c WHERE smid % 3 <> 0),
u AS (SELECT c.smid, c.layer, coalesce(n.code, c.code) AS code FROM c LEFT JOIN n USING (smid))"""
ORACLE = {
    "log_parse": f"WITH {_LOG} SELECT * FROM parsed",
    "log_visits": f"WITH {_LOG} {_VISITS}",
    "log_total_ips": f"WITH {_LOG} SELECT count(DISTINCT ip) AS total_ips, count(*) AS total_visits FROM v",
    "stream_log_visits": f"WITH {_LOG} {_VISITS}",
    "command_parse": f"""WITH {_MSG}, x AS (SELECT event_id, body, regexp_full_match(body, 'build\\|[^|]+\\|\\d{{4}}-\\d{{2}}-\\d{{2}}') AS formed, try_cast(split_part(body, '|', 3) AS DATE) AS d FROM msg)
SELECT event_id, CASE WHEN formed THEN d IS NOT NULL END AS ok, CASE WHEN formed AND d IS NOT NULL THEN split_part(body, '|', 2) END AS name, CASE WHEN formed AND d IS NOT NULL THEN CAST(d AS VARCHAR) END AS day FROM x""",
    "contains_lookup": """WITH t AS (SELECT event_id, event_type || '_' || (user_id % 9) AS word FROM events),
n AS (SELECT n_nationkey * 3 + length(t) AS pos, n_name || '_' || t || '_' || (n_nationkey % 9) AS project FROM nation, (VALUES ('click'), ('view'), ('purchase')) v(t))
SELECT event_id, word, min_by(project, pos) AS found FROM t LEFT JOIN n ON contains(project, word) GROUP BY event_id, word""",
    "stream_dedup": "SELECT DISTINCT event_id % 700 AS uid FROM events",
    "stream_dedup_recent": """WITH RECURSIVE r AS (SELECT event_id, event_type AS mailbox, event_id * 7919 % (300 + event_id % 7 * 150) AS uid, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
s AS (SELECT mailbox, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS uid, false AS fresh FROM (SELECT DISTINCT mailbox FROM r)
UNION ALL SELECT r.mailbox, r.k, CASE WHEN list_contains(held, r.uid) THEN held WHEN len(held) = 150 THEN list_append(held, r.uid)[31:] ELSE list_append(held, r.uid) END, r.event_id, r.uid, NOT list_contains(held, r.uid) FROM s JOIN r ON r.mailbox = s.mailbox AND r.k = s.k + 1)
SELECT event_id, mailbox, uid FROM s WHERE fresh""",
    "stream_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "diff_added_lines": "SELECT doc_id, coalesce(array_to_string([x[2] FOR x IN list_zip(range(len(l)), l) IF x[1] % 5 = 0], chr(10)), '') AS added FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "after_marker": "SELECT doc_id, CASE WHEN contains(text, 'the ') THEN list_last(string_split(text, 'the ')) END AS tail FROM documents",
    "size_parse": """WITH o AS (SELECT o_orderkey, (o_custkey % 500) || ['mb', 'KB', 'b', '', ' kb', 'xb', 'm', 'K'][o_orderkey % 8 + 1] AS size, o_custkey % 500 AS n, [1048576, 1024, 1, 1, NULL, NULL, 1048576, 1024][o_orderkey % 8 + 1] AS f FROM orders)
SELECT o_orderkey, size, CAST(n * f AS BIGINT) AS bytes, format('{:.2f} MB', round(CAST(n * f AS DOUBLE) / 1048576, 2)) AS shown FROM o""",
    "sheet_names": """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE substr(replace(p_name, ' ', '/') || ' :' || p_type || '*' || p_brand, 1, 24) END AS title FROM part),
s AS (SELECT *, CASE WHEN trim(title) = '' THEN 'Sheet' ELSE substr(trim(regexp_replace(title, '[:\\\\/?*\\[\\]]', '_', 'g')), 1, 31) END AS x FROM t)
SELECT p_partkey, title, CASE WHEN row_number() OVER (PARTITION BY x ORDER BY p_partkey) = 1 THEN x ELSE substr(x, 1, 28) || '_' || p_partkey END AS sheet FROM s""",
    "unique_names": """WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END || '<' || (c_nationkey % 5) || '>.b3dm' AS name FROM customer),
s AS (SELECT *, regexp_replace(name, '[<>]', '_', 'g') AS x, row_number() OVER (PARTITION BY lower(regexp_replace(name, '[<>]', '_', 'g')) ORDER BY c_custkey) - 1 AS r FROM f)
SELECT c_custkey, name, CASE WHEN r = 0 THEN x ELSE replace(x, '.b3dm', '') || '_' || r || '.b3dm' END AS out_name FROM s""",
    "split_list": "SELECT doc_id, CAST(len(l) AS BIGINT) AS n_items, l[-1] AS last_item FROM (SELECT doc_id, [trim(x) FOR x IN regexp_split_to_array(text, '[,\\r\\n]+') IF trim(x) <> ''] AS l FROM documents)",
    "uri_strip": "SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS uri FROM pages",
    "uri_resolve": """WITH f AS (SELECT DISTINCT 'data/' || s_nationkey || '/tile' || (s_suppkey % 40) || '.b3dm' AS path FROM supplier),
r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'data/' || c_nationkey || '/tile' || (c_custkey % 45) || '.b3dm' WHEN 1 THEN c_nationkey || '/TILE' || (c_custkey % 45) || '.b3dm' ELSE 'old/tile' || (c_custkey % 45) || '.b3dm' END AS uri FROM customer)
SELECT c_custkey, uri, min_by(path, (CASE WHEN path = uri THEN '0' WHEN ends_with(lower(path), '/' || lower(uri)) THEN '1' ELSE '2' END) || path) AS resolved
FROM r LEFT JOIN f ON lower(split_part(path, '/', -1)) = lower(split_part(uri, '/', -1)) GROUP BY c_custkey, uri""",
    "changeset_keep": f"{_KEEP} SELECT path FROM k",
    "changeset_report": f"""WITH {_FILES}, x AS (SELECT commit_id, string_agg('[' || status || '] ' || path, chr(10) ORDER BY '[' || status || '] ' || path) AS files FROM f GROUP BY commit_id)
SELECT o_orderkey AS commit_id, 'dev' || (o_custkey % 20) AS author, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, o_orderpriority || ' change' AS message, coalesce(files, '(none)') AS files
FROM orders LEFT JOIN x ON o_orderkey = commit_id WHERE o_orderdate > TIMESTAMP '1998-01-01'""",
    "keep_anti": f"{_KEEP} SELECT 'static/' || (p_partkey % 90) || '.js' AS path, p_partkey FROM part WHERE 'static/' || (p_partkey % 90) || '.js' NOT IN (SELECT path FROM k)",
    "keep_semi": f"{_KEEP} SELECT 'static/' || (p_partkey % 90) || '.js' AS path, p_partkey FROM part WHERE 'static/' || (p_partkey % 90) || '.js' IN (SELECT path FROM k)",
    "key_rows": f"WITH {_SHEET} SELECT * FROM kr",
    "first_wins": f"WITH {_SHEET} SELECT min(row_no) AS row_no, target, layer, feature FROM kr GROUP BY target, layer, feature",
    "seq_code": f"WITH {_CODED} SELECT * FROM n",
    "seq_code_update": f"WITH {_CODED} SELECT * FROM u",
    "blank_audit": f"WITH {_CODED} SELECT layer, count(*) FILTER (WHERE code IS NULL OR trim(code) = '') AS n_blank, count(*) AS n_rows FROM u GROUP BY layer HAVING count(*) FILTER (WHERE code IS NULL OR trim(code) = '') > 0",
    "history_snapshot": "SELECT CAST(event_id AS VARCHAR) AS id, 'p' || (user_id % 20) AS project, event_type AS build_type, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, CAST(event_id AS VARCHAR)) <= 10",
    "log_append": "SELECT '[' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '] order ' || o_orderkey AS value FROM orders",
    "stamped_names": "SELECT o_orderkey, 'PKG-' || strftime(o_orderdate, '%Y-%m-%d-%H-%M') || '-' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '-full' ELSE '-patch' END AS folder FROM orders",
    "history_top_n": "WITH e AS (SELECT event_id, event_type || (user_id % 5) AS project, ts FROM events) SELECT event_id, project, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id) AS place FROM e QUALIFY place <= 50",
}
