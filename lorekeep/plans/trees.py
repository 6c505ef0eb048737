"""Walks, snapshots and positions in trees of blocks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import tree as op
from lorekeep.plans.adapters import TREE_SQL, table, tree

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _live_sql(seq: int) -> str:
    return f"live AS (SELECT * FROM block WHERE valid_from <= {seq} AND (valid_to IS NULL OR valid_to > {seq}))"


def _walk_sql(seq: int, anchor: str, depth: int, places: str = "true") -> str:
    """Walks by paths; places are those among all blocks below the anchor."""
    return f"""WITH RECURSIVE {TREE_SQL}, {_live_sql(seq)},
  w AS (SELECT CAST(1 AS INTEGER) AS depth, uid, parent, content, seq_pos, [seq_pos] AS path FROM live WHERE {anchor}
    UNION ALL SELECT CAST(w.depth + 1 AS INTEGER), c.uid, c.parent, c.content, c.seq_pos, list_append(w.path, c.seq_pos) FROM w JOIN live c ON c.parent = w.uid),
  p AS (SELECT *, row_number() OVER (ORDER BY path, uid) AS place FROM w),
  b AS (SELECT a.uid, count(*) - 1 AS n_below FROM w a JOIN w x ON x.path[1:len(a.path)] = a.path GROUP BY a.uid)
  SELECT depth, p.uid, parent, content, place, n_below, depth = {depth} AND n_below > 0 AS has_more FROM p JOIN b ON b.uid = p.uid WHERE depth <= {depth} AND {places}"""


_WALKED = ["depth", "uid", "parent", "content", "place", "n_below", "has_more"]


@query(_walk_sql(2, "parent IS NULL", 3))
def blocks_dfs(spark: SparkSession, d: str) -> DataFrame:
    return op.depth_first(tree(spark, d), 2, None, 3).select(*_WALKED)


@query(_walk_sql(2, "parent IS NULL", 99, "place BETWEEN 101 AND 400"))
def blocks_dfs_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the walk as a range of places."""
    return op.depth_first(tree(spark, d), 2, offset=100, limit=300).select(*_WALKED)


@query(_walk_sql(3, "parent = 'r1'", 2))
def subtree_dfs(spark: SparkSession, d: str) -> DataFrame:
    return op.depth_first(tree(spark, d), 3, "r1", 2).select(*_WALKED)


@query(f"WITH {TREE_SQL} SELECT uid, parent, seq_pos, content FROM block WHERE valid_from <= 2 AND (valid_to IS NULL OR valid_to > 2)")
def blocks_as_of(spark: SparkSession, d: str) -> DataFrame:
    return op.as_of(tree(spark, d), 2).select("uid", "parent", "seq_pos", "content")


@query(f"WITH RECURSIVE {TREE_SQL}, w AS (SELECT uid, parent, CAST(1 AS INTEGER) AS depth FROM block WHERE parent IS NULL UNION ALL SELECT b.uid, b.parent, CAST(depth + 1 AS INTEGER) FROM block b JOIN w ON b.parent = w.uid) SELECT * FROM w")
def taxonomy_depth(spark: SparkSession, d: str) -> DataFrame:
    return op.taxonomy(tree(spark, d))


@query(f"WITH {TREE_SQL} SELECT parent, CAST(coalesce(max(seq_pos), 0) + 1000 AS DECIMAL(38,10)) AS next_pos FROM block GROUP BY 1")
def append_positions(spark: SparkSession, d: str) -> DataFrame:
    return op.append_positions(tree(spark, d))


@query(f"""WITH {TREE_SQL}, s AS (SELECT uid, parent, CAST(seq_pos AS BIGINT) AS p, lag(CAST(seq_pos AS BIGINT)) OVER w AS l, lead(CAST(seq_pos AS BIGINT)) OVER w AS r FROM block WINDOW w AS (PARTITION BY parent ORDER BY seq_pos, uid))
  SELECT uid, parent, CAST((coalesce(l, 0) + p) / 2 AS DECIMAL(38,10)) AS before, CAST((p + coalesce(r, p + 5000)) / 2 AS DECIMAL(38,10)) AS after FROM s""")
def midpoint_keys(spark: SparkSession, d: str) -> DataFrame:
    return op.midpoints(tree(spark, d))


@query(f"WITH {TREE_SQL} SELECT uid, CAST(row_number() OVER (PARTITION BY parent ORDER BY seq_pos, uid) * 10000 AS DECIMAL(38,10)) AS seq_pos FROM block")
def resequence(spark: SparkSession, d: str) -> DataFrame:
    return op.resequenced(tree(spark, d)).select("uid", "seq_pos")


@query(f"WITH {TREE_SQL} SELECT uid, parent, valid_from, CASE WHEN uid IN ('n3', 'n4', 'c5') AND valid_to IS NULL THEN 6 ELSE valid_to END AS valid_to FROM block UNION ALL SELECT uid || '-b', 'r0', 6, NULL FROM block WHERE uid IN ('n3', 'n4', 'c5')")
def move_blocks(spark: SparkSession, d: str) -> DataFrame:
    moves = spark.range(3).select(F.element_at(F.array(F.lit("n3"), F.lit("n4"), F.lit("c5")), F.col("id").cast("int") + 1).alias("uid"))
    moves = moves.select("uid", F.concat("uid", F.lit("-b")).alias("new_uid"), F.lit("r0").alias("new_parent"), F.lit(1).alias("new_pos"))
    return op.move(tree(spark, d), moves, 6).select("uid", "parent", "valid_from", "valid_to")


@query("SELECT doc_id, CAST(n + 1 AS INTEGER) AS uid, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)")
def preorder_uid(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    return op.preorder(lines.withColumn("path", F.array("n")), "doc_id", "path").select("doc_id", "uid", "text")


_KIND = "CASE WHEN n % 4 = 3 OR n % 4 = 2 THEN 'list' WHEN n % 8 = 4 THEN 'rule' WHEN n % 8 = 0 THEN 'heading' ELSE 'paragraph' END"


@query(f"""WITH b AS (SELECT doc_id, CAST(n AS INTEGER) AS n, {_KIND} AS kind FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)),
  h AS (SELECT *, last_value(CASE WHEN kind <> 'list' THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS host_n, last_value(CASE WHEN kind <> 'list' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM b)
  SELECT doc_id, n, kind, CASE WHEN kind = 'list' AND k IN ('paragraph', 'heading') THEN host_n END AS host FROM h""")
def list_nesting(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "l")).select("doc_id", "n", F.expr(_KIND).alias("kind"))
    return op.list_hosts(blocks, "doc_id", "n")


_HEAP_SQL = "node AS (SELECT 'c' || c_custkey AS uid, CASE WHEN c_custkey > 1 THEN 'c' || (c_custkey // 2) END AS parent, c_custkey AS k FROM customer)"


def _heap(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a tree in which k // 2 is above k: as deep as the number of its digits in binary."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("long")
    return table(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("uid"), F.when(k > 1, F.concat(F.lit("c"), F.floor(k / 2))).alias("parent"), k.cast("decimal(38,10)").alias("seq_pos"), F.col("c_name").alias("content"), F.lit(0).cast("long").alias("valid_from"), none.alias("valid_to"))


@query(f"""WITH RECURSIVE {_HEAP_SQL}, w AS (SELECT uid, k, CAST(1 AS INTEGER) AS depth, [k] AS path FROM node WHERE parent IS NULL UNION ALL SELECT n.uid, n.k, CAST(depth + 1 AS INTEGER), list_append(path, n.k) FROM node n JOIN w ON n.parent = w.uid),
  up AS (SELECT k AS a, k FROM w UNION ALL SELECT a // 2, k FROM up WHERE a > 1), size AS (SELECT a, count(*) - 1 AS n_below FROM up GROUP BY a)
  SELECT uid, depth, row_number() OVER (ORDER BY path) AS place, n_below FROM w JOIN size ON a = k""")
def deep_walk(spark: SparkSession, d: str) -> DataFrame:
    return op.depth_first(_heap(spark, d), 0).select("uid", "depth", "place", "n_below")


@query("SELECT 'c' || c_custkey AS uid, CAST(c_custkey % 50 + 1 AS INTEGER) AS depth, 'c' || (c_custkey - c_custkey % 50) AS head FROM customer")
def chain_depths(spark: SparkSession, d: str) -> DataFrame:
    """Customers in chains of fifty, one below the other."""
    from lorekeep.operators.numbering import ancestry

    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("id"), F.when(k % 50 != 0, F.concat(F.lit("c"), k - 1)).alias("parent"))
    return ancestry(rows).select(F.col("id").alias("uid"), "depth", "head")


@query(f"""WITH RECURSIVE {TREE_SQL}, {_live_sql(6)}, move AS (SELECT n.uid, CASE WHEN s % 3 = 0 THEN c.uid WHEN s % 3 = 1 THEN 'r0' ELSE 'gone' END AS new_parent FROM (SELECT n_nationkey AS s, 'n' || n_nationkey AS uid FROM nation) n LEFT JOIN (SELECT parent, min(uid) AS uid FROM live WHERE uid LIKE 'c%' GROUP BY parent) c ON c.parent = n.uid)
  SELECT uid, new_parent, CASE WHEN new_parent = 'gone' THEN 'no live parent' ELSE 'below itself' END AS reason FROM move WHERE new_parent = 'gone' OR new_parent LIKE 'c%'""")
def refused_moves(spark: SparkSession, d: str) -> DataFrame:
    """Nations moved under a customer of theirs, under a region, or under nothing that is there."""
    blocks = tree(spark, d)
    own = op.as_of(blocks, 6).where("uid LIKE 'c%'").groupBy("parent").agg(F.min("uid").alias("child")).withColumnRenamed("parent", "uid")
    s = F.col("n_nationkey") % 3
    moves = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("n"), "n_nationkey").alias("uid")).join(own, "uid", "left")
    moves = moves.select("uid", F.concat("uid", F.lit("-b")).alias("new_uid"), F.when(s == 0, F.col("child")).when(s == 1, F.lit("r0")).otherwise(F.lit("gone")).alias("new_parent"), F.lit(1).alias("new_pos"))
    return op.refused_moves(blocks, moves, 6).select("uid", "new_parent", "reason")


@query(f"""WITH {TREE_SQL}, last AS (SELECT parent, max(seq_pos) AS last FROM block WHERE valid_to IS NULL GROUP BY parent),
  child AS (SELECT 'x' || n_nationkey || '-' || i AS uid, CASE WHEN n_nationkey < 20 THEN 'n' || n_nationkey END AS parent, i AS place FROM nation, (VALUES (1), (2)) v(i)),
  placed AS (SELECT c.*, row_number() OVER (PARTITION BY parent ORDER BY place, uid) AS n FROM child c)
  SELECT uid, p.parent, CAST(coalesce(last, 0) + n * 1000 AS DECIMAL(38,10)) AS seq_pos FROM placed p LEFT JOIN last l ON l.parent IS NOT DISTINCT FROM p.parent""")
def append_children(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("place"))
    rows = n.select(F.concat(F.lit("x"), "n_nationkey", F.lit("-"), "place").alias("uid"), F.when(F.col("n_nationkey") < 20, F.concat(F.lit("n"), "n_nationkey")).alias("parent"), "place", F.lit("new").alias("content"))
    return op.appended(tree(spark, d), rows, 7).select("uid", "parent", "seq_pos")


@query(f"""WITH {TREE_SQL} SELECT uid, 'delete' AS event_type, 6 AS seq FROM block WHERE valid_to IS NULL AND uid LIKE 'c%7' UNION ALL SELECT uid || '-b', 'insert', 6 FROM block WHERE uid LIKE 'c%7'""")
def change_events(spark: SparkSession, d: str) -> DataFrame:
    before = tree(spark, d)
    moves = before.where("uid LIKE 'c%7'").select("uid", F.concat("uid", F.lit("-b")).alias("new_uid"), F.lit("r0").alias("new_parent"), F.lit(1).alias("new_pos"))
    events = op.change_events(before, op.move(before, moves, 6), 1)
    return events.select("uid", "event_type", F.get_json_object("event_data", "$.sequence").cast("int").alias("seq"))


@query(f"""WITH {TREE_SQL} SELECT parent, arg_max(uid, (seq_pos, uid)) AS uid FROM block WHERE valid_to IS NULL GROUP BY parent""")
def last_children(spark: SparkSession, d: str) -> DataFrame:
    return op.last_children(tree(spark, d))


@query(f"""WITH b AS (SELECT doc_id, {_KIND} AS kind FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents))
  SELECT doc_id, count(*) AS n_blocks, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM b GROUP BY doc_id""")
def block_stats(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "l")).select("doc_id", F.expr(_KIND).alias("kind"))
    return op.block_stats(blocks, "doc_id")


#: A line's level as a heading, from its place and length.
_LEVEL = "1 + (n * 7 + length(l)) % 4"


@query(f"""WITH RECURSIVE h AS (SELECT doc_id, n, l, CAST({_LEVEL} AS INTEGER) AS lv FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)),
  w AS (SELECT doc_id, n, l, CAST([] AS INTEGER[]) AS before, [1] AS path FROM h WHERE n = 0
    UNION ALL SELECT h.doc_id, h.n, h.l, w.path, list_append(w.path[1:h.lv - 1], CASE WHEN len(w.path) >= h.lv THEN w.path[h.lv] + 1 ELSE 1 END) FROM w JOIN h ON h.doc_id = w.doc_id AND h.n = w.n + 1)
  SELECT doc_id, CAST(n AS INTEGER) AS n, array_to_string(path, '.') AS ordinals, substr(sha256('<docx-bytes>|' || array_to_string(before, '.') || '|' || substr(l, 1, 80)), 1, 12) AS key FROM w""")
def section_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Lines as headings: their ordinals, and keys from the ordinals before them."""
    from lorekeep.functions import text as tx

    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    levels = F.transform("lines", lambda l, n: F.expr("1") + (n * 7 + F.length(l)) % 4)
    rows = lines.withColumn("paths", tx.ordinal_paths(levels.cast("array<int>")))
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip("lines", "paths", F.concat(F.array(F.lit("")), F.slice("paths", 1, F.size("paths") - 1)).alias("before"))).alias("n", "h"))
    return rows.select("doc_id", "n", F.col("h.paths").alias("ordinals"), tx.stable_id(F.lit("<docx-bytes>"), F.col("h.before"), F.col("h.lines")).alias("key"))


@query(f"""WITH {_HEAP_SQL}, b AS (SELECT 'c' || c_custkey AS uid, 'n' || c_nationkey AS parent, c_custkey AS k FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY k) AS r FROM b),
  f AS (SELECT parent, min(k) AS k FROM b GROUP BY parent), i AS (SELECT r.uid || '-' || n AS uid, r.parent, r.r, n FROM f JOIN r ON r.k = f.k, (SELECT unnest(range(1, 41)) AS n)),
  a AS (SELECT uid, parent, r, 0 AS n FROM r UNION ALL SELECT * FROM i)
  SELECT uid, parent, row_number() OVER (PARTITION BY parent ORDER BY r, n) AS place FROM a""")
def keyed_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Customers as siblings with hardly a gap between them, and forty blocks behind the first of each nation."""
    from pyspark.sql import Window

    from lorekeep.operators.placing import insert_after

    c, none = table(spark, d, "customer"), F.lit(None).cast("long")
    blocks = c.select(F.concat(F.lit("c"), "c_custkey").alias("uid"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), (F.col("c_custkey") * F.lit("0.0000000001").cast("decimal(12,10)")).cast("decimal(38,10)").alias("seq_pos"), F.col("c_name").alias("content"), F.lit(0).cast("long").alias("valid_from"), none.alias("valid_to"))
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("k")).select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "k").alias("after"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("n"))
    put = insert_after(blocks, first.select(F.concat("after", F.lit("-"), "n").alias("uid"), "parent", "after", "n", F.lit("new").alias("content")), 1)
    return put.select("uid", "parent", F.row_number().over(Window.partitionBy("parent").orderBy("seq_pos")).alias("place"))


@query(f"WITH {TREE_SQL} SELECT uid, parent, seq_pos, content FROM block WHERE valid_from <= 3 AND (valid_to IS NULL OR valid_to > 3)")
def replay_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks as of a number, from the log of what was done to them."""
    from lorekeep.operators import events

    return events.replay(events.block_events(tree(spark, d)), "block", 3).select(F.col("key").alias("uid"), "parent", "seq_pos", "content")


@query("""WITH e AS (SELECT event_id, user_id AS k, epoch_us(ts) AS ms, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  c AS (SELECT k, max(i) AS i FROM e WHERE i = 1 OR i % 7 = 1 GROUP BY k)
  SELECT CAST(e.k AS VARCHAR) AS doc, arg_max(event_type, e.i) FILTER (e.i % 7 <> 3) AS title, CAST(arg_max(value, e.i) FILTER (e.i % 7 IN (1, 3)) AS DOUBLE) AS score, CAST(min(ms) AS BIGINT) AS created, CAST(max(ms) AS BIGINT) AS updated
  FROM e JOIN c ON c.k = e.k AND e.i >= c.i GROUP BY e.k HAVING arg_max(e.i % 7, e.i) <> 0""")
def replay_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a document's: every seventh creates, the one before deletes, the third sets the score only."""
    from pyspark.sql import Window

    from lorekeep.operators import events

    rows = table(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("ms", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.select("user_id", "ms", "i", F.col("event_type").alias("title"), F.col("value").alias("score"))
    of = lambda cond, kind, fields: events.event_rows(rows.where(cond), "document", "user_id", "ms", kind, fields, "i")
    log = events.union(of("i % 7 = 1", "create", ["title", "score"]), of("i % 7 = 3", "update", ["score"]), of("i % 7 IN (2, 4, 5, 6)", "update", ["title"]), of("i % 7 = 0", "delete", []))
    return events.document_state(log).select(F.col("key").alias("doc"), "title", "score", "created", "updated")


@query("""WITH b AS (SELECT doc_id, CAST(n AS INTEGER) AS n, CAST((n * 7 + length(l)) % 4 AS INTEGER) AS level FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents))
  SELECT a.doc_id, a.n, a.level, max(p.n) AS host FROM b a LEFT JOIN b p ON p.doc_id = a.doc_id AND p.n < a.n AND p.level < a.level GROUP BY ALL""")
def list_levels(spark: SparkSession, d: str) -> DataFrame:
    """Lines as items of a list with levels: the item under which each hangs."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "l"))
    return op.item_hosts(lines.select("doc_id", "n", ((F.col("n") * 7 + F.length("l")) % 4).alias("level")), "doc_id", "n", "level", 4)


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<(script|style|title)[^>]*>.*?</(script|style|title)>', '', 'gs'), '<(h[1-6]|li)[^>]*>', 1)) AS tag FROM pages)
  SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL""")
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Headings by level and items of lists among the blocks of each page."""
    from lorekeep.sources import html

    rows = html.read_pages(table(spark, d, "pages"))
    tag = F.when(F.col("kind") == "heading", F.concat(F.lit("h"), F.col("level").cast("string"))).when(F.col("kind") == "list_item", "li")
    return rows.where("kind IN ('heading', 'list_item')").groupBy(F.col("doc_id").cast("long").alias("page_id"), tag.alias("tag")).agg(F.count("*").alias("n"))
