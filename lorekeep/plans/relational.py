"""Listings, joins and reports over documents, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import access, listing
from lorekeep.plans.adapters import DOCUMENTS_SQL, documents, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"WITH {DOCUMENTS_SQL} SELECT uid, title, domain, tier, status FROM document WHERE NOT deleted AND tier = 'en' AND status = '1'")
def list_docs_filtered(spark: SparkSession, d: str) -> DataFrame:
    return listing.list_documents(documents(spark, d), tier="en", status="1").select("uid", "title", "domain", "tier", "status")


_BOUNDED = "SELECT o_orderkey AS uid, o_orderstatus AS status, o_orderpriority AS tier, c_mktsegment AS domain, CAST(o_orderdate AS DATE) AS due_date, o_orderdate + INTERVAL 10 DAY AS updated_at, o_totalprice < 1000 AS deleted FROM orders JOIN customer ON c_custkey = o_custkey"


@query(f"SELECT uid, status, domain, tier FROM ({_BOUNDED}) WHERE NOT deleted AND domain = 'BUILDING' AND status = 'O' AND due_date <= DATE '1997-06-30' AND updated_at <= TIMESTAMP '1997-06-01 00:00:00'")
def list_docs_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, by domain, status and both last dates."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    docs = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("tier"), F.col("c_mktsegment").alias("domain"), F.to_date("o_orderdate").alias("due_date"),
        (F.col("o_orderdate") + F.expr("INTERVAL 10 DAY")).alias("updated_at"), (F.col("o_totalprice") < 1000).alias("deleted"),
    )
    found = listing.list_documents(docs, domain="BUILDING", status="O", query="", due=F.lit("1997-06-30").cast("date"), updated=F.lit("1997-06-01 00:00:00").cast("timestamp_ntz"))
    return found.select("uid", "status", "domain", "tier")


@query(f"""WITH {DOCUMENTS_SQL} SELECT uid, title FROM document WHERE NOT deleted AND (title ILIKE '%the license version%'
  OR (list_contains(regexp_extract_all(lower(content), '[a-z0-9]+'), 'license') AND list_contains(regexp_extract_all(lower(content), '[a-z0-9]+'), 'version')))""")
def fts_match(spark: SparkSession, d: str) -> DataFrame:
    return listing.list_documents(documents(spark, d), query="the license version").select("uid", "title")


@query("SELECT c_custkey AS uid, c_name AS name, n_name AS organisation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def user_org_left(spark: SparkSession, d: str) -> DataFrame:
    orgs = table(spark, d, "nation").where("n_regionkey < 3")
    return table(spark, d, "customer").join(orgs, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.col("n_name").alias("organisation"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a document: the lines of an order."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("version_no"), F.col("l_partkey").alias("content"), F.col("l_linestatus").alias("state"))


_LATEST = "latest AS (SELECT l_orderkey AS doc, l_linenumber AS version_no, l_partkey AS content, l_linestatus AS state FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1)"


def _latest(spark: SparkSession, d: str) -> DataFrame:
    # generated lines repeat a number now and then: ties go to the larger content, then to the larger state
    rows = _versions(spark, d).withColumn("rank", F.struct("version_no", "content", "state"))
    return listing.latest(rows, "doc", "rank").select("doc", "version_no", "content", "state")


@query(f"WITH {_LATEST} SELECT doc, version_no, content FROM latest")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select("doc", "version_no", "content")


@query(f"""WITH {_LATEST} SELECT o_orderkey AS doc, c_mktsegment AS kind, n_name AS domain, r_name AS tier, o_orderstatus AS status, version_no
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN latest ON doc = o_orderkey""")
def doc_star(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.join(_latest(spark, d), F.col("doc") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").alias("doc"), F.col("c_mktsegment").alias("kind"), F.col("n_name").alias("domain"), F.col("r_name").alias("tier"), F.col("o_orderstatus").alias("status"), "version_no"
    )


@query(f"WITH {_LATEST} SELECT o_orderkey AS doc, o_orderpriority AS title, version_no, state FROM orders LEFT JOIN latest ON doc = o_orderkey")
def doc_detail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(_latest(spark, d), F.col("doc") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("title"), "version_no", "state")


@query(f"WITH {_LATEST} SELECT o_orderkey AS doc, o_orderpriority AS title, version_no, state FROM orders LEFT JOIN latest ON doc = o_orderkey")
def doc_detail_all(spark: SparkSession, d: str) -> DataFrame:
    """Another name of doc_detail."""
    return doc_detail(spark, d)


def _counts(spark: SparkSession, d: str, *by: str) -> DataFrame:
    return documents(spark, d).where(~F.col("deleted")).groupBy(*by).agg(F.count("*").alias("n"))


@query(f"WITH {DOCUMENTS_SQL} SELECT domain, status, count(*) AS n FROM document WHERE NOT deleted GROUP BY ALL")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, "domain", "status")


@query(f"WITH {DOCUMENTS_SQL} SELECT domain AS a, status AS b, count(*) AS n FROM document WHERE NOT deleted GROUP BY ALL")
def sankey_domain_status(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, "domain", "status").select(F.col("domain").alias("a"), F.col("status").alias("b"), "n")


@query(f"WITH {DOCUMENTS_SQL} SELECT status AS a, tier AS b, count(*) AS n FROM document WHERE NOT deleted GROUP BY ALL")
def sankey_status_tier(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, "status", "tier").select(F.col("status").alias("a"), F.col("tier").alias("b"), "n")


@query(f"WITH {DOCUMENTS_SQL} SELECT tier, count(*) AS n FROM document WHERE NOT deleted GROUP BY ALL")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, "tier")


@query("SELECT l_orderkey AS doc, CAST(coalesce(max(l_linenumber), 0) + 1 AS BIGINT) AS next_version FROM lineitem GROUP BY 1 UNION ALL SELECT -1, CAST(coalesce(max(l_linenumber), 0) + 1 AS BIGINT) FROM lineitem WHERE l_orderkey < 0")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    rows = _versions(spark, d)
    each = rows.groupBy("doc").agg((F.coalesce(F.max("version_no"), F.lit(0)) + 1).cast("long").alias("next_version"))
    none = listing.next_number(rows.where("doc < 0"), "version_no").select(F.lit(-1).cast("long").alias("doc"), F.col("next").cast("long").alias("next_version"))
    return each.union(none)


@query(f"""WITH {DOCUMENTS_SQL} SELECT uid, title, domain, CASE status WHEN 'unrated' THEN 0 WHEN '0' THEN 1 ELSE 2 END AS stage FROM document WHERE NOT deleted""")
def constellation(spark: SparkSession, d: str) -> DataFrame:
    stages = spark.sql("SELECT * FROM VALUES ('unrated', 0), ('0', 1), ('1', 2) AS s(status, stage)")
    return listing.lifecycle(documents(spark, d).where(~F.col("deleted")), stages).select("uid", "title", "domain", "stage")


@query("SELECT o_custkey AS doc, o_orderkey AS comment, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders")
def comments_desc(spark: SparkSession, d: str) -> DataFrame:
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("comment"), F.row_number().over(newest).alias("place"))


@query(f"WITH {DOCUMENTS_SQL} SELECT uid, title FROM document WHERE NOT deleted ORDER BY title, uid LIMIT 25 OFFSET 50")
def doc_page(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).where(~F.col("deleted")).select("uid", "title")
    return listing.page(rows, [F.col("title"), F.col("uid")], offset=50, limit=25)


_RULES = [(1, "src1", None, None, True, 5), (2, None, "fr", None, False, 7), (3, None, None, "0", True, 7), (4, "src2", "en", "1", True, 9), (5, None, None, None, False, 1)]
_RULE_SQL = "rule(uid, domain, tier, status, block_import, priority) AS (VALUES (1, 'src1', NULL, NULL, true, 5), (2, NULL, 'fr', NULL, false, 7), (3, NULL, NULL, '0', true, 7), (4, 'src2', 'en', '1', true, 9), (5, NULL, NULL, NULL, false, 1))"


@query(f"""WITH {DOCUMENTS_SQL}, {_RULE_SQL}, best AS (SELECT d.uid, r.block_import FROM document d JOIN rule r ON (r.domain IS NULL OR r.domain = d.domain) AND (r.tier IS NULL OR r.tier = d.tier) AND (r.status IS NULL OR r.status = d.status)
  QUALIFY row_number() OVER (PARTITION BY d.uid ORDER BY priority DESC, r.uid) = 1)
  SELECT uid AS key, coalesce(block_import, false) AS blocked FROM document LEFT JOIN best USING (uid)""")
def policy_best(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "uid int, domain string, tier string, status string, block_import boolean, priority int")
    requests = documents(spark, d).select(F.col("uid").alias("key"), "domain", "tier", "status")
    return access.best_policy(requests, rules).select("key", "blocked")


def _access(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Users of the events in groups and organisations; roles by domain, document and for all."""
    users = table(spark, d, "events").select(F.col("user_id").alias("user")).distinct().withColumn("org", F.col("user") % 11)
    members = users.select("user", (F.col("user") % 13).alias("grp"))
    none = F.lit(None)
    row = lambda n: spark.range(n)
    bindings = (
        row(11).select(F.lit("org").alias("principal"), none.cast("long").alias("user"), none.cast("long").alias("grp"), F.col("id").alias("org"), (F.col("id") % 3).alias("role"), F.lit("domain").alias("scope"), F.concat(F.lit("src"), F.col("id")).alias("scope_value"))
        .union(row(13).select(F.lit("group"), none.cast("long"), F.col("id"), none.cast("long"), F.lit(1).cast("long"), F.lit("resource"), F.col("id").cast("string")))
        .union(row(5).select(F.lit("user"), F.col("id"), none.cast("long"), none.cast("long"), F.lit(0).cast("long"), F.lit("tenant"), none.cast("string")))
    )
    permissions = row(3).select(F.col("id").alias("role"), F.when(F.col("id") < 2, "edit").otherwise("view").alias("permission"))
    docs = documents(spark, d).select(F.col("uid").alias("doc"), "domain")
    # a document's own list: every tenth lets a group view and edit, every seventh a role
    acl = (
        docs.where("doc % 10 = 0").select("doc", F.lit("group").alias("principal"), none.cast("long").alias("user"), (F.col("doc") % 13).alias("grp"), none.cast("long").alias("org"), none.cast("long").alias("role"), F.array(F.lit("view"), F.lit("edit")).alias("rights"), none.cast("string").alias("scope"), none.cast("string").alias("scope_value"))
        .union(docs.where("doc % 7 = 0").select("doc", F.lit("role"), none.cast("long"), none.cast("long"), none.cast("long"), F.lit(2).cast("long"), F.array(F.lit("edit")), F.lit("domain"), F.col("domain")))
    )
    return {"docs": docs, "users": users, "members": members, "bindings": bindings, "permissions": permissions, "acl": acl}


_ACCESS_SQL = f"""{DOCUMENTS_SQL}, usr AS (SELECT DISTINCT user_id AS u, user_id % 11 AS org, user_id % 13 AS grp FROM events),
  binding AS (SELECT 'org' AS principal, i AS k, i % 3 AS role, 'domain' AS scope, 'src' || i AS scope_value FROM range(11) r(i) UNION ALL SELECT 'group', i, 1, 'resource', CAST(i AS VARCHAR) FROM range(13) r(i) UNION ALL SELECT 'user', i, 0, 'tenant', NULL FROM range(5) r(i)),
  eff AS (SELECT DISTINCT u, role, scope, scope_value FROM usr JOIN binding b ON (principal = 'org' AND k = org) OR (principal = 'group' AND k = grp) OR (principal = 'user' AND k = u)),
  acl AS (SELECT uid AS doc, domain, 'group' AS principal, uid % 13 AS k FROM document WHERE uid % 10 = 0 UNION ALL SELECT uid, domain, 'role', 2 FROM document WHERE uid % 7 = 0),
  grants AS (SELECT u, CAST(NULL AS BIGINT) AS doc FROM eff WHERE role < 2 AND scope = 'tenant'
    UNION SELECT u, d.uid FROM eff JOIN document d ON (scope = 'domain' AND scope_value = d.domain) OR (scope = 'resource' AND TRY_CAST(scope_value AS BIGINT) = d.uid) WHERE role < 2
    UNION SELECT u, doc FROM acl JOIN usr ON principal = 'group' AND k = grp
    UNION SELECT u, doc FROM acl JOIN eff ON principal = 'role' AND k = role AND (scope = 'tenant' OR (scope = 'domain' AND scope_value = domain) OR (scope = 'resource' AND TRY_CAST(scope_value AS BIGINT) = doc)))"""


@query(f"WITH {_ACCESS_SQL} SELECT u AS user, doc FROM grants")
def can_user_matrix(spark: SparkSession, d: str) -> DataFrame:
    return access.can_user(**_access(spark, d), permission="edit")


@query(f"WITH {_ACCESS_SQL} SELECT u AS user, role, scope, scope_value FROM eff")
def effective_bindings(spark: SparkSession, d: str) -> DataFrame:
    a = _access(spark, d)
    return access.effective_bindings(a["users"], a["members"], a["bindings"])


@query("""SELECT o_custkey % 100 AS grp, c_custkey AS conv, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL""")
def targets_semi(spark: SparkSession, d: str) -> DataFrame:
    """Members of the chosen targets: a semi join with a set of ids."""
    orders = table(spark, d, "orders")
    wanted = orders.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    rows = orders.join(wanted, "o_custkey", "left_semi").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy((F.col("o_custkey") % 100).alias("grp"), F.col("c_custkey").alias("conv")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS user, max(seq) AS last_seq, count(*) AS n FROM (SELECT user_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events) GROUP BY 1 HAVING bool_and(user_id IS NOT NULL)")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """Last change and number of changes of each user; seq numbers all events by time."""
    events = table(spark, d, "events").select("event_id", "ts", "user_id")
    seq = numbered(events, ["ts", "event_id"])
    return seq.groupBy(F.col("user_id").alias("user")).agg(F.max("seq").alias("last_seq"), F.count("*").alias("n"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with seq, their number in a total order: days are counted first, and rows numbered within
    a day, so that no task gets them all.  The first column of order must be a timestamp."""
    day = F.to_date(order[0])
    days = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    # one row for each day
    before = days.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("day").orderBy(*order))
    return rows.withColumn("day", day).withColumn("inner", inner).join(before, "day").withColumn("seq", F.col("before") + F.col("inner")).drop("day", "inner", "before")


@query("""WITH c AS (SELECT c_nationkey AS a, c_custkey % 7 AS b, count(*) AS n FROM customer GROUP BY ALL)
  SELECT n_name AS a, r_name AS b, CAST(sum(n) AS BIGINT) AS n FROM c JOIN nation ON n_nationkey = a JOIN region ON r_regionkey = b GROUP BY ALL""")
def flow_by_dimensions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 7).alias("part"))
    left = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("code"))
    right = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("code"))
    return listing.flow_counts(docs, left, right, "c_nationkey", "part")


@query("""WITH l AS (SELECT o_custkey AS cust, o_orderstatus AS s, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY ALL)
  SELECT cust, string_agg(s || '=' || v, ',' ORDER BY s) AS shown FROM l GROUP BY cust""")
def latest_map(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("turn", F.struct("o_orderdate", "o_orderkey"))
    found = listing.as_map(rows, "o_custkey", "o_orderstatus", "o_orderkey", "turn")
    pairs = F.transform(F.map_entries("map"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select(F.col("o_custkey").alias("cust"), F.array_join(pairs, ",").alias("shown"))


@query("""WITH r AS (SELECT doc_id, source, CASE WHEN n_chars < 20 AND source <> 'src1' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END AS k FROM documents),
  w AS (SELECT source, min(k) AS k FROM r GROUP BY source) SELECT doc_id, ['infrastructure', 'logic', 'result'][k + 1] AS outcome FROM r JOIN w USING (source, k)""")
def result_outcome(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.when((F.col("n_chars") < 20) & (F.col("source") != "src1"), "short").alias("infra"), F.when(F.col("lang") == "fr", "lang").alias("logic"))
    return listing.outcome(rows, "source", "infra", "logic").select("doc_id", "outcome")


@query(f"WITH {DOCUMENTS_SQL} SELECT domain, arg_max(uid, uid) AS uid FROM document WHERE uid <= 500 GROUP BY domain")
def restriction_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = listing.up_to(documents(spark, d).select("domain", "uid"), "uid", 500).withColumn("place", F.col("uid"))
    return listing.last_wins(rows, "domain", "place").select("domain", "uid")


@query("SELECT o_orderkey AS uid FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def targets_by_label(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("uid"), F.col("c_mktsegment").alias("label"))
    return listing.targets(table(spark, d, "orders").select(F.col("o_orderkey").alias("uid")), members=members, label="BUILDING")
