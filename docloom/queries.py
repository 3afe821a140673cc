"""Queries of the document engine on the test tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vclock
from .functions.analysis import STOP_WORDS, TOKEN
from .functions.scalars import format_position
from .operators import changelog, flatten, indexes, rates, search
from .operators.indexes import IndexDef
from .plans.ast import HasWord
from .plans.parser import parse

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def _tok(col: str) -> str:
    return f"list_filter(regexp_extract_all(lower({col}), '{TOKEN.replace(chr(39), chr(39) * 2)}'), lambda t: t NOT IN {_STOP} AND length(t) <= 255)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _simple(name: str, table: str, text: str, where: str, columns: str = "*") -> None:
    cols = [c.strip() for c in columns.split(",")]
    QUERIES[name] = lambda spark, d: search.query(_table(spark, d, table), text, amount=None).select(*cols)
    ORACLE[name] = f"SELECT {columns} FROM {table} WHERE {where}"


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return keep


_simple("match_all", "nation", "*", "true")
_simple("eq_string", "orders", '(= :o_orderstatus "P")', "o_orderstatus = 'P'")
_simple("eq_string_spaces", "part", '(= :p_name "small ring")', "p_name = 'small ring'")
_simple("eq_int", "part", "(= :p_size 11)", "p_size = 11")
_simple("lt", "part", "(< :p_size 5)", "p_size < 5")
_simple("gt", "part", "(> :p_size 45)", "p_size > 45")
_simple("lte", "part", "(<= :p_size 5)", "p_size <= 5")
_simple("gte", "part", "(>= :p_size 45)", "p_size >= 45")
_simple("gt_float", "customer", "(> :c_acctbal 9000)", "c_acctbal > 9000")
_simple("type_strict", "part", '(= :p_size "11")', "false")
_simple("type_strict_mixed", "part", '(or (= :p_size "11") (= :p_name "small ring") (= :p_name 11))', "p_name = 'small ring'")
_simple("stop_words_mixed", "documents", '(or (has-word "text" "the") (has-word "text" "thing"))', f"list_contains({_tok('text')}, 'thing')", "doc_id, lang, source")
_simple("starts_with_token", "part", '(starts-with :p_name "wid")', f"len(list_filter({_tok('p_name')}, lambda t: starts_with(t, 'wid'))) > 0")
_simple("has_word", "part", '(has-word :p_name "ring")', f"list_contains({_tok('p_name')}, 'ring')")
_simple("has_word_docs", "documents", '(has-word "text" "thing")', f"list_contains({_tok('text')}, 'thing')", "doc_id, lang, source")
_simple("stop_word_docs", "documents", '(has-word "text" "the")', "false", "doc_id, lang, source")
_simple("word_prefix_docs", "documents", '(has-word-starting-with "text" "qu")', f"len(list_filter({_tok('text')}, lambda t: starts_with(t, 'qu'))) > 0", "doc_id, lang, source")
_simple("and_or_not", "part", '(and (= :p_type "PROMO") (or (< :p_size 10) (> :p_size 40)) (not (= :p_brand "Brand#2")))', "p_type = 'PROMO' AND (p_size < 10 OR p_size > 40) AND NOT coalesce(p_brand = 'Brand#2', false)")
_simple("not_two_valued", "part", "(not (> :p_size 10))", "NOT coalesce(p_size > 10, false)")
_simple("not_equals", "part", '(not= :p_type "PROMO")', "NOT coalesce(p_type = 'PROMO', false)")
_simple("contains", "part", '(contains :p_name "all r")', "contains(p_name, 'all r')")
_simple("empty_and", "part", "(and)", "false")
_simple("empty_not", "nation", "(not)", "true")


@_query("SELECT p_partkey, nullif(p_size, 7) AS size FROM part WHERE NOT coalesce(nullif(p_size, 7) > 10, false)")
def not_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size"))
    return search.query(part, "(not (> :size 10))", amount=None)


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def has_item(spark: SparkSession, d: str) -> DataFrame:
    items = _table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("priorities"))
    customers = _table(spark, d, "customer").join(items, F.col("c_custkey") == F.col("o_custkey"))
    return search.query(customers, '(= :priorities "1-URGENT")', amount=None).select("c_custkey", "c_name")


@_query("SELECT event_id, event_type FROM events WHERE cast(json_extract(props, '$.k') AS BIGINT) > 90")
def nested_field(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events").withColumn("props", F.parse_json("props"))
    return search.query(events, '(> "props$k" 90)', amount=None).select("event_id", "event_type")


@_query("SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def sort_page(spark: SparkSession, d: str) -> DataFrame:
    return search.query(_table(spark, d, "orders"), '(= :o_orderstatus "F")', id_col="o_orderkey", sort_by="o_totalprice", sort_order="desc", offset=20, amount=10)


@_query(
    f"WITH t AS (SELECT p_partkey, {_tok('p_name')} AS w FROM part), n AS (SELECT count(*) AS n, count(*) FILTER (list_contains(w, 'ring')) AS df FROM t) "
    "SELECT p_partkey, round(sqrt(len(list_filter(w, lambda t: t = 'ring'))::DOUBLE) * power(1 + ln(n / (df + 1.0::DOUBLE)), 2) / sqrt(len(w)::DOUBLE), 6) AS score FROM t, n WHERE list_contains(w, 'ring')"
)
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part")
    node = parse('(has-word :p_name "ring")')
    scored = search.relevance(part, node)
    return search.query(scored, node, amount=None).select("p_partkey", F.round("score", 6).alias("score"))


@_query(
    "SELECT event_id, 'event_type' AS field, event_type AS v FROM events UNION ALL SELECT event_id, 'user_id', user_id::VARCHAR FROM events "
    "UNION ALL SELECT event_id, 'props$k', json_extract_string(props, '$.k') FROM events"
)
def flatten_entries(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events").select("event_id", "event_type", "user_id", F.from_json("props", "k bigint").alias("props"))
    return flatten.entries(events, "event_id").select(F.col("id").alias("event_id"), "field", F.coalesce("s", F.col("n").cast("string"), F.col("d").cast("string")).alias("v"))


@_query("SELECT event_id, 'k' AS field, cast(json_extract(props, '$.k') AS BIGINT) AS n FROM events")
def flatten_variant(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events").select("event_id", F.parse_json("props").alias("doc"))
    return flatten.variant_entries(events, "event_id", "doc").select(F.col("id").alias("event_id"), "field", "n")


@_query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def collect_fields(spark: SparkSession, d: str) -> DataFrame:
    turns = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    fields = flatten.regroup(flatten.entries(turns, "conv_id"))
    return fields.select(F.col("id").alias("conv_id"), F.array_join(F.col("s")["turns$role"], ",").alias("roles"))


@_query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def custom_index(spark: SparkSession, d: str) -> DataFrame:
    customers = _table(spark, d, "customer")
    built = indexes.build(customers, IndexDef.of("by_segment", {"segment": "c_mktsegment"}), "c_custkey")
    found = search.query(built, '(= "segment" "BUILDING")', amount=None).select("id")
    return search.fetch(customers, "c_custkey", found)


@_query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def partial_index(spark: SparkSession, d: str) -> DataFrame:
    return indexes.build(_table(spark, d, "customer"), IndexDef.of("some", {"name": "c_name"}, "startswith(c_name, 'Customer#00000001')"), "c_custkey")


@_query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return changelog.by_prefix(_table(spark, d, "customer"), "Customer#0000001", "c_name").select("c_custkey", "c_name")


@_query(f"SELECT * FROM part WHERE list_contains({_tok('p_name')}, 'ring')")
def index_hit_join(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part")
    post = search.postings(part, "p_partkey", "p_name")
    return search.fetch(part, "p_partkey", search.hits(post, HasWord(":p_name", "ring"), part.select(F.col("p_partkey").alias("id"))))


_LOG = "user_id AS id, event_id AS seq, event_type, value, (event_type = 'error') AS deleted"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "value", (F.col("event_type") == "error").alias("deleted"))


@_query(f"WITH l AS (SELECT {_LOG} FROM events) SELECT id, seq, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM l) WHERE k = 1 AND NOT deleted")
def snapshot_latest(spark: SparkSession, d: str) -> DataFrame:
    return changelog.snapshot(_log(spark, d)).drop("deleted")


@_query("SELECT user_id AS id, min(event_id) AS seq FROM events WHERE event_id > 5000 GROUP BY user_id ORDER BY seq LIMIT 1024")
def changelog_after(spark: SparkSession, d: str) -> DataFrame:
    return changelog.after(_log(spark, d), 5000)


@_query(f"WITH l AS (SELECT {_LOG} FROM events) SELECT id, seq, event_type, deleted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM l WHERE seq > 5000) WHERE k = 1 ORDER BY seq LIMIT 1024")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    return changelog.feed(_log(spark, d), 5000).select("id", "seq", "event_type", "deleted")


@_query("SELECT user_id AS id, min(event_id) AS seq FROM events WHERE event_id > 5000 GROUP BY user_id ORDER BY seq LIMIT 20")
def changelog_page(spark: SparkSession, d: str) -> DataFrame:
    return changelog.after(_log(spark, d), 5000, limit=20)


@_query(f"WITH l AS (SELECT {_LOG} FROM events) SELECT id, seq, event_type, deleted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM l WHERE seq > 5000) WHERE k = 1 ORDER BY seq LIMIT 20")
def change_feed_page(spark: SparkSession, d: str) -> DataFrame:
    return changelog.feed(_log(spark, d), 5000, limit=20).select("id", "seq", "event_type", "deleted")


_BY_TYPE = IndexDef.of("by_type", {"type": "variant_get(doc, '$.type', 'string')"}, "variant_get(doc, '$.type', 'string') <> 'view'")
_BY_TYPE_SQL = f"WITH l AS (SELECT {_LOG} FROM events) SELECT id, event_type AS type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM l) WHERE k = 1 AND NOT deleted AND event_type <> 'view'"


def _changes(spark: SparkSession, d: str, after: int, until: int | None = None) -> DataFrame:
    """What one pass over the log sees: the last version of each id between two positions."""
    log = _log(spark, d).filter(F.col("seq") > after)
    rows = changelog.latest(log if until is None else log.filter(F.col("seq") <= until), "id", "seq")
    return rows.withColumn("doc", F.parse_json(F.to_json(F.struct(F.col("event_type").alias("type")))))


@_query(_BY_TYPE_SQL)
def index_passes(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a stored index after three passes over the log."""
    passes = [indexes.sql_entries(_changes(spark, d, *span), _BY_TYPE) for span in ((0, 3000), (3000, 6000), (6000,))]
    found = indexes.current_entries(passes[0].unionByName(passes[1]).unionByName(passes[2]))
    return found.select("id", F.col("s")["type"][0].alias("type"))


@_query(_BY_TYPE_SQL)
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An index's rows after changed ids lost their old ones and got new ones."""
    before, changed = _changes(spark, d, 0, 6000), _changes(spark, d, 6000)
    old, new = (indexes.build(x.filter("not deleted"), _BY_TYPE, "id") for x in (before, changed))
    return indexes.upsert(old, changed, new)


@_query("SELECT index_id, count(*) AS total, count(*) FILTER (value < low) AS errors, count(*) FILTER (NOT value < low) AS indexed FROM events, (VALUES ('a', 10), ('b', 50)) AS i(index_id, low) GROUP BY index_id")
def index_pass_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of one pass of two indexes over the same documents."""
    defs = spark.createDataFrame([("a", 10), ("b", 50)], "index_id string, low int")
    return indexes.pass_stats(_table(spark, d, "events"), defs, F.col("value") < F.col("low"))


@_query(
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 100 <> 0 AND o_orderkey % 200 <> 0 "
    "UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 200 = 0"
)
def overlay(spark: SparkSession, d: str) -> DataFrame:
    base = _table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    key = F.col("o_orderkey")
    staged = base.filter(key % 100 == 0).select("o_orderkey", F.lit("X").alias("o_orderstatus"), (key % 200 != 0).alias("deleted"))
    return changelog.overlay(base, staged, "o_orderkey")


@_query("SELECT event_type AS index_id, count(*) AS total, count(*) FILTER (value < 10) AS errors, count(*) FILTER (NOT value < 10) AS indexed FROM events GROUP BY event_type")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return indexes.stats(_table(spark, d, "events"), F.col("event_type"), F.col("value") < 10)


@_query("SELECT user_id AS index_id, count(*) AS total, count(*) FILTER (event_type <> 'view') AS errors FROM events GROUP BY user_id HAVING count(*) > 50 AND count(*) FILTER (event_type <> 'view') / count(*)::DOUBLE > 0.8")
def failed_indexes(spark: SparkSession, d: str) -> DataFrame:
    stats = indexes.stats(_table(spark, d, "events"), F.col("user_id"), F.col("event_type") != "view")
    return indexes.failed(stats, over=50).drop("indexed")


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS total, round(count(*) / 3600.0::DOUBLE, 9) AS rate FROM events GROUP BY 1, 2")
def event_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates.rates(_table(spark, d, "events"), seconds=3600).select("start", "event_type", "total", F.round("rate", 9).alias("rate"))


@_query("SELECT event_type, count(*)::BIGINT AS total FROM events GROUP BY event_type")
def event_totals(spark: SparkSession, d: str) -> DataFrame:
    return rates.totals(_table(spark, d, "events"))


@_query("SELECT min(event_id) AS oldest, max(event_id) AS newest, count(*) AS total FROM events")
def log_positions(spark: SparkSession, d: str) -> DataFrame:
    return changelog.positions(_log(spark, d))


def _clocks(spark: SparkSession, d: str) -> DataFrame:
    def clock(a, b):
        return F.create_map(F.lit("a"), a.cast("bigint"), F.lit("b"), b.cast("bigint"))

    o, c = F.col("o_orderkey"), F.col("o_custkey")
    third = [F.floor(x / 3) for x in (o, c)]
    return _table(spark, d, "orders").select("o_orderkey", F.when(o % 10 != 0, clock(o % 3, c % 3)).alias("history"), clock(*[x % 3 for x in third]).alias("candidate"))


_CLOCK_SQL = "SELECT o_orderkey, o_orderkey % 10 = 0 AS fresh, o_orderkey % 3 AS a, o_custkey % 3 AS b, (o_orderkey // 3) % 3 AS x, (o_custkey // 3) % 3 AS y FROM orders"
_CLIENT_SQL = "CASE WHEN fresh OR (x >= a AND y >= b) THEN 'write' ELSE 'conflict' END"
_REPLICA_SQL = "CASE WHEN fresh THEN 'write' WHEN x = a AND y = b THEN 'skip' WHEN x >= a AND y >= b THEN 'write' WHEN a >= x AND b >= y THEN 'skip' ELSE 'conflict' END"


@_query(f"SELECT o_orderkey, {_CLIENT_SQL} AS status FROM ({_CLOCK_SQL})")
def vclock_status_client(spark: SparkSession, d: str) -> DataFrame:
    return _clocks(spark, d).select("o_orderkey", vclock.client_status(F.col("history"), F.col("candidate")).alias("status"))


@_query(f"SELECT o_orderkey, {_REPLICA_SQL} AS status FROM ({_CLOCK_SQL})")
def vclock_status_replication(spark: SparkSession, d: str) -> DataFrame:
    return _clocks(spark, d).select("o_orderkey", vclock.replication_status(F.col("history"), F.col("candidate")).alias("status"))


@_query(f"SELECT o_orderkey, x + 1 AS bumped, y AS kept FROM ({_CLOCK_SQL})")
def vclock_increment(spark: SparkSession, d: str) -> DataFrame:
    new = vclock.increment(F.col("candidate"), F.lit("a"))
    return _clocks(spark, d).select("o_orderkey", new["a"].alias("bumped"), new["b"].alias("kept"))


@_query(
    f"WITH c AS ({_CLOCK_SQL}), s AS (SELECT *, o_orderkey % 7 <> 0 AS here, o_orderkey % 11 <> 0 AS there FROM c) "
    f"SELECT o_orderkey AS id, CASE WHEN NOT there THEN 'keep' WHEN NOT here OR fresh THEN 'write' ELSE {_REPLICA_SQL} END AS status FROM s WHERE here OR there"
)
def replication_merge(spark: SparkSession, d: str) -> DataFrame:
    clocks = _clocks(spark, d).withColumnRenamed("o_orderkey", "id")
    current = clocks.filter("id % 7 <> 0").select("id", "history")
    incoming = clocks.filter("id % 11 <> 0").select("id", F.col("candidate").alias("history"))
    return changelog.merge(current, incoming).select(F.coalesce("id", "in_id").alias("id"), "status")


@_query(f"SELECT o_orderkey AS id FROM ({_CLOCK_SQL}) WHERE {_CLIENT_SQL} = 'conflict'")
def conflicts_list(spark: SparkSession, d: str) -> DataFrame:
    return vclock_status_client(spark, d).filter("status = 'conflict'").select(F.col("o_orderkey").alias("id"))


@_query(f"SELECT o_orderkey AS id FROM ({_CLOCK_SQL}) WHERE {_CLIENT_SQL} = 'conflict' AND o_orderkey <> 1")
def conflicts_clear(spark: SparkSession, d: str) -> DataFrame:
    return changelog.without_conflicts(conflicts_list(spark, d), 1)


@_query("SELECT l_orderkey, arg_max(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS l_linestatus FROM lineitem GROUP BY l_orderkey")
def bulk_last_wins(spark: SparkSession, d: str) -> DataFrame:
    ops = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus")
    return changelog.last_wins(ops, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").select("l_orderkey", "l_linestatus")


@_query("SELECT event_id, lpad(cast(event_id AS VARCHAR), 30, '0') AS position FROM events")
def synctag_format(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", format_position(F.col("event_id")).alias("position"))


@_query("SELECT * FROM orders WHERE o_orderkey = 7")
def point_read(spark: SparkSession, d: str) -> DataFrame:
    return changelog.by_id(_table(spark, d, "orders"), 7, "o_orderkey")


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 14000")
def key_seek(spark: SparkSession, d: str) -> DataFrame:
    return changelog.seek(_table(spark, d, "orders"), 14000, "o_orderkey").select("o_orderkey", "o_orderstatus")
