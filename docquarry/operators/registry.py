"""Queries of the document engine over the test tables, and the same in SQL.

Every query reads its whole table.  Rows come back as flat columns.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.definition import CollectionDefinition, Index, IndexField
from ..plans.query import Aggregation as A
from ..plans.query import Filter, QueryRequest, TextSearch
from ..sources import tables as t
from . import execute as ex
from . import kv, paging
from .collection import Collection

Q = QueryRequest


def _index(*fields: IndexField, unique: bool = False, text: str | None = None) -> Index:
    return Index("+".join(f.path for f in fields), fields, unique, text)


def orders(spark: SparkSession, d: str) -> Collection:
    fields = [IndexField("/status"), IndexField("/price", "number", 2), IndexField("/date"), IndexField("/priority"), IndexField("/customer/key", "number", 0)]
    definition = CollectionDefinition("orders", [_index(f) for f in fields])
    members = {"/status": F.col("o_orderstatus"), "/price": t.money("o_totalprice"), "/date": t.iso("o_orderdate"), "/priority": F.col("o_orderpriority"), "/customer/key": F.col("o_custkey")}
    return t.collection(definition, t.read(spark, d, "orders"), t.fixed_width("o_orderkey"), members)


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def lineitem(spark: SparkSession, d: str) -> Collection:
    fields = [IndexField("/flag"), IndexField("/line"), IndexField("/qty", "number", 2), IndexField("/price", "number", 2), IndexField("/disc", "number", 2), IndexField("/ship"), IndexField("/order", "number", 0), IndexField("/no", "number", 0)]
    definition = CollectionDefinition("lineitem", [*[_index(f) for f in fields], _index(fields[6], fields[7], unique=True)])
    members = {"/flag": F.col("l_returnflag"), "/line": F.col("l_linestatus"), "/qty": t.money("l_quantity"), "/price": t.money("l_extendedprice"), "/disc": t.money("l_discount"), "/ship": t.iso("l_shipdate"), "/order": F.col("l_orderkey"), "/no": F.col("l_linenumber")}
    id = F.md5(F.concat_ws("|", *[t.money(c).cast("string") if c in ("l_quantity", "l_extendedprice") else F.col(c).cast("string") for c in _LINE]))
    return t.collection(definition, t.read(spark, d, "lineitem"), id, members)


def events(spark: SparkSession, d: str) -> Collection:
    """/value is absent where event_id % 5 is 0 and null where it is 1; /props/k is not declared."""
    fields = [IndexField("/type"), IndexField("/at"), IndexField("/eventId", "number", 0), IndexField("/user", "number", 0), IndexField("/value", "number", 4)]
    definition = CollectionDefinition("events", [*[_index(f) for f in fields], _index(*fields[:3], unique=True)])
    fifth = F.col("event_id") % 5
    members = {"/type": F.col("event_type"), "/at": t.iso("ts"), "/eventId": F.col("event_id"), "/user": F.col("user_id"), "/value": F.when(fifth != 1, t.money("value", 4)), "/props": F.col("props")}
    return t.collection(definition, t.read(spark, d, "events"), t.fixed_width("event_id"), members, present={"/value": fifth != 0}, raw=("/props",))


def documents(spark: SparkSession, d: str) -> Collection:
    fields = [IndexField("/lang"), IndexField("/nChars", "number", 0), IndexField("/words", "string_array"), IndexField("/text")]
    definition = CollectionDefinition("documents", [*[_index(f) for f in fields], Index("text", (fields[3],), text="unicode_v1"), Index("english", (fields[3],), text="english_v1")])
    members = {"/lang": F.col("lang"), "/nChars": F.col("n_chars"), "/words": F.split("text", " "), "/text": F.col("text")}
    return t.collection(definition, t.read(spark, d, "documents"), t.fixed_width("doc_id"), members)


def conversations(spark: SparkSession, d: str) -> Collection:
    fields = [IndexField("/role"), IndexField("/turn", "number", 0), IndexField("/text")]
    definition = CollectionDefinition("conversations", [*[_index(f) for f in fields], Index("text", (fields[2],), text="unicode_v1")])
    members = {"/role": F.col("role"), "/turn": F.col("turn"), "/text": F.col("text")}
    id = F.concat(t.fixed_width("conv_id"), F.lit("-"), t.fixed_width("turn", 4))
    return t.collection(definition, t.read(spark, d, "conversations"), id, members)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def flat(source: Collection, df: DataFrame, **paths: str) -> DataFrame:
    """id and the values of declared paths."""
    access = {name: source.access(path, False) for name, path in paths.items()}
    return df.select("id", *[(a.num if a.num is not None else a.txt).alias(name) for name, a in access.items()])


def grouped(source: Collection, request: QueryRequest, **names: str) -> DataFrame:
    """Groups with `names` for their paths, and a mark for the absent where asked (name__present)."""
    df = ex.groups(source, request)
    out = [F.col(f"`{p}`").alias(n) for n, p in names.items() if not n.endswith("__present")]
    out += [(F.col(f"`{p}#tag`") > 0).alias(n) for n, p in names.items() if n.endswith("__present")]
    return df.select(*out, *[F.col(f"`{a}`") for a in request.aggregates])


_OID = "lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id"
_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
_ODATE = _ISO.format("o_orderdate")
_EID = "lpad(CAST(event_id AS VARCHAR), 12, '0') AS id"
_EVALUE = "CASE WHEN event_id % 5 > 1 THEN CAST(value AS DECIMAL(18,4)) END"
_LID = "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)), CAST(l_extendedprice AS DECIMAL(18,2))))"

# ------------------------------------------------------------------- scans


@query(f"SELECT {_OID}, o_orderstatus AS status, {_PRICE} AS price, {_ODATE} AS date FROM orders")
def scan_all(spark, d):
    s = orders(spark, d)
    return flat(s, ex.all_rows(s, Q("orders")), status="/status", price="/price", date="/date")


@query(f"SELECT {_OID}, CAST(1 AS BIGINT) AS version FROM orders WHERE o_orderkey = 42")
def point_get(spark, d):
    return ex.get(orders(spark, d), "000000000042").select("id", "version")


@query(f"SELECT {_OID} FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def id_page_after(spark, d):
    return ex.ids_after(orders(spark, d), "000000000100", 50)


@query(f"SELECT {_OID} FROM orders")
def id_scan_headers(spark, d):
    return ex.ids(orders(spark, d), Q("orders"))


# ----------------------------------------------------------------- filters


def _filtered(source: Collection, where: Filter, scan: bool = False) -> DataFrame:
    return ex.ids(source, Q(source.definition.name).filter(where).allow_scan(scan))


@query(f"SELECT {_OID} FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, d):
    return _filtered(orders(spark, d), Filter().eq("/status", "F"))


@query(f"SELECT {_EID} FROM events WHERE ({_EVALUE}) IS DISTINCT FROM (SELECT min({_EVALUE}) FROM events)")
def filter_ne(spark, d):
    s = events(spark, d)
    least = ex.groups(s, Q("events").aggregate("m", A.min("/value"))).first()["m"]
    return _filtered(s, Filter().ne("/value", least))


@query(f"SELECT {_OID} FROM orders WHERE {_PRICE} >= 50000 AND {_PRICE} < 150000.5 AND {_ODATE} > '1995-01-01'")
def filter_range_closed_open(spark, d):
    return _filtered(orders(spark, d), Filter().gte("/price", 50000).lt("/price", Decimal("150000.5")).gt("/date", "1995-01-01"))


@query(f"SELECT {_OID} FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def filter_in(spark, d):
    return _filtered(orders(spark, d), Filter().is_in("/priority", ["1-URGENT", "2-HIGH"]).is_in("/customer/key", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]))


@query(f"SELECT {_EID} FROM events WHERE event_type NOT IN ('view', 'click')")
def filter_nin(spark, d):
    return _filtered(events(spark, d), Filter().not_in("/type", ["view", "click"]))


@query(
    f"SELECT {_LID} AS id FROM lineitem WHERE (l_returnflag = 'R' OR (CAST(l_quantity AS DECIMAL(18,2)) >= 45 AND l_linestatus = 'O')) AND NOT (CAST(l_discount AS DECIMAL(18,2)) > 0.05)"
)
def filter_and_or_not(spark, d):
    where = Filter.or_([Filter().eq("/flag", "R"), Filter().gte("/qty", 45).eq("/line", "O")]) & ~Filter().gt("/disc", Decimal("0.05"))
    return _filtered(lineitem(spark, d), where)


@query(f"SELECT {_OID} FROM orders WHERE false")
def filter_never(spark, d):
    return _filtered(orders(spark, d), Filter.or_([]))


@query(f"SELECT {_EID} FROM events WHERE event_id % 5 <> 0")
def filter_exists(spark, d):
    return _filtered(events(spark, d), Filter().exists("/value"))


@query(f"SELECT {_EID} FROM events WHERE event_id % 5 = 0")
def filter_missing(spark, d):
    return _filtered(events(spark, d), Filter().missing("/value"))


@query(f"SELECT {_EID} FROM events WHERE event_id % 5 = 1 OR ({_EVALUE}) < 10")
def filter_null_vs_missing(spark, d):
    return _filtered(events(spark, d), Filter().eq("/value", None) | Filter().lt("/value", 10))


@query("SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id FROM documents WHERE list_contains(string_split(text, ' '), 'the') AND NOT list_contains(string_split(text, ' '), 'is')")
def filter_contains(spark, d):
    return _filtered(documents(spark, d), Filter().contains("/words", "the") & ~Filter().contains("/words", "is"))


@query(f"SELECT {_EID} FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50 AND CAST(json_extract(props, '$.k') AS INTEGER) < 75")
def filter_scan_undeclared(spark, d):
    return _filtered(events(spark, d), Filter().gte("/props/k", 50).lt("/props/k", 75), scan=True)


@query(f"SELECT {_EID} FROM events WHERE event_type = 'click' AND ({_EVALUE}) > 20")
def index_intersection(spark, d):
    return _filtered(events(spark, d), Filter().eq("/type", "click").gt("/value", 20))


@query(f"SELECT {_EID} FROM events WHERE event_type = 'click' OR ({_EVALUE}) > 90")
def index_union(spark, d):
    return _filtered(events(spark, d), Filter().eq("/type", "click") | Filter().gt("/value", 90))


@query(f"SELECT {_EID} FROM events WHERE NOT coalesce(event_type = 'click' AND ({_EVALUE}) > 20, false)")
def index_complement(spark, d):
    return _filtered(events(spark, d), ~Filter().eq("/type", "click").gt("/value", 20))


# -------------------------------------------------------------- projection


@query(
    f"""SELECT {_OID}, '{{"customer":{{"key":' || o_custkey || '}},"price":' || rtrim(rtrim(CAST({_PRICE} AS VARCHAR), '0'), '.') || '}}' AS body FROM orders WHERE o_orderstatus = 'P'"""
)
def select_nested(spark, d):
    request = Q("orders").filter(Filter().eq("/status", "P")).select(["/customer/key", "/price", "/customer/none"])
    return ex.projected(ex.all_rows(orders(spark, d), request), request).select("id", "body")


# ------------------------------------------------------- sort, limit, pages


@query(f"SELECT {_LID} AS id, CAST(l_quantity AS DECIMAL(18,2)) AS qty FROM lineitem ORDER BY l_returnflag, CAST(l_quantity AS DECIMAL(18,2)) DESC, {_LID} LIMIT 500")
def sort_multi_key_limit(spark, d):
    s = lineitem(spark, d)
    b = ex.bound(s, Q("lineitem").sort_asc("/flag").sort_desc("/qty"))
    return flat(s, b.df.orderBy(*ex.ordering(b)).limit(500), qty="/qty").select("id", F.col("qty").cast("decimal(18,2)").alias("qty"))


@query(f"SELECT id FROM (SELECT {_OID}, o_orderpriority AS p FROM orders) ORDER BY p DESC, id LIMIT 100")
def sort_desc_id_tiebreak(spark, d):
    return ex.rows(orders(spark, d), Q("orders").sort_desc("/priority").limit(100)).select("id")


@query(f"SELECT id FROM (SELECT {_EID}, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 = 1 THEN 1 ELSE 2 END AS tag, {_EVALUE} AS v FROM events) ORDER BY tag DESC, v DESC, id LIMIT 700")
def sort_missing_null_desc(spark, d):
    return ex.rows(events(spark, d), Q("events").sort_desc("/value").limit(700)).select("id")


@query(f"SELECT {_OID} FROM orders ORDER BY o_orderkey LIMIT 100")
def default_order_limit(spark, d):
    return ex.rows(orders(spark, d), Q("orders")).select("id")


_WALK = f"SELECT {_EID}, {_ISO.format('ts')} AS at FROM events WHERE event_type = 'purchase'"


def _walk(spark, d, request: QueryRequest, pages: int = 1) -> DataFrame:
    """The rows of the given page of a seek walk."""
    s = events(spark, d)
    after = None
    for _ in range(pages - 1):
        last = paging.seek_rows(s, request, after, 0).collect()[-1]
        after = [last[k] for k in last.asDict() if k[0] == "k" and k[1:].isdigit()]
    return flat(s, paging.seek_rows(s, request, after, 0), at="/at")


_SEEK = Q("events").filter(Filter().eq("/type", "purchase")).sort_asc("/at").sort_asc("/eventId").paging("seek").limit(40)


@query(f"{_WALK} ORDER BY ts, event_id LIMIT 40")
def seek_first_page(spark, d):
    return _walk(spark, d, _SEEK)


@query(f"{_WALK} ORDER BY ts, event_id LIMIT 40 OFFSET 40")
def seek_next_page(spark, d):
    return _walk(spark, d, _SEEK, 2)


@query(f"{_WALK} AND {_ISO.format('ts')} >= '2024-01-10' AND {_ISO.format('ts')} < '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 40")
def seek_desc_range(spark, d):
    where = Filter().eq("/type", "purchase").gte("/at", "2024-01-10").lt("/at", "2024-01-20")
    return _walk(spark, d, Q("events").filter(where).sort_desc("/at").sort_desc("/eventId").paging("seek").limit(40))


@query(f"SELECT {_OID} FROM orders ORDER BY {_PRICE} DESC, o_orderkey LIMIT 150")
def snapshot_pages(spark, d):
    s = orders(spark, d)
    request = Q("orders").sort_desc("/price").limit(50)
    ids = []
    for _ in range(3):
        got = paging.page(s, request)
        ids += [(r["id"],) for r in got.rows]
        request = request.cursor(got.cursor)
    return spark.createDataFrame(ids, "id string")


# -------------------------------------------------------------- aggregates


@query(
    f"""SELECT o_orderstatus AS status, count(*) AS orders, CAST(sum({_PRICE}) AS DECIMAL(38,2)) AS revenue,
    CAST(round_even(CAST(sum({_PRICE}) AS DECIMAL(38,2)) / count(*), 2) AS DECIMAL(38,2)) AS mean FROM orders WHERE {_PRICE} >= 1000 AND {_PRICE} < 400000 GROUP BY 1"""
)
def agg_orders_by_status(spark, d):
    request = Q("orders").filter(Filter().gte("/price", 1000).lt("/price", 400000)).group_by(["/status"])
    request = request.aggregate("orders", A.count()).aggregate("revenue", A.sum("/price")).aggregate("mean", A.avg("/price", 2))
    return grouped(orders(spark, d), request, status="/status")


#: sum / count half-even: whole numbers only, as in the engine.
_HALF_EVEN = """
WITH s AS (SELECT {keys} CAST(sum({v}) * {up} AS HUGEINT) AS n, count({v}) AS c FROM {table} {where} {group}),
q AS (SELECT *, CAST(n // c AS HUGEINT) AS q, n - (n // c) * c AS r FROM s WHERE c > 0)
SELECT {out} CAST(CAST(q + CASE WHEN 2 * r > c OR (2 * r = c AND q % 2 <> 0) THEN 1 ELSE 0 END AS DECIMAL(38,0)) / {down} AS DECIMAL(38,{scale})) AS mean FROM q
"""


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def group_by_one(spark, d):
    return grouped(lineitem(spark, d), Q("lineitem").group_by(["/flag"]).aggregate("n", A.count()), flag="/flag")


@query(
    """SELECT l_returnflag AS flag, l_linestatus AS line, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS qty,
    CAST(min(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS low, CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS high FROM lineitem GROUP BY 1, 2"""
)
def group_by_many(spark, d):
    request = Q("lineitem").group_by(["/flag", "/line"]).aggregate("n", A.count()).aggregate("qty", A.sum("/qty")).aggregate("low", A.min("/price")).aggregate("high", A.max("/price"))
    return grouped(lineitem(spark, d), request, flag="/flag", line="/line")


@query("SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def count_star(spark, d):
    return ex.groups(events(spark, d), Q("events").filter(Filter().eq("/type", "error")).aggregate("n", A.count()))


@query("SELECT count(*) FILTER (event_id % 5 > 1) AS n, count(*) AS whole FROM events")
def count_field(spark, d):
    return ex.groups(events(spark, d), Q("events").aggregate("n", A.count_of("/value")).aggregate("whole", A.count()))


@query(f"SELECT event_type AS type, CAST(sum(v) AS DECIMAL(38,4)) AS total, CAST(min(v) AS DECIMAL(38,4)) AS low, CAST(max(v) AS DECIMAL(38,4)) AS high FROM (SELECT event_type, {_EVALUE} AS v FROM events) GROUP BY 1")
def sum_min_max(spark, d):
    request = Q("events").group_by(["/type"]).aggregate("total", A.sum("/value")).aggregate("low", A.min("/value")).aggregate("high", A.max("/value"))
    return grouped(events(spark, d), request, type="/type")


@query(_HALF_EVEN.format(keys="event_type AS type,", v="v", up=10**4, table=f"(SELECT event_type, {_EVALUE} AS v FROM events)", where="", group="GROUP BY 1", out="type,", down=10**4, scale=4))
def avg_half_even(spark, d):
    return grouped(events(spark, d), Q("events").group_by(["/type"]).aggregate("mean", A.avg("/value", 4)), type="/type")


@query(f"SELECT {_EVALUE} AS v, event_id % 5 <> 0 AS v__present, count(*) AS n FROM events WHERE event_id % 5 < 2 OR ({_EVALUE}) < 3 GROUP BY 1, 2".replace("AS v,", "AS v,"))
def group_missing_null(spark, d):
    request = Q("events").filter(Filter().missing("/value") | Filter().eq("/value", None) | Filter().lt("/value", 3)).group_by(["/value"]).aggregate("n", A.count())
    return grouped(events(spark, d), request, v="/value", v__present="/value").select(F.col("v").cast("decimal(18,4)").alias("v"), "v__present", "n")


@query("SELECT count(*) AS n, CAST(0 AS DECIMAL(38,2)) AS total, CAST(NULL AS DECIMAL(38,2)) AS low FROM orders WHERE false")
def group_empty(spark, d):
    return ex.groups(orders(spark, d), Q("orders").filter(Filter.or_([])).aggregate("n", A.count()).aggregate("total", A.sum("/price")).aggregate("low", A.min("/price")))


@query("SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def group_scan_undeclared(spark, d):
    df = grouped(events(spark, d), Q("events").group_by(["/props/k"]).aggregate("n", A.count()).allow_scan(), k="/props/k")
    return df.select(F.col("k").cast("decimal(38,0)").cast("int").alias("k"), "n")


# ------------------------------------------------------------------- search

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_DOCS = f"SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, doc_id, lang, n_chars, {_TOKENS} AS w FROM documents"
_CONV = f"SELECT lpad(CAST(conv_id AS VARCHAR), 12, '0') || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS id, role, {_TOKENS} AS w FROM conversations"


def _found(source: Collection, search: TextSearch) -> DataFrame:
    return ex.ids(source, Q(source.definition.name).search(search))


@query(f"SELECT id FROM ({_DOCS}) WHERE list_contains(w, 'the') AND list_contains(w, 'idiot')")
def search_terms(spark, d):
    return _found(documents(spark, d), TextSearch("text", "idiot THE"))


@query(f"SELECT id FROM ({_DOCS}) WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def search_phrase(spark, d):
    return _found(documents(spark, d), TextSearch("text", "of the").phrase())


@query(f"SELECT id FROM ({_DOCS}) WHERE list_contains(w, 'the') AND len(list_filter(w, lambda x: starts_with(x, 'idi'))) > 0")
def search_prefix(spark, d):
    return _found(documents(spark, d), TextSearch("text", "the idi").prefix())


@query(f"SELECT id FROM ({_DOCS}) WHERE len(list_filter(list_distinct(w), lambda x: damerau_levenshtein(x, 'idiot') <= 1)) > 0")
def search_fuzzy(spark, d):
    return _found(documents(spark, d), TextSearch("text", "idiot").fuzzy(1))


@query(f"SELECT id FROM ({_DOCS}) WHERE list_contains(w, 'the') AND lang = 'en' AND n_chars > 2000 ORDER BY n_chars DESC, id LIMIT 100")
def search_filter_sort(spark, d):
    request = Q("documents").search(TextSearch("text", "the")).filter(Filter().eq("/lang", "en").gt("/nChars", 2000)).sort_desc("/nChars").limit(100)
    return ex.rows(documents(spark, d), request).select("id")


@query(f"SELECT role, count(*) AS n FROM ({_CONV}) WHERE list_contains(w, 'the') GROUP BY 1")
def search_aggregate(spark, d):
    request = Q("conversations").search(TextSearch("text", "the")).group_by(["/role"]).aggregate("n", A.count())
    return grouped(conversations(spark, d), request, role="/role")


@query(
    f"""WITH d AS ({_CONV}), s AS (SELECT count(*) AS n, sum(len(w)) AS total FROM d),
    f AS (SELECT id, len(w) AS size, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'of')) AS b FROM d),
    g AS (SELECT *, (SELECT ln(1 + (s.n - count(*) + 0.5) / (count(*) + 0.5)) FROM f WHERE a > 0) AS ia, (SELECT ln(1 + (s.n - count(*) + 0.5) / (count(*) + 0.5)) FROM f WHERE b > 0) AS ib,
      1.2 * (0.25 + 0.75 * size / (s.total / s.n)) AS norm FROM f, s)
    SELECT id, round(ia * 2.2 * a / (a + norm) + ib * 2.2 * b / (b + norm), 6) AS score FROM g WHERE a > 0 AND b > 0""".replace("(SELECT ln(1 + (s.n - count(*)", "(SELECT ln(1 + (max(s.n) - count(*)").replace("FROM f WHERE a > 0) AS ia", "FROM f, s WHERE a > 0) AS ia").replace("FROM f WHERE b > 0) AS ib", "FROM f, s WHERE b > 0) AS ib")
)
def bm25_rank(spark, d):
    df = ex.all_rows(conversations(spark, d), Q("conversations").search(TextSearch("text", "of the")))
    return df.select("id", F.round("score", 6).alias("score"))


# ------------------------------------------------------ constraints, ordered


@query("SELECT CAST(l_orderkey AS DECIMAL(38,0)) AS okey, CAST(l_linenumber AS DECIMAL(38,0)) AS line, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    from ..sources.constraints import violations

    s = lineitem(spark, d)
    index = next(i for i in s.definition.indexes if i.unique)
    return violations(s, index).select(F.col("`/order`").alias("okey"), F.col("`/no`").alias("line"), "n")


def _kv(spark, d) -> DataFrame:
    raw = t.read(spark, d, "orders")
    return raw.select(t.fixed_width("o_orderkey").cast("binary").alias("key"), F.concat_ws(":", "o_orderstatus", "o_custkey").cast("binary").alias("value"))


_KV = "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, o_orderstatus || ':' || o_custkey AS value FROM orders"


def _text(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"SELECT * FROM ({_KV}) WHERE key >= '000000000100' AND key < '000000000900' ORDER BY key LIMIT 64")
def kv_range_forward(spark, d):
    return _text(kv.forward(_kv(spark, d), b"000000000100", b"000000000900", 64))


@query(f"SELECT * FROM ({_KV}) WHERE key >= '000000000100' AND key < '000000000900' ORDER BY key DESC LIMIT 64")
def kv_range_reverse(spark, d):
    return _text(kv.reverse(_kv(spark, d), b"000000000100", b"000000000900", 64))


@query(f"SELECT * FROM ({_KV}) WHERE key = '000000000007'")
def kv_point_get(spark, d):
    return _text(kv.get(_kv(spark, d), b"000000000007"))


@query(f"SELECT * FROM ({_KV}) WHERE starts_with(key, '0000000001')")
def kv_prefix(spark, d):
    return _text(kv.with_prefix(_kv(spark, d), b"0000000001"))


@query(f"SELECT key, CASE WHEN CAST(key AS BIGINT) % 3 = 0 THEN 'new' ELSE value END AS value FROM ({_KV}) WHERE CAST(key AS BIGINT) % 5 <> 0")
def kv_merge_levels(spark, d):
    base = _kv(spark, d)
    n = F.col("key").cast("string").cast("long")
    newest = base.where(n % 5 == 0).select("key", F.lit(None).cast("binary").alias("value"))
    middle = base.where(n % 3 == 0).select("key", F.lit("new").cast("binary").alias("value"))
    return _text(kv.merged([newest, middle, base]))


# ------------------------------------------------------- writes, feed, archive


def _tenant(spark, name: str):
    from ..sources.scratch import shared_folder
    from ..sources.store import Tenant

    tenant = Tenant(spark, shared_folder(spark, name))
    declared = [_index(IndexField("/type")), _index(IndexField("/user", "number", 0))]
    tenant.activate([CollectionDefinition("events", declared), CollectionDefinition("other", declared, write_mode="append_only", archivable=True)])
    return tenant


def _bodies(spark, d) -> DataFrame:
    """(id, body text) of all events."""
    body = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")))
    return t.read(spark, d, "events").select(t.fixed_width("event_id").alias("id"), body.alias("body"))


_EVENTS = f"SELECT {_EID}, event_type AS type, CAST(user_id AS DECIMAL(38,0)) AS user, event_id FROM events"


@query(
    f"""SELECT id, CASE WHEN event_id IN (1, 2) THEN 'patched' ELSE type END AS type, CASE WHEN event_id = 2 THEN NULL ELSE "user" END AS "user" FROM ({_EVENTS}) WHERE event_id NOT IN (3, 4)
    UNION ALL SELECT 'new', 'put', CAST(7 AS DECIMAL(38,0))"""
)
def write_put_patch_delete(spark, d):
    from ..sources.store import Batch

    tenant = _tenant(spark, "writes")
    tenant.load("events", _bodies(spark, d))
    batch = Batch("once").put("events", "new", {"type": "put", "user": 7}, "absent").patch("events", "000000000001", {"type": "patched"}).patch("events", "000000000002", {"type": "patched", "user": None})
    batch = batch.delete("events", "000000000003").delete("events", "000000000004")
    tenant.mutate(batch)
    tenant.mutate(batch)  # a retry changes nothing
    s = tenant.collection("events")
    return flat(s, s.df, type="/type", user="/user")


@query(f"""SELECT id, "user" FROM ({_EVENTS}) QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY id) = 1""")
def load_unique_rejected(spark, d):
    """A bulk load that breaks a unique index is refused whole; one that keeps it is taken."""
    from ..plans.errors import EngineError
    from ..sources.store import Tenant
    from ..sources.scratch import shared_folder

    tenant = Tenant(spark, shared_folder(spark, "unique"))
    tenant.activate([CollectionDefinition("first", [Index("user", (IndexField("/user", "number", 0),), unique=True)])])
    bodies = _bodies(spark, d)
    try:
        tenant.load("first", bodies)
        raise AssertionError("equal keys were loaded")
    except EngineError as refused:
        if refused.code != "UNIQUE_VIOLATION":
            raise
    first = bodies.groupBy(F.get_json_object("body", "$.user").alias("user")).agg(F.min_by("body", "id").alias("body"), F.min("id").alias("id"))
    tenant.load("first", first.select("id", "body"))
    s = tenant.collection("first")
    return flat(s, s.df, user="/user")


@query(f"""SELECT id, CASE WHEN event_id <= 600 THEN 'staged' ELSE type END AS type, "user" FROM ({_EVENTS}) WHERE event_id % 7 <> 0 OR event_id > 600""")
def staged_commit(spark, d):
    """Six hundred operations in chunks become visible in one commit."""
    tenant = _tenant(spark, "staged")
    tenant.load("events", _bodies(spark, d))
    before = tenant.collection("events").df.where("cast(id as int) <= 600").select("id").collect()
    name = tenant.begin()
    ops = [{"op": "delete", "collection": "events", "id": r["id"], "expected": "any"} if int(r["id"]) % 7 == 0 else {"op": "patch", "collection": "events", "id": r["id"], "patch": {"type": "staged"}, "expected": "any"} for r in before]
    for k in range(0, len(ops), 200):
        tenant.append(name, k // 200, ops[k : k + 200])
    tenant.finalize(name)
    s = tenant.collection("events")
    return flat(s, s.df, type="/type", user="/user")


@query(f"SELECT id FROM ({_CONV}) WHERE list_contains(w, 'the') AND id <> '000000000001-0000' UNION ALL SELECT 'new'")
def search_after_write(spark, d):
    """A search reads the stored text index that the load and the commits have written."""
    from ..sources.scratch import shared_folder
    from ..sources.store import Batch, Tenant

    tenant = Tenant(spark, shared_folder(spark, "searched"))
    tenant.activate([CollectionDefinition("notes", [Index("text", (IndexField("/text"),), text="unicode_v1")])])
    id = F.concat(t.fixed_width("conv_id"), F.lit("-"), t.fixed_width("turn", 4))
    tenant.load("notes", t.read(spark, d, "conversations").select(id.alias("id"), F.to_json(F.struct("text")).alias("body")))
    tenant.mutate(Batch("w").put("notes", "new", {"text": "over The hill"}).put("notes", "other", {"text": "under it"}).delete("notes", "000000000001-0000"))
    return _found(tenant.collection("notes"), TextSearch("text", "the"))


def _fed(spark, d):
    """A tenant whose feed has all events: those of odd users in one commit, then all others in another collection."""
    tenant = _tenant(spark, "feed")
    tenant.feed_events = 1 << 40
    tenant.feed_bytes = 1 << 50
    odd = t.read(spark, d, "events").where("user_id % 2 = 1").select(t.fixed_width("event_id").alias("id"))
    bodies = _bodies(spark, d)
    tenant.load("events", bodies.join(odd, "id", "left_semi"))
    tenant.load("other", bodies.join(odd, "id", "left_anti"))
    return tenant


_FED = f"""SELECT row_number() OVER (ORDER BY CASE WHEN user_id % 2 = 1 THEN 0 ELSE 1 END, event_id) AS sequence, {_EID},
  CASE WHEN user_id % 2 = 1 THEN 'events' ELSE 'other' END AS collection, count(*) OVER (PARTITION BY user_id % 2) AS commit_event_count FROM events"""


@query(f"SELECT sequence, id, collection, commit_event_count FROM ({_FED}) WHERE sequence > 100")
def feed_after(spark, d):
    from ..sources import feed

    return feed.table(_fed(spark, d), 100).select("sequence", "id", "collection", "commit_event_count")


@query(f"SELECT sequence, id FROM ({_FED}) WHERE collection = 'other'")
def feed_scope(spark, d):
    from ..sources import feed

    return feed.frame(_fed(spark, d), ["other"]).select("sequence", "id")


@query(f"SELECT sequence, id FROM ({_FED}) WHERE collection = 'events'")
def feed_stream(spark, d):
    from ..sources.scratch import shared_folder
    from ..streaming.feed import register

    register(spark)
    tenant = _fed(spark, d)
    out, state = shared_folder(spark, "stream"), shared_folder(spark, "stream-state")
    stream = spark.readStream.format("docquarry_feed").option("path", tenant.files.root).option("collections", "events").load()
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("sequence", "id")


@query(f"SELECT id, type FROM ({_EVENTS})")
def archive_union(spark, d):
    tenant = _tenant(spark, "archive")
    tenant.archive_documents = tenant.archive_bytes = 1 << 60
    revision = tenant.load("other", _bodies(spark, d))
    tenant.archive("all", "other", revision)
    s = tenant.collection("other", archived=True)
    return flat(s, s.df, type="/type")


@query(f"SELECT {_EID} FROM events")
def lease_scan_pages(spark, d):
    tenant = _tenant(spark, "lease")
    tenant.load("events", _bodies(spark, d))
    lease = tenant.lease()
    df = tenant.lease_frame(lease, "events").select("id")
    tenant.close(lease)
    return df


@query("SELECT CAST(o_orderkey % 1000 AS BIGINT) AS key, max_by(o_custkey, o_orderkey) AS value FROM orders GROUP BY 1 HAVING max_by(o_orderstatus, o_orderkey) <> 'P'")
def kv_commit_log(spark, d):
    log = t.read(spark, d, "orders")
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string").cast("binary"))
    df = log.select(F.col("o_orderkey").alias("sequence"), F.lit(0).alias("ordinal"), (F.col("o_orderkey") % 1000).cast("string").cast("binary").alias("key"), value.alias("value"))
    return kv.commits(df).select(F.col("key").cast("string").cast("long").alias("key"), F.col("value").cast("string").cast("long").alias("value"))


@query(f"SELECT * FROM ({_KV}) ORDER BY key LIMIT 128")
def kv_sealed_run(spark, d):
    from ..sources.scratch import shared_folder

    path = shared_folder(spark, "run")
    root = kv.seal(_kv(spark, d), path, "zstd")
    return _text(kv.forward(kv.opened(spark, path, root), None, None, 128))
