"""Registered queries of the relational operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewise.functions.predicates import group_function, row_function, value_function
from tuplewise.relation import DEE, DUM, Relation, is_relation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Callable[[Callable[[str], Relation]], Relation]], None]:
    """Registers ``body(tables)`` under ``name``; ``tables("orders")`` is a relation."""

    def register(body: Callable[[Callable[[str], Relation]], Relation]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return body(lambda t: Relation(spark.read.parquet(f"{sf_dir}/{t}.parquet"))).df

        QUERIES[name], SQL[name] = run, sql

    return register


def _money(value):
    """Money as a decimal, so that sums don't depend on their order."""
    return value.cast("decimal(18,2)")


def _total(attr: str):
    return lambda t: F.sum(_money(t[attr])).cast("double")


#: flagship: revenue by market segment, over two joins
def flagship(t: Callable[[str], Relation]) -> Relation:
    return (
        t("lineitem").join(t("orders"), {"l_orderkey": "o_orderkey"})
        .join(t("customer"), {"o_custkey": "c_custkey"})
        .summarize(["c_mktsegment"], {"n": "count", "revenue": _total("l_extendedprice"), "largest": {"op": "max", "attr": "l_extendedprice"}})
    )


_query("flagship", """
SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, max(l_extendedprice) AS largest
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")(flagship)

_AF = "SELECT * FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'"
_query("restrict", _AF)(lambda t: t("lineitem").restrict({"l_returnflag": "A", "l_linestatus": "F"}))
_query("where", "SELECT * FROM orders WHERE o_orderstatus = 'F'")(lambda t: t("orders").where({"o_orderstatus": "F"}))
_query("restrict_fn", "SELECT * FROM lineitem WHERE l_quantity > 45")(lambda t: t("lineitem").restrict(lambda r: r.l_quantity > 45))
_query("restrict_all", "SELECT * FROM nation")(lambda t: t("nation").restrict({}))
_query("restrict_other_type", "SELECT * FROM nation WHERE false")(lambda t: t("nation").restrict({"n_nationkey": "1"}))
_query("exclude", "SELECT * FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")(lambda t: t("customer").exclude({"c_mktsegment": "BUILDING"}))
_query("restrict_project", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")(
    lambda t: t("lineitem").restrict({"l_returnflag": "A"}).project(["l_orderkey", "l_suppkey"])
)
_query("project", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")(lambda t: t("orders").project(["o_orderstatus", "o_orderpriority", "no_such"]))
_query("allbut", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")(
    lambda t: t("orders").allbut(["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "no_such"])
)
_query("extend", "SELECT *, l_extendedprice * (1 - l_discount) AS net, l_shipdate AS shipped FROM lineitem")(
    lambda t: t("lineitem").extend({"net": lambda r: r.l_extendedprice * (1 - r.l_discount), "shipped": "l_shipdate"})
)
_query("constants", "SELECT * REPLACE ('x' AS n_name), 1 AS one FROM nation")(lambda t: t("nation").constants({"n_name": "x", "one": 1}))
_query("constants_nested", "SELECT r_regionkey, r_name, 'a' AS first, 2 AS size, 3 AS total FROM region")(
    lambda t: t("region").constants({"tag": {"name": "a"}, "parts": [{"x": 1}, {"x": 2, "y": None}]})
    .extend({"first": lambda r: r.tag["name"], "size": lambda r: F.size(r.parts), "total": lambda r: F.aggregate(r.parts, F.lit(0), lambda a, x: a + x["x"])})
    .allbut(["tag", "parts"])
)
_query("extend_python", "SELECT n_nationkey, n_name, n_regionkey, n_name || '/' || n_regionkey AS label FROM nation")(
    lambda t: t("nation").extend({"label": row_function("string")(lambda r: f"{r['n_name']}/{r['n_regionkey']}")})
)
_query("rename", "SELECT r_regionkey AS r_name, r_name AS r_regionkey FROM region")(lambda t: t("region").rename({"r_regionkey": "r_name", "r_name": "r_regionkey"}))
_query("rename_fn", "SELECT n_nationkey AS N_NATIONKEY, n_name AS N_NAME, n_regionkey AS N_REGIONKEY FROM nation")(lambda t: t("nation").rename(str.upper))
_query("prefix", "SELECT n_nationkey, n_name AS x_n_name, n_regionkey AS x_n_regionkey FROM nation")(lambda t: t("nation").prefix("x_", ["n_nationkey"]))
_query("suffix", "SELECT n_nationkey AS n_nationkey_x, n_name, n_regionkey AS n_regionkey_x FROM nation")(lambda t: t("nation").suffix("_x", ["n_name"]))
_query("transform_all", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")(lambda t: t("region").transform(lambda v: v.cast("string")))
_query("transform_chain", "SELECT upper(CAST(r_regionkey AS VARCHAR)) AS r_regionkey, upper(r_name) AS r_name FROM region")(
    lambda t: t("region").transform([lambda v: v.cast("string"), F.upper])
)
_query("transform_map", "SELECT n_nationkey, lower(trim(n_name)) AS n_name, n_regionkey FROM nation")(
    lambda t: t("nation").transform({"n_name": [F.trim, F.lower], "no_such": F.upper})
)

_query("transform_python", "SELECT n_nationkey, reverse(n_name) || '.' AS n_name, n_regionkey FROM nation")(
    lambda t: t("nation").transform({"n_name": [value_function("string")(lambda v: v[::-1]), lambda v: F.concat(v, F.lit("."))]})
)


def _buyers(t, low: int, high: int | None = None) -> Relation:
    return t("orders").restrict(lambda r: (r.o_totalprice > low) if high is None else (r.o_totalprice > low) & (r.o_totalprice < high)).project(["o_custkey"])


_LARGE, _MIDDLE = "SELECT o_custkey FROM orders WHERE o_totalprice > 250000", "SELECT o_custkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 300000"
for _name, _sql in (("union", "UNION"), ("minus", "EXCEPT"), ("intersect", "INTERSECT")):
    _query(_name, f"{_LARGE} {_sql} {_MIDDLE}")(lambda t, op=_name: getattr(_buyers(t, 250_000), op)(_buyers(t, 100_000, 300_000)))

_NATIONS = "SELECT n_nationkey AS nationkey, n_name, n_regionkey FROM nation"
_query("join_natural", f"SELECT s_suppkey, s_name, nationkey, n_name, s_acctbal, n_regionkey FROM (SELECT s_suppkey, s_name, s_nationkey AS nationkey, s_acctbal FROM supplier) JOIN ({_NATIONS}) USING (nationkey)")(
    lambda t: t("supplier").rename({"s_nationkey": "nationkey"}).join(t("nation").rename({"n_nationkey": "nationkey"}))
)
_query("join_keys_array", "SELECT s_suppkey, c_custkey, k FROM (SELECT s_suppkey, s_nationkey AS k FROM supplier) JOIN (SELECT c_custkey, c_nationkey AS k FROM customer) USING (k)")(
    lambda t: t("supplier").project(["s_suppkey", "s_nationkey"]).rename({"s_nationkey": "k"})
    .join(t("customer").project(["c_custkey", "c_nationkey"]).rename({"c_nationkey": "k"}), ["k"])
)
_query("join_keys_object", "SELECT o.*, c_name, c_nationkey, c_acctbal, c_mktsegment FROM orders o JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey")(
    lambda t: t("orders").join(t("customer"), {"o_custkey": "c_custkey"})
)
_query("join_clash", "SELECT n_nationkey, r_name AS name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda t: t("nation").rename({"n_name": "name"}).join(t("region").rename({"r_name": "name"}), {"n_regionkey": "r_regionkey"})
)
_query("join_no_keys", "SELECT * FROM region CROSS JOIN nation")(lambda t: t("region").join(t("nation"), []))
_query("cross_product", "SELECT DISTINCT r_name, n_name FROM region CROSS JOIN nation")(lambda t: t("region").project(["r_name"]).cross_product(t("nation").project(["n_name"])))
_query("cross_join", "SELECT DISTINCT r_name AS name, n_nationkey FROM region CROSS JOIN nation")(
    lambda t: t("region").project(["r_name"]).rename({"r_name": "name"}).cross_join(t("nation").project(["n_name", "n_nationkey"]).rename({"n_name": "name"}))
)
_BIG = "(SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000)"


def _big(t) -> Relation:
    return t("orders").restrict(lambda r: r.o_totalprice > 300_000).project(["o_custkey", "o_orderkey", "o_totalprice"])


_query("left_join", f"SELECT c.*, o_orderkey, o_totalprice FROM customer c LEFT JOIN {_BIG} ON c_custkey = o_custkey")(lambda t: t("customer").left_join(_big(t), {"c_custkey": "o_custkey"}))
_query("left_join_clash", f"SELECT c_custkey, o_totalprice AS amount, o_orderkey FROM customer LEFT JOIN {_BIG} ON c_custkey = o_custkey")(
    lambda t: t("customer").project(["c_custkey", "c_acctbal"]).rename({"c_acctbal": "amount"}).left_join(_big(t).rename({"o_totalprice": "amount"}), {"c_custkey": "o_custkey"})
)
_query("matching", f"SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM {_BIG} WHERE o_custkey = c_custkey)")(lambda t: t("customer").matching(_big(t), {"c_custkey": "o_custkey"}))
_query("not_matching", f"SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_BIG} WHERE o_custkey = c_custkey)")(lambda t: t("customer").not_matching(_big(t), {"c_custkey": "o_custkey"}))


def _flat(attr: str, field: str):
    """Size and sum of a nested relation, to compare flat rows."""
    def sums(r):
        return F.aggregate(r[attr], F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x[field].cast("decimal(18,2)")).cast("decimal(28,2)")).cast("double")

    return {"size": lambda r: F.size(r[attr]).cast("long"), "total": sums}


_query("image", f"SELECT c_custkey, count(o_orderkey) AS size, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS total FROM customer LEFT JOIN {_BIG} ON c_custkey = o_custkey GROUP BY c_custkey")(
    lambda t: t("customer").project(["c_custkey"]).image(_big(t), "orders", {"c_custkey": "o_custkey"}).extend(_flat("orders", "o_totalprice")).rename({}).project(["c_custkey", "size", "total"])
)
_query("image_rows", f"SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN {_BIG} ON c_custkey = o_custkey")(
    lambda t: t("customer").project(["c_custkey"]).image(_big(t), "orders", {"c_custkey": "o_custkey"}).ungroup("orders")
)
_query("group_rows", "SELECT n_regionkey, '[' || string_agg('{\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_name) || ']' AS nations FROM nation GROUP BY n_regionkey")(
    lambda t: t("nation").project(["n_regionkey", "n_name"]).group(["n_name"], "nations").transform({"nations": lambda v: F.to_json(F.sort_array(v))})
)
_GROUP = "SELECT o_custkey, count(*) AS size, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey"
_query("group", _GROUP)(
    lambda t: t("orders").group(["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "orders").extend(_flat("orders", "o_totalprice")).project(["o_custkey", "size", "total"])
)
_query("group_allbut", _GROUP)(lambda t: t("orders").group(["o_custkey"], "orders", allbut=True).extend(_flat("orders", "o_totalprice")).project(["o_custkey", "size", "total"]))
_query("ungroup", "SELECT * FROM orders")(lambda t: t("orders").group(["o_custkey"], "orders", allbut=True).ungroup("orders"))
_query("wrap", "SELECT c_custkey, c_name AS name, c_acctbal AS acctbal FROM customer")(
    lambda t: t("customer").wrap(["c_name", "c_acctbal"], "w").extend({"name": lambda r: r.w["c_name"], "acctbal": lambda r: r.w["c_acctbal"]}).project(["c_custkey", "name", "acctbal"])
)
_query("wrap_allbut", "SELECT c_custkey, c_mktsegment AS segment FROM customer")(
    lambda t: t("customer").wrap(["c_custkey"], "w", allbut=True).extend({"segment": lambda r: r.w["c_mktsegment"]}).project(["c_custkey", "segment"])
)
_query("unwrap", "SELECT * FROM customer")(lambda t: t("customer").wrap(["c_name", "c_acctbal"], "w").unwrap("w"))
_query("autowrap", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")(
    lambda t: t("nation").autowrap("_").extend({"id": lambda r: r.n["nationkey"], "name": lambda r: r.n["name"], "region": lambda r: r.n["regionkey"]}).project(["id", "name", "region"])
)
_BY = "l_returnflag, l_linestatus"
_FLAGS = ["l_returnflag", "l_linestatus"]
_query("summarize_count", f"SELECT {_BY}, count(*) AS n FROM lineitem GROUP BY {_BY}")(lambda t: t("lineitem").summarize(_FLAGS, {"n": "count"}))
_query("summarize_sum", f"SELECT {_BY}, sum(l_quantity) AS total FROM lineitem GROUP BY {_BY}")(lambda t: t("lineitem").summarize(_FLAGS, {"total": {"op": "sum", "attr": "l_quantity"}}))
_query("summarize_min_max", f"SELECT {_BY}, min(l_quantity) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY {_BY}")(
    lambda t: t("lineitem").summarize(_FLAGS, {"low": {"op": "min", "attr": "l_quantity"}, "high": {"op": "max", "attr": "l_extendedprice"}})
)
_query("summarize_avg", f"SELECT {_BY}, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY {_BY}")(
    lambda t: t("lineitem").summarize(_FLAGS, {"mean": {"op": "avg", "attr": "l_quantity"}}).transform({"mean": lambda v: F.round(v, 6)})
)
_query("summarize_collect", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")(
    lambda t: t("nation").summarize(["n_regionkey"], {"names": {"op": "collect", "attr": "n_name"}}).transform({"names": lambda v: F.array_join(F.sort_array(v), "|")})
)
_query("summarize_custom", "SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY c_mktsegment")(
    lambda t: t("customer").summarize(["c_mktsegment"], {"spread": lambda g: F.max(g.c_acctbal) - F.min(g.c_acctbal)})
)
_query("summarize_python", "SELECT n_regionkey, count(*) AS n, string_agg(n_name, '+' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey")(
    lambda t: t("nation").summarize(["n_regionkey"], {
        "n": "count", "names": group_function("string")(lambda rows: "+".join(r["n_name"] for r in sorted(rows, key=lambda r: -r["n_nationkey"]))),
    })
)
_query("cross_product_clash", "SELECT DISTINCT o_orderstatus, o_orderpriority, r_name FROM orders CROSS JOIN region")(
    lambda t: t("orders").rename({"o_orderkey": "r_regionkey"}).project(["o_orderstatus", "o_orderpriority"])
    .cross_product(t("region").extend({"o_orderstatus": lambda r: F.lit("?")}).project(["o_orderstatus", "r_name"]))
)
_query("summarize_total", "SELECT count(*) AS n FROM lineitem")(lambda t: t("lineitem").summarize([], {"n": "count"}))
_query("summarize_empty", "SELECT count(*) AS n FROM lineitem WHERE false HAVING count(*) > 0")(lambda t: t("lineitem").restrict(lambda r: F.lit(False)).summarize([], {"n": "count"}))
_LEFT = f"customer LEFT JOIN {_BIG} ON c_custkey = o_custkey"


def _left(t) -> Relation:
    return t("customer").left_join(_big(t), {"c_custkey": "o_custkey"})


_query("avg_null_as_zero", f"SELECT c_mktsegment, round(avg(coalesce(o_totalprice, 0)), 4) AS mean FROM {_LEFT} GROUP BY c_mktsegment")(
    lambda t: _left(t).summarize(["c_mktsegment"], {"mean": {"op": "avg", "attr": "o_totalprice"}}).transform({"mean": lambda v: F.round(v, 4)})
)
_query("sum_null_as_zero", f"SELECT c_nationkey, coalesce(sum(o_orderkey), 0)::BIGINT AS total FROM {_LEFT} GROUP BY c_nationkey")(
    lambda t: _left(t).summarize(["c_nationkey"], {"total": {"op": "sum", "attr": "o_orderkey"}})
)
_query("collect_nulls", f"SELECT c_nationkey, count(*) AS values, count(*) - count(o_orderkey) AS nulls FROM {_LEFT} GROUP BY c_nationkey")(
    lambda t: _left(t).summarize(["c_nationkey"], {"v": {"op": "collect", "attr": "o_orderkey"}})
    .extend({"values": lambda r: F.size(r.v).cast("long"), "nulls": lambda r: F.size(F.filter(r.v, lambda x: x.isNull())).cast("long")}).project(["c_nationkey", "values", "nulls"])
)
_query("dee", "SELECT 1 AS one, n_name FROM nation")(lambda t: DEE(t("nation").df.sparkSession).constants({"one": 1}).join(t("nation").project(["n_name"])))
_query("dum", "SELECT n_name FROM nation WHERE false")(lambda t: t("nation").project(["n_name"]).join(DUM(t("nation").df.sparkSession)))


def _rows(name: str, sql: str, body) -> None:
    """Registers a terminal, whose result becomes rows again."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return body(spark, lambda t: Relation(spark.read.parquet(f"{sf_dir}/{t}.parquet")))

    QUERIES[name], SQL[name] = run, sql


_rows("y_by_x", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS v FROM nation", lambda s, t: s.createDataFrame(list(t("nation").y_by_x("n_name", "n_nationkey").items()), "k string, v string"))
_rows("one", "SELECT * FROM region WHERE r_regionkey = 1", lambda s, t: s.createDataFrame([t("region").restrict({"r_regionkey": 1}).one()], "r_regionkey int, r_name string"))
_rows("is_equal", "SELECT true AS same, false AS other", lambda s, t: s.createDataFrame([(
    t("orders").is_equal(t("orders").group(["o_custkey"], "g", allbut=True).ungroup("g")), t("nation").is_equal(t("nation").restrict({"n_regionkey": 1})),
)], "same boolean, other boolean"))
_rows("to_array", "SELECT * FROM region", lambda s, t: s.createDataFrame(t("region").to_array(), "r_regionkey int, r_name string"))
_rows("to_text", "SELECT '| ' || lpad(CAST(r_regionkey AS VARCHAR), 11) || ' | ' || rpad(r_name, (SELECT greatest(max(length(r_name)), 6)::INT FROM region), ' ') || ' |' AS line FROM region".replace("11)", "11, ' ')"), lambda s, t: s.createDataFrame([(x,) for x in t("region").to_text().splitlines()[3:-1]], "line string"))
_rows("y_by_x_ordered", "SELECT CAST(n_regionkey AS VARCHAR) AS k, max_by(n_name, n_nationkey) AS v FROM nation GROUP BY n_regionkey", lambda s, t: s.createDataFrame(list(t("nation").y_by_x("n_name", "n_regionkey", "n_nationkey").items()), "k string, v string"))
_rows("iterate", "SELECT * FROM nation", lambda s, t: s.createDataFrame(list(t("nation")), "n_nationkey int, n_name string, n_regionkey int"))
_rows("to_relation", "SELECT DISTINCT n_regionkey FROM nation", lambda s, t: t("nation").to_relation().project(["n_regionkey"]).df)
_rows("is_relation", "SELECT true AS relation, false AS frame, false AS list", lambda s, t: s.createDataFrame([(is_relation(t("nation")), is_relation(t("nation").df), is_relation([]))], "relation boolean, frame boolean, list boolean"))


def _unknown(s: SparkSession, t: Callable[[str], Relation]) -> DataFrame:
    try:
        t("nation").summarize([], {"x": {"op": "median", "attr": "n_nationkey"}})
    except ValueError as e:
        return s.createDataFrame([(str(e),)], "message string")
    raise AssertionError("an unknown aggregator was accepted")


_rows("unknown_aggregator", "SELECT 'Unknown aggregator: median' AS message", _unknown)
_rows("of_rows", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey > 3 THEN n_regionkey END AS n_regionkey FROM nation", lambda s, t: Relation.of(
    [r if r["n_nationkey"] > 3 else {k: r[k] for k in ("n_nationkey", "n_name")} for r in t("nation").to_array()], "n_nationkey int, n_name string, n_regionkey int"
).df)


def _pushed(s: SparkSession, sf_dir: str) -> DataFrame:
    """A custom source's own restriction, over a keyed layout written to the warehouse."""
    import uuid

    from tuplewise.sources import read_keyed, write_keyed

    top = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/_keyed_{uuid.uuid4().hex}"
    write_keyed(Relation(s.read.parquet(f"{sf_dir}/customer.parquet")), path, "c_custkey", 8)
    return read_keyed(s, path, "c_custkey", 8).restrict({"c_custkey": 77}).df


QUERIES["source_pushdown"], SQL["source_pushdown"] = _pushed, "SELECT * FROM customer WHERE c_custkey = 77"
