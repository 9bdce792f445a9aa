from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import tuplewise as tw
from tuplewise import DEE, DUM, Relation

NAN = float("nan")
S = [
    {"sid": "S1", "name": "Smith", "status": 20, "city": "London"},
    {"sid": "S2", "name": "Jones", "status": 10, "city": "Paris"},
    {"sid": "S3", "name": "Blake", "status": 30, "city": "Paris"},
    {"sid": "S4", "name": "Clark", "status": 20, "city": "London"},
    {"sid": "S5", "name": "Adams", "status": 30, "city": "Athens"},
]
P = [{"pid": "P1", "city": "London"}, {"pid": "P2", "city": "Paris"}, {"pid": "P3", "city": "Oslo"}]
SP = [{"sid": "S1", "pid": "P1", "qty": 200}, {"sid": "S1", "pid": "P2", "qty": 100}, {"sid": "S2", "pid": "P1", "qty": 300}]


@pytest.fixture(scope="module")
def s(spark):
    return Relation.of(S)


def same(relation, rows):
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    got = relation.to_array() if isinstance(relation, Relation) else relation
    assert sorted(got, key=key) == sorted(rows, key=key)


def test_filters(s):
    same(s.restrict({"city": "Paris"}).project(["sid"]), [{"sid": "S2"}, {"sid": "S3"}])
    same(s.where(lambda t: t.status > 20).project(["sid"]), [{"sid": "S3"}, {"sid": "S5"}])
    same(s.exclude("status >= 20").project(["sid"]), [{"sid": "S2"}])
    same(s.restrict({}), S)
    same(s.restrict({"nope": 1}), [])
    same(s.restrict({"status": "20"}), [])
    same(s.restrict({"status": True}), [])
    same(s.restrict(lambda t: t.status - 20).project(["sid"]), [{"sid": "S2"}, {"sid": "S3"}, {"sid": "S5"}])  # truthiness
    with pytest.raises(ValueError, match="nope"):
        s.restrict(lambda t: t.nope == 1)


def test_exclude_keeps_unknown(spark):
    r = Relation.of([{"a": 1}, {"a": None}])
    same(r.exclude(lambda t: t.a == 1), [{"a": None}])
    same(r.restrict({"a": None}), [{"a": None}])


def test_projection_and_extension(s):
    same(s.project(["city", "nope"]), [{"city": c} for c in ("London", "Paris", "Athens")])
    same(s.allbut(["sid", "name", "status", "nope"]), [{"city": c} for c in ("London", "Paris", "Athens")])
    same(s.restrict({"sid": "S1"}).extend({"status": lambda t: t.status + 1, "old": "status", "k": lambda t: 7}).allbut(["name", "city"]), [{"sid": "S1", "status": 21, "old": 20, "k": 7}])
    same(s.restrict({"sid": "S1"}).constants({"city": "x"}).project(["city"]), [{"city": "x"}])
    with pytest.raises(ValueError):
        s.extend({"x": "nope"})


def test_row_function(s):
    @tw.row_function("string")
    def label(t):
        return f"{t['sid']}/{t['status']}"

    same(s.restrict({"sid": "S1"}).extend({"l": label}).project(["l"]), [{"l": "S1/20"}])


def test_renaming(spark):
    r = Relation.of([{"a": 1, "b": 2}])
    same(r.rename({"a": "b", "b": "a"}), [{"b": 1, "a": 2}])
    same(r.rename({"a": "b"}), [{"b": 2}])
    same(r.rename({"a": ""}), [{"a": 1, "b": 2}])
    same(r.rename(lambda n: n + n), [{"aa": 1, "bb": 2}])
    same(r.prefix("x.", ["a"]), [{"a": 1, "x.b": 2}])
    same(r.suffix("_y", except_=["b"]), [{"a_y": 1, "b": 2}])


def test_transform(spark):
    r = Relation.of([{"a": "x", "b": " y "}])
    same(r.transform(F.upper), [{"a": "X", "b": " Y "}])
    same(r.transform([F.trim, F.upper]), [{"a": "X", "b": "Y"}])
    same(r.transform([]), [{"a": "x", "b": " y "}])
    same(r.transform({"b": F.trim, "nope": F.upper}), [{"a": "x", "b": "y"}])


def test_set_operators(spark):
    a, b = Relation.of([{"i": 1, "n": "A"}, {"i": 2, "n": "B"}, {"i": 2, "n": "B"}]), Relation.of([{"n": "B", "i": 2}, {"n": "C", "i": 3}])
    same(a.union(b), [{"i": 1, "n": "A"}, {"i": 2, "n": "B"}, {"i": 3, "n": "C"}])
    same(a.minus(b), [{"i": 1, "n": "A"}])
    same(a.intersect(b), [{"i": 2, "n": "B"}])
    other = Relation.of([{"x": 1}])
    same(a.minus(other), [{"i": 1, "n": "A"}, {"i": 2, "n": "B"}])
    same(a.intersect(other), [])
    with pytest.raises(TypeError):
        a.union(Relation.of([{"i": "1", "n": "A"}]))


def test_nested_relations_are_bags(spark):
    kind = "k long, r array<struct<x:long>>"
    bag = lambda *xs: Relation.of([{"k": 1, "r": [{"x": x} for x in xs]}], kind)
    assert bag(1, 2).is_equal(bag(2, 1))
    assert not bag(1, 2).is_equal(bag(1, 2, 2))
    assert len(bag(1, 2).union(bag(2, 1)).to_array()) == 1


def test_joins(s):
    p = Relation.of(P)
    assert len(s.join(p).to_array()) == 4
    same(s.restrict({"sid": "S5"}).left_join(p).project(["sid", "pid"]), [{"sid": "S5", "pid": None}])
    same(s.matching(p, ["city"]).project(["sid"]), [{"sid": x} for x in ("S1", "S2", "S3", "S4")])
    same(s.not_matching(p).project(["sid"]), [{"sid": "S5"}])
    assert len(s.join(p, {}).to_array()) == 15
    assert len(s.join(s, ["sid"]).to_array()) == 5  # with itself
    with pytest.raises(ValueError):
        s.join(p, ["nope"])


def test_join_clashes(spark):
    a, b = Relation.of([{"k": 1, "c": "left"}, {"k": 2, "c": "left"}]), Relation.of([{"k": 1, "c": "right"}])
    same(a.join(b, ["k"]), [{"k": 1, "c": "right"}])
    same(a.left_join(b, ["k"]), [{"k": 1, "c": "right"}, {"k": 2, "c": None}])
    same(a.cross_product(b), [{"k": 1, "c": "left"}, {"k": 2, "c": "left"}])
    same(a.join(Relation.of([{"j": 1, "k": 9}]), {"k": "j"}), [{"k": 9, "c": "left"}])


def test_null_nan_and_type_of_keys(spark):
    a, b = Relation.of([{"k": None, "x": 1}, {"k": 1.0, "x": 2}, {"k": NAN, "x": 3}]), Relation.of([{"k": None, "y": 1}, {"k": NAN, "y": 2}])
    same(a.join(b).project(["x", "y"]), [{"x": 1, "y": 1}])
    same(a.matching(b).project(["x"]), [{"x": 1}, {"x": 3}])
    same(a.not_matching(b).project(["x"]), [{"x": 2}])
    same(Relation.of([{"k": 1}, {"k": None}]).join(Relation.of([{"k": "1", "z": 1}, {"k": None, "z": 2}]), ["k"]).project(["z"]), [{"z": 2}])
    assert len(Relation.of([{"k": NAN}, {"k": None}], "k double").project(["k"]).to_array()) == 1


def test_image(s):
    out = {r["sid"]: r["sp"] for r in s.image(Relation.of(SP), "sp", ["sid"]).to_array()}
    assert sorted(x["pid"] for x in out["S1"]) == ["P1", "P2"] and out["S5"] == [] and set(out["S2"][0]) == {"pid", "qty"}


def test_group_ungroup(spark):
    sp = Relation.of(SP)
    g = sp.group(["pid", "qty"], "items")
    assert {r["sid"]: len(r["items"]) for r in g.to_array()} == {"S1": 2, "S2": 1}
    assert g.ungroup("items").is_equal(sp) and sp.group(["sid"], "items", allbut=True).ungroup("items").is_equal(sp)
    same(Relation.of([{"x": 1, "r": [{"x": 5}]}, {"x": 2, "r": []}], "x long, r array<struct<x:long>>").ungroup("r"), [{"x": 5}])
    with pytest.raises(ValueError):
        sp.ungroup("qty")
    with pytest.raises(Exception, match="not a relation"):
        Relation.of([{"x": 1, "r": None}], "x long, r array<struct<y:long>>").ungroup("r").to_array()


def test_wrap_unwrap_autowrap(s):
    one = s.restrict({"sid": "S1"})
    w = one.wrap(["status", "city"], "d")
    same(w, [{"sid": "S1", "name": "Smith", "d": {"status": 20, "city": "London"}}])
    assert w.unwrap("d").is_equal(one) and one.wrap(["sid", "name"], "d", allbut=True).is_equal(w)
    with pytest.raises(ValueError):
        one.unwrap("sid")
    same(Relation.of([{"id": 1, "a_x": 1, "a_y_z": 2}]).autowrap(), [{"id": 1, "a": {"x": 1, "y_z": 2}}])
    same(Relation.of([{"a.x": 1}]).autowrap("."), [{"a": {"x": 1}}])
    with pytest.raises(ValueError):
        Relation.of([{"a": 1, "a_x": 1}]).autowrap()


def test_summarize(s):
    same(s.summarize(["city"], {"n": "count", "t": {"op": "sum", "attr": "status"}}), [{"city": "London", "n": 2, "t": 40}, {"city": "Paris", "n": 2, "t": 40}, {"city": "Athens", "n": 1, "t": 30}])
    same(s.summarize([], {"n": "count"}), [{"n": 5}])
    same(s.restrict({"sid": "no"}).summarize([], {"n": "count"}), [])
    same(s.summarize([], {"d": lambda g: F.max(g.status) - F.min(g.status)}), [{"d": 20}])
    with pytest.raises(ValueError, match="Unknown aggregator"):
        s.summarize([], {"x": "median"})


def test_aggregates_of_nulls(spark):
    r = Relation.of([{"g": "a", "v": 10.0}, {"g": "a", "v": None}, {"g": "b", "v": None}, {"g": "c", "v": NAN}, {"g": "c", "v": 4.0}])
    ops = {o: {"op": o, "attr": "v"} for o in ("sum", "min", "max", "avg", "collect")}
    out = {x["g"]: x for x in r.summarize(["g"], ops).to_array()}
    assert (out["a"]["sum"], out["a"]["avg"], out["a"]["min"]) == (10.0, 5.0, 10.0)
    assert (out["b"]["sum"], out["b"]["avg"], out["b"]["min"], out["b"]["collect"]) == (0.0, 0.0, None, [None])
    assert out["c"]["sum"] == out["c"]["avg"] == 4.0 and out["c"]["min"] != out["c"]["min"]


def test_terminals(s):
    assert s.restrict({"sid": "S1"}).one()["name"] == "Smith"
    with pytest.raises(ValueError, match="More than one"):
        s.one()
    with pytest.raises(ValueError, match="empty"):
        s.restrict({"sid": "x"}).one()
    assert s.y_by_x("name", "sid")["S2"] == "Jones"
    assert Relation.of([{"k": 1.0, "v": 1}, {"k": None, "v": 2}]).y_by_x("v", "k") == {"1": 1, "null": 2}
    assert s.is_equal(S + S[:1]) and not s.is_equal(S[:2]) and s.restrict({"sid": ""}).is_equal([])
    assert tw.is_relation(s) and not tw.is_relation(S)
    assert len(list(s)) == 5 and s.to_relation().is_equal(s)


def test_standalone_functions_mirror_the_operand(s):
    assert tw.project(S, ["sid"]) and isinstance(tw.project(S, ["sid"]), list)
    assert isinstance(tw.restrict(s, {}), Relation) and tw.restrict(s.df, {"sid": "S1"}).count() == 1
    assert len(tw.join(S, P)) == 4
    with pytest.raises(TypeError):
        tw.project(12, [])


def test_dee_and_dum(spark, s):
    dee, dum = DEE(spark), DUM(spark)
    n = lambda r: len(r.to_array())
    assert s.project([]).is_equal(dee) and n(dee.project([])) == 1 and n(dum.project([])) == 0
    assert s.join(dee).is_equal(s) and dee.join(s).is_equal(s) and n(s.join(dum)) == 0 and n(dee.join(dum)) == 0
    assert s.left_join(dum).is_equal(s) and s.left_join(dee).is_equal(s) and n(dum.left_join(s)) == 0
    assert s.matching(dee).is_equal(s) and n(s.matching(dum)) == 0 and n(s.not_matching(dee)) == 0 and s.not_matching(dum).is_equal(s)
    assert s.union(dum).is_equal(s) and n(dee.union(dee)) == 1
    assert [n(dee.minus(dee)), n(dee.minus(dum)), n(dum.minus(dum)), n(dee.intersect(dee)), n(dee.intersect(dum)), n(dum.intersect(dum))] == [0, 1, 0, 1, 0, 0]
    assert s.cross_product(dee).is_equal(s) and n(s.cross_product(dum)) == 0
    same(dee.summarize([], {"n": "count"}), [{"n": 1}])
    assert n(dum.summarize([], {"n": "count"})) == 0
    same(dee.extend({"x": lambda t: 1}), [{"x": 1}])
    same(dee.group([], "g"), [{"g": [{}]}])
    same(dee.wrap([], "w"), [{"w": {}}])
    same(s.restrict({"sid": "S1"}).project(["sid"]).image(dee, "i"), [{"sid": "S1", "i": [{}]}])
    assert dee.rename({}).is_equal(dee) and dee.transform([]).is_equal(dee) and dum.autowrap().is_equal(dum)


def test_laws(s):
    p = {"city": "Paris"}
    assert s.restrict(p).union(s.exclude(p)).is_equal(s)
    assert s.matching(P).union(s.not_matching(P)).is_equal(s)
    a, b = s.restrict(p), s.restrict(lambda t: t.status > 10)
    assert a.intersect(b).is_equal(b.intersect(a)) and a.minus(b).is_equal(a.minus(a.intersect(b)))


def test_plans_push_filters_and_need_no_python(spark):
    r = Relation(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")).restrict({"l_returnflag": "A"}).project(["l_orderkey"])
    plan = r.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_returnflag" in plan and "Python" not in plan and "l_comment" not in plan
    again = r.project(["l_orderkey"]).df._jdf.queryExecution().optimizedPlan().toString()
    assert again.count("Aggregate") == 1


def test_definitions():
    text = tw.definitions()
    assert "    def left_join(self, other: Operand, keys: Keys = None) -> Relation: ..." in text
    assert "def project(operand: Operand, attrs: Iterable[str]) -> Relation: ..." in text and "Aggregator = str | " in text


def test_python_functions_and_nested_constants(spark):
    s = Relation.of([{"k": "a", "v": 1}, {"k": "a", "v": None}, {"k": "b", "v": 3}])
    median = tw.group_function("double")(lambda rows: float(len([r for r in rows if r["v"] is not None])))
    assert s.summarize(["k"], {"m": median, "n": "count"}).is_equal([{"k": "a", "m": 1.0, "n": 2}, {"k": "b", "m": 1.0, "n": 1}])
    assert s.restrict({"k": "z"}).summarize([], {"m": median}).to_array() == []
    shown = tw.value_function("string")(lambda v: f"<{v}>")
    assert s.transform({"v": shown}).is_equal([{"k": "a", "v": "<1>"}, {"k": "a", "v": "<None>"}, {"k": "b", "v": "<3>"}])
    assert s.project(["k"]).transform([shown, shown]).is_equal([{"k": "<<a>>"}, {"k": "<<b>>"}])
    nested = s.restrict({"k": "b"}).constants({"t": {"x": 1, "y": [1, 2]}, "r": Relation.of([{"p": 1}, {"p": 2}])}).one()
    assert nested == {"k": "b", "v": 3, "t": {"x": 1, "y": [1, 2]}, "r": [{"p": 1}, {"p": 2}]}
    assert Relation.of([{"k": 1, "v": i, "at": -i} for i in range(5)]).y_by_x("v", "k", "at") == {"1": 0}


def test_products_look_for_duplicates_in_the_operands(spark):
    a, b = Relation.of([{"k": 1}, {"k": 1}, {"k": 2}]), Relation.of([{"k": 9, "c": "x"}, {"k": 8, "c": "x"}])
    out = a.cross_product(b)
    assert sorted(map(str, out.to_array())) == ["{'k': 1, 'c': 'x'}", "{'k': 2, 'c': 'x'}"]
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Cross") < plan.index("Aggregate")  # the join is above
    assert a.cross_product([{"k": 5}, {"k": 6}]).is_equal([{"k": 1}, {"k": 2}]) and a.project(["k"]).cross_product([]).to_array() == []
