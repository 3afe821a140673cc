"""Parser, builders and compiler (C1-C20), text analysis (B7)."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docloom.operators import search
from docloom.plans import dsl
from docloom.plans.ast import All, And, Cmp, Contains, HasWord, Ne, Not, Or, TokenPrefix
from docloom.plans.parser import QueryParseError, parse

ANIMALS = [("1", "zebra", "a stripy horse", 25), ("2", "aardvark", "eats ants", 500), ("3", "giraffe", "long neck", 100), ("4", "anteater", "a stupid looking animal", 50)]


@pytest.fixture(scope="module")
def animals(spark):
    return spark.createDataFrame(ANIMALS, "id string, name string, description string, number int")


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("*", "1234"), ('(= "name" "zebra")', "1"), ('(= :name "Zebra")', ""), ('(starts-with :name "zeb")', "1"), ('(starts-with :description "hor")', "1"),
        ('(has-word :description "horse")', "1"), ('(has-word :description "a")', ""), ('(has-word-starting-with :description "stup")', "4"),
        ("(= :number 50)", "4"), ('(= :number "50")', ""), ("(< :number 50)", "1"), ("(> :number 100)", "2"), ("(<= :number 25)", "1"), ("(>= :number 500)", "2"), ("(> :number 99.5)", "23"),
        ("(and)", ""), ("(or)", ""), ("(not)", "1234"), ('(not (= :missing "x"))', "1234"), ("(and (> :number 25) (not (> :number 100)))", "34"),
        ('(or (= :name "zebra") (= :number 50))', "14"), ('(not= :name "zebra")', "234"), ('(contains :description "ok")', "4"), ('(= :number 99999999999)', ""),
    ],
)
def test_c1_c20_filters(animals, text, ids):
    assert "".join(sorted(r.id for r in search.query(animals, text).collect())) == ids


@pytest.mark.parametrize("text", ["", "(", "(= :a)", "(= :a 1", "(<> :a 1)", '(< :a "1")', "(starts-with :a 5)", "(and 5)", "* *", '(= :a "")', ")"])
def test_c20_parse_errors(text):
    with pytest.raises(QueryParseError) as e:
        parse(text)
    assert e.value.position >= 0 and e.value.expected


def test_c11_collections_and_nested(spark):
    rows = [(1, ["one", "two", None], [(1, "x")], {"k": 5}), (2, ["two"], [(7, "y"), (8, "x")], {"k": 9}), (3, [], None, None)]
    df = spark.createDataFrame(rows, "id int, tags array<string>, parts array<struct<n:int,s:string>>, props struct<k:int>")

    def ids(text):
        return [r.id for r in search.query(df, text, id_col="id").collect()]

    assert ids('(= :tags "one")') == [1]
    assert ids('(not (= :tags "one"))') == [2, 3]
    assert ids('(= "parts$s" "x")') == [1, 2]
    assert ids("(> :parts$n 7)") == [2]
    assert ids("(< :props$k 6)") == [1]
    assert ids("(not (> :props$k 6))") == [1, 3]


def test_pushdown_and_top_k(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ANIMALS, "id string, name string, description string, number int").write.parquet(path)
    df = search.query(spark.read.parquet(path), '(and (= :name "zebra") (> :number 3))', id_col="id", sort_by="number", offset=1, amount=2).select("id", "number")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,zebra)" in plan and "GreaterThan(number,3)" in plan and "TakeOrderedAndProject" in plan and "description" not in plan


def test_g1_g5_order_and_pages(animals):
    def names(**options):
        return [r.name for r in search.query(animals, id_col="id", **options).collect()]

    assert names(sort_by="name") == ["aardvark", "anteater", "giraffe", "zebra"]
    assert names(sort_by=":name", sort_order="desc", amount=1) == ["zebra"]
    assert names(offset=3, amount=10) == ["anteater"]


def test_postings_agree_with_filters(spark, animals):
    post = search.postings(animals, "id", "name", "description")
    every = animals.select("id")
    for text in ('(has-word :description "horse")', '(and (has-word-starting-with :description "a") (not (has-word :description "ants")))', '(or (has-word :name "zebra") (has-word :name "giraffe"))', "(not)"):
        node = parse(text)
        assert {r.id for r in search.hits(post, node, every).collect()} == {r.id for r in search.query(animals, node).collect()}


field = st.sampled_from([":name", "name", ":number", ":description", ":gone", "odd name"])
leaf = st.one_of(
    st.just(All()), st.builds(Cmp, st.just("="), field, st.sampled_from(["zebra", 'a "b\\', 50, 2.5])), st.builds(Cmp, st.sampled_from(["<", ">", "<=", ">="]), field, st.integers(-5, 600)),
    st.builds(HasWord, field, st.sampled_from(["ants", "horse"])), st.builds(TokenPrefix, field, st.sampled_from(["a", "z"]), st.sampled_from(["starts-with", "has-word-starting-with"])),
    st.builds(Contains, field, st.just("e")), st.builds(Ne, field, st.just("zebra")),
)
tree = st.recursive(leaf, lambda x: st.one_of(*[st.builds(k, st.lists(x, max_size=3).map(tuple)) for k in (And, Or, Not)]), max_leaves=6)


@given(tree)
@settings(max_examples=200, deadline=None)
def test_text_round_trip(node):
    assert parse(dsl.to_text(node)) == node


def _plain(node, row):
    def value(f):
        return row.get(f.removeprefix(":"))

    def words(f):
        v = value(f)
        return [w for w in v.split() if w != "a"] if isinstance(v, str) else []

    match node:
        case All():
            return True
        case Cmp(op, f, x):
            v = value(f)
            if v is None or isinstance(v, str) != isinstance(x, str):
                return False
            return {"=": v == x}[op] if op == "=" else {"<": v < x, ">": v > x, "<=": v <= x, ">=": v >= x}[op]
        case HasWord(f, w):
            return w in words(f)
        case TokenPrefix(f, p, _):
            return any(w.startswith(p) for w in words(f))
        case Contains(f, p):
            return isinstance(value(f), str) and p in value(f)
        case Ne(f, x):
            return not _plain(Cmp("=", f, x), row)
        case And(args):
            return bool(args) and all(_plain(a, row) for a in args)
        case Or(args):
            return any(_plain(a, row) for a in args)
        case Not(args):
            return not any(_plain(a, row) for a in args)


@given(tree)
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random_filters_agree_with_plain_python(animals, node):
    want = {r[0] for r in ANIMALS if _plain(node, dict(zip(("id", "name", "description", "number"), r, strict=True)))}
    assert {r.id for r in search.query(animals, node).collect()} == want
