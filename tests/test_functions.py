import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import code, fuzzy, text
from palimpsest.operators.diffing import line_ops


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {v}" for k, v in zip(values, ["string"] * len(values), strict=True))) if values else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "old,new,types",
    [
        (["a", "b", "c"], ["a", "b", "c"], "equal equal equal"), ([], ["a", "b"], "add add"), (["a", "b"], [], "remove remove"), (["a", "b", "c"], ["a", "B", "c"], "equal change equal"),
        (["a", "c"], ["a", "b", "c"], "equal add equal"), (["a", "b", "c"], ["a", "c"], "equal remove equal"), (["  hello  "], ["hello"], "equal"), ([], [], ""), (["a", "b"], ["c", "d"], "change change"),
    ],
)
def test_line_ops(old, new, types):
    assert [o["type"] for o in line_ops(old, new)] == types.split()


@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
@settings(max_examples=80, deadline=None)
def test_line_ops_cover_both_sides(old, new):
    ops = line_ops(old, new)
    assert [o["old"] for o in ops if o["old"] is not None] == list(range(len(old)))
    assert [o["new"] for o in ops if o["new"] is not None] == list(range(len(new)))
    longest = max(n for n in range(len(old) + 1) if any(all(c in it for c in s) for s in itertools.combinations(old, n) for it in [iter(new)]))
    assert sum(o["type"] == "equal" for o in ops) == longest


def plain_score(target, query):
    """Every way to lay the query out in the target."""
    low, q, best = target.lower(), query.lower(), None
    for at in itertools.combinations(range(len(low)), len(q)):
        if any(low[i] != c for i, c in zip(at, q, strict=True)):
            continue
        total, run, next_ = 0.0, 0, 0
        for k, i in enumerate(at):
            on = i == next_ and run > 0
            run = run + 1 if on else int(k == 0)
            total += 1 + (6 * run if on else 0) + max(0, 10 - i) - (i - next_) * 0.5
            if i == 0 or low[i - 1] in "_-" or (target[i].isupper() and target[i - 1].islower()):
                total += 5
            next_ = i + 1
        best = total if best is None else max(best, total)
    return None if best is None else best - 0.6 * len(low)


@given(st.text("abA_", min_size=1, max_size=8), st.text("ab", min_size=1, max_size=3))
@settings(max_examples=150, deadline=None)
def test_alignment(target, query):
    got, want = fuzzy.best_alignment(target, query), plain_score(target, query)
    assert (got is None and want is None) or got == pytest.approx(want)


def test_fuzzy_score(spark):
    score = lambda t, q: one(spark, fuzzy.fuzzy_score("t", q), t=t)
    assert score("BeaconState", "BeaconState") > 9000
    assert score("BeaconState", "Beacon") > 9000
    assert score("BeaconState", "xyz") is None
    assert score("anything", "") == 0
    assert score("BeaconState", "bs") is not None and score("babysitter", "bs") is not None
    assert score("process_block", "proc") > score("preprocess_block", "proc")
    assert "<mark>" in one(spark, fuzzy.fuzzy_highlight("t", "bs"), t="BeaconState")
    assert one(spark, fuzzy.fuzzy_highlight("t", ""), t="test<>") == "test&lt;&gt;"


def test_text(spark):
    assert one(spark, text.url_params("h"), h="#/types?spec=consensus-specs&kind=class") == {"spec": "consensus-specs", "kind": "class"}
    for h in ("#/types", "", "?", "#/a?x=&=y"):
        assert one(spark, text.url_params("h"), h=h) == {}
    assert one(spark, text.url_params("h"), h="?q=hello%20world") == {"q": "hello world"}
    assert one(spark, text.escape_html("h"), h='<script>&"') == "&lt;script&gt;&amp;&quot;"
    assert one(spark, text.escape_html(F.lit(None).cast("string"))) == ""
    assert one(spark, text.safe_id("h"), h="foo.bar[0]") == "foo_bar_0_"
    assert one(spark, text.normalize("h"), h="getBlock_V2-x") == "getblockv2x"
    found = one(spark, text.annotations("h"), h="[New in Electra:EIP7002:EIP7251] [Modified in EIP7928] [New in Electra:EIP7002]")
    assert [(r["change"], r["number"]) for r in found] == [("new", 7002), ("new", 7251), ("modified", 7928)]
    assert one(spark, text.pull_number("h"), h="pr-12") == 12 and one(spark, text.pull_number("h"), h="deneb") is None
    assert one(spark, text.fork_from_suffix("h"), h="BlockRequestFulu") == "fulu" and one(spark, text.fork_from_suffix("h"), h="Attestation") == "phase0"
    assert one(spark, text.references("h"), h='def f(x: State):\n    """The Doc"""\n    return MAX_SIZE + Block(x)') == ["Block", "State"]
    assert one(spark, text.path_domain("h"), h="vm/instructions/arithmetic.py") == "vm-instructions"
    assert one(spark, text.path_domain("h"), h="vm/gas.py") == "vm-gas" and one(spark, text.path_domain("h"), h="__init__.py") == "fork-meta"
    status = lambda head, c, first=False: tuple(one(spark, text.change_status(F.lit(head), F.array(F.lit("Containers")), F.lit(c), F.lit(first))))
    assert status("`X`", "a # [Modified in Electra:EIP1]") == (False, True)
    assert status("Modified `X`", "a") == (False, True) and status("`X`", "a", True) == (True, False)


def test_code():
    got = code.parse_fields("class A(Container):\n    # [New in X]\n    a: uint64  # inline\n\n    b: List[X, N]\n    # lost\n\n    c: int\n    def f(self): pass\n    d: int")
    assert [(f["name"], f["type"], f["comment"]) for f in got] == [("a", "uint64", "[New in X]; inline"), ("b", "List[X, N]", ""), ("c", "int", "")]
    assert code.split_params("a: Dict[str, int], b=(1, 2), c") == ["a: Dict[str, int]", " b=(1, 2)", " c"]
    got = code.parse_signature('def f(a: int,\n      b: str = "x") -> bool:\n    """Doc."""\n    return True')
    assert got["return_type"] == "bool" and got["docstring"] == "Doc." and got["params"][1] == {"name": "b", "type": "str", "default": "'x'"}
    assert code.schema_type({"type": "array", "items": {"$ref": "#/c/Block"}}) == "List[Block]" and code.schema_type({"anyOf": [{"type": "string"}, {"$ref": "a/B"}]}) == "string | B"
