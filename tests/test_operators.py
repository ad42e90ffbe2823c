import json

from pyspark.sql import functions as F

from palimpsest.operators import canonical, diffing, graph, versions
from palimpsest.plans.catalog import Catalog, build_items
from palimpsest.sources import markdown, metadata, openapi, pysource
from palimpsest.streaming import incremental


def test_carry_forward_by_bucket_equals_plain(spark):
    rows = [(k, i, None if (i * 7 + k) % 3 else f"v{i}") for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, v string").withColumn("b", F.floor(F.col("i") / 7))
    for f in (versions.carry_forward, versions.value_before):
        plain = {(r.k, r.i): r.x for r in f(df, ["k"], "i", "v", "x").collect()}
        assert plain == {(r.k, r.i): r.x for r in f(df, ["k"], "i", "v", "x", "b").collect()}
    flags = lambda b: {(r.k, r.i): (r.is_new, r.is_modified) for r in versions.change_flags(df, ["k"], "i", "v", b).collect()}
    assert flags(None) == flags("b")


def test_empty_counts_as_missing_and_changes_restore_values(spark):
    df = spark.createDataFrame([("T", 0, "a"), ("T", 1, ""), ("T", 2, "a"), ("T", 3, "b"), ("T", 4, None)], "n string, s int, code string")
    full = {r.s: r.x for r in versions.carry_forward(df, ["n"], "s", "code", "x").collect()}
    assert full == {0: "a", 1: "a", 2: "a", 3: "b", 4: "b"}
    kept = versions.dedup_changes(df, ["n"], "s", "code")
    assert sorted(r.s for r in kept.collect()) == [0, 3]
    again = df.select("n", "s").join(kept, ["n", "s"], "left")
    assert full == {r.s: r.x for r in versions.carry_forward(again, ["n"], "s", "code", "x").collect()}


def test_canonical(spark):
    df = spark.createDataFrame([("X", "beacon-apis", ""), ("X", "consensus-specs", "c"), ("X", "aaa", "d"), ("Y", "bbb", None), ("Y", "aaa", "z")], "n string, s string, code string")
    has = F.coalesce(F.col("code") != "", F.lit(False))
    got = {r.n: r.canonical for r in canonical.canonical_source(df, ["n"], "s", canonical.priority_of(F.col("s")), has_code=has).collect()}
    assert got == {"X": "consensus-specs", "Y": "aaa"}
    assert canonical.canonical_source(df, ["n"], "s", F.lit(0), "first_with_code", has).filter("n = 'X'").first().canonical == "aaa"


def test_snapshot_diff_mirrors(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert diffing.snapshot_diff(a, a, ["k"], "v").isEmpty()
    there = {(r.k, r.action) for r in diffing.snapshot_diff(a, b, ["k"], "v").collect()}
    back = {(r.k, {"added": "removed", "removed": "added"}.get(r.action, r.action)) for r in diffing.snapshot_diff(b, a, ["k"], "v").collect()}
    assert there == back == {(1, "removed"), (2, "modified"), (4, "added")}


def test_cross_refs_skip_own_names(spark):
    edges = spark.createDataFrame([("api", "f", "v1", "State"), ("api", "f", "v2", "State"), ("api", "g", "v1", "Own"), ("core", "h", "v1", "State")], "spec string, src string, fork string, dst string")
    defined = spark.createDataFrame([("core", "State"), ("api", "Own"), ("core", "Own")], "spec string, name string")
    speaks = spark.createDataFrame([("State", "core"), ("Own", "core")], "name string, spec string")
    assert [tuple(r) for r in graph.cross_refs(edges, defined, speaks).collect()] == [("api", "f", "core", "State", "v1,v2")]


MD = """# Spec
## Custom types
| Name | SSZ equivalent | Description |
| - | - | - |
| `Slot` | `uint64` | a slot |
## Constants
### Misc
| Name | Value |
| - | - |
| `FAR_NAME` | `2**64 - 1` |
## Containers
### `State`
Some prose.
*[New in Electra:EIP1]*
```python
class State(Container):
    a: uint64
```
```python
def ignored(): pass
```
### Helpers
```python
@dataclass
class Box(object):
    b: int
```
```python
def f(x: State) -> Slot:
    return x
```
"""


def test_markdown(spark):
    got = markdown.extract(spark.createDataFrame([(MD, "v1", "a.md"), ("", "v1", "b.md"), (None, "v1", "c.md")], "content string, fork string, file string")).collect()
    assert [(r.row, r.name, r.kind) for r in got] == [("alias", "Slot", "alias"), ("constant", "FAR_NAME", "constant"), ("definition", "State", "class"), ("definition", "Box", "dataclass"), ("definition", "f", "def")]
    assert got[2].prose == "Some prose." and got[1].value == "2**64 - 1" and got[2].section_path == ["Spec", "Containers", "`State`"]


def test_markdown_of_very_many_blocks():
    import time

    n = 30_000
    text = "# T\n\n## Helpers\ntext\n" + "".join(f"```python\ndef f{i}(): pass\n```\n" for i in range(n))
    start = time.process_time()
    got = list(markdown.parse(text, "v1", "a.md"))
    assert [(r[3], r[11]) for r in got] == [(f"f{i}", 6 + 3 * i) for i in range(n)]
    assert time.process_time() - start < 5  # lines before each block were counted from the start: 30000 x 1 MB


def test_python_source(spark):
    source = 'from x import y\nLIMIT: int = 5\n"""Most of it."""\nAlias = y.Thing\n@dataclass\nclass A:\n    """Doc."""\n    f: int\n    """a field"""\ndef g(a: int, *, b=2) -> A:\n    """EIP-4844"""\ndef _p(): pass\n'
    got = pysource.extract(spark.createDataFrame([(source, "v1", "m.py"), ("def (", "v1", "broken.py"), (source, "v1", "utils/u.py")], "content string, fork string, file string")).collect()
    assert [(r.name, r.kind) for r in got] == [("LIMIT", "constant"), ("Alias", "alias"), ("A", "dataclass"), ("g", "def")]
    assert got[0].docstring == "Most of it." and got[2].fields[0].comment == "a field" and got[3].eips == [4844]


def test_python_source_is_split_once_and_cut_as_ast_cuts_it(monkeypatch):
    import ast

    source = 'A = 1; LIMIT: int = "é" ; B = x.y.z\r\nclass É(Base):\r    """ü"""\n    a: x.y[z]; b: Tuple[int, ...]\n    """é"""\n\x0c\nC = List[\n  "é",\n  b]\n'
    want = [ast.get_source_segment(source, n) for n in ast.parse(source).body]
    monkeypatch.setattr(ast, "get_source_segment", None)
    got = list(pysource.parse(source, "v1", "m.py"))
    assert [r[5] for r in got] == [want[0], want[1], want[2], "\n".join(source.split("\n")[2 - 1 : 5]), want[4]]
    assert [f["type"] for f in got[3][9]] == ["x.y[z]", "Tuple[int, ...]"] and got[4][8] == want[4][4:]
    assert list(pysource.parse(None, "v1", "m.py")) == []


def test_openapi(spark):
    root = {"paths": {"/eth/v1/x/{id}": {"get": {"operationId": "getX", "summary": "s", "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}], "responses": {"200": {"content": {"application/json": {"schema": {"anyOf": [{"$ref": "#/c/Bellatrix.Bid"}, {"$ref": "#/c/Deneb.Bid"}]}}, "application/octet-stream": {}}}, "404": {"description": "none"}}}}, "/y": {"$ref": "./y.yaml"}, "/z": {"$ref": "missing.yaml"}}}
    files = {"root.yaml": json.dumps(root), "y.yaml": "post:\n  operationId: postY\n  responses: {}\n"}
    df = spark.createDataFrame([("api", "root.yaml", "v1", files)], "spec string, root string, fork string, files map<string,string>")
    got = {r.key: r for r in openapi.extract(df).collect()}
    assert set(got) == {"GET /eth/v1/x/{id}", "POST /y"}
    x = got["GET /eth/v1/x/{id}"]
    assert x.ssz_support and x.fork_variants == {"bellatrix": "Bellatrix.Bid", "deneb": "Deneb.Bid"} and x.errors[0].code == "404"
    types = {"t.yaml": "components:\n  schemas:\n    BlockFulu:\n      allOf:\n        - $ref: '#/x/Base'\n        - properties: {a: {type: array, items: {type: string}}}\n          required: [a]\n"}
    t = openapi.extract(spark.createDataFrame([("api", "t.yaml", "v1", types)], df.schema), "types").first()
    assert t.name == "BlockFulu" and t.fields[0].type == "List[string]" and t.fields[0].required and t.references == ["Base"]
    methods = {"m.yaml": "- name: engine_newPayloadV2\n  params: [{name: p, required: true, schema: {type: array, items: {type: string}}}]\n  result: {schema: {oneOf: [{title: A}, {type: 'null'}]}}\n"}
    m = openapi.extract(spark.createDataFrame([("api", "m.yaml", "v1", methods)], df.schema), "methods").first()
    assert m.domain == "engine" and m.tags == ["shanghai"] and m.parameters[0].type == "Array[string]" and m.result_type == "A | null"


def test_json_is_read_as_yaml_reads_it(spark, monkeypatch):
    odd = ['{"a": 1e5, "b": 1.5e3, "c": 1.5e+3, "d": -0, "e": NaN}', '{"a"\n: 1}', '{"a" : "x?y", "a": {"<<": {"b": "\\/"}}}', '{"\\ud83d\\ude00": 1}', '{"a":\t1}', '{"' + "k" * 1100 + '": 1}', '{"a": "\x85"}', "[]", '["é", null, true, 12]', '{"a": 1} x', "a: [1, 2]\n"]
    import yaml

    for text in odd:
        try:
            want = yaml.safe_load(text) or {}
        except yaml.YAMLError:
            want = {}
        assert openapi.load(text) == want, text
    read = []
    monkeypatch.setattr(yaml, "safe_load", read.append)
    assert openapi.load('{"components": {"schemas": {"T": {"type": "string", "title": "is it?"}}}}')["components"] and not read


def test_yaml_is_read_as_pyyaml_reads_it(monkeypatch):
    import yaml

    odd = ["a:\t1", "a: {b: c?d}", "a: [x ?y]", "a: x?y\nb: [1]", "\n\ufeffa: 1", "a: \u2028\ufeffb", "%YAML 1.3\n---\na: 1", "é" * 1025 + ": 1", "a: &x {b: 1}\nc: {<<: *x}", "a: |\n  x?\n  [y]\n", "a: b: c", "a: '\x00'", ""]
    for text in odd:
        try:
            want = yaml.safe_load(text) or {}
        except yaml.YAMLError:
            want = {}
        assert openapi.load(text) == want, text
    read = []
    monkeypatch.setattr(yaml, "safe_load", read.append)
    assert openapi.load("- name: eth_get\n  summary: is it [a] name\n  params: []\n")[0]["params"] == [] and not read


def test_a_file_that_many_paths_refer_to_is_read_once(monkeypatch):
    read, load = [], openapi.load
    monkeypatch.setattr(openapi, "load", lambda t: read.append(t) or load(t))
    root = "paths:\n" + "".join(f"  /p{i}: {{$ref: all.yaml}}\n" for i in range(50)) + "  /none: {$ref: missing.yaml}\n"
    rows = list(openapi.parse({"root.yaml": root, "all.yaml": "get: {operationId: x}\nparameters: [{name: q, in: query}]\n"}, "root.yaml"))
    assert [r[0] for r in rows] == [f"GET /p{i}" for i in range(50)] and all(len(r[8]) == 1 for r in rows) and len(read) == 3


def test_type_versions_parse_once(spark):
    texts = {"v1": "{A: {type: string}, ~: {type: string}}", "v2": "{A: {type: string}, B: {type: string}}"}
    docs = spark.createDataFrame([("api", "t.yaml", fork, {"t.yaml": t}) for fork, t in texts.items()], "spec string, root string, fork string, files map<string,string>")
    rows = openapi.type_versions(openapi.extract(docs, "types").withColumn("seq", F.substring("fork", 2, 1).cast("int")), "seq")
    assert sorted((r.name, r.fork, r.is_new, r.is_modified) for r in rows.collect()) == [("A", "v1", True, False), ("A", "v2", False, True), ("B", "v2", True, False)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_narrow_rows_are_dealt_out(spark):
    from palimpsest.plans import made

    d = "/root/testdata/sf0.001"
    for df in (made._documents(spark, d, "t.yaml", t_yaml=made.SCHEMAS), made._files(spark, d, made.TABLES)):
        sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) >= 16 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_metadata(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(metadata.frontmatter("t").alias("m")).first().m
    assert one("---\neip: 1\ntitle: a: b\n---\nx: y") == {"eip": "1", "title": "a: b"} and one("no block") == {} and one("---\na: 1\n") == {}
    config = spark.createDataFrame([("ALTAIR_FORK_VERSION: 0x01000000",), ("DENEB_FORK_VERSION: 0x04000000",), ("other: 1",)], "line string")
    folders = spark.createDataFrame([("phase0",), ("deneb",), ("zeta",), ("_features",)], "fork string")
    assert [r.fork for r in metadata.forks_from_config(config, folders).orderBy("fork_seq").collect()] == ["phase0", "altair", "deneb", "zeta"]
    inits = spark.createDataFrame([("b", "ByBlockNumber(1_150_000)"), ("a", "ByBlockNumber(0)"), ("t", "ByTimestamp(5)"), ("m", ""), ("u", "Unscheduled(1)"), ("n", "Unscheduled()")], "fork string, init_text string")
    assert [r.fork for r in metadata.forks_from_criteria(inits).orderBy("fork_seq").collect()] == ["a", "b", "t", "n", "u", "m"]


def test_catalog(spark, tmp_path):
    files = spark.createDataFrame([(MD, "v1", "a.md"), (MD.replace("a: uint64", "a: uint64\n    c: Slot"), "v2", "a.md")], "content string, fork string, file string")
    forks = spark.createDataFrame([("v1", 0), ("v2", 1)], "fork string, fork_seq int")
    items = build_items(markdown.extract(files), forks, "core")
    cat = Catalog(spark, items)
    cat.save(str(tmp_path))
    cat.overlays = spark.createDataFrame([], "spec string, pr int, name string, action string")
    cat.save(str(tmp_path))  # a table without rows is none when it is read again
    cat = Catalog.load(spark, str(tmp_path))
    assert cat.overlays is None
    assert cat.list_specs().first().n_items == 3
    assert cat.lookup_type("State", "v1")["code"].endswith("a: uint64") and "f" in cat.lookup_type("State")["used_by"]
    assert cat.lookup_type("Stat")["suggestions"] == ["State"] and "available" in cat.lookup_type("State", "v9")
    d = cat.diff_type("State", "v1", "v2")
    assert d["fields_added"] == ["c"] and d["code_changed"] and "fields_removed" not in d
    assert {(r.section, r.name, r.change, r.number) for r in cat.what_changed("v2").collect()} == {("item", "State", "modified", None), ("total", None, None, 3)}
    assert cat.what_changed("nope")["available_forks"] == ["v1", "v2"] and "error" in cat.what_changed("pr-9") and "error" in cat.what_changed("pr-x")
    assert cat.lookup_endpoint("x").count() == cat.list_prs().count() == 0
    assert {r.name for r in cat.search("stat").collect()} == {"State"}
    assert {(r.section, r.spec, r.item, r.detail) for r in cat.trace_type("State").collect()} >= {("used_by", "core", "f", None), ("defined_in", "core", "class", "v1,v2"), ("canonical_source", "core", None, None)}
    built = items.filter("name = 'f'").withColumn("code", F.concat("code", F.lit("  # x")))
    over = cat.index_pr("core", 7, built.unionByName(items.filter("name <> 'f'")))
    cat.overlays = over
    assert {r.action for r in over.collect()} == {"modified"} and cat.lookup_type("f", "pr-7")["code_at"].endswith("# x")
    assert "error" in cat.lookup_type("f", "pr-8") and cat.lookup_type("State", "pr-7")["fork"] == "v2"
    assert cat.reindex({"core": lambda: items}, ["core", "nope"])[1] == {"core": "ok", "nope": "unknown spec"}


def test_priorities():
    assert canonical.PRIORITY == {"consensus-specs": 1, "execution-specs": 2, "builder-specs": 3, "relay-specs": 4, "beacon-APIs": 5, "execution-apis": 6, "remote-signing-api": 7}


def test_line_diff_of_long_texts():
    old = [f"line {i % 5000}" for i in range(6000)]
    new = [x for i, x in enumerate(old) if i % 7] + ["end"]
    ops = diffing.line_ops(old, new)
    assert sum(o["type"] == "equal" for o in ops) == sum(1 for i in range(6000) if i % 7)


def test_incremental_refresh(spark, tmp_path):
    src, target = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    def put(name, rows):
        (src / name).write_text("\n".join(json.dumps(r) for r in rows))
    def run():
        incremental.refresh(spark, str(src), "pr int, sha string, spec string", target, str(tmp_path / "cp"), ["pr"], "sha", "spec").awaitTermination()
        return sorted((r.pr, r.sha, r.spec) for r in spark.read.parquet(target).collect())
    put("a.json", [{"pr": 1, "sha": "x", "spec": "s"}, {"pr": 2, "sha": "y", "spec": "t"}])
    assert run() == [(1, "x", "s"), (2, "y", "t")]
    put("b.json", [{"pr": 1, "sha": "x", "spec": "s"}, {"pr": 1, "sha": "z", "spec": "s"}])
    assert run() == [(1, "z", "s"), (2, "y", "t")]  # an overlay is written anew by its pull request
    put("c.json", [{"pr": 2, "sha": "y", "spec": "t"}])
    assert run() == [(1, "z", "s"), (2, "y", "t")]


def test_lookup_of_an_item_with_very_many_versions_and_users(spark, tmp_path):
    n = 1100
    rows = [("a", "T", f"v{i}", i, f"class T:\n    x: uint{i}", []) for i in range(n)]
    rows += [("consensus-specs", "T", "w", n + 5, "class T:\n    y: int", []), ("consensus-specs", "T", "v3", 3, None, [])]
    rows += [("a", f"u{i:04}", "v0", 0, "T", ["T"]) for i in range(n)]
    spark.createDataFrame(rows, "spec string, name string, fork string, fork_seq int, code string, references array<string>").coalesce(1).write.parquet(str(tmp_path / "items"))
    cat = Catalog(spark, spark.read.parquet(str(tmp_path / "items")), priority={"consensus-specs": 0})
    last = cat.lookup_type("T", spec="a")
    assert last["fork"] == f"v{n - 1}" and len(last["versions"]) == n and last["used_by"] == [f"u{i:04}" for i in range(n)]
    assert cat.lookup_type("T")["fork"] == "w" and cat.lookup_type("T", f"v{n - 1}")["code_at"].endswith(f"uint{n - 1}")
    assert len(cat.lookup_type("T", "none")["available"]) == n + 1
    assert cat.diff_type("T", f"v{n - 2}", f"v{n - 1}")["fields_modified"] == ["x"]
