"""The catalog's query API: tables in, DataFrames or small answers out.

Ten calls: list_specs, lookup_type, lookup_endpoint, what_changed, trace_type, search, diff_type, list_prs, index_pr,
reindex. An empty answer tells what there is instead. Virtual versions ``pr-N`` read the overlay first and fall back
to the latest mainline version; an unknown number is an error. Tables that a catalog lacks count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as code_functions
from ..functions import text
from ..functions.code import parse_fields
from ..operators import annotate, canonical, diffing, graph, search, versions
from ..sources.tables import has_rows, json_rows, write_by


EDGES = "spec string, src string, fork string, dst string"
OVERLAY = "spec string, pr int, name string, fork string, action string, code string, old_value string"
#: Kinds that a name's canonical source is chosen from.
TYPES = ["class", "dataclass"]


class Catalog:
    """Tables: versions (ITEM_VERSION), endpoints (ENDPOINT), constants, prs and overlays (spec, pr, name, fork, code, action)."""

    def __init__(self, spark: SparkSession, items: DataFrame, endpoints: DataFrame | None = None, constants: DataFrame | None = None, prs: DataFrame | None = None, overlays: DataFrame | None = None, priority: dict[str, int] = canonical.PRIORITY):
        self.spark, self.items, self.priority = spark, items, priority
        self.endpoints, self.constants, self.prs, self.overlays = endpoints, constants, prs, overlays
        self.edges = items.select("spec", F.col("name").alias("src"), "fork", F.explode("references").alias("dst")) if "references" in items.columns else self._none(EDGES)

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        def read(name: str) -> DataFrame | None:
            return spark.read.parquet(f"{path}/{name}") if has_rows(spark, f"{path}/{name}") else None

        items = read("items")
        if items is None:
            raise ValueError(f"no items under {path}")
        return cls(spark, items, *map(read, ("endpoints", "constants", "prs", "overlays")))

    def save(self, path: str) -> None:
        for name, df in (("items", self.items), ("endpoints", self.endpoints), ("constants", self.constants), ("prs", self.prs), ("overlays", self.overlays)):
            if df is not None:
                write_by(df, f"{path}/{name}", "spec")
        write_by(self.cross_refs(), f"{path}/cross_refs", "from_spec")

    def export(self, path: str) -> None:
        """Item versions as lines of JSON, without empty values."""
        json_rows(self.items).write.mode("overwrite").text(path)

    # what there is

    def list_specs(self) -> DataFrame:
        out = self.items.groupBy("spec").agg(F.count_distinct("name").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("fork_seq", "fork"))), lambda x: x["fork"]), ",").alias("forks"))
        for name, df in (("n_endpoints", self.endpoints), ("n_constants", self.constants)):
            if df is not None:
                out = out.join(df.groupBy("spec").agg(F.count(F.lit(1)).alias(name)), "spec", "left").fillna({name: 0})
        return out

    def list_prs(self, spec: str | None = None) -> DataFrame:
        """Overlays with their numbers of changed items and what is known of each pull request, newest first."""
        over = self._none(OVERLAY) if self.overlays is None else self.overlays
        rows = diffing.overlay_actions(over.withColumn("key", F.struct("spec", "pr")), "key", "action").select("key.*", F.col("n_total").alias("n_items"), "n_added", "n_modified", "n_removed")
        if self.prs is not None:
            rows = rows.join(self.prs.withColumnRenamed("number", "pr"), ["spec", "pr"], "left")
        return (rows.filter(F.col("spec") == spec) if spec else rows).orderBy(F.desc("pr"), "spec")

    def prs_for(self, name: str) -> DataFrame:
        """Pull requests that change an item, with the change in words."""
        over = self._none(OVERLAY) if self.overlays is None else self.overlays
        none = F.array().cast("array<string>")
        of = [F.col(c) if c in over.columns else none for c in ("fields_added", "fields_removed")]
        return over.filter(F.col("name") == name).select("spec", "pr", "action", diffing.change_summary(F.col("action"), *of).alias("summary"))

    # items

    def resolved(self, name: str, spec: str | None = None) -> DataFrame:
        """All versions of an item, each with the code that holds there; carried forward within its spec only."""
        rows = self.items.filter(F.col("name") == name)
        if spec:
            rows = rows.filter(F.col("spec") == spec)
        return versions.carry_forward(rows, ["spec", "name"], "fork_seq", "code", "code_at")

    def _speaks(self, rows: DataFrame) -> str | None:
        found = canonical.canonical_source(rows, ["name"], "spec", canonical.priority_of(F.col("spec"), self.priority), has_code=F.col("code_at").isNotNull()).first()
        return found["canonical"] if found else None

    def at(self, name: str, fork: str | None = None, spec: str | None = None) -> dict:
        """The item at a version, virtual ones included, as a dict; {"error": ...} with what there is otherwise."""
        rows = self.resolved(name, spec)
        number = int(fork[3:]) if fork and fork.startswith("pr-") and fork[3:].isdigit() else None
        if number is not None:
            if self.overlays is None or self.overlays.filter(F.col("pr") == number).isEmpty():
                return {"error": f"no overlay {fork}", "available": self._overlaid()}
            over = self.overlays.filter((F.col("pr") == number) & (F.col("name") == name)).orderBy("spec").first()
            if over:
                about = None if self.prs is None else self.prs.filter((F.col("number") == number) & (F.col("spec") == over["spec"])).first()
                return {**over.asDict(recursive=True), "code_at": over["code"], "overlaid": True} | ({"pull_request": about.asDict(recursive=True)} if about else {})
            fork = None
        got = rows.select("spec", "fork", "fork_seq").orderBy("fork_seq", "fork").collect()
        if not got:
            return {"error": f"no item {name}", "suggestions": [r["name"] for r in search.suggestions(self.items, "name", name).collect()]}
        speaks = spec or self._speaks(rows)
        own = F.col("spec").eqNullSafe(speaks)
        if fork is None:  # the latest of the source that speaks
            pick = rows.filter(own).orderBy(F.desc("fork_seq"), F.desc("fork")).first()
        else:
            pick = rows.filter(F.col("fork") == fork).orderBy(own.desc(), "fork_seq", "spec").first()
        if pick is None:
            return {"error": f"no version {fork} of {name}", "available": list(dict.fromkeys(r["fork"] for r in got))}
        return {**pick.asDict(recursive=True), "specs": sorted({r["spec"] for r in got}), "versions": [r["fork"] for r in got if r["spec"] == speaks]}

    def used_by(self, name: str) -> DataFrame:
        """Names of all items that refer to an item."""
        return self.edges.filter(F.col("dst") == name).select("src").distinct()

    def lookup_type(self, name: str, fork: str | None = None, spec: str | None = None) -> dict:
        out = self.at(name, fork, spec)
        if "error" not in out and self.edges is not None:
            out["used_by"] = [r["src"] for r in self.used_by(name).orderBy("src").collect()]
        return {k: v for k, v in out.items() if v or v is False or v == 0}

    def _overlaid(self) -> list[str]:
        return [] if self.overlays is None else [f"pr-{r['pr']}" for r in self.overlays.select("pr").distinct().orderBy("pr").collect()]

    def lookup_endpoint(self, query: str, group: str | None = None, method: str | None = None, domain: str | None = None) -> DataFrame:
        """Endpoints that have the query in path, operation, summary or a tag, of a group, method or domain if given."""
        shown = ["spec", "key", "method", "path", "operation_id", "summary", "has_examples"]
        if self.endpoints is None:
            return self._none(", ".join(f"{c} {'boolean' if c == 'has_examples' else 'string'}" for c in shown))
        hit = search.matches(["path", "operation_id", "summary"], query, normalized=["path", "operation_id"], arrays=["tags"])
        rows = self.endpoints.filter(hit)
        rows = rows if group is None else rows.filter(text.path_group("path") == group)
        return search.faceted(rows, method=method, domain=domain).select(shown)

    def what_changed(self, fork: str, spec: str | None = None) -> DataFrame | dict:
        """(spec, section, name, change, number) of a version, or {"error", "available_forks"} if it changed nothing.

        Sections are item, constant, method, eip (with its number) and total (the number of items there). A virtual
        version has the items of its overlay. An unknown spec counts as none given.
        """
        if fork.startswith("pr-"):
            over = None if self.overlays is None or not fork[3:].isdigit() else self.overlays.filter(F.col("pr") == int(fork[3:]))
            if over is None or over.isEmpty():
                return {"error": f"no overlay {fork}", "available_forks": self._overlaid()}
            section = F.when(F.col("kind") == "constant", "constant").otherwise("item") if "kind" in over.columns else F.lit("item")
            return over.select("spec", section.alias("section"), "name", F.col("action").alias("change"), F.lit(None).cast("long").alias("number"))
        rows = self.changes(fork, spec)
        if rows.isEmpty():
            return {"error": f"nothing changed in {fork}", "available_forks": [r["fork"] for r in self.items.select("fork").distinct().orderBy("fork").collect()]}
        return rows

    def changes(self, fork: str, spec: str | None = None) -> DataFrame:
        """What what_changed returns for a mainline version; no rows for an unknown one."""
        none, here = F.lit(None), F.col("fork") == fork

        def rows(df: DataFrame, section: str, name: Column, change: Column, number: Column) -> DataFrame:
            return df.select("spec", F.lit(section).alias("section"), name.cast("string").alias("name"), change.cast("string").alias("change"), number.cast("long").alias("number"))

        changed = self.items.filter(here & (F.col("is_new") | F.col("is_modified")))
        out = rows(changed, "item", F.col("name"), F.when(F.col("is_new"), "new").otherwise("modified"), none)
        tagged = annotate.annotation_rows(self.items, "code", ["spec", "name"], F.col("fork")).filter(F.col("tag_fork") == fork)
        out = out.union(rows(tagged, "eip", F.col("name"), F.col("change"), F.col("number")))
        out = out.union(rows(self.items.filter(here).groupBy("spec").agg(F.count_distinct("name").alias("n")), "total", none, none, F.col("n")))
        if self.constants is not None:
            first = self.constants.groupBy("spec", "name").agg(F.min_by("fork", "fork_seq").alias("fork")).filter(here)
            out = out.union(rows(first, "constant", F.col("name"), F.lit("new"), none))
        if self.endpoints is not None:
            out = out.union(rows(self.endpoints.filter((F.col("method") == "RPC") & F.array_contains("tags", fork)), "method", F.col("key"), F.lit("new"), none))
        known = spec is not None and not self.items.filter(F.col("spec") == spec).isEmpty()
        return out.filter(F.col("spec") == spec) if known else out

    def trace_type(self, name: str) -> DataFrame:
        """(section, spec, item, detail): where a type is defined, who uses it, links across specs, the spec that speaks for it."""
        def rows(df: DataFrame, section: str, item: Column, detail: Column) -> DataFrame:
            return df.select(F.lit(section).alias("section"), "spec", item.cast("string").alias("item"), detail.cast("string").alias("detail"))

        own = self.items.filter(F.col("name") == name)
        defined = versions.present_in(own, ["spec"], "fork_seq", F.col("fork")).join(own.groupBy("spec").agg(F.min_by("kind", "fork_seq").alias("kind")), "spec")
        used = self.edges.filter(F.col("dst") == name).select("spec", "src").distinct()
        links = self.cross_refs()
        links = links.filter(F.col("to_type") == name).union(links.filter((F.col("from_item") == name) & (F.col("to_type") != name))).withColumnRenamed("from_spec", "spec")
        speaks = self.type_map().filter(F.col("name") == name)
        return (
            rows(defined, "defined_in", F.col("kind"), F.col("present_in")).union(rows(used, "used_by", F.col("src"), F.lit(None)))
            .union(rows(links, "cross_spec_refs", F.col("from_item"), F.concat_ws("/", "to_spec", "to_type"))).union(rows(speaks, "canonical_source", F.lit(None), F.lit(None)))
        )

    def type_map(self) -> DataFrame:
        """(name, spec): the spec that speaks for each type."""
        return graph.type_map(self.items, "name", "spec", F.struct(canonical.priority_of(F.col("spec"), self.priority), "spec"), TYPES).select("name", "spec")

    def cross_refs(self) -> DataFrame:
        defined = self.items.select("spec", "name").distinct()
        return graph.cross_refs(self.edges, defined, self.type_map())

    def search(self, query: str, limit: int = 20) -> DataFrame:
        names = self.items.select("name", "domain").distinct()
        tables = {"items": (names, "name", search.matches(["name", "domain"], query, normalized=["name"]))}
        if self.constants is not None:
            aliases = self.constants.filter("category = 'alias'") if "category" in self.constants.columns else self.constants.limit(0)
            for kind, rows in (("constants", self.constants.join(aliases.select("name").distinct(), "name", "left_anti")), ("aliases", aliases)):
                tables[kind] = (rows.select("name").distinct(), "name", search.matches(["name"], query))
        if self.endpoints is not None:
            tables["endpoints"] = (self.endpoints, "key", search.matches(["path", "summary", "operation_id"], query))
        return search.search_union(tables, limit)

    def diff_type(self, name: str, from_fork: str, to_fork: str) -> dict:
        """Fields and lines that differ between two versions of an item."""
        a, b = self.at(name, from_fork), self.at(name, to_fork)
        for side in (a, b):
            if "error" in side:
                return side
        old, new = a.get("code_at") or "", b.get("code_at") or ""
        fields = [{f["name"]: f["type"] for f in side.get("fields") or parse_fields(c)} for side, c in ((a, old), (b, new))]
        changed = {
            "fields_added": sorted(fields[1].keys() - fields[0].keys()),
            "fields_removed": sorted(fields[0].keys() - fields[1].keys()),
            "fields_modified": sorted(k for k in fields[0].keys() & fields[1].keys() if fields[0][k] != fields[1][k]),
        }
        types = [{"name": k, "from_type": fields[0][k], "to_type": fields[1][k]} for k in changed["fields_modified"]]
        changed |= {"fields_changed": types, "from_url": a.get("github_url"), "to_url": b.get("github_url"), "spec": b.get("spec")}
        return {"name": name, "from": from_fork, "to": to_fork, "code_changed": old != new, "old_code": old, "new_code": new, "lines": diffing.line_ops(old.split("\n"), new.split("\n"))} | {k: v for k, v in changed.items() if v}

    # building

    def index_pr(self, spec: str, pr: int, built: DataFrame) -> DataFrame:
        """Overlay rows of one pull request: what differs between its items, built from its files, and the mainline's."""
        keys = ["name", "fork"]
        main, new = (df.filter(F.col("spec") == spec) for df in (self.items, built))
        given = [c for c in ("fields", "params") if c in main.columns and c in new.columns]
        none = F.expr(f"cast(array() AS {code_functions.FIELDS})")
        main, new = (df.select(*keys, "code", *[F.col(c) if c in given else none.alias(c) for c in ("fields", "params")]) for df in (main, new))
        diff = diffing.index_diff(main, new, keys)
        old = main.select(*keys, F.col("code").alias("old_value"))
        code = new.select(*keys, "code")
        rows = diff.drop("code").join(old, keys, "left").join(code, keys, "left")
        return rows.select(F.lit(spec).alias("spec"), F.lit(pr).alias("pr"), *keys, "action", F.coalesce("code", "old_value").alias("code"), "old_value", "fields_added", "fields_removed", "fields_modified", "code_changed", "params_changed")

    def reindex(self, builders: dict[str, Callable[[], DataFrame]], specs: list[str] | None = None) -> tuple[Catalog, dict[str, str]]:
        """A catalog with the named specs' items built anew, and what became of each spec."""
        report, fresh = {}, []
        for spec in specs or sorted(builders):
            if spec in builders:
                fresh.append(builders[spec]())
                report[spec] = "ok"
            else:
                report[spec] = "unknown spec"
        kept = self.items.filter(~F.col("spec").isin([s for s, r in report.items() if r == "ok"]))
        for df in fresh:
            kept = kept.unionByName(df, allowMissingColumns=True)
        return Catalog(self.spark, kept, self.endpoints, self.constants, self.prs, self.overlays, self.priority), report


def build_items(rows: DataFrame, forks: DataFrame, spec: str, file_rules: dict[str, str] | None = None, section_rules: dict[str, str] | None = None, base_url: str = "") -> DataFrame:
    """Extracted definitions (name, kind, fork, code, ...) as item versions: order, flags, domain, fields, signature, tags, link."""
    placed = rows.filter("row = 'definition'").join(F.broadcast(forks), "fork")  # a version axis has some tens of rows
    flagged = versions.change_flags(placed, ["name"], "fork_seq", "code")
    heading = F.coalesce(F.element_at("section_path", -1), F.lit("")) if "section_path" in rows.columns else F.lit("")
    sections = F.coalesce(F.col("section_path"), F.array()) if "section_path" in rows.columns else F.array().cast("array<string>")
    domain = text.section_domain("file", sections, file_rules or {}, section_rules or {}, "other") if section_rules or file_rules else text.path_domain("file") if "section_path" not in rows.columns else text.section_domain("file", sections, {"": ""}, {"": ""}, "other")
    status = text.change_status(heading, sections, F.coalesce("code", F.lit("")), F.col("is_new"))
    signature = code_functions.signature("code")
    more = {
        "spec": F.lit(spec), "references": text.references("code"), "domain": domain, "inline_comments": text.inline_comments("code"), "eips": text.annotations("code"),
        "marked_new": status["is_new"], "marked_modified": status["is_modified"], "github_url": text.source_url(F.lit(base_url), "file", anchor_=text.anchor(heading)),
    }
    return flagged.withColumns(more).withColumn("fields", code_functions.fields("code")).withColumn("__s", signature).withColumns({"params": F.col("__s.params"), "return_type": F.col("__s.return_type")}).drop("__s")
