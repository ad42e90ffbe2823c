"""Queries of the ten calls, over a catalog that is made from the tables: a version of a type for some of the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, versions
from ..sources.tables import table
from .catalog import Catalog
from .queries import query

#: The catalog's versions as SQL: v has the rows, f their flags and carried code, e the edges.
VERSIONS = """with g as (select 's' || (p_size % 3) as spec, 'T' || (p_partkey % 40) as name, p_size % 4 as fork_seq, min(p_partkey) as k, 'v' || (p_size % 4) as fork from part group by all),
v as (select spec, name, fork, fork_seq, case when k % 2 = 0 then 'class' else 'def' end as kind, case when k % 3 <> 0 then 'c' || (k % 5) || case when k % 4 = 0 then ' # [New in v1:EIP' || (k % 7) || ']' when k % 4 = 1 then ' # [Modified in EIP' || (k % 6) || ']' else '' end end as code, 'T' || ((k * 7) % 50) as ref from g),
f as (select *, last_value(code ignore nulls) over (partition by spec, name order by fork_seq rows between unbounded preceding and current row) as code_at, row_number() over w = 1 as is_new, coalesce(lag(code) over w <> code, false) as plain, lag(code) over w is not null and (code is null or lag(code) over w <> code) as is_modified from v window w as (partition by spec, name order by fork_seq)),
e as (select spec, name as src, fork, ref as dst from v),
m as (select name, min(spec) as spec from v where kind = 'class' group by 1),
x as (select e.spec as from_spec, e.src as from_item, m.spec as to_spec, e.dst as to_type, string_agg(distinct e.fork, ',' order by e.fork) as forks from e join m on m.name = e.dst where e.spec <> m.spec and not exists (select 1 from v where v.spec = e.spec and v.name = e.dst) group by 1, 2, 3, 4),
u as (select 's' || (o_custkey % 3) as spec, (o_custkey % 20) :: int as pr, 'T' || (o_orderkey % 60) as name, 'v3' as fork, max(case o_orderstatus when 'O' then 'added' when 'F' then 'removed' else 'modified' end) as action, 'o' || max(o_orderkey) as code from orders group by 1, 2, 3),
q as (select distinct spec, pr as number, 'title ' || pr as title from u)
"""


def made(s: SparkSession, d: str) -> Catalog:
    p = table(s, d, "part")
    size = F.col("p_size")
    g = p.groupBy(F.concat(F.lit("s"), size % 3).alias("spec"), F.concat(F.lit("T"), F.col("p_partkey") % 40).alias("name"), (size % 4).alias("fork_seq")).agg(F.min("p_partkey").alias("k"))
    k = F.col("k")
    tag = F.when(k % 4 == 0, F.concat(F.lit(" # [New in v1:EIP"), k % 7, F.lit("]"))).when(k % 4 == 1, F.concat(F.lit(" # [Modified in EIP"), k % 6, F.lit("]"))).otherwise("")
    v = g.select(
        "spec", "name", "fork_seq", F.concat(F.lit("v"), "fork_seq").alias("fork"), F.when(k % 2 == 0, "class").otherwise("def").alias("kind"), F.lit("other").alias("domain"),
        F.when(k % 3 != 0, F.concat(F.lit("c"), k % 5, tag)).alias("code"), F.array(F.concat(F.lit("T"), (k * 7) % 50)).alias("references"),
    )
    items = versions.change_flags(v, ["spec", "name"], "fork_seq", "code")
    endpoints = table(s, d, "pages").select(F.concat(F.lit("s"), F.col("page_id") % 3).alias("spec"), F.concat(F.lit("GET "), "url").alias("key"), F.when(F.col("page_id") % 5 == 0, "RPC").otherwise("GET").alias("method"), F.col("url").alias("path"), F.concat(F.lit("getPage"), "page_id").alias("operation_id"), F.lit("a page").alias("summary"), F.array(F.concat(F.lit("v"), F.col("page_id") % 4)).alias("tags"), F.lit("web").alias("domain"), F.lit(False).alias("has_examples"))
    constants = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") % 3).alias("spec"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 4).cast("int").alias("fork_seq"), F.concat(F.lit("v"), F.col("s_suppkey") % 4).alias("fork"), F.when(F.col("s_suppkey") % 2 == 0, "alias").otherwise("constants").alias("category"))
    o = table(s, d, "orders").withColumn("a", F.when(F.col("o_orderstatus") == "O", "added").when(F.col("o_orderstatus") == "F", "removed").otherwise("modified"))
    overlays = o.groupBy(F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("spec"), (F.col("o_custkey") % 20).cast("int").alias("pr"), F.concat(F.lit("T"), F.col("o_orderkey") % 60).alias("name")).agg(F.lit("v3").alias("fork"), F.max("a").alias("action"), F.concat(F.lit("o"), F.max("o_orderkey")).alias("code"))
    prs = overlays.select("spec", F.col("pr").alias("number")).distinct().withColumn("title", F.concat(F.lit("title "), "number"))
    return Catalog(s, items, endpoints, constants, prs, overlays)


def _row(s: SparkSession, found: dict, columns: dict[str, str]) -> DataFrame:
    values = [",".join(found[c]) if isinstance(found.get(c), list) else found.get(c) for c in columns]
    return s.createDataFrame([values], ", ".join(f"`{c}` {t}" for c, t in columns.items()))


@query(VERSIONS + """select v.spec, count(distinct v.name) as n_items, string_agg(distinct v.fork, ',' order by v.fork) as forks, (select count(*) from pages where 's' || (page_id % 3) = v.spec) as n_endpoints, (select count(*) from supplier where 's' || (s_suppkey % 3) = v.spec) as n_constants from v group by v.spec""")
def list_specs(s, d):
    return made(s, d).list_specs()


SPEAKS = "(select min(spec) from f where name = 'T8' and code_at is not null)"


@query(VERSIONS + f"""select 'T8' as name, spec, fork, code_at, (select string_agg(distinct src, ',' order by src) from e where dst = 'T8') as used_by, (select string_agg(fork, ',' order by fork) from f where name = 'T8' and spec = {SPEAKS}) as versions from f where name = 'T8' and fork = 'v1' order by spec <> {SPEAKS}, spec limit 1""")
def lookup_type(s, d):
    return _row(s, made(s, d).lookup_type("T8", "v1"), {"name": "string", "spec": "string", "fork": "string", "code_at": "string", "used_by": "string", "versions": "string"})


@query(VERSIONS + """select name, code as code_at, pr, action, 'title ' || pr as title, true as overlaid from u where name = 'T8' order by pr, spec limit 1""")
def lookup_overlaid_type(s, d):
    """An item of an overlay at the virtual version of its pull request, with what is known of that."""
    cat = made(s, d)
    first = cat.overlays.filter("name = 'T8'").orderBy("pr", "spec").first()
    found = cat.lookup_type("T8", f"pr-{first['pr']}")
    return _row(s, found | {"title": found["pull_request"]["title"]}, {"name": "string", "code_at": "string", "pr": "int", "action": "string", "title": "string", "overlaid": "boolean"})


@query("select 'no item T9z' as error, (select string_agg(name, ',') from (select distinct 'T' || (p_partkey % 40) as name from part where false)) as suggestions")
def lookup_unknown_type(s, d):
    found = made(s, d).lookup_type("T9z")
    return _row(s, {"error": found["error"], "suggestions": ",".join(found.get("suggestions", [])) or None}, {"error": "string", "suggestions": "string"})


@query("select 's' || (page_id % 3) as spec, 'GET ' || url as key, case when page_id % 5 = 0 then 'RPC' else 'GET' end as method from pages where (contains(lower(url), 'page1') or contains('getpage' || page_id, 'page1') or contains(replace(replace(lower(url), '_', ''), '-', ''), 'page1')) and page_id % 5 <> 0")
def lookup_endpoint(s, d):
    return made(s, d).lookup_endpoint("page1", method="GET").select("spec", "key", "method")


@query(VERSIONS + """select spec, 'item' as section, name, case when is_new then 'new' else 'modified' end as change, null :: bigint as number from f where fork = 'v1' and (is_new or is_modified)
union all select distinct spec, 'eip', name, lower(regexp_extract(code, '(New|Modified) in', 1)), cast(regexp_extract(code, 'EIP([0-9]+)', 1) as bigint) from f where code like '%EIP%' and case when code like '%New in%' then 'v1' else fork end = 'v1'
union all select spec, 'total', null, null, count(distinct name) from f where fork = 'v1' group by 1
union all select 's' || (s_suppkey % 3), 'constant', s_name, 'new', null from supplier where s_suppkey % 4 = 1
union all select 's' || (page_id % 3), 'method', 'GET ' || url, 'new', null from pages where page_id % 5 = 0 and page_id % 4 = 1""")
def what_changed(s, d):
    return made(s, d).what_changed("v1")


@query("select 'nothing changed in v9' as error, 'v0,v1,v2,v3' as available_forks")
def what_changed_unknown(s, d):
    return _row(s, made(s, d).what_changed("v9"), {"error": "string", "available_forks": "string"})


@query(VERSIONS + "select spec, 'item' as section, name, action as change, null :: bigint as number from u where pr = 7")
def what_changed_in_overlay(s, d):
    return made(s, d).what_changed("pr-7")


@query(VERSIONS + """select 'defined_in' as section, spec, arg_min(kind, fork_seq) as item, string_agg(fork, ',' order by fork_seq) as detail from v where name = 'T14' group by spec
union all select distinct 'used_by', spec, src, null from e where dst = 'T14'
union all select 'cross_spec_refs', from_spec, from_item, to_spec || '/' || to_type from x where to_type = 'T14' or from_item = 'T14'
union all select 'canonical_source', spec, null, null from m where name = 'T14'""")
def trace_type(s, d):
    return made(s, d).trace_type("T14")


@query(VERSIONS + "select * from x")
def catalog_cross_refs(s, d):
    return made(s, d).cross_refs()


@query(VERSIONS + """, h as (select 'items' as category, name from (select distinct name from v) where contains(lower(name), 't1') union all select case when s_suppkey % 2 = 0 then 'aliases' else 'constants' end, s_name from supplier where contains(lower(s_name), 't1') union all select 'endpoints', 'GET ' || url from pages where contains(lower(url), 't1'))
select category, name, rank, total_matched from (select *, row_number() over (partition by category order by name) as rank, count(*) over (partition by category) as total_matched from h) where rank <= 5""")
def search_catalog(s, d):
    return made(s, d).search("t1", 5).withColumn("rank", F.col("rank").cast("long"))


@query(VERSIONS + f""", s as (select fork, coalesce(code_at, '') as code from f where name = 'T8' and spec = {SPEAKS})
select 'T8' as name, 'v0' as "from", 'v3' as "to", a.code <> b.code as code_changed, a.code as old_code, b.code as new_code from s a, s b where a.fork = 'v0' and b.fork = 'v3'""")
def diff_type(s, d):
    return _row(s, made(s, d).diff_type("T8", "v0", "v3"), {"name": "string", "from": "string", "to": "string", "code_changed": "boolean", "old_code": "string", "new_code": "string"})


@query(VERSIONS + "select spec, pr, count(*) as n_items, count(*) filter (where action = 'added') as n_added, count(*) filter (where action = 'modified') as n_modified, count(*) filter (where action = 'removed') as n_removed, 'title ' || pr as title from u where spec = 's1' group by 1, 2")
def list_prs(s, d):
    return made(s, d).list_prs("s1")


@query(VERSIONS + "select spec, pr, action, action as summary from u where name = 'T8'")
def prs_for_type(s, d):
    return made(s, d).prs_for("T8")


@query(VERSIONS + """, n as (select name, fork, case when fork_seq = 1 then 'changed' else code end as code from v where spec = 's1' and fork_seq <> 2 union all select 'New', 'v3', 'n')
select coalesce(a.name, b.name) as name, coalesce(a.fork, b.fork) as fork, 7 as pr, case when a.name is null then 'added' when b.name is null then 'removed' else 'modified' end as action, coalesce(b.code, a.code) as code, a.code as old_value from (select * from v where spec = 's1') a full join n b on a.name = b.name and a.fork = b.fork where a.name is null or b.name is null or coalesce(a.code, '') <> coalesce(b.code, '')""")
def index_pr(s, d):
    cat = made(s, d)
    own = cat.items.filter("spec = 's1' AND fork_seq <> 2")
    fresh = s.createDataFrame([("s1", "New", "v3", "n")], "spec string, name string, fork string, code string")
    built = own.withColumn("code", F.when(F.col("fork_seq") == 1, "changed").otherwise(F.col("code"))).unionByName(fresh, allowMissingColumns=True)
    return cat.index_pr("s1", 7, built).select("name", "fork", "pr", "action", "code", "old_value")


@query(VERSIONS + "select spec, count(*) as n, count(*) filter (where spec = 's1' and fork_seq = 0) as n_built, case when spec = 's1' then 'ok' end as report from v where spec <> 's1' or fork_seq = 0 group by 1")
def reindex(s, d):
    cat = made(s, d)
    after, report = cat.reindex({"s1": lambda: cat.items.filter("spec = 's1' AND fork_seq = 0")}, ["s1"])
    rows = after.items.groupBy("spec").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("spec") == "s1") & (F.col("fork_seq") == 0)).alias("n_built"))
    return rows.withColumn("report", F.when(F.col("spec") == "s1", report["s1"]))


@query(VERSIONS + """select from_spec || ' -> ' || to_spec as boundary, from_item as "from", to_type as "to", forks from x""")
def boundary_links(s, d):
    return graph.boundary_links(made(s, d).cross_refs())


@query(VERSIONS + """select spec, name, fork, code_at, plain from (select spec, name, fork, code_at, is_new as plain from f) where name like 'T1%'""")
def resolved_versions(s, d):
    """All versions of some items with the code that holds there, carried forward within their spec."""
    cat = made(s, d)
    rows = versions.carry_forward(cat.items.filter("name LIKE 'T1%'"), ["spec", "name"], "fork_seq", "code", "code_at")
    return rows.select("spec", "name", "fork", "code_at", F.col("is_new").alias("plain"))
