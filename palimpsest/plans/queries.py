"""Queries of the catalog's operators over whole tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..operators import annotate, canonical, diffing, facets, graph, search, versions
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# versions: customers' orders by year, events of users, turns of conversations

YEARLY = "select o_custkey as item, cast(year(o_orderdate) as bigint) as fork, max(o_orderpriority) as code from orders group by 1, 2"
FLAGGED = f"select *, lag(code) over (partition by item order by fork) as prev from ({YEARLY})"


def _yearly(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("item"), F.year("o_orderdate").cast("long").alias("fork")).agg(F.max("o_orderpriority").alias("code"))


def _log(s: SparkSession, d: str, value: str) -> DataFrame:
    """Events in one total order, cut by day so that a busy user's rows spread over tasks."""
    e = table(s, d, "events").select("user_id", "ts", "event_id", value)
    return e.withColumns({"at": F.struct("ts", "event_id"), "day": F.to_date("ts")})


@query(f"select fork, count(*) filter (where prev is null) as n_new, count(*) filter (where prev is not null and prev <> code) as n_modified, count(*) as n_total from ({FLAGGED}) group by 1")
def fork_summary(s, d):
    return versions.fork_summary(versions.change_flags(_yearly(s, d), ["item"], "fork", "code"), "fork")


@query(f"select item, fork, code, prev is null as is_new, coalesce(prev <> code, false) as is_modified from ({FLAGGED})")
def change_flags(s, d):
    return versions.change_flags(_yearly(s, d), ["item"], "fork", "code")


@query("select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) where p is null or p <> event_type")
def dedup_changes(s, d):
    return versions.dedup_changes(_log(s, d, "event_type"), ["user_id"], "at", "event_type", "day").select("user_id", "event_id", "event_type")


SPARSE = "case when event_type = 'purchase' then event_type || ':' || event_id end"


@query(f"select user_id, event_id, last_value({SPARSE} ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as carried from events")
def carry_forward(s, d):
    sparse = F.when(F.col("event_type") == "purchase", F.concat_ws(":", "event_type", "event_id"))
    return versions.carry_forward(_log(s, d, "event_type"), ["user_id"], "at", sparse, "carried", "day").select("user_id", "event_id", "carried")


@query(f"select user_id, event_id, last_value({SPARSE} ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from events")
def value_before(s, d):
    sparse = F.when(F.col("event_type") == "purchase", F.concat_ws(":", "event_type", "event_id"))
    return versions.value_before(_log(s, d, "event_type"), ["user_id"], "at", sparse, "before", "day").select("user_id", "event_id", "before")


@query("select conv_id, arg_max(turn, turn) as turn, arg_max(role, turn) as role, arg_max(text, turn) as text from conversations group by 1")
def latest_version(s, d):
    return versions.latest_version(table(s, d, "conversations"), ["conv_id"], F.col("turn")).select("conv_id", "turn", "role", "text")


@query("with p as (select user_id, max(ts) - interval 30 day as at from events group by 1) select p.user_id, arg_max(e.event_id, (e.ts, e.event_id)) as event_id from p left join events e on e.user_id = p.user_id and e.ts <= p.at group by 1")
def as_of_version(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id")
    probes = e.groupBy("user_id").agg((F.max("ts") - F.expr("interval 30 days")).alias("at"))
    return versions.as_of(probes, e, ["user_id"], "at", "ts", "event_id", "event_id_then", tie="event_id", bucket=F.to_date("at")).select("user_id", F.col("event_id_then").alias("event_id"))


@query(f"select item, min(fork) as introduced from ({YEARLY}) group by 1")
def introduced_at(s, d):
    return versions.introduced(_yearly(s, d), ["item"], "fork")


@query(f"select item, string_agg(cast(fork as varchar), ',' order by fork) as present_in from ({YEARLY}) group by 1")
def present_in(s, d):
    return versions.present_in(_yearly(s, d), ["item"], "fork")


@query(f"select item, string_agg(cast(fork as varchar), ',' order by fork) as modified_in from ({FLAGGED}) where prev <> code group by 1")
def modified_in(s, d):
    flagged = versions.change_flags(_yearly(s, d), ["item"], "fork", "code")
    return versions.present_in(flagged.filter("is_modified"), ["item"], "fork", name="modified_in")


@query(f"select item, fork, lag(fork) over (partition by item order by fork) as prev_shown from ({YEARLY}) where fork <> 1997")
def previous_shown(s, d):
    return versions.previous_shown(_yearly(s, d), ["item"], "fork", F.col("fork") != 1997, "prev_shown").select("item", "fork", "prev_shown")


@query(f"select item, fork, coalesce(code <> prev, false) as has_diff from ({FLAGGED})")
def signature_diff(s, d):
    return versions.has_diff(_yearly(s, d), ["item"], "fork", F.col("code")).select("item", "fork", "has_diff")


@query("select conv_id, count(*) as n_turns, max(turn) as last_turn, sum(len(string_split(text, chr(10)))) :: bigint as n_lines from conversations group by 1")
def item_lines(s, d):
    c = table(s, d, "conversations").withColumn("lines", F.size(F.split("text", "\n")))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max("turn").alias("last_turn"), F.sum("lines").alias("n_lines"))


# canonical sources: one text from several sources

@query("select md5(text) as item, arg_min(source, (cast(substr(source, 4) as int), source)) as canonical from documents group by 1")
def canonical_source(s, d):
    docs = table(s, d, "documents").withColumn("item", F.md5("text"))
    return canonical.canonical_source(docs, ["item"], "source", F.expr("try_cast(substring(source, 4) as int)"))


@query("select md5(text) as item, arg_min(doc_id, doc_id) as doc_id, arg_min(lang, doc_id) filter (where lang <> '') as lang, arg_min(source, doc_id) as source from documents group by 1")
def merge_sources(s, d):
    docs = table(s, d, "documents").withColumn("item", F.md5("text")).select("item", "doc_id", "lang", "source")
    return canonical.merge_sources(docs, ["item"], F.col("doc_id"), fill=["lang"], keep=["doc_id", "source"])


@query("select item, source, doc_id from (select md5(text) as item, source, doc_id, row_number() over (partition by md5(text), source order by doc_id) as n from documents) where n = 1")
def sources_distinct(s, d):
    docs = table(s, d, "documents").select(F.md5("text").alias("item"), "source", "doc_id")
    return canonical.sources_distinct(docs, ["item"], "source", F.col("doc_id"))


@query("with i as (select c_mktsegment as name, 'customer' as kind, min(c_custkey) as id from customer group by 1), x as (select p_type as name, 'part' as kind, p_partkey as id from part union all select c_mktsegment, 'part', c_custkey from customer) select * from i union all select name, kind, id from (select *, row_number() over (partition by name order by id) as n from x where name not in (select name from i)) where n = 1")
def collision_union(s, d):
    c, p = table(s, d, "customer"), table(s, d, "part")
    items = c.groupBy(F.col("c_mktsegment").alias("name")).agg(F.lit("customer").alias("kind"), F.min("c_custkey").alias("id"))
    extra = p.select(F.col("p_type").alias("name"), F.lit("part").alias("kind"), F.col("p_partkey").alias("id")).unionByName(c.select(F.col("c_mktsegment").alias("name"), F.lit("part").alias("kind"), F.col("c_custkey").alias("id")))
    return canonical.collision_union(items, extra, "name", F.col("id"))


@query("select page_id, case when contains(url, '/a') then 'a-pages' when contains(url, 'http') then 'web' end as spec from pages")
def contains_first(s, d):
    return canonical.contains_first(table(s, d, "pages").select("page_id", "url"), "url", {"/a": "a-pages", "http": "web"}, "spec").select("page_id", "spec")


# graph: capitalised names of documents as references, nations as specs

TOKENS = "select distinct source as spec, doc_id, lang as fork, unnest(regexp_extract_all(text, '[A-Z][a-zA-Z0-9_]+', 0)) as dst from documents"


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("source").alias("spec"), "doc_id", F.col("lang").alias("fork"), F.explode(text.type_tokens("text")).alias("dst"))


@query(f"with t as ({TOKENS}), b as (select spec, dst, min(fork) as f from t group by 1, 2), c as (select dst, min(spec) as spec from b group by 1) select b.spec as from_spec, b.dst as from_item, c.spec as to_spec, b.dst as to_type, string_agg(distinct t.fork, ',' order by t.fork) as forks from b join c on b.dst = c.dst and b.spec <> c.spec join t on t.spec = b.spec and t.dst = b.dst group by 1, 2, 3, 4")
def cross_refs(s, d):
    return graph.links_by_name(_tokens(s, d), "dst", "spec", "fork")


@query("select sn.n_name as source, cn.n_name as target, count(*) as n_links, sn.n_name || ' -> ' || cn.n_name as boundary from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey where sn.n_name <> cn.n_name group by 1, 2")
def boundary_map(s, d):
    n = table(s, d, "nation")
    sup = table(s, d, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source")), "s_nationkey").select("s_suppkey", "source")
    cus = table(s, d, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("target")), "c_nationkey").select("c_custkey", "target")
    o = table(s, d, "orders").join(cus, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "target")
    li = table(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.boundary_map(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("source", "target"), "source", "target")


@query(f"select dst, string_agg(distinct spec, ',' order by spec) as used_by, count(distinct spec) as n_users from ({TOKENS}) group by 1")
def reverse_refs(s, d):
    return graph.reverse_refs(_tokens(s, d), "spec", "dst")


@query("with v as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+', 0)) as token from benchmark), t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+', 0)) as token from documents) select doc_id, token from t where token in (select token from v)")
def vocab_refs(s, d):
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("token")
    vocabulary, tokens = table(s, d, "benchmark").select(words), table(s, d, "documents").select("doc_id", words)
    return graph.vocabulary_refs(tokens, vocabulary, "token")


EDGES = "select distinct s_name as src, p_brand as dst from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey"


def _edges(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_name").alias("src"), F.col("p_brand").alias("dst")).distinct()


@query(f"select src, dst, case when dst = 'Brand#11' then 'used_by' else 'uses' end as direction from ({EDGES}) where dst = 'Brand#11' or src = 'Brand#11'")
def trace(s, d):
    return graph.trace(_edges(s, d), "Brand#11", "src", "dst")


@query("select p_type as name, arg_min(p_brand, p_partkey) as spec from part where p_size > 10 group by 1")
def type_map(s, d):
    p = table(s, d, "part").withColumn("kind", F.when(F.col("p_size") > 10, "class").otherwise("other"))
    return graph.type_map(p.withColumnRenamed("p_type", "name"), "name", "p_brand", F.col("p_partkey"), ["class"])


# diffs and overlays

@query(f"with y as ({YEARLY}), a as (select * from y where fork = 1996), b as (select * from y where fork = 1997) select coalesce(a.item, b.item) as item, a.code as old_value, b.code as new_value, case when a.item is null then 'added' when b.item is null then 'removed' else 'modified' end as action from a full join b on a.item = b.item where a.code is distinct from b.code")
def snapshot_diff(s, d):
    y = _yearly(s, d)
    return diffing.snapshot_diff(y.filter("fork = 1996"), y.filter("fork = 1997"), ["item"], "code")


@query("""with f as (select l_orderkey as item, l_linenumber % 2 as side, 'p' || (l_partkey % 7) as name, max(cast(l_quantity as bigint)) :: varchar as type from lineitem group by 1, 2, 3), a as (select * from f where side = 0), b as (select * from f where side = 1),
j as (select coalesce(a.item, b.item) as item, coalesce(a.name, b.name) as name, case when a.name is null then 'a' when b.name is null then 'r' when a.type <> b.type then 'm' end as c from a full join b on a.item = b.item and a.name = b.name)
select item, coalesce(string_agg(name, ',' order by name) filter (where c = 'a'), '') as fields_added, coalesce(string_agg(name, ',' order by name) filter (where c = 'r'), '') as fields_removed, coalesce(string_agg(name, ',' order by name) filter (where c = 'm'), '') as fields_modified from j group by 1""")
def field_diff(s, d):
    f = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("item"), (F.col("l_linenumber") % 2).alias("side"), F.concat(F.lit("p"), F.col("l_partkey") % 7).alias("name")).agg(F.max(F.col("l_quantity").cast("long")).cast("string").alias("type"))
    one = F.struct("name", "type", F.lit("").alias("comment"))
    sides = f.groupBy("item").agg(F.collect_list(F.when(F.col("side") == 0, one)).alias("old"), F.collect_list(F.when(F.col("side") == 1, one)).alias("new"))
    out = diffing.field_diff(sides, "old", "new")
    return out.select("item", *[F.array_join(c, ",").alias(c) for c in ("fields_added", "fields_removed", "fields_modified")])


@query("select d.doc_id, coalesce(case when l.toxic = 1 then 'flagged' end, d.lang) as lang, l.doc_id is not null as overlaid from documents d left join labels l on d.doc_id = l.doc_id")
def overlay_resolve(s, d):
    overlay = table(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").alias("lang"))
    return diffing.overlay_resolve(table(s, d, "documents").select("doc_id", "lang"), overlay, ["doc_id"], ["lang"])


ACTIONS = "select o_custkey as pr, case o_orderstatus when 'O' then 'added' when 'F' then 'removed' else 'other' end as action from orders"


@query(f"select pr, count(*) filter (where action = 'added') as n_added, count(*) filter (where action = 'other') as n_modified, count(*) filter (where action = 'removed') as n_removed, count(*) as n_total from ({ACTIONS}) group by 1")
def overlay_list(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("pr"), F.when(F.col("o_orderstatus") == "O", "added").when(F.col("o_orderstatus") == "F", "removed").otherwise("other").alias("action"))
    return diffing.overlay_actions(o, "pr", "action")


@query("select conv_id, md5(text) as sha from conversations c where turn = 1 and not exists (select 1 from conversations o where o.turn = 0 and o.conv_id = c.conv_id and o.text = c.text)")
def stale_overlays(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.md5("text").alias("sha"))
    return diffing.stale(c.filter("turn = 1").drop("turn"), c.filter("turn = 0"), ["conv_id", "sha"])


@query("select distinct c_custkey as pr from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def closed_overlays(s, d):
    return diffing.closed(table(s, d, "customer").select(F.col("c_custkey").alias("pr")), table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("pr")), "pr").distinct()


@query(None)
def line_diff(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    before = versions.value_before(c, ["conv_id"], "turn", "text", "old")
    return before.select("conv_id", "turn", diffing.counted(diffing.line_diff("old", "text")).alias("x")).select("conv_id", "turn", "x.*")


# annotations

LINKS = "select distinct page_id, case when contains(url, 'https') then 'new' else 'modified' end as change, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as link from pages"


def _links(s: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(s, d, "pages").select("page_id", F.when(F.col("url").contains("https"), "new").otherwise("modified").alias("change"), F.explode(F.array_distinct(links)).alias("link"))


@query(LINKS)
def annotations(s, d):
    return _links(s, d)


@query("select distinct doc_id, regexp_extract(tag, '^.(New|Modified)', 1) as change, case when tag like '[New%' then 'v' || (doc_id % 3) else 'late' end as fork, unnest(regexp_extract_all(tag, 'EIP([0-9]+)', 1)) as number from (select doc_id, unnest(regexp_extract_all('[New in v' || (doc_id % 3) || ':EIP' || (doc_id % 50) || ':EIP' || (doc_id % 7) || '] [Modified in EIP' || (doc_id % 11) || ']', '\\[(?:New|Modified) in [^\\]]+\\]', 0)) as tag from documents)")
def tag_annotations(s, d):
    code = F.format_string("[New in v%d:EIP%d:EIP%d] [Modified in EIP%d]", F.col("doc_id") % 3, F.col("doc_id") % 50, F.col("doc_id") % 7, F.col("doc_id") % 11)
    rows = annotate.annotation_rows(table(s, d, "documents").select("doc_id", code.alias("code")), "code", ["doc_id"], F.lit("late"))
    return rows.select("doc_id", F.initcap("change").alias("change"), F.col("number").cast("string").alias("number"), F.col("tag_fork").alias("fork"))


@query("select p_brand as number, min(fork) as fork, count(*) filter (where change = 'new') as n_new, count(*) filter (where change = 'modified') as n_modified, count(*) as n_total, string_agg(distinct spec, ',' order by spec) as specs from (select p_brand, l_suppkey as item, l_returnflag as spec, case when l_discount < 0.05 then 'new' else 'modified' end as change, min(year(l_shipdate)) :: bigint as fork from lineitem join part on l_partkey = p_partkey group by 1, 2, 3, 4) group by 1")
def impact_index(s, d):
    li = table(s, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("spec"), F.when(F.col("l_discount") < 0.05, "new").otherwise("modified").alias("change"), F.year("l_shipdate").cast("long").alias("fork"))
    rows = li.join(table(s, d, "part").select("p_partkey", F.col("p_brand").alias("number")), F.col("l_partkey") == F.col("p_partkey"))
    return annotate.impact_index(rows, "number", "item", "spec", "change", F.col("fork"), "fork")


@query("select n_nationkey, n_name, r_name from nation left join (select * from region where r_regionkey < 3) on n_regionkey = r_regionkey")
def meta_enrich(s, d):
    n = table(s, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return annotate.enrich(n, table(s, d, "region").filter("r_regionkey < 3"), "r_regionkey").select("n_nationkey", "n_name", "r_name")


FIELDS = "select l_suppkey as item, l_returnflag as field, cast(year(l_shipdate) as bigint) as fork, max(l_linestatus || l_linenumber) as type from lineitem group by 1, 2, 3"


@query(f"select item, field, min(fork) as defined_at, arg_min(type, fork) as first_type, arg_max(type, fork) as latest_type, count(*) as n_versions from ({FIELDS}) group by 1, 2")
def field_index(s, d):
    f = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("field"), F.year("l_shipdate").cast("long").alias("fork")).agg(F.max(F.concat("l_linestatus", "l_linenumber")).alias("type"))
    return annotate.field_index(f, "item", "field", "fork", "type")


# search

@query("select p_partkey, p_name, p_brand from part where p_partkey = 42")
def lookup(s, d):
    return table(s, d, "part").filter("p_partkey = 42").select("p_partkey", "p_name", "p_brand")


@query(r"select p_partkey, replace(replace(lower(regexp_replace(p_type || '_' || upper(p_brand[1]) || 'xY', '([a-z])([A-Z])', '\1_\2', 'g')), '_', ''), '-', '') as normalized from part")
def normalize(s, d):
    mixed = F.concat("p_type", F.lit("_"), F.upper(F.substring("p_brand", 1, 1)), F.lit("xY"))
    return table(s, d, "part").select("p_partkey", text.normalize(mixed).alias("normalized"))


@query("select p_partkey, case when instr(lower(p_name), 'ed') > 0 then 200 - (instr(lower(p_name), 'ed') - 1) - abs(length(p_name) - 2) when regexp_matches(lower(p_name), 'e.*d') then 20 end :: bigint as score from part where regexp_matches(lower(p_name), 'e.*d')")
def substring_rank(s, d):
    return table(s, d, "part").select("p_partkey", fuzzy.match_score("p_name", "ed").alias("score")).filter("score IS NOT NULL")


@query("select p_partkey from part where regexp_matches(lower(p_name), 'a.*t.*e')")
def subsequence(s, d):
    return table(s, d, "part").filter(F.lower("p_name").rlike(fuzzy.subsequence_pattern("ate"))).select("p_partkey")


@query(None)
def fuzzy_score(s, d):
    return table(s, d, "part").select("p_partkey", fuzzy.fuzzy_score("p_name", "ate").alias("score")).filter("score IS NOT NULL")


@query("""with h as (select 'customer' as category, c_name as name from customer where contains(lower(c_name), '1') union all select 'supplier', s_name from supplier where contains(lower(s_name), '1') union all select 'part', p_name || '#' || p_partkey from part where contains(lower(p_name || '#' || p_partkey), '1'))
select category, name, rank, total_matched from (select *, row_number() over (partition by category order by name) as rank, count(*) over (partition by category) as total_matched from h) where rank <= 20""")
def search_union(s, d):
    part = table(s, d, "part").select(F.concat_ws("#", "p_name", "p_partkey").alias("p_name"))
    cats = {"customer": (table(s, d, "customer"), "c_name"), "supplier": (table(s, d, "supplier"), "s_name"), "part": (part, "p_name")}
    out = search.search_union({k: (df, n, search.matches([n], "1")) for k, (df, n) in cats.items()})
    return _long(out, "rank")


@query("select page_id, url from pages where contains(lower(url), 'page') or contains(replace(replace(lower(url), '_', ''), '-', ''), 'page')")
def endpoint_search(s, d):
    return table(s, d, "pages").filter(search.matches(["url"], "page", normalized=["url"])).select("page_id", "url")


@query("select lang, doc_id, n_chars, rank from (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents) where rank <= 3")
def topk_facet(s, d):
    top = search.top_per(table(s, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 3)
    return _long(top, "rank")


@query("select page_id, coalesce(nullif(regexp_extract(p, '/v[0-9]+/([^/]+)', 1), ''), nullif(regexp_extract(p, '^([A-Za-z]+)_', 1), ''), nullif(regexp_extract(p, '^/?([^/]+)', 1), ''), 'other') as grp from (select page_id, regexp_replace(url, '^https?://[^/]+', '') as p from pages)")
def path_group(s, d):
    return table(s, d, "pages").select("page_id", text.path_group(F.regexp_replace("url", "^https?://[^/]+", "")).alias("grp"))


@query("select name, score from (select distinct p_type as name, case when instr(lower(p_type), 'a') > 0 then 200 - (instr(lower(p_type), 'a') - 1) - abs(length(p_type) - 1) end :: bigint as score from part) where score is not null order by score desc, name desc limit 5")
def suggestions(s, d):
    return search.suggestions(table(s, d, "part").select(F.col("p_type").alias("name")), "name", "a")


@query("select doc_id, source, lang from documents where source in ('src0', 'src1') and lang = 'en'")
def faceted(s, d):
    return search.faceted(table(s, d, "documents").select("doc_id", "source", "lang"), source=["src0", "src1"], lang="en")


# facets

@query("select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' else 'total' end as facet, coalesce(lang, source) as value, count(*) as n from documents group by grouping sets ((lang), (source), ())")
def facet_counts(s, d):
    return facets.facet_counts(table(s, d, "documents"), ["source", "lang"])


@query("select p_brand, count(*) filter (where b = 'small') as n_small, count(*) filter (where b = 'large') as n_large, count(*) as n_total from (select p_brand, case when p_size < 25 then 'small' else 'large' end as b from part) group by 1")
def domains_pivot(s, d):
    return facets.pivot_counts(table(s, d, "part"), "p_brand", F.when(F.col("p_size") < 25, "small").otherwise("large"), ["small", "large"])


@query("select source, string_agg(distinct lang, ',' order by lang) as members, count(distinct lang) as n_members, count(*) as n_docs, cast(sum(n_chars) as bigint) as n_chars from documents group by 1")
def spec_summary(s, d):
    return facets.group_members(table(s, d, "documents"), "source", "lang", [F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars")])


@query("select distinct cast(year(o_orderdate) as bigint) as fork from orders order by fork")
def available(s, d):
    return table(s, d, "orders").select(F.year("o_orderdate").cast("long").alias("fork")).distinct().orderBy("fork")


@query("select cast(count(*) as bigint) as n_docs, cast(sum(len(regexp_extract_all(text, '[A-Z][a-zA-Z0-9_]+', 0))) as bigint) as n_refs, cast(sum(n_chars) as bigint) as n_chars from documents")
def meta_totals(s, d):
    refs = F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-zA-Z0-9_]+"), F.lit(0)))
    return facets.totals(table(s, d, "documents"), {"n_docs": F.lit(1), "n_refs": refs, "n_chars": F.col("n_chars")})


@query("select word as spec, count(*) as n from (select distinct p_partkey, unnest(string_split(p_name, ' ')) as word from part) group by 1")
def spec_counts(s, d):
    return facets.exploded_counts(table(s, d, "part").select(F.split("p_name", " ").alias("words")), "words", "spec")


@query("select cast(doc_id as varchar) as file, cast(len(string_split(text, chr(10))) as bigint) as n_lines from documents")
def file_lines(s, d):
    return facets.file_lines(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"), "file", "text")


@query("select event_id, cast(props->>'$.k' as bigint) as k from events")
def json_props(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select page_id, regexp_extract(url, '[?](.*)$', 1) as q, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as escaped, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') as safe from pages")
def url_text(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("url", "[?](.*)$", 1).alias("q"), text.escape_html("url").alias("escaped"), text.safe_id("url").alias("safe"))


@query("select p_partkey, regexp_replace(replace(replace(lower(p_name), '`', ''), ' ', '-'), '[^a-z0-9_-]', '', 'g') as anchor from part")
def anchors(s, d):
    return table(s, d, "part").select("p_partkey", text.anchor("p_name").alias("anchor"))


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, count(distinct user_id) as n_users from events group by 1, 2")
def event_hours(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


def queries() -> dict[str, Query]:
    from . import calls, made, stored  # noqa: F401  they add theirs

    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
