"""Operators over several tables: matches, mappings, plans, queues, counts and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordforge.operators import aggregates, contained, diffs, filters, matching, queue, ranking, records, repair
from recordforge.plans import discovery, promotion
from recordforge.queries.catalog import NOW, biz, biz_sql, jobs, jobs_sql, joined, now, query, table

_BIZ = f"with biz as ({biz_sql()})"
_JOBS = f"with jobs as ({jobs_sql()})"


# ---- matches

@query(f"{_BIZ} select id, place_id in (select place_id from biz where id % 4 = 0 and place_id <> '') there from biz where place_id is not null and place_id <> '' union all select id, false from biz where place_id is null or place_id = ''")
def existing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = biz(spark, sf_dir).withColumn("place_id", F.nullif("place_id", F.lit("")))
    there, lacking = matching.existing(rows, rows.where("id % 4 = 0"), "place_id")
    return there.select("id", F.lit(True).alias("there")).unionByName(lacking.select("id", F.lit(False).alias("there")))


@query("with r as (select c_custkey id, lower(c_mktsegment) as n, case when c_custkey % 3 = 0 then '' else 'd' || c_nationkey end d from customer) select id, (select min(o.id) from r o where o.n = r.n and o.d = r.d and o.d <> '' and o.id <> r.id) parent_id from r")
def merge_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "case when c_custkey % 2 = 0 then upper(c_mktsegment) else concat(' ', lower(c_mktsegment)) end name", "case when c_custkey % 3 = 0 then '' else concat('d', c_nationkey) end domain")
    return matching.merge_parent(rows, rows).select("id", "parent_id")


@query("with m as (select c_custkey old_id, substr(sha256('n' || c_custkey), 1, 24) new_id from customer where c_custkey % 3 <> 0) select m.new_id as id, p.new_id parent, q.new_id friend, c_name from customer c join m on m.old_id = c.c_custkey left join m p on p.old_id = c.c_custkey // 2 left join m q on q.old_id = case when c.c_custkey % 5 = 0 then null else c.c_custkey + 1 end")
def remapped_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_custkey div 2 parent", "case when c_custkey % 5 = 0 then null else c_custkey + 1 end friend", "c_name")
    ids = rows.where("id % 3 <> 0").select(F.col("id").alias("old_id"), F.substring(F.sha2(F.concat(F.lit("n"), F.col("id")), 256), 1, 24).alias("new_id"))
    return matching.remap_tree(rows, ids, ["parent", "friend"])


@query("select s_suppkey, d <= 200 and sim >= 0.7 as confirmed, case when d <= 200 and sim >= 0.7 then 'confirmed' when d > 200 then 'too_far' else 'name_differs' end reason from (select s_suppkey, (s_suppkey * 37 % 400)::double d, s_suppkey % 10 / 10.0 sim from supplier)")
def match_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "cast(s_suppkey * 37 % 400 as double) d", "s_suppkey % 10 / 10 sim")
    return rows.withColumn("c", matching.confirm(F.col("d"), F.col("sim"))).select("s_suppkey", "c.*")


@query(f"{_JOBS}, w as (select distinct user_id business_id, t type from events, (values ('click'), ('view'), ('other')) x(t)) select * from w where not exists (select 1 from jobs j where j.business_id = w.business_id and j.type = w.type and j.status in ('pending', 'running') and j.id % 20 = 1)")
def not_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").select(F.col("user_id").alias("business_id"), F.explode(F.array(*map(F.lit, ("click", "view", "other")))).alias("type")).distinct()
    return queue.not_in_flight(wanted, jobs(spark, sf_dir).where("id % 20 = 1"))


@query("select o_orderkey id, p published_id, s session_id from (select *, row_number() over (partition by p order by o_orderkey) r from (select o_orderkey, o_custkey s, case when o_orderkey % 9 = 0 then null else o_orderkey // 3 end p from orders where o_custkey % 2 = 0) where p is not null) where r = 1")
def session_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", "case when o_orderkey % 9 = 0 then null else o_orderkey div 3 end published_id", "o_custkey session_id")
    return promotion.session_records(sessions, rows)


_REFS = "from (select c_custkey id, [c_nationkey, (c_nationkey + 7) % 30, c_nationkey] ids from customer)"


@query(f"""with e as (select id, unnest(ids) r, generate_subscripts(ids, 1) p {_REFS}), m as (select e.*, n_name as name, case when n_nationkey % 4 = 0 then null else 'T' || n_nationkey end new_id from e left join nation on n_nationkey = r),
g as (select id, coalesce(list(new_id order by p) filter (new_id is not null), []) n, coalesce(list(coalesce(name, r::varchar) order by p) filter (new_id is null), []) u from m group by 1)
select id, array_to_string(list_transform(list_filter(list_zip(n, range(1, 99)), lambda x: x[1] is not null and list_position(n, x[1]) = x[2]), lambda x: x[1]), ',') new_ids, array_to_string(u, ',') unresolved, len(u) > 0 any_unresolved from g""")
def taxonomy_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "transform(array(c_nationkey, (c_nationkey + 7) % 30, c_nationkey), x -> cast(x as string)) ids")
    nation = table(spark, sf_dir, "nation")
    source = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    target = nation.where("n_nationkey % 4 <> 0").select(F.concat(F.lit("T"), "n_nationkey").alias("id"), F.concat(F.lit(" "), F.lower("n_name")).alias("name"))
    out = matching.remap_by_name(rows, "ids", source, target)
    return out.select("id", joined("new_ids").alias("new_ids"), joined("unresolved").alias("unresolved"), "any_unresolved")


_USERS = "select s_suppkey user_id, 'u' || s_suppkey || '@x.org' email, s_suppkey % 3 = 0 is_seeder, 1000 - s_suppkey ordinal from supplier"


@query(f"""{_BIZ}, u as ({_USERS}), s as (select * from u where is_seeder), l as (select id, arg_min(email, ordinal * 100000 + user_id) email from (select c_custkey id, (c_custkey * k) % 37 + 1 uid from customer, (values (1), (3)) t(k) where c_custkey % 6 = 0) join s on s.user_id = uid group by 1),
x as (select biz.*, l.email le, a.email ae, c.email ce from biz left join l using (id) left join s a on a.user_id = biz.id % 50 left join s c on c.user_id = biz.id % 41)
select id, coalesce(le, ae, ce) seeder_email, concat_ws(',', case when is_crawler then 'crawler' end, case when is_cvb then 'cvb' end, case when coalesce(le, ae, ce) is not null then 'manual_seeder' end) sources, (coalesce(is_crawler, false) or coalesce(is_cvb, false)) and coalesce(le, ae, ce) is not null is_overlap, is_seeded is distinct from true is_net_new from x where coalesce(is_crawler, false) or coalesce(is_cvb, false) or coalesce(le, ae, ce) is not null""")
def provenance_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "supplier").selectExpr("s_suppkey user_id", "'u' || s_suppkey || '@x.org' email", "s_suppkey % 3 = 0 is_seeder", "1000 - s_suppkey ordinal")
    links = table(spark, sf_dir, "customer").where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("row_id"), F.explode(F.expr("array(c_custkey * 1 % 37 + 1, c_custkey * 3 % 37 + 1)")).alias("user_id"))
    rows = biz(spark, sf_dir).withColumns({"authorised_user": F.col("id") % 50, "creator": F.col("id") % 41})
    return matching.recompute_provenance(rows, users, links).withColumn("sources", joined("sources"))


@query("select c_custkey id from customer where c_nationkey || c_mktsegment in (select c_nationkey || c_mktsegment from customer group by 1 having count(*) > 1)")
def colliding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_nationkey || c_mktsegment k")
    return matching.shared_keys(rows, "k").select("id")


@query("with n as (select o_custkey k, count(*) n from orders where o_orderkey % 5 = 0 group by 1), v as (select o_custkey k, count(*) n from orders where o_orderkey % 7 = 0 group by 1) select c.c_custkey winner, c.c_custkey + 1 loser, concat_ws(',', case when coalesce(a.n, 0) > 0 and b.n is null then 'fives' end, case when coalesce(d.n, 0) > 0 and e.n is null then 'sevens' end) only_loser_has from customer c left join n a on a.k = c.c_custkey + 1 left join n b on b.k = c.c_custkey left join v d on d.k = c.c_custkey + 1 left join v e on e.k = c.c_custkey where c.c_custkey % 2 = 0")
def lost_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey winner", "c_custkey + 1 loser")
    children = lambda k: table(spark, sf_dir, "orders").where(f"o_orderkey % {k} = 0").select(F.col("o_custkey").alias("parent_id"))
    return matching.content_asymmetry(pairs, {"fives": children(5), "sevens": children(7)}).withColumn("only_loser_has", joined("only_loser_has"))


@query("select o_orderkey, o_custkey source_id, (select count(*) from orders where o_custkey % 4 = 0) missing from orders where o_custkey % 4 <> 0")
def rebuilt_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source_id"))
    found, missing = matching.rebuild_inputs(outcomes, table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("source_id"), "c_name"))
    return found.join(missing).select("o_orderkey", "source_id", "missing")


@query("select k as key, arg_max(n_nationkey, n_nationkey) as id from (select n_nationkey, unnest([lower(n_name), 'region ' || n_regionkey]) k from nation) group by 1")
def taxonomy_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey id", "concat(' ', n_name, '  ') name", "concat('Region  ', n_regionkey) title")
    return matching.dictionary(rows, ["name", "title"])


@query("with w as (select distinct trim(c_mktsegment) as name, lower(trim(c_mktsegment)) k from customer), h as (select k, case when k in ('building', 'machinery') then 'h-' || k else substr(sha256(k), 1, 24) end id from w group by 1) select w.name, h.id, w.k not in ('building', 'machinery') created from w join h using (k)")
def found_or_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("name"))
    known = spark.createDataFrame([("h-building", "Building"), ("h-machinery", " MACHINERY")], "id string, name string")
    ids, new = matching.find_or_create(wanted, known)
    return ids.join(new.select("id", F.lit(True).alias("created")), "id", "left").select("name", "id", F.coalesce("created", F.lit(False)).alias("created"))


@query("select l_orderkey id, array_to_string(list(k order by l_linenumber, t) filter (k is not null), ',') ids, array_to_string(list(t order by l_linenumber, t) filter (k is null), ',') missing from (select l_orderkey, l_linenumber, p_brand t, case when p_brand like '%1' then 'k-' || p_brand end k from lineitem join part on p_partkey = l_partkey) group by 1")
def titles_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_brand"))), lambda x: x["p_brand"]).alias("titles"))
    known = table(spark, sf_dir, "part").where("p_brand like '%1'").select(F.col("p_brand").alias("title"), F.concat(F.lit("k-"), "p_brand").alias("id")).distinct()
    out = matching.titles_to_ids(rows, "titles", known)
    empty = lambda c: F.when(F.size(c) > 0, joined(c))
    return out.select("id", empty("ids").alias("ids"), empty("missing").alias("missing"))


@query("select c_custkey id, exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 11 = 0) or exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 13 = 0 and o_orderstatus <> 'P') has_media from customer")
def any_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "parent_id")
    relations = [orders.where("o_orderkey % 11 = 0").select("parent_id"), orders.where("o_orderkey % 13 = 0").select("parent_id", (F.col("o_orderstatus") == "P").alias("is_deleted"))]
    return matching.has_any_child(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), relations)


@query(f"{_BIZ} select id from biz where id % 3 = 0 and (coalesce(is_seeded, false) or coalesce(is_cvb, false) or coalesce(is_crawler, false)) and is_deleted is distinct from true")
def cohort_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.range(0, 3_000_000, 3).select("id")
    return matching.in_cohort(ids.unionByName(ids.limit(5)), biz(spark, sf_dir), filters.cohort())


@query("select s_suppkey id, case when a in ('old town', 'harbor') then a end area, coalesce(a = 'old town', false) ambiguous, case when a = 'harbor' then 'Boston' end area_city from (select s_suppkey, case s_suppkey % 4 when 0 then 'old town' when 1 then 'harbor' when 2 then 'old town' end a from supplier)")
def areas_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "case s_suppkey % 4 when 0 then 'near OLD TOWN square' when 1 then 'At HarborSide' when 2 then 'Harbor of the Old Town' else 'nowhere' end words")
    areas = spark.createDataFrame([("Old Town", "York", 1), ("Old Town", "Bern", 4), ("Harbor", "Boston", 2), ("", "None", 0), ("Hill", "Rome", 3)], "area string, city string, ordinal int")
    return contained.area_in_text(rows, areas, "words").select("id", "area", "ambiguous", "area_city")


@query("select s_suppkey id, case when s_suppkey % 2 = 0 then 'p' || s_suppkey when s_suppkey % 3 = 0 then 'site' when s_suppkey % 5 = 0 then 'own' end emails from supplier")
def email_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "case when s_suppkey % 2 = 0 then concat('P', s_suppkey) end place_id", "case when s_suppkey % 3 = 0 then 'https://w.example/' else 'https://v.example' end website", "case when s_suppkey % 5 = 0 then 'k' end own")
    known = rows.where("place_id is not null").select(F.col("place_id").alias("key"), F.lower("place_id").alias("value")).unionByName(spark.createDataFrame([("https://w.example", "site"), ("k", "own")], "key string, value string"))
    return matching.cascade_look_up(rows, known, [F.col("place_id"), F.col("website"), F.regexp_replace("website", "/$", ""), F.col("own")]).select("id", "emails")


# ---- plans

@query(f"{_BIZ}, c as (select id, name, city, place_id, industry || '.example' as domain from biz where id % 2 = 0), t as (select * from biz where id % 6 = 1), m as (select c.*, case when place_id <> '' then place_id in (select place_id from t where place_id <> '') else exists (select 1 from t where t.name = c.name and t.city = c.city) end there from c), f as (select m.id, (select min(x.id) from biz x where x.id % 6 = 1 and lower(x.industry) = lower(b.industry) and x.industry || '.example' = m.domain and x.id <> m.id) parent from m join biz b using (id) where not there) select (select count(*) from m) total, (select count(*) from m where there) already_there, 0::bigint would_merge, (select count(*) from f) standalone, (select count(*) from f where exists (select 1 from orders where o_custkey = f.id and o_orderkey % 9 = 0)) with_media")
def promotion_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = biz(spark, sf_dir).withColumn("domain", F.concat("industry", F.lit(".example"))).select("id", "name", "city", F.when(F.col("place_id").isNull(), "").otherwise(F.col("place_id")).alias("place_id"), "domain")
    media = table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("parent_id"))
    return promotion.dry_run(rows.where("id % 2 = 0"), rows.where("id % 6 = 1"), [media])


@query("select p_partkey, 'o' || p_size owner_id, case when p_partkey % 5 > 0 then substr(sha256((p_partkey - p_partkey % 5) || ':o' || p_size), 1, 24) end parent_id, substr(sha256(p_partkey || ':o' || p_size), 1, 24) as id from (select p_partkey, min(p_size) over (partition by p_partkey // 5) p_size from part) where p_size % 2 = 0")
def copied_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "part").select("p_partkey", F.min("p_size").over(Window.partitionBy(F.floor(F.col("p_partkey") / 5))).alias("s"))
    items = rows.selectExpr("cast(p_partkey as string) id", "cast(p_partkey as string) kind", "s owner_id", "case when p_partkey % 5 > 0 then cast(p_partkey - p_partkey % 5 as string) end parent_id")
    ids = rows.where("s % 2 = 0").select(F.col("s").alias("old_id"), F.concat(F.lit("o"), "s").alias("new_id")).distinct()
    return promotion.copy_media(items, ids).select(F.col("kind").cast("long").alias("p_partkey"), "owner_id", "parent_id", "id")


@query(f"{_BIZ}, f as (select *, trim(coalesce(place_id, '')) p from biz) select id from biz where id % 7 = 0 and city is distinct from 'other' and id % 10 <> 9 and id % 5 = 0 and id % 8 <> 0")
def sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = biz(spark, sf_dir).where("id % 7 = 0")
    target = source.where("id % 10 <> 9").withColumn("city", F.expr("case when id % 5 = 0 then 'other' else city end"))
    return promotion.ready_to_apply(diffs.preview(source, target, ["city"], done=source.where("id % 8 = 0").select("id"))).select("id")


@query(f"""{_BIZ}, f as (select *, case when id % 2 = 0 then 'P' || id when id % 7 > 0 then 'P' || id % 50 end p from biz where cover like '%media.example%' and cover not like '%/Defaults/%' and id % 11 <> 0), c as (select p, count(*) n from f where p is not null group by 1), g as (select f.* from f join c using (p) where c.n = 1 and id % 3 <> 0 and id % 10 <> 9)
select 'patch' kind, id, 'city' detail from g where id % 5 = 4 union all select 'wallet', id, '' from g where id % 4 <> 0 union all select 'marker', id, 'v2' from g union all select 'unit', o_custkey, (count(*) filter (o_orderkey % 2 = 0))::varchar from orders where o_custkey in (select id from g) group by 2""")
def sync_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = {"hours_status": F.lit("done"), "n_hours": F.lit(1), "n_categories": F.lit(1), "address": F.lit("77 Sunset Blvd"), "match": F.lit(None).cast("boolean"), "country": F.lit(""), "lat": F.lit(40.0), "lng": F.lit(-75.0), "n_outlets": F.lit(1), "place_id": F.expr("case when id % 2 = 0 then 'P' || id when id % 7 > 0 then 'P' || id % 50 end"), "is_active": F.col("id") % 11 != 0}
    source = biz(spark, sf_dir).withColumns(good)
    target = source.where("id % 10 <> 9").withColumn("city", F.expr("case when id % 5 = 4 then 'other' else city end"))
    outlets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent_id"), F.lit(True).alias("is_active"), F.lit(None).cast("boolean").alias("is_deleted"), F.when(F.col("o_orderkey") % 2 == 0, "physical").otherwise("mobile").alias("category"))
    markers = source.select("id", F.when(F.col("id") % 3 == 0, "v2").otherwise("v1").alias("version"))
    plan = promotion.sync_plan(source, target, ["city", "industry"], outlets, source.where("id % 4 = 0").select(F.col("id").alias("owner_id")), markers, "v2")
    rows = [
        plan["patches"].select(F.lit("patch").alias("kind"), "id", joined("changed_fields").alias("detail")), plan["wallets"].select(F.lit("wallet").alias("kind"), F.col("owner_id").alias("id"), F.lit("").alias("detail")),
        plan["markers"].select(F.lit("marker").alias("kind"), "id", F.col("version").alias("detail")), plan["units"].select(F.lit("unit").alias("kind"), F.col("parent_id").alias("id"), F.col("physical").cast("string").alias("detail")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("select o_custkey parent_id, count(*) filter (o_orderstatus = 'O' and o_orderkey % 3 <> 0 and o_orderkey % 2 = 0) physical, count(*) filter (o_orderstatus = 'O' and o_orderkey % 3 <> 0 and o_orderkey % 2 = 1) mobile from orders group by 1")
def unit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    outlets = table(spark, sf_dir, "orders").selectExpr("o_custkey parent_id", "case o_orderstatus when 'O' then true when 'F' then false end is_active", "case when o_orderkey % 3 = 0 then true when o_orderkey % 3 = 1 then null else false end is_deleted", "case when o_orderkey % 2 = 0 then 'physical' else 'mobile' end category")
    return diffs.unit_counts(outlets)


@query("select event_id id from events where event_id % 6 in (1, 2, 3, 5) order by event_id limit 15")
def discovery_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").selectExpr("event_id source_id", "case when event_id % 6 in (1, 2, 3, 5) then 'candidate' else 'blocked' end outcome")
    return discovery.batch(found, 15).select(F.col("source_id").alias("id"))


@query("select o_orderkey id, case when o_orderkey % 3 = 0 then 'reviews' when o_orderkey % 3 = 1 then 'menus' else 'gallery' end stage from orders where o_custkey % 10 = 0 and (o_orderkey % 3 < 2 or o_orderkey % 2 = 0) union all select o_orderkey + 1000000, 'menus' from orders where o_custkey % 10 = 0 and o_orderkey % 3 = 2 and o_orderkey % 2 = 1")
def stage_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", "o_custkey parent_id", "case when o_orderkey % 2 = 0 then 'photo' else 'menu-x' end name", "o_orderkey % 3 k")
    ids = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"))
    plan = lambda stage: repair.stage_deletes(rows.where("k = 0"), rows.where("k = 1"), rows.where("k = 2"), ids, stage)
    said = lambda d, stage: d.select("id", F.lit(stage).alias("stage"))
    menus = plan("menus")
    return said(plan("reviews")["reviews"], "reviews").unionByName(said(menus["menus"], "menus")).unionByName(menus["files"].select((F.col("id") + 1000000).alias("id"), F.lit("menus").alias("stage"))).unionByName(said(plan("gallery")["files"], "gallery"))


# ---- queues and states

@query(f"{_JOBS} select id, case when id % 3 = 0 then status when id % 3 = 1 then 'done' when attempts >= 3 then 'failed' else 'pending' end status from jobs")
def settled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir)
    return queue.settle(rows, rows.where("id % 3 > 0").select("id", (F.col("id") % 3 == 1).alias("ok"))).select("id", "status")


@query(f"{_JOBS} select id from jobs where id % 4 <> 0 or id % 8 = 4 union all select id + 1000000 from jobs where id % 3 = 0")
def not_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).withColumn("marker", F.expr("case when id % 8 = 0 then 'p1' when id % 8 = 4 then 'p0' end"))
    second = rows.withColumn("marker", F.expr("case when id % 3 = 0 then null else 'p1' end"))
    return queue.not_passed(rows, "marker", "p1").select("id").unionByName(queue.not_passed(second, "marker", "p1").select((F.col("id") + 1000000).alias("id")))


@query(f"{_JOBS}, w as (select distinct business_id, type, 'P' || (id % 3 + 1) tier from jobs), o as (select business_id, type, min(tier) tier from w group by 1, 2) select business_id, type, tier, epoch_ms(timestamp '{NOW}') + (dense_rank() over (order by tier)) * 86400000 + business_id at_ms from o")
def enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = jobs(spark, sf_dir).select("business_id", "type", F.concat(F.lit("P"), (F.col("id") % 3 + 1).cast("string")).alias("tier")).distinct()
    return queue.enqueue(wanted, start=now()).select("business_id", "type", "tier", F.unix_millis("created").alias("at_ms"))


@query(f"{_JOBS} select id, 'raw' status, null::bigint validated, null::bigint enriched, source_id from jobs")
def reset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).select("id", "status", F.col("id").alias("validated"), F.col("id").alias("enriched"), "source_id")
    back = queue.reset(rows, "transformed", {"raw": ["validated", "enriched"], "transformed": ["enriched"]})
    assert back.where("enriched is not null or validated is null").isEmpty()
    return queue.reset(back, "raw", {"raw": ["validated", "enriched"], "transformed": ["enriched"]})


@query(f"{_JOBS} select id, case when status = 'pending' and attempts < 2 then 'validated' when status = 'pending' then 'pending' else status end status from jobs")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir)
    return rows.select("id", records.progress_stage("status", (F.col("status") == "pending") & (F.col("attempts") < 2), "validated").alias("status"))


# ---- counts and picks

@query("select count(*) total, count(*) filter (o_orderstatus = 'F') failed, count(*) filter (o_orderstatus = 'P') in_review, count(*) filter (o_orderdate::date = date '1996-01-02') published_today from orders")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("case o_orderstatus when 'F' then 'failed' when 'P' then 'review' else 'x' end status", "o_orderdate published_at")
    return aggregates.dashboard(rows, F.lit("1996-01-02").cast("date"))


@query(f"{_BIZ}, m as (select case when id % 3 = 0 then 'mismatch' when id % 3 = 1 then 'match' else 'skipped' end outcome, city from biz) select 'outcome' kind, outcome as name, count(*) n from m group by 2 union all select 'place', city, n from (select city, count(*) n from m where outcome = 'mismatch' group by 1 order by n desc, city limit 10)")
def mismatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = biz(spark, sf_dir).withColumn("outcome", F.expr("case id % 3 when 0 then 'mismatch' when 1 then 'match' else 'skipped' end"))
    by, top = aggregates.mismatch_stats(rows, "outcome", "city")
    return by.select(F.lit("outcome").alias("kind"), F.col("outcome").alias("name"), "n").unionByName(top.select(F.lit("place").alias("kind"), F.col("city").alias("name"), "n"))


@query("select * from (select sum(t) total, sum(p) published, sum(p) filter (prod) live, greatest(0, sum(p) - coalesce(sum(p) filter (prod), 0)) staging, count(distinct city) filter (city <> '' and t > 0) cities, floor(100.0 * sum(p) / sum(t) + 0.5)::bigint publish_rate from (select c_custkey % 9 t, least(c_custkey % 9, c_custkey % 4) p, case when c_custkey % 8 = 0 then '' else c_mktsegment end city, c_custkey % 5 < 2 prod from customer))")
def session_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey % 9 total", "least(c_custkey % 9, c_custkey % 4) published", "case when c_custkey % 8 = 0 then '' else c_mktsegment end city", "case c_custkey % 5 when 0 then array('staging', 'production') when 1 then array('prod') when 2 then array('staging') else array() end migrated_to")
    return aggregates.session_totals(rows)


@query("select c_custkey id, greatest(0, 10 - n) missing from (select c_custkey, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by 1)")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").join(have, "c_custkey", "left")
    return rows.select(F.col("c_custkey").alias("id"), aggregates.gap(F.lit(10), F.coalesce("n", F.lit(0))).alias("missing"))


@query("select p_brand, n from (select p_brand, count(*) n from part group by 1 order by n desc, p_brand limit 5)")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_n(table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("p_brand")], 5)


@query("with h as (select user_id site, 'e' || event_id || '@x.org' email, case when event_id % 5 = 0 or user_id % 7 = 0 then true else false end is_role, case event_id % 3 when 0 then 'A' when 1 then 'B' else 'C' end tier, event_id % 4 = 0 domain_matches, event_id as position from events where event_id % 3 < 2 or user_id % 2 = 0), p as (select *, bool_and(is_role) over (partition by site) only_role from h), q as (select *, case when only_role then 'C' else tier end t from p where only_role or not is_role) select site, email, t tier from (select *, row_number() over (partition by site order by t, domain_matches desc, position, email) r from q) where r = 1")
def best_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").where("event_id % 3 < 2 or user_id % 2 = 0").selectExpr("user_id site", "concat('e', event_id, '@x.org') email", "event_id % 5 = 0 or user_id % 7 = 0 is_role", "element_at(array('A', 'B', 'C'), cast(event_id % 3 + 1 as int)) tier", "event_id % 4 = 0 domain_matches", "event_id position")
    return ranking.best_emails(hits).select("site", "email", "tier")


@query("""with l as (select user_id site, event_id as position, case event_id % 5 when 0 then 'https://www.s.example/contact/?a=1' when 1 then 'https://s.example/about-us' when 2 then 'https://other.example/contact' when 3 then 'http://S.example/Team#x' else 'https://s.example/shop' end link from events),
f as (select *, lower(regexp_replace(regexp_replace(link, '[?#].*$', ''), '/+$', '')) k, regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1) p from l where not regexp_matches(link, 'other|shop')),
o as (select *, row_number() over (partition by site, k order by position, link) n from f)
select site, link, place from (select site, link, row_number() over (partition by site order by greatest(length(p), 1), link) place from o where n = 1) where place <= 3""")
def contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "events").selectExpr("user_id site", "event_id position", "'s.example' host", "element_at(array('https://www.s.example/contact/?a=1', 'https://s.example/about-us', 'https://other.example/contact', 'http://S.example/Team#x', 'https://s.example/shop'), cast(event_id % 5 + 1 as int)) link")
    return ranking.contact_links(links).select("site", "link", "place")


@query("with f as (select user_id parent, event_id as position, ts, case event_id % 4 when 0 then 'exterior' when 1 then 'menu' when 2 then 'interior' else 'other' end folder, case when event_id % 3 = 0 then '' else 'u' || event_id end url from events) select parent, url, first_id from (select *, row_number() over (partition by parent order by case folder when 'interior' then 1 when 'exterior' then 2 else 3 end, position) r, first_value(position) over (partition by parent order by ts, position) first_id from f where url <> '') where r = 1")
def picked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "events").selectExpr("user_id parent", "event_id position", "ts", "element_at(array('exterior', 'menu', 'interior', 'other'), cast(event_id % 4 + 1 as int)) folder", "case when event_id % 3 = 0 then '' else concat('u', event_id) end url")
    first = ranking.earliest(files.where("url <> ''"), "parent", "ts", "position").withColumnRenamed("position", "first_id")
    return ranking.pick_image(files, ["interior", "exterior"]).join(first, "parent")


@query("select user_id, event_id as value from (select user_id, event_id, row_number() over (partition by user_id order by case event_type when 'purchase' then 1 when 'click' then 2 end, event_id) r from events where event_type in ('purchase', 'click')) where r = 1")
def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), F.col("event_id").alias("value"), F.col("event_id").alias("position"))
    return ranking.first_label(rows, "user_id", {"purchase": 1, "click": 2})


@query("select c_custkey, (select min(s_suppkey) from supplier where contains(c_name, cast(s_suppkey as varchar)) and s_suppkey > 9)::varchar as first from customer")
def first_keys_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least supplier key whose digits stand in a customer's name, by the join that takes gazetteers of any size."""
    names = table(spark, sf_dir, "supplier").where("s_suppkey > 9").selectExpr("cast(s_suppkey as string) name", "s_suppkey ordinal")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return contained.first_contained(rows, F.col("c_name"), names, sent=0).select("c_custkey", "first")


#: A category map from the parts: second words, whole names, and names with more behind them, which hold the raw ones.
_CATEGORY_TABLE = """
select distinct split_part(p_name, ' ', 2) key, 'Goods' industry, cast(100 + length(p_name) * 7 % 13 as int) ordinal from {part} where p_partkey % 2 = 0 and length(p_name) % 2 = 0
union select distinct concat(p_name, ' deluxe') key, 'Luxury' industry, cast(100 + length(p_name) * 5 % 11 as int) ordinal from {part} where length(p_name) % 3 = 0
union select distinct p_name key, 'Goods' industry, 1 ordinal from {part} where length(p_name) % 5 = 0
"""


@query(f"with t as (select key, industry, row_number() over (order by ordinal, key) o from ({_CATEGORY_TABLE.format(part='part')}) qualify row_number() over (partition by key order by ordinal, industry) = 1), n as (select distinct p_name from part), m as (select p_name, coalesce(max(case when key = p_name then industry end), arg_min(industry, o)) industry, coalesce(max(case when key = p_name then key end), arg_min(key, o)) key from n left join t on contains(p_name, key) or contains(key, p_name) group by 1) select p_partkey, coalesce(industry, 'None') industry, coalesce(key, '') category, key is null is_fallback from part join m using (p_name)")
def category_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names through a category map that is a table: exact keys, keys within the name, and keys that hold it."""
    given = spark.sql(_CATEGORY_TABLE, part=table(spark, sf_dir, "part"))
    once = given.groupBy("key").agg(F.min_by("industry", F.struct("ordinal", "industry")).alias("industry"), F.min("ordinal").alias("at"))
    keys = once.select("key", "industry", F.array("key").alias("categories"), F.struct("at", "key").alias("ordinal"))
    out = contained.map_categories(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_name"), keys, default="None", sent=0)
    return out.select("p_partkey", F.col("mapped.industry").alias("industry"), F.coalesce(F.get("mapped.categories", F.lit(0)), F.lit("")).alias("category"), F.col("mapped.is_fallback").alias("is_fallback"))


@query("""with n as (select * from nation where n_regionkey in (1, 3)), c as (select * from customer where c_nationkey in (select n_nationkey from n)), s as (select * from supplier where s_nationkey in (select n_nationkey from n)), o as (select * from orders where o_custkey in (select c_custkey from c)),
l as (select * from lineitem where l_orderkey in (select o_orderkey from o) or l_suppkey in (select s_suppkey from s))
select 'nation' as "table", count(*) n from n union all select 'customer', count(*) from c union all select 'supplier', count(*) from s union all select 'orders', count(*) from o union all select 'lineitem', count(*) from l union all select 'events', count(*) from events where user_id in (select c_custkey from c) union all select 'reviews', -1 union all select 'documents', -1""")
def purge_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows below some regions, along two branches that meet in the line items, with a table that isn't there and a column that isn't."""
    t = lambda name: lambda: table(spark, sf_dir, name)
    specs = [
        repair.Below("lineitem", t("lineitem"), "l_orderkey", (("orders", "l_orderkey"), ("supplier", "l_suppkey"))), repair.Below("orders", t("orders"), "o_orderkey", (("customer", "o_custkey"),)), repair.Below("customer", t("customer"), "c_custkey", (("nation", "c_nationkey"),)),
        repair.Below("supplier", t("supplier"), "s_suppkey", (("nation", "s_nationkey"),)), repair.Below("nation", t("nation"), "n_nationkey", (("region", "n_regionkey"),)), repair.Below("events", t("events"), "event_id", (("customer", "user_id"),)),
        repair.Below("reviews", t("reviews"), "id", (("orders", "order_id"),)), repair.Below("documents", t("documents"), "doc_id", (("customer", "owner_id"), ("reviews", "review_id"))),
    ]
    roots = table(spark, sf_dir, "region").where("r_regionkey in (1, 3)")
    return repair.purge_graph(roots, specs, root_key="r_regionkey", root="region", guard=F.col("r_regionkey") == 0)[0].select("table", "n")
