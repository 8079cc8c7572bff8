"""Operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordforge.functions import names
from recordforge.functions.nulls import not_true, present
from recordforge.operators import aggregates, dedup, diffs, filters, gates, judgement, matching, queue, ranking, records, repair, sets, similar
from recordforge.plans import discovery, promotion
from recordforge.queries.catalog import NOW, biz, biz_sql, jobs, jobs_sql, joined, now, query, scratch, table, values
from recordforge.sources import sinks
from recordforge.sources.versions import Versioned

_BIZ = f"with biz as ({biz_sql()})"
_JOBS = f"with jobs as ({jobs_sql()})"

_STREET = "(a <> '' and not regexp_matches(a, '\\b[A-Za-z]{2}\\s+\\d{5}(?:-\\d{4})?\\b') and (regexp_matches(a, '^\\d') or regexp_matches(a, '(?i)\\b(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard)\\b')))"
_GATE = f"""{_BIZ},
c as (select *, trim(coalesce(place_id, '')) p, regexp_replace(trim(coalesce(address, '')), '(?i),\\s*(USA|United States(?: of America)?)\\s*$', '') a from biz),
counts as (select p, count(*) n from c where p <> '' group by p),
g as (select c.*, coalesce(is_active, false) and coalesce(n_outlets >= 1, false) active_outlet, match is distinct from false verified_place,
  coalesce(cover <> '' and cover not like '%/Defaults/%' and cover not like '%googleusercontent%' and cover like '%media.example%', false) real_cover,
  coalesce(hours_status = 'done' and n_hours > 0, false) real_hours, coalesce(industry <> '' and n_categories > 0, false) taxonomy,
  a <> '' and not regexp_matches(trim(address), '(?i)^\\s*(https?://|www\\.)') and not regexp_matches(trim(address), '^\\+?[\\d\\s\\-().]{{7,}}$') and {_STREET.replace('{', '{{').replace('}', '}}')} and trim(coalesce(city, '')) <> '' valid_address,
  p <> '' and coalesce(counts.n, 0) <= 1 single_place,
  not (lat = 0 and lng = 0) and lower(trim(coalesce(country, ''))) in ('', 'united states') and lat between 24 and 50 and lng between -125 and -66 domestic,
  coalesce(email_source = 'website_scrape' and trim(email) <> '', false) verified_email
  from c left join counts using (p)),
f as (select *, active_outlet and verified_place and real_cover and real_hours and taxonomy and valid_address and single_place and domestic pass_core from g)
""".replace("{{", "{").replace("}}", "}")
_REASON = "case when not active_outlet then 'active_outlet' when not verified_place then 'verified_place' when not real_cover then 'real_cover' when not real_hours then 'real_hours' when not taxonomy then 'taxonomy' when not valid_address then 'valid_address' when not single_place then 'single_place' when not domestic then 'domestic' end"


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.evaluate(biz(spark, sf_dir))


@query(f"{_GATE} select count(*) total, count(*) filter (pass_core) pass_core, 0::bigint pass_all, {', '.join(f'count(*) filter (not {k}) fail_{k}' for k in gates.ORDER)}, count(*) filter (not verified_email) fail_verified_email from f")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.facets(_gated(spark, sf_dir), "gate", [*gates.ORDER, "verified_email"], ["pass_core", "pass_all"])


@query(f"{_GATE} select {_REASON} reason, count(*) n from f where not pass_core group by 1")
def first_fail_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.reasons(_gated(spark, sf_dir).withColumn("reason", gates.first_fail()), "reason")


@query(f"{_GATE} select case when n_block = 0 and n_fix = 0 then 'passing' when n_block = 0 and n_fix = 1 then 'P1' when n_block = 0 then 'P2' when n_fix >= 1 then 'P3' else 'blocked' end tier, count(*) n from (select (not real_cover)::int + (not real_hours)::int + (not taxonomy)::int n_fix, (not single_place)::int + (not domestic)::int n_block from f) group by 1")
def priority_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = gates.tier("gate", ["real_cover", "real_hours", "taxonomy"], ["single_place", "domestic"])
    return _gated(spark, sf_dir).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_BIZ} select id, name, city from biz where (coalesce(is_seeded, false) or coalesce(is_cvb, false) or coalesce(is_crawler, false)) and contains(lower(name), '1') and state in (select r_name from region where r_regionkey in (1, 2, 3)) and place_id <> '' and is_deleted is distinct from true order by name, id limit 5 offset 5")
def filter_builder_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [r[0] for r in table(spark, sf_dir, "region").where("r_regionkey in (1, 2, 3)").select("r_name").collect()]
    s = filters.Search(q="1", q_columns=("name",), among={"state": wanted}, has={"place_id": True}, flags={"is_deleted": False}, only_cohort=True)
    rows, _ = ranking.page(filters.search(biz(spark, sf_dir), s), [F.col("name"), F.col("id")], ranking.Page(2, 5))
    return rows.select("id", "name", "city")


@query(f"{_GATE} select id from f where not real_cover and not taxonomy and verified_place and place_id in (select place_id from biz where place_id <> '' group by 1 having count(*) > 1)")
def filter_by_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = filters.Search(fails=("real_cover", "taxonomy"), passes=("verified_place",))
    return filters.search(_gated(spark, sf_dir), s, duplicates_of="place_id").select("id")


@query(f"{_BIZ} select count(*) total, greatest(1, ceil(count(*) / 200.0))::bigint pages from biz where cover is null or cover = ''")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page(biz(spark, sf_dir).where(filters.Search(has={"cover": False}).column()), [F.col("id")], ranking.Page(size=5000))[1]


@query(f"{_BIZ} select id, address <> '' and (regexp_matches(name, '(?i)test') is false) and coalesce(is_seeded or is_cvb or is_crawler, false) and is_deleted is distinct from true resolvable, coalesce(place_id <> '' and (coalesce(cover, '') = '' or cover like '%/Defaults/%'), false) coverless from biz")
def row_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biz(spark, sf_dir).select("id", filters.resolvable().alias("resolvable"), filters.coverless("/Defaults/").alias("coverless"))


@query("select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderdate >= timestamp '1997-01-01 00:00:00' and o.o_orderstatus <> 'P')")
def missing_child_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp '1997-01-01 00:00:00'").withColumn("is_deleted", F.col("o_orderstatus") == "P")
    return matching.without_children(table(spark, sf_dir, "customer"), orders, key="c_custkey", parent="o_custkey").select("c_custkey", "c_name")


@query("select o_orderkey, coalesce(n, 0) n_children, coalesce(b, 0) n_inactive, coalesce(n, 0) > 0 and coalesce(b, 0) = 0 all_active from orders left join (select l_orderkey, count(*) n, count(*) filter (l_linestatus <> 'O') b from lineitem group by 1) on l_orderkey = o_orderkey")
def child_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("is_active", F.col("l_linestatus") == "O")
    return matching.child_flags(table(spark, sf_dir, "orders"), lines, key="o_orderkey", parent="l_orderkey").select("o_orderkey", "n_children", "n_inactive", "all_active")


@query("select o_custkey, count(*) filter (o_orderstatus = 'O') \"O\", count(*) filter (o_orderstatus = 'F') \"F\", count(*) filter (o_orderstatus = 'P') \"P\", count(*) filter (o_orderstatus = 'X') \"X\" from orders group by 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram(table(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F", "P", "X"], by=["o_custkey"])


@query(f"{_BIZ} select coalesce(nullif(address, ''), 'Unknown') address, count(*) total, count(*) filter (is_active) published, min(nullif(state, '')) state, greatest(0, count(*) - count(*) filter (is_active)) pending, floor(100.0 * count(*) filter (is_active) / count(*) + 0.5)::bigint publish_rate from biz group by 1")
def coverage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coverage(biz(spark, sf_dir), "address", F.col("is_active"), state="state")


@query("select user_id, event_type as mode, n from (select *, row_number() over (partition by user_id order by n desc, first) r from (select user_id, event_type, count(*) n, min(event_id) first from events where event_type <> '' group by all)) where r = 1")
def mode_with_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mode(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type"), "event_id")


@query("select min(ts) oldest, max(ts) newest, count(*) total, count(value) computed, count(*) - count(value) missing from events")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.freshness(table(spark, sf_dir, "events").withColumn("ts2", F.when(F.col("value").isNotNull(), F.col("ts"))), "ts2")


@query("select count(*) filter (a and not b and not c) only_a, count(*) filter (b and not a and not c) only_b, count(*) filter (c and not a and not b) only_c, count(*) filter (a::int + b::int + c::int >= 2) several, count(*) filter (not a and not b and not c) as none from (select l_quantity > 25 a, l_discount > 0.05 b, l_returnflag = 'R' c from lineitem)")
def exclusive_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_quantity > 25 a", "l_discount > 0.05 b", "l_returnflag = 'R' c")
    return aggregates.exclusive(rows, ["a", "b", "c"])


@query("select coalesce(event_type, 'unknown') event_type, count(*) n from events group by 1")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by(table(spark, sf_dir, "events"), "event_type")


@query("select before, after, count(*) n from (select event_type before, lead(event_type) over (partition by user_id order by ts, event_id) after from events) where after is not null group by all")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("before"), F.lead("event_type").over(w).alias("after")).where("after is not null")
    return aggregates.transitions(rows, "before", "after")


@query("select distinct p_brand from part where p_brand <> ''")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.distinct_values(table(spark, sf_dir, "part"), "p_brand")


@query("select p_brand, n, floor(100.0 * n / sum(n) over () + 0.5)::bigint share from (select p_brand, count(*) n from part group by 1 order by n desc, p_brand limit 8)")
def top_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_shares(table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), "p_brand", "n")


@query("select o_custkey, o_orderpriority, b.n in_bucket, examples, t.total, t.done, t.done >= t.total complete from (select o_custkey, o_orderpriority, count(*) n, array_to_string(list_sort(list(o_orderkey::varchar) filter (r <= 3)), ',') examples from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) r from orders) group by all) b join (select o_custkey, count(*) total, count(*) filter (o_orderstatus = 'F') done from orders group by 1) t using (o_custkey)")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.progress(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", "o_orderpriority", "o_orderkey")
    return out.withColumn("examples", joined("examples"))


@query("select lang, coalesce(nullif(source, ''), 'Highlights') source, count(*) n, min(doc_id) place from documents group by all")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.by_section(table(spark, sf_dir, "documents"), ["lang"], "source", "doc_id")


@query("select sha256(text) digest, count(*) n, min(doc_id) first_id from documents where trim(text) <> '' group by 1 having count(*) > 1")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", F.when(F.trim("text") != "", F.sha2("text", 256)).alias("digest")), "digest", id_col="doc_id")


_SCORE = "(case when coalesce(cover like '%media.example%' and cover not like '%googleusercontent%' and cover not like '%/Defaults/%', false) then 16 else 0 end + case when coalesce(hours_status = 'done' and n_hours > 0, false) then 8 else 0 end + case when industry <> '' and n_categories > 0 then 4 else 0 end + case when n_outlets >= 1 then 2 else 0 end)"


@query(f"{_BIZ}, s as (select id, trim(place_id) place_id, {_SCORE} score, created from biz where trim(place_id) <> ''), r as (select *, row_number() over w rn, first_value(id) over w survivor_id, count(*) over (partition by place_id) n from s window w as (partition by place_id order by score desc, created nulls last, id)) select id, place_id, score, survivor_id, case when rn = 1 then 'keep' else 'purge' end as action from r where n > 1")
def survivor_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.plan(biz(spark, sf_dir), "place_id", dedup.usefulness("media.example", "googleusercontent", "/Defaults/"))


@query(f"{_BIZ}, s as (select id, trim(place_id) place_id, {_SCORE} score, created from biz where trim(place_id) <> ''), r as (select *, row_number() over w rn, first_value(id) over w survivor_id, count(*) over (partition by place_id) n from s window w as (partition by place_id order by score desc, created nulls last, id)), k as (select o_custkey id, count(*) n from orders where o_totalprice > 400000 group by 1) select count(distinct place_id) groups, count(*) filter (rn = 1) kept, count(*) filter (rn > 1 and not (coalesce(l.n, 0) > 0 and coalesce(v.n, 0) = 0)) purged, count(*) filter (rn > 1 and coalesce(l.n, 0) > 0 and coalesce(v.n, 0) = 0) flagged from r left join k l on l.id = r.id left join k v on v.id = r.survivor_id where r.n > 1")
def dedup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = dedup.plan(biz(spark, sf_dir), "place_id", dedup.usefulness("media.example", "googleusercontent", "/Defaults/"))
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("parent_id"))
    return dedup.totals(dedup.guarded(planned, {"orders": big}), "place_id")


@query("select id, case when key is not null and exists (select 1 from customer c where c.c_mktsegment || c.c_nationkey = key) then 'key' when key is null and exists (select 1 from nation n where n.n_name = city and name in (select lower(regexp_replace(c_name, '[#]', ' ')) from customer c2 where c2.c_nationkey = n.n_nationkey)) then 'name_city' end matched_by from (select s_suppkey id, case when s_suppkey % 2 = 0 then 'BUILDING' || s_nationkey end key, n_name city, lower(regexp_replace(replace(s_name, 'Supplier', 'Customer'), '[#]', ' ')) name from supplier join nation on s_nationkey = n_nationkey)")
def two_tier_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    mine = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey id", "case when s_suppkey % 2 = 0 then 'BUILDING' || s_nationkey end place_id", "city", "replace(s_name, 'Supplier', 'Customer') name")
    theirs = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey id", "c_mktsegment || c_nationkey place_id", "city", "c_name name")
    return matching.two_tier_match(mine, theirs).select("id", "matched_by")


@query("select a.c_custkey id, b.s_suppkey other_id, concat_ws(',', case when a.c_nationkey = b.s_nationkey and a.c_custkey % 10 = b.s_suppkey % 10 then 'k1' end, case when round(a.c_acctbal) = round(b.s_acctbal) then 'k2' end) keys from customer a join supplier b on (a.c_nationkey = b.s_nationkey and a.c_custkey % 10 = b.s_suppkey % 10) or round(a.c_acctbal) = round(b.s_acctbal) where a.c_custkey <> b.s_suppkey")
def or_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_nationkey * 10 + c_custkey % 10 k1", "round(c_acctbal) k2")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "s_nationkey * 10 + s_suppkey % 10 k1", "round(s_acctbal) k2")
    return matching.or_key_match(a, b, ["k1", "k2"]).withColumn("keys", joined("keys"))


@query("with f as (select p_partkey id, p_brand || p_size b, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x not in ('the', 'a', 'an', 'and', 'co', 'inc')), ' ') n from part) select a.id, b.id other_id, round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n))::double, 9) similarity from f a join f b on a.b = b.b and a.id < b.id where round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n))::double, 9) >= 0.6")
def fuzzy_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey id", "p_brand || p_size block", "p_name name")
    return similar.fuzzy_pairs(rows, "block", names.dedup_form(F.col("name")), least=0.6).withColumn("similarity", F.round("similarity", 9))


_LABEL = "lower(concat(p_name, ' ', p_brand, ' ', cast(p_size as varchar(9))))"


@query(f"with f as (select distinct {_LABEL} n from part) select a.n a, b.n b, round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n))::double, 9) similarity from f a, f b where a.n < b.n and round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n))::double, 9) >= 0.9")
def similar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = table(spark, sf_dir, "part").selectExpr("'' block", f"{_LABEL} form").distinct()
    return similar.similar_texts(forms, 0.9).select("a", "b", F.round("similarity", 9).alias("similarity"))


# Made points on both sides of 180 degrees and around the poles, where cells differ from band to band.
_FAR = "select {0} id, '' as name, case {0} % 4 when 0 then 89.9996 + ({0} % 7) * 0.00005 when 1 then -89.9 + ({0} % 11) * 0.0001 when 2 then 60 + ({0} % 5) * 0.0002 else -10 + ({0} % 3) * 0.0002 end lat, case {0} % 3 when 0 then 180 - ({0} % 13) * 0.0002 when 1 then -180 + ({0} % 17) * 0.0002 else ({0} * 37 % 3600) * 0.1 - 180 end lng from {1}"


@query(f"with c as ({_FAR.format('c_custkey', 'customer')}), s as ({_FAR.format('s_suppkey', 'supplier')}), p as (select c.id, s.id known_id, 2 * 6371000 * asin(sqrt(pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - c.lng) / 2), 2))) d from c, s) select id, known_id, round(d, 2) distance from p where d <= 50")
def polar_geo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = lambda key, t: spark.sql(_FAR.format(key, "{t}"), t=table(spark, sf_dir, t)).selectExpr("id", "name", "cast(lat as double) lat", "cast(lng as double) lng")
    return matching.near_existing(points("c_custkey", "customer"), points("s_suppkey", "supplier"), digits=2).select("id", "known_id", "distance")


@query("with c as (select c_custkey id, c_name as name, 40 + (c_custkey % 97) * 0.00021::double lat, -75 - (c_custkey % 89) * 0.00023::double lng from customer), s as (select s_suppkey id, replace(s_name, 'Supplier', 'Customer') as name, 40 + (s_suppkey % 97) * 0.00021::double + 0.0001 lat, -75 - (s_suppkey % 89) * 0.00023::double lng from supplier), p as (select c.id, s.id known_id, 2 * 6371000 * asin(sqrt(pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - c.lng) / 2), 2))) d, 1 - levenshtein(replace(lower(c.name), '#', ' '), replace(lower(s.name), '#', ' ')) / greatest(length(c.name), length(s.name))::double sim from c, s) select id, known_id, round(d, 3) distance, round(sim, 9) similarity from p where d <= 50 and sim >= 0.85")
def grid_geo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_name name", "40 + (c_custkey % 97) * 0.00021D lat", "-75 - (c_custkey % 89) * 0.00023D lng")
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "replace(s_name, 'Supplier', 'Customer') name", "40 + (s_suppkey % 97) * 0.00021D + 0.0001D lat", "-75 - (s_suppkey % 89) * 0.00023D lng")
    return matching.near_existing(c, s, digits=3).withColumn("similarity", F.round("similarity", 9))


@query("select p_partkey from (select p_partkey, row_number() over (order by p_partkey) - 1 r, count(*) over () n from part) where r in (select floor(i * (select count(*) from part) / 37)::bigint from range(37) t(i))")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stride_sample(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 37)


@query(f"{_BIZ} select id, concat_ws(',', case when coalesce(balance < 0, false) then 'debt' end, case when cover is null or cover = '' then 'no_cover' end, case when coalesce(n_categories = 0, false) then 'no_category' end, case when coalesce(length(name) > 18, false) then 'long' end) signs from biz")
def signature_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordforge.functions.nulls import blank, fired

    signs = fired(("debt", F.col("balance") < 0), ("no_cover", blank(F.col("cover"))), ("no_category", F.col("n_categories") == 0), ("long", F.length("name") > 18))
    return biz(spark, sf_dir).select("id", joined(signs).alias("signs"))


@query(f"{_BIZ}, t as (select id, case when id % 5 = 0 then 'other' else city end city, case when id % 7 = 0 then null else industry end industry, n_outlets + (id % 3 = 0)::int n_outlets, state from biz where id % 10 <> 9) select s.id, case when s.id % 8 = 0 then 'skipped' when t.id is null then 'missing' when ch <> '' then 'patched' else 'unchanged' end outcome, case when s.id % 8 = 0 or t.id is null then '' else ch end changed_fields from (select s.id, t.id tid, concat_ws(',', case when s.city is distinct from t.city then 'city' end, case when s.industry is distinct from t.industry then 'industry' end, case when s.n_outlets is distinct from t.n_outlets then 'n_outlets' end) ch from biz s left join t using (id)) x join biz s on s.id = x.id left join t on t.id = s.id")
def row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = biz(spark, sf_dir)
    target = source.where("id % 10 <> 9").withColumns({"city": F.expr("case when id % 5 = 0 then 'other' else city end"), "industry": F.expr("case when id % 7 = 0 then null else industry end"), "n_outlets": F.expr("n_outlets + int(id % 3 = 0)")})
    out = diffs.preview(source, target, ["city", "industry", "n_outlets"], asserted="state", done=source.where("id % 8 = 0").select("id"))
    return out.withColumn("changed_fields", joined("changed_fields"))


_LINES = f"""{_BIZ}, a as (select id, city, case id % 5 when 0 then id || ' Oak Ave, ' || case when id % 2 = 0 then city else 'Durham' end || ', NC 27' || lpad((id % 1000)::varchar, 3, '0') when 1 then 'Suite 4, ' || id || ' Elm St, ' || city || ', tx 78701-1234, USA' when 2 then id || ' Elm St' when 3 then 'x, ' || id || ', NC 27614' end line from biz),
p as (select *, list_transform(string_split(regexp_replace(line, ', USA$', ''), ','), lambda x: trim(x)) s from a)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "case id % 5 when 0 then id || ' Oak Ave, ' || case when id % 2 = 0 then city else 'Durham' end || ', NC 27' || lpad(cast(id % 1000 as string), 3, '0') when 1 then 'Suite 4, ' || id || ' Elm St, ' || city || ', tx 78701-1234, USA' when 2 then id || ' Elm St' when 3 then 'x, ' || id || ', NC 27614' end"
    return biz(spark, sf_dir).withColumn("address", F.expr(line))


@query(f"{_LINES} select id, case when line is null then 'empty_address' when len(s) < 2 then 'fewer_than_2_segments' when not regexp_full_match(s[-1], '[A-Za-z]{{2}}\\s+\\d{{5}}(-\\d{{4}})?') then 'no_state_zip_segment' when regexp_full_match(s[-2], '\\d+') then 'numeric_derived' when lower(s[-2]) = lower(city) then 'match' else 'mismatch' end outcome, case when len(s) >= 2 and regexp_full_match(s[-1], '[A-Za-z]{{2}}\\s+\\d{{5}}(-\\d{{4}})?') and not regexp_full_match(s[-2], '\\d+') then s[-2] end derived from p")
def city_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.resync_city(_lines(spark, sf_dir)).select("id", "outcome", "derived")


@query(f"{_LINES} select id, case when line is null or len(s) < 2 then 'not_needed' when len(s) >= 3 then 'split' else 'unsplittable' end outcome, case when len(s) >= 3 then array_to_string(s[1:len(s) - 2], ', ') end new_street, coalesce(len(s) >= 3 and lower(s[-2]) <> lower(city), false) city_differs from p")
def street_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.split_street(_lines(spark, sf_dir).withColumn("formatted", F.lit(None).cast("string"))).select("id", "outcome", "new_street", "city_differs")


@query(f"{_BIZ} select id, place_id <> '' and place_id is not null recoverable from biz where cover like '%/Defaults/%'")
def placeholder_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.strip_placeholders(biz(spark, sf_dir), "/Defaults/").select("id", "recoverable")


@query("with n as (select * from nation where n_regionkey = 2), c as (select * from customer where c_nationkey in (select n_nationkey from n)), o as (select * from orders where o_custkey in (select c_custkey from c)), l as (select * from lineitem where l_orderkey in (select o_orderkey from o)) select 'nation' as \"table\", count(*) n from n union all select 'customer', count(*) from c union all select 'orders', count(*) from o union all select 'lineitem', count(*) from l")
def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    chain = [("nation", t("nation"), "n_nationkey", "n_regionkey"), ("customer", t("customer"), "c_custkey", "c_nationkey"), ("orders", t("orders"), "o_orderkey", "o_custkey"), ("lineitem", t("lineitem"), "l_orderkey", "l_orderkey")]
    return repair.cascade_counts(repair.refuse(t("region").where("r_regionkey = 2"), F.col("r_name") == "none"), chain, root_key="r_regionkey")


@query("select l.doc_id, case when quality = 0 and doc_id % 3 <> 0 and toxic = 0 then 'not_applicable' when toxic = 1 then 'skip' when quality = 1 and doc_id % 5 <> 0 then 'accept' else 'review' end as action, not (quality = 0 and doc_id % 3 <> 0 and toxic = 0) and doc_id % 5 = 0 needs_review from labels l")
def judge_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumns({"industry": F.expr("case when quality = 1 then 'x' end"), "confidence": F.expr("case when doc_id % 3 = 0 then 0.5D else 0.7D end"), "anomaly": F.expr("case when toxic = 1 then 'skip' when quality = 1 then 'accept' end")})
    return rows.withColumn("r", judgement.route(F.col("industry"), F.col("confidence"), F.col("anomaly"), [F.col("doc_id") % 5 == 0])).select("doc_id", "r.*")


@query(f"{_JOBS} select id, business_id, type, 'running' status, attempts + 1 attempts from jobs where status = 'pending' and attempts < 3 order by created, id limit 25")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claim(jobs(spark, sf_dir), 25).select("id", "business_id", "type", "status", "attempts")


@query(f"{_JOBS} select business_id, type from jobs group by all having count(*) filter (status in ('pending', 'running')) > 0 or count(*) filter (status in ('done', 'failed') and completed > timestamp '{NOW}' - interval 15 minutes) > 0 or count(*) filter (status in ('done', 'failed') and completed > timestamp '{NOW}' - interval 4 hours) >= 5")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.suppressed(jobs(spark, sf_dir), now())


@query(f"{_JOBS} select recent, pending, recent * 2 hourly, case when recent > 0 then floor(pending / (recent * 2))::bigint end hours_left from (select count(*) filter (status = 'done' and completed > timestamp '{NOW}' - interval 30 minutes) recent, count(*) filter (status = 'pending') pending from jobs)")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.throughput(jobs(spark, sf_dir), now(), minutes=30)


@query(f"{_JOBS} select id, case when status = 'running' and claimed < timestamp '{NOW}' - interval 10 minutes and attempts < 3 then 'pending' else status end status from jobs")
def stuck_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.stuck(jobs(spark, sf_dir), now()).select("id", "status")


@query(f"{_JOBS}, d as (select *, source_id % 7 = 0 seen from jobs where status = 'done') select id, not seen and row_number() over (partition by source_id order by id) = 1 inserts from d")
def drain_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = jobs(spark, sf_dir).where("status = 'done'")
    return queue.drain(done, done.where("source_id % 7 = 0").select("source_id")).select("id", "inserts")


@query(f"{_JOBS} select user_id, greatest(0, 12 - coalesce(n, 0)) remaining from (select distinct user_id from events) left join (select user_id, count(*) n from events where ts >= timestamp '{NOW}' - interval 72 hours group by 1) using (user_id)")
def event_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"))
    return queue.quota(events.select("user_id").distinct(), events, now(), key="user_id")


@query("select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, value desc) r from events) where r = 1")
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "ts")


@query(f"{_BIZ}, t as (select * from biz where id % 3 = 0) select biz.id, case when t.id is null then 'insert' when biz.id % 2 = 0 then 'merge' else 'skip' end as action from biz left join (select place_id, min(id) id from t where place_id <> '' group by 1) t using (place_id)")
def promotion_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = biz(spark, sf_dir)
    return promotion.resolve_conflicts(rows, rows.where("id % 3 = 0"), rows.where("id % 2 = 0").select("id", F.lit("overwrite").alias("choice"))).select("id", "action")


@query("with i as (select substr(sha256(n_name), 1, 24) new_id, n_nationkey old_id from nation where n_nationkey % 4 <> 3) select i.new_id as id, n_name, j.new_id as twin, k.new_id as region_head from nation n join i on i.old_id = n.n_nationkey left join i j on j.old_id = (n.n_nationkey + 5) % 25 left join i k on k.old_id = n.n_regionkey")
def remap_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    ids = nation.where("n_nationkey % 4 <> 3").select(F.col("n_nationkey").alias("old_id"), F.substring(F.sha2("n_name", 256), 1, 24).alias("new_id"))
    rows = nation.selectExpr("n_nationkey id", "n_name", "(n_nationkey + 5) % 25 twin", "n_regionkey region_head")
    return matching.remap_tree(rows, ids, ["twin", "region_head"])


@query("select s_suppkey, n_name parent_name from supplier left join nation on n_nationkey = s_nationkey and n_regionkey <> 1")
def look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").where("n_regionkey <> 1")
    return matching.look_up(table(spark, sf_dir, "supplier"), "s_nationkey", nation, key="n_nationkey", name="n_name").select("s_suppkey", "parent_name")


@query(f"{_BIZ} select id, (select min(b.id) from biz b where lower(b.industry) = lower(biz.industry) and b.id <> biz.id and b.is_deleted is distinct from true) parent_id from biz where is_deleted is distinct from true")
def same_name_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.same_name_parent(biz(spark, sf_dir), name="industry").select("id", "parent_id")


@query("select o_orderkey, parts from orders join (select l_orderkey, string_agg(distinct p_brand, ',' order by p_brand) parts from lineitem join part on p_partkey = l_partkey group by 1) on l_orderkey = o_orderkey")
def names_of_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("refs"))
    found = matching.names_of(refs, "refs", table(spark, sf_dir, "part"), key="p_partkey", name="p_brand")
    return found.select(F.col("id").alias("o_orderkey"), joined(F.array_sort(F.array_distinct("names"))).alias("parts"))


@query("select a.l_orderkey, a.s, case when a.s = b.s then true else false end same from (select l_orderkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) s from lineitem group by 1) a left join (select l_orderkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) s from lineitem where l_linenumber < 3 group by 1) b using (l_orderkey)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("a"), F.collect_list(F.when(F.col("l_linenumber") < 3, F.col("l_returnflag"))).alias("b"))
    whole, first = sets.union(F.col("a"), F.col("b")), F.array_distinct("b")
    return rows.select("l_orderkey", joined(F.array_sort(whole)).alias("s"), (sets.same_set(whole, first) & sets.subset(first, whole) & (F.size(sets.pull(whole, F.lit("?"))) > 0)).alias("same"))


@query("select * from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) place from (select l_orderkey, l_linenumber, l_extendedprice from lineitem)) where place <= 2")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_per(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], n=2, place="place")


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by event_id) r from (select *, row_number() over (partition by value order by event_id) o from events) where o = 1) where r <= 12")
def capped_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cap_per(table(spark, sf_dir, "events"), "user_id", [F.col("event_id")], once="value", n=12).select("event_id", "user_id")


@query("select c_custkey, c_name, c_acctbal, c_mktsegment from (select c_custkey, c_name, coalesce(b, c_acctbal) c_acctbal, c_mktsegment from customer left join (select c_custkey, -1.0::double b from customer where c_custkey % 4 = 0) using (c_custkey)) union all select c_custkey + 1000000, c_name, -1.0, c_mktsegment from customer where c_custkey % 4 = 0")
def table_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = old.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.lit(-1.0))
    # An earlier write of the same keys comes after them, with a greater balance and a lower place in the order of writes.
    later, early = new.unionByName(new.withColumn("c_custkey", F.col("c_custkey") + 1000000)).withColumn("at", F.lit(2)), new.withColumns({"c_acctbal": F.lit(99.0), "at": F.lit(1)})
    return sinks.upsert(old, later.unionByName(early), ["c_custkey"], order="at")


@query("select c_custkey, case when c_custkey % 50 = 7 then -1.0::double else c_acctbal end c_acctbal, c_mktsegment from customer where c_custkey % 40 <> 3 union all select c_custkey + 1000000, -1.0, c_mktsegment from customer where c_custkey % 50 = 7")
def versioned_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert and a delete on a versioned table, each of which rewrites only the buckets of its keys."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")
    stored = Versioned.create(rows, scratch(spark, "customers"), ["c_custkey"], buckets=16)
    new = rows.where("c_custkey % 50 = 7").withColumn("c_acctbal", F.lit(-1.0))
    stored.merge(new.unionByName(new.withColumn("c_custkey", F.col("c_custkey") + 1000000)))
    stored.delete(rows.where("c_custkey % 40 = 3").select("c_custkey"))
    return stored.read()


@query("select c_custkey, c_name, c_acctbal::double c_acctbal from customer where c_acctbal > 0")
def json_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON and read again."""
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    path = scratch(spark, "dump")
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("select c_custkey, is_deleted from (select c_custkey, c_custkey % 6 = 0 is_deleted from customer) where c_custkey % 10 <> 1")
def table_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit(False).alias("is_deleted"))
    return sinks.hard_delete(sinks.soft_delete(rows, rows.where("c_custkey % 6 = 0"), "c_custkey"), rows.where("c_custkey % 10 = 1"), "c_custkey")


@query("select c_custkey from customer where c_custkey % 3 <> 0")
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    return sinks.insert_missing(rows.where("c_custkey % 3 = 0"), rows, ["c_custkey"])


ISSUES = [
    (1, "A", "x@y", "", 91.0, "failed", "name:error,email:warning,phone:info,latitude:error,categories:info"), (2, "Good Name", "a@b.com", "123", 10.0, "validated", "categories:info"), (3, None, None, None, None, "failed", "name:error,email:info,phone:info,categories:info"),
]


@query(values(["id", "name", "email", "phone", "latitude", "status", "issues"], ISSUES))
def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:5] for r in ISSUES], "id long, name string, email string, phone string, latitude double").withColumns({"longitude": F.lit(1.0), "categories": F.array().cast("array<string>"), "website": F.lit("")})
    out = rows.withColumn("found", records.issues("business"))
    return out.select("id", "name", "email", "phone", "latitude", records.status_of(F.col("found")).alias("status"), joined(F.transform("found", lambda i: F.concat_ws(":", i["field"], i["severity"]))).alias("issues"))


@query(f"{_BIZ} select id, case when outcome = 'candidate' and id % 4 = 0 then 'processed' else outcome end outcome from (select id, case when coalesce(case id % 6 when 0 then 'parking' when 1 then null else 'cafe' end, '') in ('', 'parking') then 'blocked' when id % 3 = 0 then 'low_confidence' else 'candidate' end outcome from biz)")
def discovery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = biz(spark, sf_dir)
    places = rows.select(F.col("id").alias("source_id"), "name", F.expr("case id % 6 when 0 then 'parking' when 1 then null else 'cafe' end").alias("category"), F.expr("case when id % 3 = 0 then 0.2D else 0.9D end").alias("confidence"), "lat", "lng")
    far = rows.select(F.col("id"), "name", F.lit(-10.0).alias("lat"), F.lit(10.0).alias("lng"))
    return discovery.candidates(places, far, rows.where("id % 4 = 0").select(F.col("id").alias("source_id"))).select(F.col("source_id").alias("id"), "outcome")


@query(f"{_BIZ} select id, coalesce(not (name = '' or name is null), false) named, is_deleted is distinct from true live from biz")
def null_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biz(spark, sf_dir).select("id", present(F.col("name")).alias("named"), not_true(F.col("is_deleted")).alias("live"))
