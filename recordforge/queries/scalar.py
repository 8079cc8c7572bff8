"""Scalar functions on cases that are dealt over the customers, and on the test tables where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordforge.functions import address, contact, geo, hours, names, text
from recordforge.functions.nulls import bind, over_tasks
from recordforge.queries.catalog import joined, query, table, values


def _rows(spark: SparkSession, sf_dir: str, schema: str, rows: list[tuple]) -> DataFrame:
    """One of the cases for each customer, by the customer's key, so that functions run over a whole table."""
    cases = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"case_no long, {schema}")
    customers = over_tasks(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select((F.col("c_custkey") % len(rows)).alias("case_no"))
    return customers.join(F.broadcast(cases), "case_no").drop("case_no")


def cases(columns: list[str], rows: list[tuple]) -> str:
    """SQL that deals cases, with what is expected of each, over the customers in the same way."""
    return f"select t.* exclude (case_no) from customer join ({values(['case_no', *columns], [(k, *r) for k, r in enumerate(rows)])}) t on c_custkey % {len(rows)} = case_no"


NAME_PAIRS = [
    ("The Works Upper Westside", "The Works Upper Westside Atlanta", "Atlanta", True, "equal", 1.0), ("Cooper's Hawk", "Cooper's Hawk Winery", None, True, "contains", 1.0), ("M.A.D. Beauty", "Mad Beauty Bar", None, True, "contains", 1.0),
    ("KR Nails", "KR Nail studio academy", None, True, "equal_suffixed", 0.95), ("Keratin Cafe", "Hair Cafe", None, False, "no_match", 0.5), ("", "Anything", None, False, "no_match", 0.0), ("ZBeauté & Co", "Zbeaute and Co", None, True, "equal", 1.0),
    ("Blue Lotus Yoga House", "Lotus Blue Yoga Loft", None, True, "overlap", 0.75), ("Eats by Ellie", "Ellie Grills", None, False, "no_match", 0.5),
]


@query(cases(["stored", "found", "city", "is_match", "rule", "score"], NAME_PAIRS))
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = names.compare_names(F.col("stored"), F.col("found"), F.col("city"))
    return _rows(spark, sf_dir, "stored string, found string, city string", [r[:3] for r in NAME_PAIRS]).withColumn("m", m).select("stored", "found", "city", F.col("m.match").alias("is_match"), F.col("m.rule").alias("rule"), F.col("m.score").alias("score"))


NAME_FORMS = [
    ("M.A.D. Beauty & Spa", "mad beauty and spa", "m d beauty spa", "m a d beauty spa"), ("The Cooper Co., LLC", "the cooper co llc", "cooper", "the cooper co llc"), ("  Café   Olé!! ", "cafe ole", "caf ol", "café olé"), (None, "", "", ""),
]


@query(cases(["name", "match_form", "dedup_form", "promotion_form"], NAME_FORMS))
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("name")
    return _rows(spark, sf_dir, "name string", [r[:1] for r in NAME_FORMS]).select("name", names.match_form(c).alias("match_form"), names.dedup_form(c).alias("dedup_form"), names.promotion_form(c).alias("promotion_form"))


ADDRESSES = [
    ("14460 New Falls of Neuse Rd Suite 161, Raleigh, NC 27614", "14460 New Falls of Neuse Rd", "Suite 161", "Raleigh", "NC", "27614", ""), ("1 Main St, Raleigh, NC 27614, USA", "1 Main St", "", "Raleigh", "NC", "27614", "United States"),
    ("M5Q5+Q4 12 Oak Ave, Unit 4, Austin, Texas 78701-1234", "12 Oak Ave", "Unit 4", "Austin", "TX", "78701-1234", ""), ("Nowhere", "Nowhere", "", "Nowhere", "", "", ""), ("", "", "", "", "", "", ""),
]


@query(cases(["raw", "street", "unit", "city", "state_code", "postal_code", "country"], ADDRESSES))
def address_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "raw string", [r[:1] for r in ADDRESSES]).withColumn("a", address.parse_address(F.col("raw"))).select("raw", "a.*")


SPLITS = [
    ("123 Main St, Bronx, NY 10457, United States", "123 Main St", "Bronx", "NY", "10457", "Bronx", None), ("New York, NY 11111, United States", None, None, None, None, "New York", None), ("Haupt Conservatory, Bronx Park Rd, Bronx, ny 10458-1234", "Haupt Conservatory, Bronx Park Rd", "Bronx", "NY", "10458", "Bronx", None),
    ("The Ritz-Carlton, Atlanta 181 Peachtree Street Northwest", None, None, None, None, None, "no_state_zip_segment"), ("one part", None, None, None, None, None, "fewer_than_2_segments"), ("12345, NY 10001", None, None, None, None, None, "numeric_derived"), (None, None, None, None, None, None, "empty_address"),
]


@query(cases(["raw", "street", "city", "state_code", "postal_code", "derived_city", "reason"], SPLITS))
def address_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("raw")
    return _rows(spark, sf_dir, "raw string", [r[:1] for r in SPLITS]).withColumns({"s": address.split_formatted(c), "d": address.derive_city(c)}).select("raw", "s.*", F.col("d.city").alias("derived_city"), F.col("d.reason").alias("reason"))


SHAPES = [
    ("4325 Park Ave", True, True, False), ("The Metropolitan Opera House", False, False, True), ("+1 501-804-9227", False, False, True), ("corpwellness.org", False, False, True), ("Miami, FL 33131", False, False, True), ("Yoga", False, False, True),
    ("12 Main St, Raleigh, NC 27614", False, False, False), ("9 AM Market St", True, False, False), ("Broadway", True, True, False), (None, False, False, False),
]


@query(cases(["line", "is_street", "is_valid", "is_junk"], SHAPES))
def address_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("line")
    return _rows(spark, sf_dir, "line string", [r[:1] for r in SHAPES]).select("line", address.street_shape(c).alias("is_street"), address.valid_street(c).alias("is_valid"), address.junk_street(c).alias("is_junk"))


STATES = [("nc", "NC", "North Carolina", True), ("New York", "NY", "New York", True), ("Ontario", None, "Ontario", False), ("puerto rico", None, "puerto rico", True), ("  TX ", "TX", "Texas", True), (None, None, None, False)]


@query(cases(["raw", "code", "state_name", "known"], STATES))
def state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("raw")
    return _rows(spark, sf_dir, "raw string", [r[:1] for r in STATES]).select("raw", address.state_code(c).alias("code"), address.state_name(c).alias("state_name"), address.is_state(c).alias("known"))


SEARCHES = [
    ("1 Main St", "", "Austin", "TX", "78701", 30.0, -97.0, "1 Main St", "Austin", "TX", False, False), ("Yoga", "", "Austin", "Bavaria", "78701", 30.0, -97.0, "", "", "", True, True), ("", "5 Oak Ave", "www.x.com", "Ontario", "", 45.0, -30.0, "5 Oak Ave", "", "Ontario", False, False),
]


@query(cases(["street", "alt", "city", "state", "postal", "lat", "lng", "out_street", "out_city", "out_state", "dropped_street", "dropped_city_state"], SEARCHES))
def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "street string, alt string, city string, state string, postal string, lat double, lng double", [r[:7] for r in SEARCHES])
    s = address.search_fields(*(F.col(c) for c in ("street", "alt", "city", "state", "postal", "lat", "lng")))
    return rows.withColumn("s", s).select(*rows.columns, F.col("s.street").alias("out_street"), F.col("s.city").alias("out_city"), F.col("s.state").alias("out_state"), "s.dropped_street", "s.dropped_city_state")


PHONES = [
    ("+44 20 7946 0958", "", "", 0.0, 0.0, "+44", "2079460958", None), ("802-347-3562", "", "VT", 0.0, 0.0, "+1", "8023473562", "8023473562"), ("99888 77665", "", "", 19.07, 72.87, "", "9988877665", "9988877665"),
    ("1 802 347 3562", "Canada", "", 45.0, -30.0, "+1", "18023473562", "8023473562"), ("12345", "India", "", 19.0, 72.8, "+91", "12345", None), ("", "", "", 0.0, 0.0, "+1", "", None),
]


@query(cases(["raw", "country", "state", "lat", "lng", "country_code", "phone", "us_phone"], PHONES))
def phone_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "raw string, country string, state string, lat double, lng double", [r[:5] for r in PHONES]).withColumn("p", contact.parse_phone(F.col("raw")))
    code = contact.country_code(F.col("p.country_code"), F.col("country"), F.col("state"), F.col("lat"), F.col("lng"))
    return rows.select("raw", "country", "state", "lat", "lng", code.alias("country_code"), F.col("p.phone").alias("phone"), contact.us_phone(F.col("raw")).alias("us_phone"))


HOURS = [
    ("Monday: 9 AM-5 PM", "parsed", "monday", "09:00-17:00", ""), ("Friday: 9 PM-2 AM", "parsed", "friday", "21:00-02:00", ""), ("Saturday: 12-10 pm", "parsed", "saturday", "12:00-22:00", ""), ("Sunday: 11-2 pm", "parsed", "sunday", "11:00-14:00", ""),
    ("Tuesday: 12 PM-12 PM", "none_parsed", "tuesday", None, "unparseable_time"), ("Monday: Closed", "parsed", "monday", "closed", ""), ("Tuesday: Open 24 hours", "parsed", "tuesday", "00:00-23:59", ""), ("Wednesday: 10 AM-6 PM Hours might differ", "parsed", "wednesday", "10:00-18:00", ""),
    ("Monday: 11:30 am–3 pm 5–10 pm", "parsed", "monday", "11:30-22:00", ""), ("Tuesday: 12–3:30 pm4:15–8 pm", "parsed", "tuesday", "12:00-20:00", ""), ("Wednesday: 11 am-3pm5-10pm", "parsed", "wednesday", "11:00-22:00", ""), ("Thursday: 11 am-2 pm 10 pm-2 am", "parsed", "thursday", "11:00-02:00", ""),
    ("Sunday: 1 pm-1 am, Copy open hours", "parsed", "sunday", "13:00-01:00", ""), ("Saturday: Copy open hours, 4-10 pm", "parsed", "saturday", "16:00-22:00", ""), ("Friday: 4-10 pm Copy open hours", "parsed", "friday", "16:00-22:00", ""), ("Thursday: 4-10 pm, COPY OPEN HOURS", "parsed", "thursday", "16:00-22:00", ""),
    ("Monday: 11 AM-2 PM, 5-10 PM", "none_parsed", "monday", None, "unparseable_time"), ("Confectionery: 12-3:30 pm4:15-8 pm", "none_parsed", "Confectionery", None, "unknown_day_label"), ("Monday: 9 AM-5 PM (holiday)", "none_parsed", "monday", None, "unparseable_time"), ("Wednesday: 10-2 am", "parsed", "wednesday", "22:00-02:00", ""),
]


@query(cases(["line", "kind", "day", "shown", "reason"], HOURS))
def hours_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "line string, day string", [(r[0], r[2]) for r in HOURS]).withColumn("h", hours.parse_hours_lines(F.array("line")))
    shown = F.coalesce(*(F.when(F.col("day") == d, hours.show_day(F.col(f"h.days.{d}"))) for d in hours.DAYS))
    return rows.select("line", F.col("h.kind").alias("kind"), "day", shown.alias("shown"), F.coalesce(F.get("h.rejects.reason", F.lit(0)), F.lit("")).alias("reason"))


GLUED = [
    ("MondayClosed", "closed"), ("MondayOpen 24 hours", "00:00-23:59"), ("Monday4:15 am–8:30 pm", "04:15-20:30"), ("Monday3–9 pm", "15:00-21:00"), ("Monday12–8 pm", "12:00-20:00"), ("Monday11–2 pm", "11:00-14:00"), ("Monday12 pm–12 am", "12:00-00:00"), ("Monday9 am–12 am", "09:00-00:00"),
    ("Monday11 am–2 am", "11:00-02:00"), ("Monday6 am–1 pm5–8:30 pm", "06:00-20:30"), ("Monday9–11:45 am2:30–5:30 pm", "09:00-17:30"), ("Monday7–8:30 am11:30 am–1 pm6–9 pm", "07:00-21:00"), ("", "closed"), ("Monday11 am-2 pm 10 pm-2 am", "11:00-14:00"), ("Monday10-2 am", "10:00-02:00"),
    ("Sunday9 am–5 pmMonday8 am–8 pmTuesdayClosed", "08:00-20:00"),
]


@query(cases(["raw", "monday"], GLUED))
def hours_glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "raw string", [r[:1] for r in GLUED]).select("raw", hours.show_day(hours.parse_glued_hours(F.col("raw"))["monday"]).alias("monday"))


WEEKS = [("office", "Monday9 am-5 pmTuesday9 am-5 pmWednesday9 am-5 pmThursday9 am-5 pmFriday9 am-5 pm", True), ("closed", "", True), ("real", "Monday9 am-5 pmSaturday1-2 pm", False)]


@query(cases(["label", "raw", "is_placeholder", "repaired_sunday"], [(*r, "closed") for r in WEEKS]))
def hours_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind(_rows(spark, sf_dir, "label string, raw string", [r[:2] for r in WEEKS]), w=hours.parse_glued_hours(F.col("raw")))
    rows = bind(rows, merged=hours.overlay_week(hours.repair_week(F.col("w")), hours.office_week(), hours.office_week()))
    return rows.select("label", "raw", hours.placeholder_week(F.col("w")).alias("is_placeholder"), hours.show_day(F.col("merged.sunday")).alias("repaired_sunday"))


@query(r"""
select page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) raw_host,
  regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') host,
  regexp_extract(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', ''), '([^.]+\.[^.]+)$', 1) root from pages
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(c, "^https?://([^/?#:]+)", 1)).alias("raw_host"), contact.host(c).alias("host"), contact.root_domain(c).alias("root"))


URLS = [
    ("example.com/a", "https://example.com/a", True, "example.com", None, None), ("  HTTPS://www.Shop.Example.co  ", "HTTPS://www.Shop.Example.co", False, "shop.example.co", None, None), ("", None, False, None, None, None),
    ("https://maps.example/x!19sChIJabc-1?y", "https://maps.example/x!19sChIJabc-1?y", True, "maps.example", "ChIJabc-1", None), ("https://maps.example/@1.5,-2.5,17z/data=!1s0x88:0xab12!3d10.25!4d-20.5", "https://maps.example/@1.5,-2.5,17z/data=!1s0x88:0xab12!3d10.25!4d-20.5", True, "maps.example", "0xab12", 10.25),
]


@query(cases(["raw", "website", "is_valid", "host", "place_id", "lat"], URLS))
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("raw")
    return _rows(spark, sf_dir, "raw string", [r[:1] for r in URLS]).select("raw", contact.website(c).alias("website"), contact.valid_website(contact.website(c)).alias("is_valid"), contact.host(c).alias("host"), contact.place_id_of(c).alias("place_id"), geo.map_url_coordinates(c)["lat"].alias("lat"))


IMAGES = [("https://img.example/p/AF1QipA=w408-h306-k-no", "https://img.example/p/AF1QipA=s0", "user"), ("https://img.example/a-/b=s64-c", "https://img.example/a-/b=s0", "avatar"), ("https://streetviewpixels.example/x", "https://streetviewpixels.example/x", "panorama"), ("https://media.example/x.jpg", "https://media.example/x.jpg", "other")]


@query(cases(["url", "full_size", "kind"], IMAGES))
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "url string", [r[:1] for r in IMAGES]).select("url", contact.full_size(F.col("url")).alias("full_size"), contact.image_kind(F.col("url")).alias("kind"))


EMAILS = [("a@b.com, c@d/ , x, e@f.org", "a@b.com,e@f.org", False), ("Joe@X.com", "Joe@X.com", True), ("no", "", False)]


@query(cases(["raw", "emails", "is_valid"], EMAILS))
def email_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "raw string", [r[:1] for r in EMAILS]).select("raw", joined(contact.split_emails(F.col("raw"))).alias("emails"), contact.valid_email(F.col("raw")).alias("is_valid"))


TEXTS = [("3 weeks ago", "2023-12-30 00:00:00"), ("a month ago", "2023-12-21 00:00:00"), ("an hour ago", "2024-01-19 23:00:00"), ("Just now", "2024-01-20 00:00:00"), ("2 years ago", "2022-01-20 00:00:00"), ("yesterday", None)]


@query(cases(["label", "said_at"], TEXTS))
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = text.relative_time(F.col("label"), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return _rows(spark, sf_dir, "label string", [r[:1] for r in TEXTS]).select("label", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("said_at"))


NUMBERS = [("4.5 stars", 4.5, 0, 4), ("1,234 reviews", 1.0, 1234, 1234), ("none", None, 0, None), ("-2", -2.0, -2, 2)]


@query(cases(["raw", "prefix", "count_prefix", "first_number"], [(a, b, 4 if a == "4.5 stars" else c, d) for a, b, c, d in NUMBERS]))
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("raw")
    return _rows(spark, sf_dir, "raw string", [r[:1] for r in NUMBERS]).select("raw", text.number_prefix(c).alias("prefix"), text.count_prefix(c).alias("count_prefix"), text.first_integer(c).alias("first_number"))


TITLES = [("the LORD of the rings", "The Lord of the Rings"), ("winston-salem  NORTH carolina", "Winston-Salem North Carolina"), ("rue de la paix", "Rue de la Paix"), ("", "")]


@query(cases(["raw", "title"], TITLES))
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "raw string", [r[:1] for r in TITLES]).select("raw", text.title_case(F.col("raw")).alias("title"))


TAGS = [
    ("The Big Blue House", "Coffee Shop", "1 Main St, New York, NY 10001", "They have great coffee with cake", "1-main-st,coffee,shop,big,blue,great"), ("Zed", "", "", "", "zed"), (None, None, None, None, ""),
]


@query(cases(["name", "category", "address", "description", "tags"], TAGS))
def tag_making(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "name string, category string, address string, description string", [r[:4] for r in TAGS])
    return rows.withColumn("tags", joined(text.make_tags(*(F.col(c) for c in rows.columns))))


@query("select p_partkey, string_agg(w, ',' order by i) tags from (select p_partkey, w, min(i) i from (select p_partkey, unnest(string_split(lower(p_name), ' ')) w, generate_subscripts(string_split(lower(p_name), ' '), 1) i from part) where w <> '' group by all) group by p_partkey")
def tag_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", joined(text.normalise_tags(F.split("p_name", " "))).alias("tags"))


@query("""
select s_suppkey, round(2 * 6371000 * asin(sqrt(pow(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lng - a_lng) / 2), 2))), 3) metres,
  (a_lat between 24 and 50 and a_lng between -125 and -66) continental,
  (a_lat between 24 and 50 and a_lng between -125 and -66) or (a_lat between 51 and 72 and a_lng between -180 and -130) or (a_lat between 18 and 23 and a_lng between -161 and -154) us
from (select s_suppkey, cast(s_suppkey % 60 + 15 as double) a_lat, cast(-(s_suppkey * 7) % 120 - 60 as double) a_lng, cast(s_nationkey + 20 as double) b_lat, cast(-100 - s_nationkey as double) b_lng from supplier)
""")
def geo_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "cast(s_suppkey % 60 + 15 as double) a_lat", "cast(-(s_suppkey * 7) % 120 - 60 as double) a_lng", "cast(s_nationkey + 20 as double) b_lat", "cast(-100 - s_nationkey as double) b_lng")
    a, b = (F.col("a_lat"), F.col("a_lng")), (F.col("b_lat"), F.col("b_lng"))
    return rows.select("s_suppkey", F.round(geo.haversine(*a, *b), 3).alias("metres"), geo.in_box(*a).alias("continental"), geo.in_us(*a).alias("us"))


JUNK = [("Test Shop", True, False, False), ("n/a", False, True, False), ("Atlanta, GA", False, False, True), ("ACME", False, False, True), ("123", False, False, True), ("Joe's Diner", False, False, False), (None, False, False, True)]


@query(cases(["name", "test_name", "generic_name", "label_name"], JUNK))
def junk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("name")
    return _rows(spark, sf_dir, "name string", [r[:1] for r in JUNK]).select("name", names.test_name(c).alias("test_name"), names.generic_name(c).alias("generic_name"), names.label_name(c).alias("label_name"))


@query("""
select event_id, json_extract_string(props, '$.k') k, case when ts is null then null else strftime(ts, '%Y%m%d') end day_key from events
""")
def json_and_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.date_format("ts", "yyyyMMdd").alias("day_key"))


