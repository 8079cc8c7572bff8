"""The numbered queries over the test tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordforge.llm.chat import format_chats
from recordforge.llm.decontamination import contamination_report, find_contamination
from recordforge.llm.html_text import main_texts
from recordforge.llm.licenses import find_licenses
from recordforge.llm.merkle import manifest
from recordforge.llm.near_dup import near_duplicates
from recordforge.llm.packing import pack_documents
from recordforge.llm.phrases import collocations
from recordforge.llm.pii import find_pii, pii_report
from recordforge.llm.quality import quality_rules
from recordforge.llm.secrets import find_secrets, secret_report
from recordforge.llm.store import scratch
from recordforge.llm.token_counts import count_tokens
from recordforge.llm.url_filter import filter_urls

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(find_secrets(_table(spark, sf_dir, "documents")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(_table(spark, sf_dir, "documents"))
    said = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), m["matched"].cast("string"), m["size"].cast("string")))
    return found.select("doc_id", "n_words", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(said, ",").alias("licenses"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


#: JSON schemas of the tools that conversations may call.
TOOLS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "weather": {"properties": {"city": {"type": "string"}, "days": {"type": "number"}}, "required": ["city"]},
}


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(_table(spark, sf_dir, "conversations"), TOOLS)
    return out.withColumns({"call_id": F.coalesce("call_id", F.lit("")), "problems": F.array_join("problems", ",")})


#: The conversations' turns as tool use, in SQL that Spark and DuckDB both read: an assistant's turn makes two calls, the
#: second of which waits for the turn's first and for the second of the turn before; the next turn is a tool that answers.
#: By conversation and turn there are repeated ids, missing answers, cycles, unknown tools and wrong, missing or odd arguments.
TOOL_TURNS = """
select conv_id, turn, case when role = 'assistant' then 'assistant' else 'tool' end role, case when role = 'assistant' then concat(
  '{"content": null, "tool_calls": [{"id": "a', cast(case when conv_id % 5 = 0 then 1 else turn end as varchar(9)), '", "name": "', case when conv_id % 7 = 0 then 'nothing' else 'search' end, '", "arguments": {',
  case conv_id % 4 when 0 then '"query": "q"' when 1 then '"query": "q", "limit": "many"' when 2 then '"limit": 3' else '"query": "q", "other": [1]' end, '}', case when conv_id % 6 = 0 then concat(', "depends_on": ["b', cast(turn as varchar(9)), '"]') else '' end,
  '}, {"id": "b', cast(turn as varchar(9)), '", "name": "weather", "arguments": {"days": 1.5, "city": "', cast(conv_id as varchar(9)), '"}, "depends_on": ["a', cast(turn as varchar(9)), '", "b', cast(turn - 2 as varchar(9)), '"]}]}')
  else concat('{"tool_call_id": "', case when turn % 4 = 0 then 'a' else 'b' end, cast(turn - 1 as varchar(9)), '", "content": {"z": 1, "a": ', cast(turn as varchar(9)), '}}') end text
from {conversations} where role in ('assistant', 'user')
"""


def tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of made tool use in all conversations: status, what the schema objects to, and the place in the order."""
    turns = spark.sql(TOOL_TURNS.replace("{conversations}", "{c}").replace("{", "{{").replace("}", "}}").replace("{{c}}", "{c}"), c=_table(spark, sf_dir, "conversations"))
    out = format_chats(turns, TOOLS).where("role <> 'assistant'")
    return out.withColumn("problems", F.array_join("problems", ",")).withColumn("order_level", F.when(F.col("status") != "cycle", F.col("order_level"))).select("conv_id", "turn", "role", "call_id", "status", "problems", "message", "order_turn", "order_level", "order_place")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(find_pii(_table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


#: Rules (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The block list, in SQL that Spark and DuckDB both read: hosts with all below them, and single pages of hosts.
LISTED = """
select concat('https://', site, '.example.', top, '/') url from (values ('spam-farm'), ('cheap-pills'), ('casino-win'), ('free-bets'), ('ads-track'), ('adult-x')) s(site), (values ('com'), ('net'), ('org')) t(top)
union all select concat('https://listed-', cast(id as varchar(9)), '.example.', top, '/') from {numbers} n(id), (values ('com'), ('net'), ('org')) t(top)
union all select concat('https://', site, '.example.', top, '/', lang, '/', cast(id as varchar(9))) from {numbers} n(id), (values ('ththon'), ('ththan'), ('tionsh')) s(site), (values ('com'), ('org')) t(top), (values ('en'), ('fr')) l(lang) where id % 2 = 0
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), spark.sql(LISTED.format(numbers="range(10000)")), URL_RULES)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts with what an earlier run over a tenth of the documents left in it, so that the others' join with it counts."""
    docs, tokenizer, cache = _table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), scratch(spark, "token-cache")
    count_tokens(docs.where("doc_id % 10 = 0"), tokenizer, cache)
    return count_tokens(docs, tokenizer, cache)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages")).withColumnRenamed("page", "page_id")


#: What op13's leaves digest, in order.
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = {"text": F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return manifest(_table(spark, sf_dir, "documents"), LEAF_FIELDS, changed=changed).withColumnRenamed("id", "doc_id")


# The conversations hold no tool calls, so each message is plain; tool_call_links has calls made from them.
OP4_SQL = """
select conv_id, turn, role, '' call_id, 'plain' status, '' problems,
  '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}' message,
  turn order_turn, 0 order_level, 0 order_place, 0 order_kind
from conversations
"""

_SORTED = "'{' || array_to_string(list_transform(list_sort(json_keys(X)), lambda k: '\"' || k || '\":' || json_extract(X, '$.' || k)::varchar), ',') || '}'"

TOOL_CALL_LINKS_SQL = f"""
with recursive t as ({TOOL_TURNS.replace("{conversations}", "conversations").replace("{", "{{").replace("}", "}}").format()}),
c as (select conv_id, turn, place, call ->> '$.id' id, call ->> '$.name' as name, json_extract(call, '$.arguments') args, json_extract(call, '$.depends_on')::varchar[] deps,
  row_number() over (partition by conv_id, call ->> '$.id' order by turn, place) nth
  from (select conv_id, turn, place, json_extract(text, '$.tool_calls[' || place || ']') call from t, (values (0), (1)) p(place) where role = 'assistant')),
r as (select conv_id, turn, text ->> '$.tool_call_id' id, json_extract(text, '$.content') content, row_number() over (partition by conv_id, text ->> '$.tool_call_id' order by turn) nth from t where role = 'tool'),
edge as (select b.conv_id, a.id before, b.id, b.turn from c b, c a where a.conv_id = b.conv_id and a.nth = 1 and b.nth = 1 and list_contains(b.deps, a.id)),
walk as (select conv_id, id, 0 lev, turn from c where nth = 1 union select w.conv_id, e.id, lev + 1, greatest(w.turn, e.turn) from walk w join edge e on e.conv_id = w.conv_id and e.before = w.id where lev < 60),
place as (select conv_id, id, case when max(lev) < 60 then max(lev) end lev, case when max(lev) < 60 then max(turn) end anchor from walk group by all),
said as (select c.*, array_to_string(list_sort(list_filter(case
  when name = 'search' then [case when not json_exists(args, '$.query') then 'missing:query' end, case when json_type(args, '$.query') <> 'VARCHAR' then 'type:query' end, case when json_type(args, '$.limit') not in ('UBIGINT', 'BIGINT') then 'type:limit' end]
    || list_transform(list_filter(json_keys(args), lambda k: k not in ('query', 'limit')), lambda k: 'unknown:' || k)
  when name = 'weather' then [case when not json_exists(args, '$.city') then 'missing:city' end, case when json_type(args, '$.city') <> 'VARCHAR' then 'type:city' end, case when json_type(args, '$.days') not in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'type:days' end]
  else ['unknown_tool'] end, lambda x: x is not null)), ',') problems from c),
calls as (select s.conv_id, s.turn, 'call' role, s.id call_id, case when s.nth > 1 then 'duplicate_id' when lev is null then 'cycle' when a.id is null then 'no_result' else 'linked' end status, problems,
  '{{"arguments":' || {_SORTED.replace("X", "args")} || ',"id":"' || s.id || '","name":"' || name || '"}}' message, coalesce(anchor, s.turn) order_turn, coalesce(lev + 1, 1073741824) order_level, place order_place
  from said s join place p on p.conv_id = s.conv_id and p.id = s.id left join r a on a.conv_id = s.conv_id and a.id = s.id and a.nth = 1),
results as (select r.conv_id, r.turn, 'tool' role, r.id call_id, case when f.id is null then 'no_call' when r.nth > 1 then 'duplicate_result' else 'linked' end status, '' problems,
  '{{"content":' || {_SORTED.replace("X", "content")} || ',"role":"tool","tool_call_id":"' || r.id || '"}}' message, coalesce(anchor, f.turn, r.turn) order_turn, case when f.id is null then 0 else coalesce(lev + 1, 1073741824) end order_level, coalesce(f.place, 0) order_place
  from r left join c f on f.conv_id = r.conv_id and f.id = r.id and f.nth = 1 left join place p on p.conv_id = r.conv_id and p.id = r.id)
select * replace (case when status <> 'cycle' then order_level end as order_level) from (select * from calls union all select * from results)
"""

OP7_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
test as (select distinct item_id, least(10, len(w)) k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') s
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
run as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from test) where len(w) >= k)),
found as (select doc_id, item_id, i, run.k from run join test on run.k = test.k and run.s = test.s),
hit as (select doc_id, count(*) n from (select distinct doc_id, unnest(range(i, i + k)) p from found) group by all),
item as (select doc_id, count(*) n, string_agg(s, ',' order by s) s from (select distinct doc_id, item_id::varchar s from found) group by all)
select d.doc_id, len(w)::bigint n_words, coalesce(hit.n, 0)::bigint n_hit, coalesce(item.n, 0)::bigint n_items,
  sha256(coalesce(item.s, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
from d left join hit using (doc_id) left join item using (doc_id)
"""

OP8_SQL = rf"""
with listed as (select regexp_extract(url, '://([^/]*)', 1) h, regexp_extract(url, '://[^/]*(.*)$', 1) p from ({LISTED.format(numbers="range(10000)")})),
u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
r as (select *, case
  when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from u)
select page_id, host, path, rule, case rule when 'example.net/en/' then 'allow' when 'example.com/de/' then 'block' when 'org/fr/' then 'allow' when 'net/' then 'block'
  else case when exists (select 1 from listed l where l.h in (select array_to_string(list_slice(string_split(r.host, '.'), i, 99), '.') from (select unnest(range(1, 99)) i) where i <= len(string_split(r.host, '.'))) and l.p in ('/', r.path)) then 'block' else 'allow' end end as verdict
from r
"""

OP10_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') s
  from (select doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from sh group by all),
inter as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
link as (select a, b from inter join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
comp as (select a doc_id, least(a, min(b)) c from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c, d.doc_id) component_id, coalesce(c, d.doc_id) = d.doc_id kept
from d left join n using (doc_id) left join comp using (doc_id)
"""

OP11_SQL = rf"""
with w as (select coalesce(lang, 'und') lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') w from documents),
total as (select lang, sum(len(w)) n from w group by all),
f as (select lang, g, count(*) f from (select lang, w[i:i + k - 1] g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, range(1, 6) r(k))) group by all having f >= 100),
cand as (select lang, g, f from f where len(g) > 1),
inside as (select lang, g[i:j] g, max(f) f from (select lang, g, f, i, unnest(range(i + 1, least(i + len(g) - 1, len(g) + 1))) j from (select *, unnest(range(1, len(g))) i from cand)) group by all),
cut as (select c.lang, c.g, c.f a, k, l.f l, r.f r, n, (1000::hugeint * c.f * n) // (l.f::hugeint * r.f) score
  from (select *, unnest(range(1, len(g))) k from cand) c join f l on l.lang = c.lang and l.g = c.g[1:k] join f r on r.lang = c.lang and r.g = c.g[k + 1:] join total on total.lang = c.lang),
best as (select lang, g, arg_min(struct_pack(a, l, r, n, score), struct_pack(score, k)) x from cut group by all)
select lang, rank, phrase, a, l, r, n::bigint n, score::bigint score from (
  select b.lang, array_to_string(b.g, ' ') phrase, x.a, x.l, x.r, x.n, x.score, row_number() over (partition by b.lang order by x.score desc, x.a desc, array_to_string(b.g, ' ')) as rank
  from best b left join inside i on i.lang = b.lang and i.g = b.g where i.f is null or i.f < x.a) where rank <= 2000
"""

_NODE = "sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))"
_FIELD = "case when {0} is null then '-' else strlen({0}::varchar) || ':' || {0}::varchar end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in LEAF_FIELDS[:-1]) + " || " + _FIELD.format("{text}") + ")"
# A path holds, for each level, the run's digests before and after the own one. The checksum is CRC-32, bit by bit.

OP13_SQL = f"""
with recursive d as (select doc_id, source k, {_LEAF.format(text="text")} leaf,
    case when list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda z, j: xor(z >> 1, 3988292384 * (z & 1)))) % 2 = 1
    then {_LEAF.format(text="replace(text, chr(10), '')")} else {_LEAF.format(text="text")} end changed,
    row_number() over (partition by source order by doc_id nulls first) - 1 place from documents),
tree as (select k, 0 lev, list(leaf order by place) nodes from d group by k
  union all select k, lev + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: {_NODE}) from tree where len(nodes) > 1),
sub as (select k, nodes[1] subroot, row_number() over (order by k nulls first) - 1 place from tree where len(nodes) = 1),
top as (select 0 k, 0 lev, list(subroot order by place) nodes from sub
  union all select 0, lev + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: {_NODE}) from top where len(nodes) > 1),
over_path as (select 0 k, place, []::varchar[][][] path, place p from sub
  union all select o.k, place, list_append(path, [list_slice(nodes, p - p % 3 + 1, p), list_slice(nodes, p + 2, p - p % 3 + 3)]), p // 3
  from over_path o join top t on t.lev = len(path) where len(nodes) > 1),
own_path as (select k, place, []::varchar[][][] path, place p from d
  union all select o.k, place, list_append(path, [list_slice(nodes, p - p % 3 + 1, p), list_slice(nodes, p + 2, p - p % 3 + 3)]), p // 3
  from own_path o join tree t on t.k is not distinct from o.k and t.lev = len(path) where len(nodes) > 1),
own as (select k, place, arg_max(path, len(path)) path from own_path group by all),
above as (select place, arg_max(path, len(path)) path from over_path group by all),
proof as (select d.doc_id, leaf, changed, subroot, (select nodes[1] from top where len(nodes) = 1) root, list_concat(own.path, above.path) path
  from d join own on own.k is not distinct from d.k and own.place = d.place join sub on sub.k is not distinct from d.k join above on above.place = sub.place),
fold as (select doc_id, changed cur, path, 0 lev from proof
  union all select doc_id, sha256(array_to_string(path[lev + 1][1], '') || cur || array_to_string(path[lev + 1][2], '')), path, lev + 1 from fold where lev < len(path))
select p.doc_id, leaf, subroot, root, sha256(array_to_string(flatten(flatten(p.path)), '')) proof_sha256, f.cur folded_root, f.cur = root verified
from proof p join fold f on f.doc_id = p.doc_id and f.lev = len(f.path)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_licenses": op2_licenses,
    "op3_quality": op3_quality,
    "op4_chat_format": op4_chat_format,
    "tool_call_links": tool_call_links,
    "op5_pack": op5_pack,
    "op6_pii": op6_pii,
    "op7_decontaminate": op7_decontaminate,
    "op8_url_filter": op8_url_filter,
    "op9_token_counts": op9_token_counts,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_phrases": op11_phrases,
    "op12_html_text": op12_html_text,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {"op4_chat_format": OP4_SQL, "tool_call_links": TOOL_CALL_LINKS_SQL, "op7_decontaminate": OP7_SQL, "op8_url_filter": OP8_SQL, "op10_near_duplicates": OP10_SQL, "op11_phrases": OP11_SQL, "op13_merkle": OP13_SQL}
