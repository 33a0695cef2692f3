"""The registered queries of this subpackage, with production parameters, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.llm.align import align_tokenizers
from gridlume.llm.curvepack import pack_along_curve
from gridlume.llm.decontam import contaminated_documents
from gridlume.llm.divergence import source_divergence
from gridlume.llm.importance import importance_resample
from gridlume.llm.lmscore import cross_entropy_difference
from gridlume.llm.neardup import near_duplicates
from gridlume.llm.packing import pack_documents
from gridlume.llm.phrasedup import repeated_strings
from gridlume.llm.quality import BASE_RULES, RULES, quality_rules
from gridlume.llm.secrets import secret_spans
from gridlume.llm.toolcalls import link_tool_calls
from gridlume.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The file of a public vocabulary, installed on every machine; never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, tokenizer_file(), size=4096, end_id=1)


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), report=REPORT).select("doc_id", *REPORT, "base_failed", "kept")


#: The one tool of ``tool_calls_of``: answers of under 40 characters break its schema.
ANSWER_TOOL = {"answer": {"type": "object", "required": ["n_chars"], "properties": {"n_chars": {"type": "integer", "minimum": 40}, "after": {"type": "string"}}, "additionalProperties": False}}


def tool_calls_of(chats: DataFrame) -> DataFrame:
    """A conversation as one with tools, as the table holds no calls: each assistant turn calls ``answer``, and each user
    turn is the result of the turn before it (of none, at the beginning: an orphan). An answer of one line comes after the answer two turns
    before it, one of several lines after the answer two turns later; two that name each other are a cycle."""
    ref = F.concat(F.lit("c"), F.col("turn") + F.when(F.contains("text", F.lit("\n")), 2).otherwise(-2))
    after = F.struct(ref.alias("$ref"))
    call = F.struct(F.struct(after.alias("after"), F.length("text").alias("n_chars")).alias("arguments"), F.concat(F.lit("c"), F.col("turn")).alias("id"), F.lit("answer").alias("name"))
    asked = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), F.array(call).alias("tool_calls")))
    result = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), F.concat(F.lit("c"), F.col("turn") - 1).alias("tool_call_id")))
    is_user = F.col("role") == "user"
    return chats.select("conv_id", "turn", F.when(is_user, "tool").otherwise(F.col("role")).alias("role"), F.when(is_user, result).when(F.col("role") == "assistant", asked).otherwise(F.col("text")).alias("text"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(tool_calls_of(table(spark, sf_dir, "conversations")), tools=ANSWER_TOOL)


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), _good(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("text_key")


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("spans")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), _good(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(table(spark, sf_dir, "documents"), tokenizer_file(), size=2048, end_id=1)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_tool_calls, op3_importance, op4_secrets, op5_near_duplicates, op6_repeated_strings, op7_lm_scores, op8_packing, op9_decontamination, op10_toxicity, op11_curve_packing, op12_alignment, op13_source_divergence, pipeline)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_EXTRA = " or ".join(f"({r.sql})" for r in RULES if r.name not in BASE_RULES)

OP1_SQL = rf"""
with w as (select doc_id, text, {_WORDS} as words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
win as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
tri as (select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from win),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from tri) where n > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by 1),
m as (
  select w.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(cov.n, 0)::bigint as n_repeat_words, len(lines) as n_lines
  from w left join cov on w.doc_id = cov.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or {_EXTRA}) as kept
from m
"""

OP2_SQL = """
with recursive calls as (
  select conv_id, turn, role, coalesce(text, '') as text, turn + case when contains(text, chr(10)) then 2 else -2 end as needs, length(text) as n from conversations where role = 'assistant'),
size as (select conv_id, count(*) as most from calls group by 1),
walk as (
  select conv_id, turn as first, turn as here, 0 as k from calls
  union all select w.conv_id, w.first, d.turn, w.k + 1 from walk w join calls c on c.conv_id = w.conv_id and c.turn = w.here join calls d on d.conv_id = c.conv_id and d.turn = c.needs join size s on s.conv_id = w.conv_id where w.k < s.most),
walked as (select w.conv_id, first as turn, max(k) = any_value(most) as cycle, max({'turn': here, 'rank': 1 + 2 * k}) as reach from walk w join size s on s.conv_id = w.conv_id group by 1, 2),
placed as (
  select c.*, cycle, case when cycle then {'turn': c.turn, 'rank': 1} else reach end as place, u.turn as answer
  from calls c join walked w on w.conv_id = c.conv_id and w.turn = c.turn left join conversations u on u.conv_id = c.conv_id and u.turn = c.turn + 1 and u.role = 'user')
select conv_id, turn, 0::int as pos, role, 'message' as kind, null::varchar as call_id, null::varchar as name, null::varchar as status, null::varchar as problem,
  null::bigint as linked_turn, turn as order_turn, 0::bigint as order_rank, json_object('content', coalesce(text, ''), 'role', role)::varchar as json
from conversations where role <> 'user'
union all
select conv_id, turn, 1, role, 'call', 'c' || turn, 'answer',
  case when n is null or n < 40 then 'invalid' when cycle then 'cycle' when answer is null then 'unanswered' else 'ok' end, case when n is null then '$.n_chars: missing' when n < 40 then '$.n_chars: out of range' end,
  answer, place.turn, place.rank, '{"arguments":{"after":{"$ref":"c' || needs || '"}' || coalesce(',"n_chars":' || n, '') || '},"id":"c' || turn || '","name":"answer"}'
from placed
union all
select u.conv_id, u.turn, 0, 'tool', 'result', 'c' || (u.turn - 1), null, case when c.turn is null then 'orphan' else 'ok' end, null, c.turn,
  case when place.turn > u.turn then place.turn else u.turn end, case when place.turn > u.turn or place.turn = u.turn and place.rank + 1 > 2 then place.rank + 1 else 2 end,
  json_object('content', coalesce(u.text, ''), 'role', 'tool', 'tool_call_id', 'c' || (u.turn - 1))::varchar
from conversations u left join placed c on c.conv_id = u.conv_id and c.turn = u.turn - 1 where u.role = 'user'
"""

OP5_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') as words from documents),
sh as (
  select distinct doc_id, unnest(case when len(words) >= 4 then list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as both_ from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * both_ >= 80 * (p.n + q.n - both_)),
edges as (select x as u, y as v from links union select y, x from links),
reach as (select doc_id as u, doc_id as v from documents union select r.u, e.v from reach r join edges e on r.v = e.u),
comp as (select u, min(v) as component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join comp on comp.u = d.doc_id left join n on n.doc_id = d.doc_id
"""



OP6_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, p, hash(substr(x, 2 * p + 1, 200)) as h from (select doc_id, x, unnest(range(0, length(x) // 2 - 99)) as p from d)),
r as (select doc_id, p from (select doc_id, p, row_number() over (partition by h order by doc_id, p) as k from w) where k > 1),
e as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from r),
g as (select doc_id, p, sum(case when before is null or p > before + 100 then 1 else 0 end) over (partition by doc_id order by p) as run from e),
s as (select doc_id, run, min(p) as a, max(p) + 100 as b from g group by 1, 2),
s2 as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as prev from s),
k as (select s2.doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' order by a) as head, max(b) as last from s2 join d using (doc_id) group by s2.doc_id)
select d.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256 from d left join k on k.doc_id = d.doc_id
"""


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_spans(pattern: str, kind: int, keep: str = "true") -> str:
    """DuckDB: (start, kind, end, body) of the leftmost matches, from the lengths between and of them."""
    p = _sql_text(pattern)
    return f"""list_filter(list_transform(regexp_extract_all(t, {p}), lambda m, i: (
    list_sum(list_transform(regexp_split_to_array(t, {p})[1:i], lambda g: length(g)))::bigint + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i - 1], lambda b: length(b))), 0)::bigint, {kind},
    list_sum(list_transform(regexp_split_to_array(t, {p})[1:i], lambda g: length(g)))::bigint + list_sum(list_transform(regexp_extract_all(t, {p})[1:i], lambda b: length(b)))::bigint, m)), lambda s: {keep})"""


def _op4_sql() -> str:
    from gridlume.llm import secrets as s

    long = f"length(regexp_extract(s[4], {_sql_text(s.ASSIGN)}, 2)) >= 12"
    bits = "case " + " ".join(f"when regexp_matches(body, {_sql_text(c.whole)}) then {c.bits}" for c in s.CLASSES) + " end"
    allowed = " or ".join(f"regexp_matches(body, {_sql_text(p)})" for p in s.ALLOW)
    joined = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda s: ['assign', 'access', 'hex', 'entropy'][s[2] + 1] || ':' || s[1] || ':' || s[3]), ','), '')"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
b as (select doc_id, t, list_sort(list_concat({_sql_spans(s.ASSIGN, 0, long)}, {_sql_spans(s.ACCESS, 1)}, {_sql_spans(s.HEX, 2)})) as base, {_sql_spans(s.CANDIDATE, 3)} as cand from d),
cand as (select doc_id, x[1] as a, x[3] as z, x[4] as body from (select doc_id, unnest(cand) as x from b)),
cuts as (select cand.doc_id, a, z, body, x[1] as s, x[3] as e from cand join (select doc_id, unnest(base) as x from b) o on o.doc_id = cand.doc_id and x[1] < z and a < x[3]),
pieces as (
  select doc_id, a, body, greatest(a, coalesce(max(e) over (partition by doc_id, a order by s, e rows between unbounded preceding and 1 preceding), a)) as p, s as q from cuts
  union all select doc_id, a, body, greatest(a, max(e)), z from cuts group by doc_id, a, z, body
  union all select doc_id, a, body, a, z from cand where not exists (from cuts where cuts.doc_id = cand.doc_id and cuts.a = cand.a)),
whole as (select doc_id, p, substr(body, (p - a + 1)::bigint, (q - p)::bigint) as body from pieces where q - p >= {s.WINDOW}),
parts as (select doc_id, p, regexp_split_to_array(body, {_sql_text(s.ALLOW_PARTS)}) as g, regexp_extract_all(body, {_sql_text(s.ALLOW_PARTS)}) as m from whole),
gaps as (select doc_id, p, g, m, unnest(range(1, len(g) + 1)) as i from parts),
c as (select doc_id, a, (a + length(body))::bigint as z, body from (
  select doc_id, g[i] as body, (p + coalesce(list_sum(list_transform(g[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as a from gaps) where length(body) >= {s.WINDOW}),
w as (select doc_id, a, z, body, unnest(range(1, length(body) - {s.WINDOW} + 2)) as i from c where regexp_matches(body, '[0-9]') and regexp_matches(body, '[A-Za-z]') and not ({allowed})),
h as (select doc_id, a, z, body, list_sum(list_transform(list_distinct(string_split(substr(body, i, {s.WINDOW}), '')), lambda c: -((length(substr(body, i, {s.WINDOW})) - length(replace(substr(body, i, {s.WINDOW}), c, ''))) / {s.WINDOW}.0::double) * log2((length(substr(body, i, {s.WINDOW})) - length(replace(substr(body, i, {s.WINDOW}), c, ''))) / {s.WINDOW}.0::double))) as bits from w),
e as (select doc_id, list((a, 3, z, body)) as more from (select doc_id, a, z, body from h group by all having max(bits) >= any_value({bits}) - 1e-9) group by 1)
select b.doc_id, len(list_filter(base, lambda s: s[2] = 0))::bigint as n_assign, len(list_filter(base, lambda s: s[2] = 1))::bigint as n_access, len(list_filter(base, lambda s: s[2] = 2))::bigint as n_hex,
  sha256({joined('base')}) as base_sha256, {joined('list_sort(list_concat(base, coalesce(more, [])))')} as spans
from b left join e on e.doc_id = b.doc_id
"""


OP13_SQL = r"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*)::hugeint as n from w group by all),
k as (select lang, term, count(*)::hugeint as total from w group by all having count(distinct row) >= 10),
l as (select d.lang, coalesce(any_value(v), 0) as v, coalesce(any_value(size), 0) as size from d left join (select lang, count(*)::hugeint as v, sum(total)::hugeint as size from k group by 1) x on x.lang = d.lang group by 1),
g as (select d.lang, d.source, coalesce(any_value(s.size), 0)::hugeint as size from d left join (select c.lang, c.source, sum(n)::hugeint as size from c join k on k.lang = c.lang and k.term = c.term group by all) s on s.lang = d.lang and s.source = d.source group by all),
cell as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.size + 2 * l.v) as p, 1 + 1000000000::hugeint * (k.total + 2) // (l.size + 2 * l.v) as q
  from g join l on l.lang = g.lang join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::hugeint as value from cell a join cell b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pair.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from cell where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as r from every)
select lang, source, part, item, value::bigint as value, r::int as rank from ranked where part = 'pair' or r <= 10
"""


ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op2_tool_calls": OP2_SQL, "op4_secrets": _op4_sql(), "op5_near_duplicates": OP5_SQL, "op6_repeated_strings": OP6_SQL, "op13_source_divergence": OP13_SQL}
