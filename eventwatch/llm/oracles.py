"""DuckDB SQL for the operators SQL can express."""

from __future__ import annotations

from eventwatch.llm.quality_rules import RULES, STOP_FORMS, SYMBOLS
from eventwatch.llm.sharding import MULTIPLIERS, OFFSETS, ROUNDS

WORD = r"[^\x20\x09-\x0D]+"


def _rule_sql() -> str:
    tests = []
    for r in RULES:
        tests += [f"{r.measure} < {r.low}"] if r.low is not None else []
        tests += [f"{r.measure} > {r.high}"] if r.high is not None else []
    return " or ".join(tests)


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


QUALITY = f"""
with t as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), s as (
  select r, doc_id, text, regexp_extract_all(text, '{WORD}') as w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from t
), windows as (
  select r, i, array_to_string(w[i:i + 7], ' ') as win from s, unnest(range(1, len(w) - 6)) u(i) where len(w) >= 8
), twice as (
  select r, i from windows qualify count(*) over (partition by r, win) > 1
), covered as (
  select r, count(distinct i + k) as n from twice, range(8) x(k) group by r
), m as (
  select s.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words,
         len(list_filter(w, lambda x: x in ({_quoted(STOP_FORMS)}))) as n_stop
  from s left join covered c using (r)
), f as (
  select *, word_chars / greatest(n_words, 1) as mean_word_length, n_symbols / greatest(n_words, 1) as symbol_ratio,
         n_stop / greatest(n_words, 1) as stop_word_ratio, n_dup_lines / greatest(n_lines, 1) as dup_line_ratio,
         n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not ({_rule_sql()}) as kept from f
"""


def _round(x: str, k: int) -> str:
    y = f"(({x} + {OFFSETS[k]}) * {MULTIPLIERS[k]}) & 4294967295"
    y = f"((xor({y}, ({y}) >> 15)) * {MULTIPLIERS[(k + 1) % ROUNDS]}) & 4294967295"
    return f"xor({y}, ({y}) >> 13)"


SHARDING = f"""
with recursive base as (
  select doc_id, (strlen(coalesce(text, '')) + 1)::bigint as size, coalesce(text, '') as text from documents
), crc_table as (
  select b, list_reduce(list_prepend(b::ubigint, range(8)::ubigint[]),
         lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as v from range(256) t(b)
), crc_list as (select list(v order by b) as vs from crc_table
), crcs as (
  select doc_id, size, xor(list_reduce(
           list_prepend(4294967295::ubigint, list_transform(range(size - 1), lambda i: ('0x' || substr(hex(encode(text)), (2 * i + 1)::int, 2))::ubigint)),
           lambda c, x: xor(vs[((xor(c, x) & 255) + 1)::bigint], c >> 8)), 4294967295::ubigint)::bigint as text_crc32
  from base, crc_list
), n as (select count(*)::hugeint as n, (floor(sqrt(count(*) - 1)) + 1)::hugeint as a from documents
), grid as (select n, a, (n + a - 1) // a as b from n
), rows as (
  select doc_id, size, text_crc32, row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as i from crcs
), walk as (
  select i, i::hugeint as v, 0 as step from rows
  union all
  select i, x4 * b + y4 as v, step + 1 from (
    select *, (y2 + ({_round('x3', 3)})) % b as y4, x3 as x4 from (
      select *, (x1 + ({_round('y2', 2)})) % a as x3 from (
        select *, (y0 + ({_round('x1', 1)})) % b as y2 from (
          select *, (x0 + ({_round('y0', 0)})) % a as x1 from (
            select i, step, v // b as x0, v % b as y0, a, b, n from walk, grid where step = 0 or v >= n))))
  )
), last as (select i, arg_max(v, step) as place from walk group by i)
select doc_id, size, text_crc32, 'rows' as law, (place % 16)::int as shard, (place // 16)::bigint as slot,
       null::int as grown_shard
from rows join last using (i)
"""

HARD_NEGATIVES = """
with v as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, (row_number() over w)::int as rank, n.vec_id as negative_id, positive_score, n.score as negative_score
from positives join scored n using (anchor_id)
where not n.same and 80 * positive_score <= 100 * n.score and 100 * n.score <= 100 * positive_score
window w as (partition by anchor_id, positive_id order by n.score desc, n.vec_id)
qualify row_number() over w <= 5
"""

# words near each other leave the same rest without the letter at one place, or one is the rest of the other
SPELLING = r"""
with recursive runs as (
  select coalesce(doc_id::varchar, '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as c
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents)
  where length(run) >= 7 group by 1, 2
), crc_table as (
  select b, list_reduce(list_prepend(b::ubigint, range(8)::ubigint[]),
         lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as v from range(256) t(b)
), crc_list as (select list(v order by b) as vs from crc_table
), crcs as (
  select run, c, xor(list_reduce(
           list_prepend(4294967295::ubigint, list_transform(range(strlen(id || ':' || run)), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), (2 * i + 1)::int, 2))::ubigint)),
           lambda c, x: xor(vs[((xor(c, x) & 255) + 1)::bigint], c >> 8)), 4294967295::ubigint)::bigint as h
  from runs, crc_list
), w as (
  select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run) + 2)::int) else run end as word,
         sum(c)::bigint as n
  from crcs group by 1 having length(word) >= 7 and n >= 2
), rests as (
  select word, n, i, substr(word, 1, (i - 1)::int) || substr(word, (i + 1)::int) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from w)
), pairs as (
  select a.word as word, b.word as other, b.n from rests a join rests b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select rests.word, w.word, w.n from rests join w on rest = w.word
  union select w.word, rests.word, rests.n from rests join w on rest = w.word
), best as (
  select word, count(*)::bigint as n_near, min({'k': -n, 'w': other}) as b from (select distinct * from pairs) group by word
), formed as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near,
         case when -b.k >= 10 * w.n then b.w end as form, case when -b.k >= 10 * w.n then -b.k end::bigint as form_n
  from w left join best using (word)
), chain as (
  select word, form as root, 1 as d from formed where form is not null
  union all
  select chain.word, formed.form, d + 1 from chain join formed on chain.root = formed.word where formed.form is not null
), ends as (select word, arg_max(root, d) as root from chain group by word)
select word, form, coalesce(root, word) as root, n, n_near, form_n from formed left join ends using (word)
"""

ORACLES = {
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_spelling_variants": SPELLING,
    "op3_sharding": SHARDING,
    "op7_quality_rules": QUALITY,
}
