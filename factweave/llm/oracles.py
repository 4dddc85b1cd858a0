"""DuckDB SQL for what of the training-data operators SQL can express."""

from __future__ import annotations


def _kind(name: str, pattern: str, keep: str) -> str:
    """Leftmost matches of a pattern in `texts` that pass a test, with their places."""
    return f"""{name}_parts as (select doc_id, regexp_extract_all(t, '{pattern}') as hits, string_split_regex(t, '{pattern}') as gaps from texts),
    {name}_rows as (select doc_id, unnest(hits) as hit, generate_subscripts(hits, 1) as k, hits, gaps from {name}_parts where len(hits) > 0),
    {name} as (select doc_id, '{name}' as kind, hit, cast(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) as bigint) as start
               from {name}_rows where {keep})"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_DIGIT = f"cast(reverse({_DIGITS})[i] as int)"
_LUHN = f"""len({_DIGITS}) between 13 and 19 and list_sum(list_transform(range(1, len({_DIGITS}) + 1),
    lambda i: case when i % 2 = 1 then {_DIGIT} else {_DIGIT} * 2 - case when {_DIGIT} > 4 then 9 else 0 end end)) % 10 = 0"""

PERSONAL_DATA_BASE = (
    "with texts as (select doc_id, coalesce(text, '') as t from documents),\n"
    + ",\n".join([
        _kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _kind("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(hit, '.'), lambda x: len(ltrim(x, '0')) > 3 or cast('0' || right(ltrim(x, '0'), 3) as int) > 255)) = 0"),
        _kind("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
        _kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) between 9 and 15"),
    ])
    + """,
found as (select * from email union all select * from ip union all select * from card union all select * from phone),
each as (select doc_id, sum(case when kind = 'email' then 1 else 0 end) as n_email, sum(case when kind = 'ip' then 1 else 0 end) as n_ip,
                sum(case when kind = 'card' then 1 else 0 end) as n_card, sum(case when kind = 'phone' then 1 else 0 end) as n_phone,
                string_agg(kind || ':' || cast(start as string) || ':' || cast(start + length(hit) as string), ','
                           order by case kind when 'email' then 1 when 'ip' then 2 when 'card' then 3 else 4 end, start) as joined
         from found group by 1)
select doc_id, cast(coalesce(n_email, 0) as bigint) as n_email, cast(coalesce(n_ip, 0) as bigint) as n_ip, cast(coalesce(n_card, 0) as bigint) as n_card,
       cast(coalesce(n_phone, 0) as bigint) as n_phone, sha256(coalesce(joined, '')) as base_sha256
from documents left join each using (doc_id)"""
)

QUALITY_BASE = r"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words from texts),
win as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as g from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8) x),
again as (select doc_id, g from win group by 1, 2 having count(*) > 1),
marked as (select doc_id, count(distinct p) as n from (select doc_id, i + unnest(range(0, 8)) as p from win join again using (doc_id, g)) y group by 1),
lines as (select doc_id, l, row_number() over (partition by doc_id, l) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from texts) z
          where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) as n from lines where n > 1 group by 1)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
       cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines,
       cast(coalesce(marked.n, 0) as bigint) as n_repeat_words, len(words) < 20 or 100 * coalesce(marked.n, 0) > 30 * len(words) as base_failed
from w left join dup using (doc_id) left join marked using (doc_id)"""
