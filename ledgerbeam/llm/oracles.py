"""The same results in DuckDB SQL, where SQL can express the operator."""

from __future__ import annotations

from ledgerbeam.llm.params import SHARDS, URL_RULES
from ledgerbeam.llm.sharding import TABLE_SIZE, lookup_table
from ledgerbeam.llm.url_filter import CONTEXT, GRAM, HELD_BACK, START, STEPS, STRENGTH

EXACT_DEDUP = """
with keyed as (
    select doc_id, length(coalesce(text, '')) as points,
           sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256
    from documents
), ranked as (
    select doc_id, text_sha256,
           first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as keep_id,
           count(*) over (partition by text_sha256) as group_size
    from keyed
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from ranked
"""


def _url_filter() -> str:
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
    held = ", ".join(f"'{d}'" for d in HELD_BACK)

    def share(side: str) -> str:
        p = f"((sum({side}) over (partition by substr(gram, {GRAM}, 1)) + {STRENGTH} / characters) / (all_{side} + {STRENGTH}))"
        for k in range(1, CONTEXT + 1):
            at = GRAM - k
            p = (
                f"((sum({side}) over (partition by substr(gram, {at}, {k + 1})) + {STRENGTH} * {p})"
                f" / (sum({side}) over (partition by substr(gram, {at}, {k})) + {STRENGTH}))"
            )
        return f"ln({p})"

    return f"""
with rules(rule_verdict, rule_host, rule_path) as (values {rules}),
cut as (
    select page_id, coalesce(url, '') as url, strpos(coalesce(url, ''), '://') as pos from pages
), addressed as (
    select page_id,
           case when pos > 0 then substr(url, pos + 3) else '' end as rest,
           case when pos > 0 then substr(url, pos + 3) else url end as read
    from cut
), split as (
    select page_id, regexp_extract(rest, '^[^/?#]*') as host_part,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
           translate(read, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from addressed
), hosts as (
    select page_id, path, text,
           translate(host_part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host
    from split
), fitted as (
    select page_id, host, path, text, rule_host || rule_path as rule, rule_verdict,
           row_number() over (partition by page_id order by
               length(rule_host || rule_path) desc nulls last, rule_host || rule_path desc) as nth
    from hosts left join rules
      on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
), judged as (
    select page_id, host, path, text, rule, rule_verdict from fitted where nth = 1
), urls as (
    select distinct text,
           case rule_verdict when 'allow' then 1 when 'block' then 0 end as label
    from judged where text <> ''
), marked as (
    select text, label, label is not null and substr(md5(text), 1, 1) in ({held}) as held_back
    from urls
), grams as (
    select text, label, held_back, substr('{START * CONTEXT}' || text, i, {GRAM}) as gram
    from marked, unnest(range(1, length(text) + 1)) as t(i)
), counts as (
    select gram,
           sum(case when label = 1 and not held_back then 1 else 0 end) as accepted,
           sum(case when label = 0 and not held_back then 1 else 0 end) as rejected
    from grams group by gram
), totals as (
    select sum(accepted) as all_accepted, sum(rejected) as all_rejected,
           cast(count(distinct substr(gram, {GRAM}, 1)) + 1 as double) as characters
    from counts
), ratios as (
    select gram, {share("accepted")} - {share("rejected")} as log_ratio from counts, totals
), scored as (
    select text, label, held_back, round(avg(log_ratio), 6) as score
    from grams join ratios using (gram) where label is null or held_back
    group by text, label, held_back
), steps as (
    select greatest(least(cast(floor(score * {STEPS}) as integer), {20 * STEPS}), {-20 * STEPS}) as step,
           sum(case when label = 1 then 1 else 0 end) as good,
           sum(case when label = 0 then 1 else 0 end) as bad
    from scored where held_back group by 1
), sums as (select sum(good) as all_good, sum(bad) as all_bad from steps),
tried as (
    select step, round(
        coalesce(sum(good) over (order by step rows between unbounded preceding and 1 preceding), 0)
            / all_good
        + (all_bad - coalesce(sum(bad) over (
              order by step rows between unbounded preceding and 1 preceding), 0)) / all_bad, 9) as wrong
    from steps, sums where all_good > 0 and all_bad > 0
), best as (
    select coalesce((select step / {STEPS}.0::double from tried
                     order by wrong, abs(step), step limit 1), 0.0) as threshold
)
select j.page_id, j.host, j.path, j.rule,
       coalesce(j.rule_verdict,
                case when coalesce(s.score, 0.0) >= threshold then 'allow' else 'block' end) as verdict,
       case when j.rule is null then s.score end as score
from judged j cross join best
left join scored s on s.text = j.text and s.label is null and j.rule is null
"""


FILL_IN_MIDDLE = """
with cut as (
    select doc_id, coalesce(text, '') as text,
           regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as lines,
           sha256('7:' || coalesce(cast(doc_id as varchar), '')) as digest
    from documents
), drawn as (
    select doc_id, text, lines, len(lines) as n,
           cast('0x' || substr(digest, 1, 8) as bigint) as h1,
           cast('0x' || substr(digest, 9, 8) as bigint) as h2,
           cast('0x' || substr(digest, 25, 8) as bigint) as h4
    from cut
), placed as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
                then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
    from drawn
), parts as (
    select doc_id, n, form, text,
           coalesce(array_to_string(lines[1:low], ''), '') as prefix,
           coalesce(array_to_string(lines[low + 1:high], ''), '') as middle,
           coalesce(array_to_string(lines[high + 1:n], ''), '') as suffix
    from placed
)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text
              when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""

PREFIX_TRIE = """
with turns as (
    select conv_id, coalesce(text, '') as text, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as said,
           row_number() over (partition by conv_id order by turn nulls first,
               sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
    from conversations where conv_id is not null
), lists as (
    select conv_id, list(said order by pos) as said from turns group by conv_id
), crc as (  -- CRC-32 of each byte, by its polynomial
    select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as of_byte
), hashed as (
    select conv_id, said, conv_id - conv_id % 5 as base,
           xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda d: cast(ascii(d) as bigint)),
               lambda c, b: xor(c >> 8, of_byte[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 9 as h
    from lists, crc
), rebuilt as (
    select c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) as said
    from hashed c left join lists b on b.conv_id = c.base
), prefixes as (
    select conv_id, d as depth, said[1:d] as path, len(said) = d as is_end
    from rebuilt, unnest(range(0, len(said) + 1)) as u(d)
), nodes as (
    select depth, path, min(conv_id) as conv_id, count(*) as n_convs,
           count(*) filter (where is_end) as n_ends,
           coalesce(octet_length(encode(path[depth].t)), 0) as bytes,
           coalesce(string_agg(case when is_end then cast(conv_id as varchar) end, ',' order by conv_id), '') as ends
    from prefixes group by depth, path
), below as (
    select p.depth, p.path, sum((n.n_convs - 1) * n.bytes) as saved_tokens,
           count(*) filter (where n.n_ends = n.n_convs) as n_leaves
    from nodes n join prefixes p on p.conv_id = n.conv_id and p.depth <= n.depth
    group by p.depth, p.path
), children as (
    select depth - 1 as depth, path[1:depth - 1] as path, count(*) as n_children
    from nodes where depth > 0 group by all
)
select n.conv_id, cast(n.depth as bigint) as depth, u.conv_id as parent_conv_id, n.n_convs,
       coalesce(c.n_children, 0) as n_children, b.n_leaves,
       cast(b.saved_tokens as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join below b on b.depth = n.depth and b.path = n.path
left join children c on c.depth = n.depth and c.path = n.path
left join nodes u on u.depth = n.depth - 1 and u.path = n.path[1:n.depth - 1]
"""


def _sharding() -> str:
    """The table of slots is a text of three digits a slot; tests fill it by brute force."""
    slots = "".join(f"{i:03d}" for i in lookup_table(SHARDS))
    return f"""
with placed as (
    select doc_id, cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15)
                             as bigint) % {TABLE_SIZE} as integer) as slot
    from documents
), found as (
    select doc_id, slot, cast(substr('{slots}', 3 * slot + 1, 3) as integer) as shard_index from placed
)
select doc_id, slot, shard_index, 'shard-' || lpad(cast(shard_index as varchar), 3, '0') as shard
from found
"""


ORACLES = {
    "op2_url_filter": _url_filter(),
    "op5_exact_dedup": EXACT_DEDUP,
    "op10_sharding": _sharding(),
    "op11_prefix_trie": PREFIX_TRIE,
    "op13_fill_in_middle": FILL_IN_MIDDLE,
}
