"""The SQL form of the prefix trie, for DuckDB."""

TRIE_SQL = r"""
with raw as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as txt
    from conversations where conv_id is not null),
named as (
    select conv_id, turn, strlen(txt) as n_bytes,
           strlen(txt) || ':' || substr(sha256(strlen(role) || ':' || role || txt), 1, 32) as tid
    from raw),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, tid) - 1 as pos from named),
convs as (
    select conv_id, conv_id - conv_id % 5 as base,
           xor(list_reduce(list_concat([4294967295::bigint], list_transform(split(conv_id::varchar, ''), lambda d: ord(d)::bigint)),
               lambda crc, d: list_reduce(list_concat([xor(crc, d)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                                       lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 9 as h
    from (select distinct conv_id from placed)),
heads as (
    select c.conv_id, p.pos, p.tid, p.n_bytes from convs c join placed p on p.conv_id = c.base and p.pos < c.h),
taken as (select conv_id, count(*) as n from heads group by conv_id),
turns as (
    select * from heads
    union all
    select p.conv_id, p.pos - c.h + coalesce(t.n, 0), p.tid, p.n_bytes
    from placed p join convs c using (conv_id) left join taken t using (conv_id) where p.pos >= c.h),
lists as (
    select conv_id, coalesce(list(tid order by pos) filter (tid is not null), []) as tids
    from convs left join turns using (conv_id) group by conv_id),
prefixes as (
    select conv_id, d, len(tids) as n, array_to_string(tids[1:d], '|') as path
    from (select *, unnest(range(len(tids) + 1)) as d from lists)),
nodes as (
    select d, path, min(conv_id) as conv_id, count(*) as n_convs, max(n) as longest,
           string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d) as ends
    from prefixes group by d, path),
known as (
    select p.conv_id as member, p.d, nodes.conv_id
    from prefixes p join nodes on p.d = nodes.d and p.path = nodes.path),
costs as (
    select nodes.*, coalesce(t.n_bytes, 0) * (n_convs - 1) as cost, k.conv_id as parent_conv_id
    from nodes left join turns t on t.conv_id = nodes.conv_id and t.pos = nodes.d - 1
    left join known k on k.member = nodes.conv_id and k.d = nodes.d - 1),
below as (
    select k.conv_id, k.d, sum(c.cost) as saved_tokens, sum((c.longest = c.d)::int) as n_leaves
    from costs c join known k on k.member = c.conv_id and k.d <= c.d group by k.conv_id, k.d),
kids as (select parent_conv_id as conv_id, d - 1 as d, count(*) as n from costs where d > 0 group by 1, 2)
select c.conv_id, c.d::bigint as depth, c.parent_conv_id, c.n_convs, coalesce(kids.n, 0)::bigint as n_children,
       b.n_leaves::bigint as n_leaves, b.saved_tokens::bigint as saved_tokens, sha256(coalesce(c.ends, '')) as ends_sha256
from costs c join below b on b.conv_id = c.conv_id and b.d = c.d
left join kids on kids.conv_id = c.conv_id and kids.d = c.d
"""
