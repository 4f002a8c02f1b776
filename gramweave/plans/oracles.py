"""DuckDB SQL for the registered queries, over the same whole tables."""

from __future__ import annotations

K, PATTERN, PER_TEXT, BLOCK = 20, 12, 2, 512
CORE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz ,."
CONTEXT = CORE + "#"

DOCS = "docs as (select doc_id, text from documents)"
ASKS = "asks as (select item_id as query_id, text from benchmark)"
FRAMED = "asks as (select item_id as query_id, '#' || text || '#' as text from benchmark where text is not null)"
PATTERNS = f"""patterns as (
    select item_id * 1000000 + j as pattern_id, item_id as doc_id, least(j * {PATTERN}, length(text) - {PATTERN}) as x, substr(text, least(j * {PATTERN}, length(text) - {PATTERN}) + 1, {PATTERN}) as pattern
    from (select item_id, text, unnest(range((length(text) + {PATTERN - 1}) // {PATTERN})) as j from benchmark where length(text) >= {PATTERN}))"""
SAMPLE = f"""patterns as (
    select doc_id * {PER_TEXT} + no as pattern_id, doc_id, x, substr(text, x + 1, {PATTERN}) as pattern from (
        select *, ('0x' || substr(md5(doc_id || ':' || no || ':0'), 1, 8))::bigint % (length(text) - {PATTERN} + 1) as x
        from (select item_id as doc_id, text, unnest(range({PER_TEXT})) as no from benchmark where length(text) >= {PATTERN})))"""


def grams(name: str, table: str, key: str, k: int) -> str:
    return f"""{name} as (
        select {key}, b * {BLOCK} + p as pos, substr(chunk, p + 1, {k}) as gram from (
            select {key}, b, chunk, unnest(range(length(chunk) - {k} + 1)) as p from (
                select {key}, b, substr(text, b * {BLOCK} + 1, {BLOCK + k - 1}) as chunk from (
                    select {key}, text, unnest(range((length(text) - {k}) // {BLOCK} + 1)) as b from {table} where length(text) >= {k}))))"""


def islands(k: int, texts: str = "docs", asks: str = "asks", core: str | None = None) -> str:
    only = f"where translate(gram, '{core}', '') = ''" if core else ""
    return f"""{grams("tg", texts, "doc_id", k)}, {grams("qg", asks, "query_id", k)},
    hits as (select doc_id, query_id, tg.pos as x, qg.pos as i from tg join qg using (gram) {only}),
    islands as (
        select doc_id, query_id, min(x) as x, min(i) as i, count(*) + {k - 1} as d from (
            select *, x - row_number() over (partition by doc_id, query_id, x - i order by x) as island from hits)
        group by doc_id, query_id, x - i, island)"""


def found(most: int, docs: str = DOCS, patterns: str = PATTERNS) -> str:
    """located(pattern_id, doc_id, x, mismatches): windows that share a piece of the pattern in place, held against it."""
    w = PATTERN // (most + 1)
    seeds = " union all ".join(f"select pattern_id, pattern, {part * PATTERN // (most + 1)} as place, substr(pattern, {part * PATTERN // (most + 1) + 1}, {w}) as gram from patterns" for part in range(most + 1))
    return f"""{docs}, {patterns}, seeds as ({seeds}), {grams("tg", "docs", "doc_id", w)},
    near as (select distinct pattern_id, pattern, doc_id, pos - place as x from tg join seeds using (gram) where pos >= place),
    windows as (select pattern_id, pattern, doc_id, x, substr(text, x + 1, {PATTERN}) as seen from near join docs using (doc_id) where x + {PATTERN} <= length(text)),
    located as (select pattern_id, doc_id, x, len(list_filter(range(1, {PATTERN + 1}), lambda j: substr(seen, j, 1) <> substr(pattern, j, 1))) as mismatches from windows
        where len(list_filter(range(1, {PATTERN + 1}), lambda j: substr(seen, j, 1) <> substr(pattern, j, 1))) <= {most})"""


COUNTS = "select pattern_id, count(located.x) as n_occ from patterns left join located using (pattern_id) group by pattern_id"
AROUND = """around as (select pattern_id, located.doc_id, located.x, case when located.x > 0 then substr(text, located.x, 1) end as before,
    nullif(substr(text, located.x + length(pattern) + 1, 1), '') as after from located join docs using (doc_id) join patterns using (pattern_id))"""

NODES = """cuts as (select item_id, text, ceil(length(text) / 3)::int as w from benchmark),
    nodes as (select item_id * 3 + p as node_id, substr(text, p * w + 1, w) as label from (select *, unnest(range(3)) as p from cuts) where substr(text, p * w + 1, w) <> ''),
    links as (select src, dst from (select node_id as src, unnest([node_id + 1, node_id + 4]) as dst from nodes where node_id % 3 < 2) where dst in (select node_id from nodes)),
    lefts as (select dst as node_id, case when min(right(label, 1)) = max(right(label, 1)) then min(right(label, 1)) else 'N' end as lctx from links join nodes on src = node_id group by dst),
    rights as (select src as node_id, case when min(left(label, 1)) = max(left(label, 1)) then min(left(label, 1)) else '$' end as rctx from links join nodes on dst = node_id group by src),
    contexts as (select node_id, coalesce(lctx, 'N') as lctx, coalesce(rctx, '$') as rctx from nodes left join lefts using (node_id) left join rights using (node_id)),
    node_units as (select node_id::varchar as ids, [label] as parts, lctx, rctx from nodes join contexts using (node_id)),
    edge_units as (select src || ',' || dst as ids, [a.label, b.label] as parts, ca.lctx, cb.rctx from links join nodes a on src = a.node_id join nodes b on dst = b.node_id join contexts ca on src = ca.node_id join contexts cb on dst = cb.node_id),
    path_units as (select f.src || ',' || f.dst || ',' || s.dst as ids, [a.label, b.label, c.label] as parts, '$' as lctx, '$' as rctx
        from links f join links s on f.dst = s.src join nodes a on f.src = a.node_id join nodes b on f.dst = b.node_id join nodes c on s.dst = c.node_id)"""


def graph_mems(kind: str) -> str:
    """mems(ids, unit_off, query_id, i, d, text)"""
    return f"""{NODES}, units as (select *, array_to_string(parts, '') as whole from {kind}_units), unit_texts as (select ids as doc_id, lctx || whole || rctx as text from units),
    {FRAMED},
    {islands(K, "unit_texts", "asks")},
    mems as (
        select ids, x - 1 as unit_off, query_id, i, d, substr(whole, x, d) as text from islands join units on doc_id = ids join unit_texts using (doc_id) join asks using (query_id)
        where x > 0 and i > 0 and x + d < length(unit_texts.text) and i + d < length(asks.text)
          and (len(parts) = 1 or (x - 2 < length(parts[1]) and x - 1 + d >= length(whole) - length(parts[-1]))))"""


def longest(kind: str, wide: int = 16) -> str:
    """{kind}_longest(d): lengths of strings that units and queries share, the greatest among them: all runs of `wide` or more, and which lengths below occur."""
    u = f"{kind}_texts"
    runs = islands(wide, u, "asks").replace("tg as", f"{kind}_tg as").replace("qg as", f"{kind}_qg as").replace("from tg join qg", f"from {kind}_tg as tg join {kind}_qg as qg").replace("hits as", f"{kind}_hits as").replace("from hits", f"from {kind}_hits").replace("    islands as", f"    {kind}_islands as")
    short = ", ".join(f"{grams(f'{kind}_t{k}', u, 'doc_id', k)}, {grams(f'{kind}_q{k}', 'asks', 'query_id', k)}" for k in range(1, wide))
    return f"""{u} as (select ids as doc_id, lctx || array_to_string(parts, '') || rctx as text from {kind}_units), {runs}, {short},
    {kind}_longest as (select d from {kind}_islands {" ".join(f"union all select {k} where exists (select 1 from {kind}_t{k} where gram in (select gram from {kind}_q{k}))" for k in range(1, wide))} union all select 0)"""


RING = 8
#: Walks around the rings, a character a step: where a match starts, what it reaches, and what can't go on.
WALKS = f"""with recursive cuts as (select item_id, text, ceil(length(text) / {RING})::int as w from benchmark),
    nodes as (select item_id * {RING} + p as node, substr(text, p * w + 1, w) as label from (select *, unnest(range({RING})) as p from cuts) where substr(text, p * w + 1, w) <> ''),
    links as (select src, dst from (select node as src, unnest(case when node % {RING} = {RING - 1} then [node - {RING - 1}] else [node + 1, node + {RING + 1}] end) as dst from nodes) where dst in (select node from nodes)),
    asks as (select item_id as query_id, '#' || text || text || '#' as text from benchmark where text is not null),
    spelled(node, off, cur, place, s) as (
        select node, off, node, least(off + {K}, length(label)), substr(label, off + 1, {K}) from (select *, unnest(range(length(label))) as off from nodes)
        union
        select p.node, p.off, l.dst, least({K} - length(s), length(n.label)), s || substr(n.label, 1, {K} - length(s)) from spelled p join links l on l.src = p.cur join nodes n on n.node = l.dst where length(s) < {K}),
    {grams("qg", "asks", "query_id", K)},
    hits as (select p.node, p.off, q.query_id, q.pos as i, p.cur, p.place, substr(a.text, q.pos, 1) as before from spelled p join qg q on p.s = q.gram join asks a using (query_id) where q.pos > 0 and length(p.s) = {K}),
    starts as (select h.* from hits h join nodes n using (node) where case when off > 0 then substr(label, off, 1) <> before else
        exists (select 1 from links where dst = h.node) and not exists (select 1 from links join nodes p on p.node = src where dst = h.node and right(p.label, 1) = before) end),
    walk(node, off, query_id, i, cur, place, d) as (
        select node, off, query_id, i, cur, place, {K} from starts
        union
        select w.node, w.off, w.query_id, w.i, coalesce(l.dst, w.cur), case when l.dst is null then w.place + 1 else 1 end, w.d + 1 from walk w join nodes n on n.node = w.cur join asks a using (query_id)
        left join links l on l.src = w.cur and w.place = length(n.label) left join nodes t on t.node = l.dst
        where substr(case when l.dst is null then substr(n.label, w.place + 1, 1) else substr(t.label, 1, 1) end, 1, 1) = substr(a.text, w.i + w.d + 1, 1) and w.i + w.d < length(a.text))"""


NAMES = "texts as (select p_partkey as doc_id, p_name as text from part where p_name is not null)"
PASSAGES = "texts as (select item_id as doc_id, text from benchmark where text is not null)"
#: sa(doc_id, rank, sa) of texts.
ORDER = """
    sa as (select doc_id, text, row_number() over (partition by doc_id order by substr(text, sa + 1)) - 1 as rank, sa from (select doc_id, text, unnest(range(length(text) + 1)) as sa from texts)),
    bwt as (select doc_id, rank, sa, case when sa = 0 then '' else substr(text, sa, 1) end as ch from sa),
    chars as (select doc_id, ch, count(*) as n from bwt group by doc_id, ch),
    f as (select doc_id, ch, n, coalesce(sum(n) over (partition by doc_id order by ch rows between unbounded preceding and 1 preceding), 0) as first from chars),
    lf as (select doc_id, rank, first + row_number() over (partition by doc_id, ch order by rank) - 1 as lf from bwt join f using (doc_id, ch)),
    phi as (select doc_id, text, sa, lag(sa) over (partition by doc_id order by rank) as phi, lead(sa) over (partition by doc_id order by rank) as phi_inv from sa)"""
SUFFIXES, SUFFIXES_OF_PASSAGES = f"{NAMES}, {ORDER}", f"{PASSAGES}, {ORDER}"
PLCP = """select doc_id, sa, case when phi is null then 0 else
        len(list_filter(range(1, length(text) + 1), lambda j: j <= length(text) - greatest(sa, phi) and substr(text, sa + 1, j) = substr(text, phi + 1, j))) end as plcp from phi"""


def bwt_runs(order: str) -> str:
    return f"""select doc_id, run_id, min(ch) as head, min(rank) as start, count(*) as len, arg_min(sa, rank) as first_sa, arg_max(sa, rank) as last_sa from (
        select *, sum(new) over (partition by doc_id order by rank) - 1 as run_id from (
            select *, case when ch = lag(ch) over (partition by doc_id order by rank) then 0 else 1 end as new from {order})) group by doc_id, run_id"""


LETTERS = "letters as (select p_partkey as vec, unnest(range(length(p_name))) as pos, unnest(string_split(p_name, '')) as ch from part where p_name <> '')"
RUNS = """runs as (select vec, run_id, min(ch) as head, min(pos) as start, count(*) as len from (
        select *, sum(new) over (partition by vec order by pos) - 1 as run_id from (
            select *, case when ch = lag(ch) over (partition by vec order by pos) then 0 else 1 end as new from letters)) group by vec, run_id)"""
BITS = f"{LETTERS}, bits as (select vec, pos, (ch in ('a', 'e', 'i', 'o', 'u'))::int as bit from letters)"

#: Matches with the characters before and after them in the text (tb, ta) and the query (qb, qa); empty at an end.
BESIDE = """beside as (select islands.*, case when x > 0 then substr(docs.text, x, 1) else '' end as tb, case when i > 0 then substr(asks.text, i, 1) else '' end as qb,
    substr(docs.text, x + d + 1, 1) as ta, substr(asks.text, i + d + 1, 1) as qa from islands join docs using (doc_id) join asks using (query_id))"""
#: The graph with reversed ends, its nodes numbered in order.
GFA = f"""{NODES}, gfa_nodes as (select row_number() over (order by node_id) as node_id, node_id::varchar as name, regexp_replace(label, '[\t\r\n]', ' ', 'g') as label from nodes),
    gfa_links as (select a.node_id as src, links.src % 2 = 1 as src_rev, b.node_id as dst, links.dst % 5 = 0 as dst_rev from links join gfa_nodes a on a.name = links.src::varchar join gfa_nodes b on b.name = links.dst::varchar),
    turned as (select src, dst, {{turn_a}} as a, {{turn_b}} as b from gfa_links join gfa_nodes na on src = na.node_id join gfa_nodes nb on dst = nb.node_id),
    gfa_lefts as (select dst as node_id, case when min(right(a, 1)) = max(right(a, 1)) then min(right(a, 1)) else 'N' end as lctx from turned group by dst),
    gfa_rights as (select src as node_id, case when min(left(b, 1)) = max(left(b, 1)) then min(left(b, 1)) else '$' end as rctx from turned group by src)""".format(
    **{f"turn_{x}": f"case when {end}_rev then reverse(translate(n{x}.label, 'ACGTacgt', 'TGCAtgca')) else n{x}.label end" for x, end in (("a", "src"), ("b", "dst"))}
)

MEM = f"with {DOCS}, {ASKS}, {islands(K)}"
STRICT = f"with {DOCS}, {FRAMED}, {islands(K)}"
FREE = """firsts as (select query_id, i, d, min((doc_id, x)) as place from islands group by query_id, i, d),
    free as (select * from (select *, max(i + d) over (partition by query_id order by i, d desc rows between unbounded preceding and 1 preceding) as reach from firsts) where reach is null or reach < i + d)"""

ORACLE_SQL = {
    "corpus_scan": "select doc_id, length(text) as n, strlen(text) as bytes from documents",
    "pattern_parse": f"select item_id as query_id, j as pattern_id, substr(text, j * {PATTERN} + 1, {PATTERN}) as pattern from (select *, unnest(range(length(text) // {PATTERN})) as j from benchmark)",
    "query_split": """with cut as (select item_id as query_id, '#' || regexp_replace(text, '[.] ?', '#', 'g') || '#' as line from benchmark),
        parts as (select query_id, unnest(range(len(string_split(line, '#')))) as query_no, unnest(string_split(line, '#')) as query from cut)
        select * from (select *, coalesce(sum(length(query) + 1) over (partition by query_id order by query_no rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from parts) where query <> ''""",
    "graph_nodes": f"with {NODES} select * from nodes",
    "graph_links": f"with {NODES} select * from links",
    "gfa_nodes": f"with {GFA} select * from gfa_nodes",
    "gfa_links": f"with {GFA} select * from gfa_links",
    "gfa_units": f"with {GFA} select distinct src || ',' || dst as ids, a || '>' || b as parts, coalesce(lctx, 'N') as lctx, coalesce(rctx, '$') as rctx from turned left join gfa_lefts on src = gfa_lefts.node_id left join gfa_rights on dst = gfa_rights.node_id",
    "gfa_source": f"""with {NODES}, named as (select 'n' || node_id as name, node_id, regexp_replace(label, '[\t\r\n]', ' ', 'g') as label from nodes)
        select a.name as src, src % 2 = 1 as src_rev, b.name as dst, dst % 5 = 0 as dst_rev, a.label as src_label, b.label as dst_label from links join named a on a.node_id = src join named b on b.node_id = dst""",
    "index_grams": f"with {ASKS}, {grams('qg', 'asks', 'query_id', PATTERN)} select query_id, pos, gram from qg",
    "text_durations": """with times as (select doc_id, length(text) // 15 as s from documents where text is not null)
        select doc_id, case when s >= 3600 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' when s >= 60 then (s // 60) || 'm ' || (s % 60) || 's' else s || 's' end as reading from times""",
    "mem_lines": f"{MEM} select x || ',' || i || ',' || d as value from islands",
    "mem_open": f"{MEM} select * from islands",
    "mem_global": f"""{MEM}, doc_at as (select doc_id, coalesce(sum(coalesce(length(text), 0) + 1) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) + 1 as o from docs),
        ask_at as (select query_id, coalesce(sum(coalesce(length(text), 0) + 1) over (order by query_id rows between unbounded preceding and 1 preceding), 0) + 1 as o from asks)
        select (x + d.o)::bigint as joined_x, (i + a.o)::bigint as joined_i, m.d, doc_id, x as doc_x, query_id, i as query_i from islands m join doc_at d using (doc_id) join ask_at a using (query_id)""",
    "mem_symmetric": f"{STRICT} select islands.* from islands join docs using (doc_id) join asks using (query_id) where x > 0 and i > 0 and x + d < length(docs.text) and i + d < length(asks.text)",
    "mem_asymmetric": f"{STRICT}, {FREE} select query_id, i, d, place[1] as doc_id, place[2] as x from free join asks using (query_id) where i > 0 and i + d < length(text)",
    "mem_alphabet": f"""with {DOCS}, {FRAMED}, {islands(K, core=CORE)}, {BESIDE} select doc_id, query_id, x, i, d from beside where tb <> qb and ta <> qa
        and tb <> '' and qb <> '' and ta <> '' and qa <> '' and translate(tb || qb || ta || qa, '{CONTEXT}', '') = ''""",
    "mem_alphabet_asymmetric": f"""{STRICT}, {FREE} select query_id, i, d, place[1] as doc_id, place[2] as x from free join asks using (query_id) where i > 0 and i + d < length(text)
        and translate(substr(text, i + 1, d), '{CORE}', '') = '' and translate(substr(text, i, 1) || substr(text, i + d + 1, 1), '{CONTEXT}', '') = ''""",
    "mem_classes": f"{MEM} select * from islands",
    # A string is a maximal repeat if some pair of its places can be extended to neither side: the runs on all diagonals but the own.
    "maximal_repeats": f"""with {DOCS}, {grams("tg", "docs", "doc_id", K)}, again as (select gram from tg group by gram having count(*) > 1), held as (select * from tg semi join again using (gram)),
        hits as (select a.doc_id, b.doc_id as other, a.pos as x, b.pos as i from held a join held b on a.gram = b.gram where (a.doc_id, a.pos) < (b.doc_id, b.pos)),
        runs as (select doc_id, min(x) as x, count(*) + {K - 1} as d from (select *, x - row_number() over (partition by doc_id, other, x - i order by x) as run from hits) group by doc_id, other, x - i, run),
        strings as (select distinct substr(text, x + 1, d) as text, d from (select distinct doc_id, x, d from runs) join docs using (doc_id)),
        met as (select s.text, s.d from strings s join held h on h.gram = substr(s.text, 1, {K}) join docs using (doc_id) where substr(docs.text, h.pos + 1, s.d) = s.text)
        select text, d, count(*) as n_occ from met group by text, d""",
    "matching_statistics": f"""{MEM}, cover as (select query_id, unnest(range(i, i + d - {K - 1})) as p, i + d as reach, doc_id, x - i as diagonal from islands)
        select query_id, p as i, reach - p as ms, place[1] as doc_id, place[2] as x from (
            select query_id, p, reach, min((doc_id, diagonal + p)) as place from (select *, max(reach) over (partition by query_id, p) as most from cover) where reach = most group by query_id, p, reach)""",
    "longest_common_substring": f"""with {DOCS}, {ASKS}, {islands(16)}, {", ".join(grams(f"t{k}", "docs", "doc_id", k) + ", " + grams(f"q{k}", "asks", "query_id", k) for k in range(1, 16))},
        lengths as (select doc_id, max(d) as d from islands group by doc_id {" ".join(f"union all select distinct doc_id, {k} from t{k} where gram in (select gram from q{k})" for k in range(1, 16))})
        select doc_id, coalesce(max(d), 0)::bigint as d from docs left join lengths using (doc_id) group by doc_id""",
    "longest_shared": f"with {DOCS}, {ASKS}, {islands(12)} select doc_id, query_id, max(d) as d from islands group by doc_id, query_id",
    "top_mems": f"{MEM} select * from islands order by d desc, doc_id, query_id, x, i limit 20",
    "locate_exact": f"with {found(0)} select * from located",
    "count_exact": f"with {found(0)} {COUNTS}",
    "locate_mismatch": f"with {found(1)} select * from located",
    "count_mismatch": f"with {found(1)} {COUNTS}",
    "locate_report": f"with {found(1)}, counts as ({COUNTS}) select count(*) as patterns, sum(n_occ)::bigint as occ_total, sum(n_occ)::double / count(*) as occ_avg, count(*) filter (where n_occ > 0) as found from counts",
    "hamming_eq1": f"with {found(1)} select pattern_id, doc_id, x from located where mismatches = 1",
    "hamming_eq2": f"with {found(2)} select pattern_id, doc_id, x from located where mismatches = 2",
    "seed_extend": f"with {found(2)} select located.* from located join docs using (doc_id) join patterns using (pattern_id) where substr(text, located.x + 5, 8) = substr(pattern, 5, 8)",
    "occurrence_check": f"""with {found(1)}, further as (select pattern, substr(text, located.x + 2, {PATTERN}) as seen from located join docs using (doc_id) join patterns using (pattern_id))
        select count(*) as violations from further where length(seen) < {PATTERN} or len(list_filter(range(1, {PATTERN + 1}), lambda j: substr(seen, j, 1) <> substr(pattern, j, 1))) > 1""",
    "extend_left": f"with {found(0)}, {AROUND} select pattern_id, before as ch, count(*) as n_occ from around where before is not null group by pattern_id, before",
    "extend_right": f"with {found(0)}, {AROUND} select pattern_id, after as ch, count(*) as n_occ from around where after is not null group by pattern_id, after",
    "left_maximal": f"with {found(0)}, {AROUND} select pattern_id, count(distinct coalesce(before, '')) as n_chars, count(distinct coalesce(before, '')) > 1 as maximal from around group by pattern_id",
    "right_maximal": f"with {found(0)}, {AROUND} select pattern_id, count(distinct coalesce(after, '')) as n_chars, count(distinct coalesce(after, '')) > 1 as maximal from around group by pattern_id",
    "locate_indexed": f"with {found(0)} select * from located",
    "mem_indexed": f"{MEM} select * from islands",
    "index_update": "with " + found(0, "docs as (select doc_id, case when doc_id // 64 % 100 = 0 then text || (select max(text) from benchmark) else text end as text from documents where doc_id // 64 % 100 <> 1)") + " select * from located",
    "sql_locate": f"with {found(1, patterns=SAMPLE)} select distinct pattern, located.doc_id, located.x, mismatches from located join patterns using (pattern_id)",
    "sql_mems": f"{MEM} select * from islands",
    "pattern_sample": f"with {SAMPLE} select * from patterns",
    "pattern_pieces": f"with {PATTERNS} select * from patterns",
    "graph_units": f"with {NODES} select ids, array_to_string(parts, '>') as parts, lctx, rctx from edge_units",
    "unit_offsets": f"with {NODES} select node_id::varchar as ids, (coalesce(sum(length(label) + 3) over (order by node_id rows between unbounded preceding and 1 preceding), 0) + 2)::bigint as \"offset\" from nodes",
    "graph_contexts": f"with {NODES} select * from contexts",
    "graph_paths": f"with {NODES} select ids, array_to_string(parts, '>') as parts, lctx, rctx from path_units",
    "graph_mem_nodes": f"with {graph_mems('node')} select * from mems",
    "graph_mem_edges": f"with {graph_mems('edge')} select * from mems",
    "graph_mem_paths": f"with {graph_mems('path')} select * from mems",
    "graph_mem_filtered": f"with {graph_mems('path')}, strings as (select distinct text from mems), held as (select distinct s.text from strings s join documents d on contains(d.text, s.text)) select * from mems where text in (select text from held)",
    "graph_mem_asym": f"""with {graph_mems('edge')},
        firsts as (select doc_id, x, d, min((query_id, i)) as place from islands group by doc_id, x, d),
        free as (select * from (select *, max(x + d) over (partition by doc_id order by x, d desc rows between unbounded preceding and 1 preceding) as reach from firsts) where reach is null or reach < x + d),
        inner_ as (select doc_id as ids, x - 1 as unit_off, place[1] as query_id, place[2] as i, d, substr(text, x + 1, d) as text from free join unit_texts using (doc_id) where x > 0 and x + d < length(text))
        select * from inner_ m where not exists (select 1 from node_units where contains(lctx || parts[1] || rctx, m.text))""",
    "graph_mem_max": f"with {NODES}, {FRAMED}, " + ", ".join(longest(kind) for kind in ("node", "edge", "path")) + " select 'nodes' as section, max(d)::bigint as d from node_longest union all select 'edges', max(d) from edge_longest union all select 'paths', max(d) from path_longest",
    "graph_mem_walks": f"""{WALKS} select w.node, w.off, w.query_id, w.i, w.d::bigint as d, w.cur as end_node, w.place as end_off from walk w join nodes n on n.node = w.cur join asks a using (query_id)
        where w.i + w.d < length(a.text) and case when w.place < length(n.label) then substr(n.label, w.place + 1, 1) <> substr(a.text, w.i + w.d + 1, 1)
        else exists (select 1 from links where src = w.cur) and not exists (select 1 from links join nodes t on t.node = dst where src = w.cur and left(t.label, 1) = substr(a.text, w.i + w.d + 1, 1)) end""",
    "suffix_array": f"with {SUFFIXES} select doc_id, rank, sa from sa",
    "bwt": f"with {SUFFIXES} select doc_id, rank, sa, case when ch = '' then '$' else ch end as ch from bwt",
    "f_column": f"with {SUFFIXES} select doc_id, case when ch = '' then '$' else ch end as ch, n, first::bigint as first from f",
    "lf_mapping": f"with {SUFFIXES} select doc_id, rank, lf::bigint as lf from lf",
    "fl_mapping": f"with {SUFFIXES} select doc_id, lf::bigint as rank, rank as fl from lf",
    "phi": f"with {SUFFIXES} select doc_id, sa, phi from phi",
    "phi_inverse": f"with {SUFFIXES} select doc_id, sa, phi_inv from phi",
    "plcp": f"with {SUFFIXES} {PLCP}",
    "suffix_array_passages": f"with {SUFFIXES_OF_PASSAGES} select doc_id, rank, sa from sa",
    "bwt_passages": f"with {SUFFIXES_OF_PASSAGES} select doc_id, rank, sa, case when ch = '' then '$' else ch end as ch from bwt",
    "plcp_passages": f"with {SUFFIXES_OF_PASSAGES} {PLCP}",
    "bwt_runs": f"with {SUFFIXES}, runs as ({bwt_runs('bwt')}) select doc_id, run_id::bigint as run_id, case when head = '' then '$' else head end as head, start, len, first_sa, last_sa from runs",
    "char_range": f"with {SUFFIXES} select doc_id, ch, first::bigint as lo, (first + n - 1)::bigint as hi from f where ch <> ''",
    "index_stats": f"""with {SUFFIXES}, back as (select doc_id, reverse(text) as text from texts),
        rsa as (select doc_id, text, row_number() over (partition by doc_id order by substr(text, sa + 1)) - 1 as rank, sa from (select doc_id, text, unnest(range(length(text) + 1)) as sa from back)),
        rbwt as (select doc_id, rank, sa, case when sa = 0 then '' else substr(text, sa, 1) end as ch from rsa),
        a as (select doc_id, count(*) as r from ({bwt_runs('bwt')}) group by doc_id), b as (select doc_id, count(*) as r_rev from ({bwt_runs('rbwt')}) group by doc_id),
        s as (select doc_id, count(*) as sigma, (sum(n) - 1)::bigint as n from chars group by doc_id)
        select doc_id, n, sigma, r, r_rev, n::double / r as n_per_r from s join a using (doc_id) join b using (doc_id)""",
    "bit_rank_select": f"with {BITS} select vec, row_number() over (partition by vec order by pos) - 1 as k, pos, pos - coalesce(lag(pos) over (partition by vec order by pos), -1) as gap from bits where bit = 1",
    "bit_predecessor": f"""with {BITS}, ranked as (select *, coalesce(sum(bit) over (partition by vec order by pos rows between unbounded preceding and 1 preceding), 0) as rank, sum(bit) over (partition by vec) as ones,
        max(case when bit = 1 then pos end) over (partition by vec order by pos rows between unbounded preceding and 1 preceding) as predecessor from bits)
        select vec, pos, predecessor, (case when rank > 0 then rank - 1 else ones - 1 end)::bigint as circular_rank from ranked""",
    "char_rank_select": f"with {LETTERS} select vec, ch, row_number() over (partition by vec, ch order by pos) - 1 as k, pos from letters",
    "rle_runs": f"with {LETTERS}, {RUNS} select vec, run_id::bigint as run_id, head, start, len from runs",
    "rle_rank": f"with {LETTERS}, {RUNS} select vec, run_id::bigint as run_id, head, start, len, coalesce(sum(len) over (partition by vec, head order by run_id rows between unbounded preceding and 1 preceding), 0)::bigint as rank from runs",
    "alphabet_stats": "with chars as (select doc_id, unnest(string_split(text, '')) as ch from documents where text <> '') select ch, count(*) as n, count(distinct doc_id) as n_docs from chars group by ch",
    "hamming_totals": f"with {found(2)} select mismatches, count(x) as n from (select unnest(range(3)) as mismatches) left join located using (mismatches) group by mismatches",
    "hamming_histogram": f"with {found(2)}, every as (select pattern_id, unnest(range(3)) as mismatches from patterns) select pattern_id, mismatches, count(x) as n from every left join located using (pattern_id, mismatches) group by pattern_id, mismatches",
}
