"""DuckDB SQL for the operators that SQL can express, over whole tables.

Plain definitions without any of the operators' methods: every pair that shares
a shingle, every pair of vectors of a label, every window of 50 words.
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Smallest node reachable from each: label is the smallest seen, spread until nothing changes.
_REACH = """reach as (select id, id as low from nodes union select l.b, r.low from reach r join links l on l.a = r.id),
components as (select id, min(low) as component_id from reach group by id)"""

OP1 = f"""with recursive w as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as words from documents),
s as (select distinct doc_id, shingle from (select doc_id, case when len(words) < 4 then array_to_string(words, ' ')
else unnest(list_transform(range(1, greatest(len(words) - 2, 2)), lambda i : array_to_string(words[i:i + 3], ' '))) end as shingle from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
same as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from same join n p on p.doc_id = a join n q on q.doc_id = b where 100 * shared >= 80 * (p.n + q.n - shared)),
nodes as (select doc_id as id from documents),
{_REACH}
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id) join components c on c.id = d.doc_id"""

OP5 = f"""with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and vec_id is not null and len(embedding) > 0
and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x : x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.93),
nodes as (select vec_id as id from embeddings),
{_REACH},
n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings left join n on a = vec_id join components c on c.id = vec_id"""

OP8 = """with v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and len(embedding) > 0
and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x : x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20"""

OP9 = f"""with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as words from documents),
t as (select doc_id, unnest(range(1, len(words) - 48)) as i, words from w where len(words) >= 50),
windows as (select doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) as h from t),
firsts as (select h, min(doc_id) as first from windows group by h),
hits as (select doc_id, i from windows join firsts using (h) where first < doc_id),
each as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from w),
marked as (select e.doc_id, e.word, e.i, coalesce(max(h.i) over (partition by e.doc_id order by e.i rows between unbounded preceding and current row), -100) > e.i - 50 as gone
from each e left join hits h on h.doc_id = e.doc_id and h.i = e.i),
kept as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept from marked group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join kept k on k.doc_id = d.doc_id"""

#: crc32, bit by bit, of a column with the digits of a number.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda x : cast(ascii(x) as bigint))),
lambda c, d : list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y : case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""

OP11 = f"""with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as words, {_CRC32.format("cast(doc_id as varchar)")} as h from documents),
x as (select doc_id, words, len(words) as n, h % 10 = 0 and len(words) > 0 as planted, h // 10 as g, (h // 10) % greatest(len(words), 1) as a from w),
y as (select *, 1 + (n - a) // (3 + g % 8) as p from x),
d as (select doc_id, n, case when planted then list_transform(range(n), lambda i : words[1 + case when i < a then i else a + (i - a) % p end]) else words end as words from y),
grams as (select doc_id, unnest(range(greatest(n - 5, 0))) as i, unnest(list_transform(range(greatest(n - 5, 0)), lambda i : hash(words[i + 1:i + 6]))) as h from d),
same as (select a.doc_id, a.i, b.i - a.i as q from grams a join grams b on a.doc_id = b.doc_id and a.h = b.h and a.i < b.i),
stretches as (select doc_id, q, min(i) as start, count(*) + 5 as shared from (select *, i - row_number() over (partition by doc_id, q order by i) as island from same) group by doc_id, q, island),
runs as (select doc_id, start, shared + q as length, min(q) as period from stretches where q <= shared and shared + q >= 12 group by doc_id, start, shared + q),
best as (select doc_id, start, length, period from runs qualify row_number() over (partition by doc_id order by length desc, start, period) = 1),
listed as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
each as (select doc_id, unnest(words) as word, unnest(range(n)) as i from d),
kept as (select doc_id, string_agg(word, ' ' order by i) as kept from each anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, cast(floor(1000 * length / period) as bigint) as exponent_milli,
sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256 from d left join listed using (doc_id) left join best using (doc_id) left join kept using (doc_id)"""

OP12 = rf"""with rows as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
t as (select row, lang, source, unnest(terms) as term from rows),
kept as (select lang, term from t group by lang, term having count(distinct row) >= 30),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by lang, source, term),
v as (select lang, count(*) as v from kept group by lang),
g as (select lang, source, coalesce(sum(n), 0) as total, coalesce(any_value(v), 0) as v
from (select distinct lang, source from rows) left join c using (lang, source) left join v using (lang) group by lang, source),
p as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n, 1 + (cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) as p
from g join kept using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
l as (select lang, sum(total) as total, any_value(v) as v from g group by lang),
q as (select p.lang, p.term, 1 + (cast(1000000000 as hugeint) * (sum(p.n) + 5)) // (any_value(l.total) + 5 * any_value(l.v)) as q from p join l using (lang) group by p.lang, p.term),
gaps as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
parts as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
left join gaps on gaps.lang = a.lang and gaps.source = a.source and gaps.item = b.source
union all select p.lang, p.source, 'term', p.term, p.p - q.q from p join q using (lang, term) where p.n > 0 and p.p > q.q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 50"""

ORACLE_SQL = {
    "op1_minhash_near_dedup": OP1,
    "op5_embedding_near_dedup": OP5,
    "op8_nearest_neighbours": OP8,
    "op9_substring_dedup": OP9,
    "op11_periodic_runs": OP11,
    "op12_source_divergence": OP12,
}
