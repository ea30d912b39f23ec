"""DuckDB SQL for the core queries, written independently of the operators."""

from __future__ import annotations

from tallyloom.plans.sql import BASKETS, BLANK, LIVE, RATINGS, STOPWORDS, graph, trimmed

#: The names of the list, longest first, are searched in the field as one pattern: another way than the operator's.
P5 = r"""with live as (select * from (select *, row_number() over (partition by business_id order by updated_at desc) as version_rank from business) where version_rank = 1),
l as (select name, lower(nfc_normalize(name)) as plain from category_list),
p as (select string_agg(regexp_escape(plain), '|' order by length(plain) desc) as pattern from l),
b as (select business_id, replace(replace(replace(replace(regexp_replace(lower(nfc_normalize(categories)), '[\s\x{A0}\x{3000}]+', ' ', 'g'), '""', '"'), '\"', '"'), '''''', ''''), '\''', '''') as plain from live where categories is not null),
e as (select business_id, regexp_extract_all(plain, pattern) as found from b, p),
u as (select business_id, generate_subscripts(found, 1) as pos, found from e)
select business_id, pos::int as pos, name as category from u join l on l.plain = found[pos]"""

P7 = """select 'business_id' as field, business_id as key_value, {0} from live where business_id is not null group by business_id
union all select 'user_id', user_id, {0} from live where user_id is not null group by user_id"""

TOP_WORDS = f"""with {STOPWORDS}, t as (select unnest(string_split_regex(lower(text), '{BLANK}')) as raw from review),
w as (select regexp_replace(raw, '[^a-zA-Z0-9]', '', 'g') as word from t where raw not in ('(', '[', ',', '.', '!', '?', ':', ';', ']', ')'))
select word, count(*) as n from w where word <> '' and word not in (select word from stop) group by word order by n desc, word limit 50"""

CATEGORY_MEAN = f"""with {LIVE}, b as (select * from (select *, row_number() over (partition by business_id order by updated_at desc) as k from business) where k = 1),
l as (select business_id, unnest(string_split(categories, ',')) as raw from b where categories is not null),
m as (select {trimmed('raw')} as label, round(avg(stars), 6) as mean from live join l using (business_id) group by 1)
select label, mean from m order by mean desc nulls last, label limit 20"""

PARTITION_SIZES = """with c as (select business_id from review where business_id is not null group by 1 having count(*) > 50),
p as (select (unicode(right(business_id, 1)) % 20)::int as partition_id, count(*) as n_items from c group by 1)
select r.range::int as partition_id, coalesce(n_items, 0) as n_items from range(20) r left join p on p.partition_id = r.range"""


def itemset_sql(levels: int, support: int = 8) -> str:
    """The sets of each basket, grown by one item a level and kept if they are frequent; ``levels`` has to be one more than
    the largest size that occurs, which ends in an empty level."""
    made = [f"s1 as (select b as i1, count(*) as n from k group by b having count(*) >= {support}), o1 as (select u, b as i1 from k where b in (select i1 from s1))"]
    for n in range(2, levels + 1):
        have, all_ = ", ".join(f"o.i{i}" for i in range(1, n)), ", ".join(f"i{i}" for i in range(1, n + 1))
        made.append(f"g{n} as materialized (select o.u, {have}, x.i1 as i{n} from o{n - 1} o join o1 x on x.u = o.u and x.i1 > o.i{n - 1})")
        made.append(f"s{n} as materialized (select {all_}, count(*) as n from g{n} group by {all_} having count(*) >= {support})")
        made.append(f"o{n} as materialized (select g.* from g{n} g semi join s{n} s on {' and '.join(f'g.i{i} = s.i{i}' for i in range(1, n + 1))})")
    out = " union all ".join(f"select {n} as size, concat_ws(',', {', '.join(f'i{i}' for i in range(1, n + 1))}) as items, n as support from s{n}" for n in range(1, levels + 1))
    return f"with {BASKETS}, {', '.join(made)} {out}"


def labels_sql(start: str) -> str:
    return f"with {start}, l0 as (select distinct src as id, src as label from arcs), " + ", ".join(
        f"""l{i} as (select src as id, label from (select src, label, row_number() over (partition by src order by count(*) desc, label) as k
  from arcs join l{i - 1} on id = dst group by src, label) where k = 1)""" for i in range(1, 6)
    ) + " select id, label from l5"


def components_sql(start: str) -> str:
    return f"""with recursive {start}, walk as (select distinct src as id, src as seen from arcs union select id, dst from walk join arcs on src = seen)
select id, min(seen) as component from walk group by id"""


def betweenness_sql(start: str, levels: int) -> str:
    """Shortest paths from every vertex, level by level, and credits back from the last level; ``levels`` is at least the
    diameter."""
    parts = [start, "f0 as materialized (select distinct src as root, src as v, 1.0::double as paths from arcs)"]
    for i in range(1, levels + 1):
        fresh = " and ".join(f"not exists (select 1 from f{j} z where z.root = f.root and z.v = dst)" for j in range(max(0, i - 2), i))
        parts.append(f"f{i} as materialized (select f.root, dst as v, sum(paths) as paths from f{i - 1} f join arcs on src = f.v where {fresh} group by 1, 2)")
    parts.append(f"c{levels} as (select root, v, paths, 1.0::double as credit from f{levels})")
    for i in range(levels, 0, -1):
        parts.append(f"""w{i} as materialized (select c.root, c.v, p.v as p, c.credit * p.paths / c.paths as flow
  from c{i} c join arcs on arcs.src = c.v join f{i - 1} p on p.root = c.root and p.v = arcs.dst)""")
        parts.append(f"""c{i - 1} as materialized (select f.root, f.v, f.paths, 1.0 + coalesce(g.gain, 0) as credit from f{i - 1} f
  left join (select root, p, sum(flow) as gain from w{i} group by 1, 2) g on g.root = f.root and g.p = f.v)""")
    flows = " union all ".join(f"select v, p, flow from w{i}" for i in range(1, levels + 1))
    return f"with {', '.join(parts)} select least(v, p) as src, greatest(v, p) as dst, round(sum(flow) / 2, 6) as betweenness from ({flows}) group by 1, 2"


MINHASH = """u as (select user_id, row_number() over (order by user_id) - 1 as x, count(*) over () as n from (select distinct user_id from v)),
h as (select business_id, i, min((((3583 + i) * x + 4297 * i) % 939193) % (2 * n)) as h from v join u using (user_id), range(1, 31) t(i) group by 1, 2)"""
VISITS = LIVE + ", v as (select distinct business_id, user_id from live where business_id is not null and user_id is not null)"
CANDIDATES = f"{VISITS}, {MINHASH}, c as (select distinct x.business_id as a, y.business_id as b from h x join h y on x.i = y.i and x.h = y.h and x.business_id < y.business_id)"
SHARED = f"""{CANDIDATES}, z as (select business_id, count(*) as n from v group by 1),
s as (select a, b, count(*) as shared from c join v x on x.business_id = a join v y on y.business_id = b and y.user_id = x.user_id group by 1, 2),
j as (select a, b, shared / (x.n + y.n - shared) as jaccard from s join z x on x.business_id = a join z y on y.business_id = b)"""
SIMILAR = f"with {SHARED} select a as b1, b as b2, round(jaccard, 6) as sim from j where jaccard >= 0.05"
SIMILAR_GRAPH = f"{SHARED}, edges as (select a as src, b as dst from j where jaccard >= 0.3), arcs as (select src, dst from edges union all select dst, src from edges)"

TFIDF = f"""{VISITS}, {STOPWORDS}, t as (select business_id as item, review_id as doc, unnest(string_split_regex(regexp_replace(lower(text), '[0-9!-/:-@\\[-`{{-~]', '', 'g'), '{BLANK}')) as word
  from live where business_id is not null),
c as (select item, doc, word, count(*) as n from t where word <> '' and word not in (select word from stop) group by 1, 2, 3),
d as (select word, log2((select count(distinct business_id) from review) / count(*)) as idf from c group by 1),
scores as (select item, doc, word, n / max(n) over (partition by item, doc) * idf as tfidf from c join d using (word)),
items as (select item, word, place::int as place from (select *, row_number() over (partition by item order by round(tfidf, 9) desc, word, doc) as place from scores) where place <= 200),
touched as (select user_id as "user", word, count(*) as n from v join items on item = business_id group by 1, 2),
users as (select "user", word from touched where "user" in (select "user" from touched group by 1 having sum(n) > 1))"""

COSINE = f"""with {TFIDF}, ni as (select item, count(*) as n from items group by 1), nu as (select "user", count(*) as n from users group by 1),
s as (select v.user_id, v.business_id, count(*) as shared from v join (select distinct item, word from items) i on i.item = v.business_id
  join users on users."user" = v.user_id and users.word = i.word group by 1, 2)
select user_id, business_id, round(shared / (sqrt(nu.n) * sqrt(ni.n)), 6) as sim from s join ni on item = business_id join nu on nu."user" = user_id
where shared / (sqrt(nu.n) * sqrt(ni.n)) > 0.01"""

PEARSON = """case when n * sxy - sx * sy = 0 or (n * sxx - sx * sx) * (n * syy - sy * sy) = 0 then 1.0
  else (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) end"""


def pearson_sql(entity: str, other: str) -> str:
    """(a, b, sim, n) of all pairs with three common raters."""
    return f"""m as (select x.{entity} as a, y.{entity} as b, count(*) as n, sum(x.stars) as sx, sum(y.stars) as sy, sum(x.stars * x.stars) as sxx,
  sum(y.stars * y.stars) as syy, sum(x.stars * y.stars) as sxy from r x join r y on x.{other} = y.{other} and x.{entity} < y.{entity} group by 1, 2 having count(*) >= 3),
p as (select a, b, n, {PEARSON} as sim from m)"""


ITEM_MODEL = f"{RATINGS}, {pearson_sql('i', 'u')}, model as (select a, b, sim from p where sim > 0)"
USER_MODEL = f"""{RATINGS}, {pearson_sql('u', 'i')}, w as (select i, row_number() over (order by i) - 1 as x, count(*) over () as n from (select distinct i from r)),
g as (select u, k, min((((199933 + k) * x + 115249 * k) % 1000000007) % (2 * n)) as h from r join w using (i), range(1, 31) t(k) group by 1, 2),
z as (select u, count(*) as n from r group by 1),
model as (select a, b, sim from p join z x on x.u = a join z y on y.u = b where sim > 0 and p.n / (x.n + y.n - p.n) > 0.01
  and exists (select 1 from g ga join g gb on ga.k = gb.k and ga.h = gb.h where ga.u = a and gb.u = b))"""
NEAREST = """e as (select a as t, b as near, sim from model union all select b, a, sim from model),
q as (select r.u, r.i, o.stars, sim * pow(abs(sim), 1.5) as w, row_number() over (partition by r.u, r.i order by round(sim, 9) desc, near) as k
  from r join e on t = r.{0} join r o on o.{1} = r.{1} and o.{0} = near)"""
ITEM_PREDICT = f"""with {ITEM_MODEL}, {NEAREST.format('i', 'u')}, s as (select u, i, sum(stars * w) as num, sum(w) as den from q where k <= 3 group by 1, 2)
select r.u as "user", r.i as item, round(case when num <> 0 and den <> 0 then num / den else 3.823989 end, 5) as stars from r left join s on s.u = r.u and s.i = r.i"""
USER_PREDICT = f"""with {USER_MODEL}, {NEAREST.format('u', 'i')}, s as (select u, i, round(sum(stars * w) - sum(stars) / 3 * sum(w), 9) as num, sum(w) as den from q where k <= 3 group by 1, 2),
means as (select u, avg(stars) as mean from r group by 1)
select r.u as "user", r.i as item, round(case when num <> 0 and den <> 0 then mean + num / den else 3.823989 end, 5) as stars
from r join means on means.u = r.u left join s on s.u = r.u and s.i = r.i"""

SQL: dict[str, str] = {
    "review_count": "select count(*) as n from review",
    "date_contains_count": "select count(*) as n from review where contains(date, '2018')",
    "order_year_count": "select count(*) as n from orders where year(o_orderdate) = 1997",
    "distinct_users": "select count(distinct user_id) as n from review",
    "top_users": "select user_id, count(*) as n from review where user_id is not null group by 1 order by n desc, user_id limit 10",
    "top_words": TOP_WORDS,
    "category_mean": CATEGORY_MEAN,
    "popular_items": "select business_id, count(*) as n from review where business_id is not null group by 1 having count(*) > 100",
    "partition_sizes": PARTITION_SIZES,
    "region_pairs": "select user_id, business_id from review where business_id in (select business_id from business where upper(trim(state)) = 'NV')",
    "baskets": f"with {BASKETS} select u as basket, string_agg(b, ',' order by b) as items from k group by u having count(*) > 20",
    "frequent_itemsets": itemset_sql(7),
    "cooccurrence_edges": f"with {graph(8)} select src, dst, shared from edges",
    "components": components_sql(graph(8)),
    "label_propagation": labels_sql(graph(8)),
    "betweenness": betweenness_sql(graph(8), 12),
    "similar_components": components_sql(SIMILAR_GRAPH),
    "similar_labels": labels_sql(SIMILAR_GRAPH),
    "component_lines": f"""select count(*)::int as n, string_agg('''' || id || '''', ', ' order by id) as line from ({components_sql(SIMILAR_GRAPH)}) group by component""",
    "minhash_signatures": f"with {VISITS}, {MINHASH} select business_id, string_agg(h::varchar, ',' order by i) as signature from h group by 1",
    "lsh_candidates": f"with {CANDIDATES} select a, b from c",
    "similar_items": SIMILAR,
    "tfidf": f"with {TFIDF} select item, doc, word, round(tfidf, 6) as tfidf from scores",
    "item_profiles": f"with {TFIDF} select item, word, place from items",
    "user_profiles": f"""with {TFIDF} select "user", count(*) as words, min(word) as first, max(word) as last,
  sum(('0x' || md5(word)[:8])::bigint)::bigint as digest from users group by 1""",
    "content_cosine": COSINE,
    "item_cf_model": f"with {ITEM_MODEL} select a, b, round(sim, 6) as sim from model",
    "user_cf_model": f"with {USER_MODEL} select a, b, round(sim, 6) as sim from model",
    "item_cf_predict": ITEM_PREDICT,
    "user_cf_predict": USER_PREDICT,
    "order_interactions": """select o_custkey as "user", l_partkey as item, max(1.0 + (l_quantity::int - 1) % 5)::double as stars
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""",
    "hourly_events": """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events
  where event_type is not null group by 1, 2""",
    "reviews_via_json": "select review_id, user_id, business_id, stars, date, text from review",
    "business_via_json": "select business_id, name, state, categories, stars, review_count, map_extract(hours, 'Monday')[1] as monday from business",
    "pairs_via_csv": f"with {BASKETS} select u as user_id, b as business_id from k",
    "stopwords_via_text": "select trim(word) as word from stopwords where trim(word) <> ''",
    "lookups_via_json": "select user_id, row_number() over (order by user_id) - 1 as user_index from (select distinct user_id from review where user_id is not null)",
    "p5_found": P5,
    "p7_found": f"with {LIVE}, k as ({P7.format('count(*) as reviews')}) select field, key_value from k where reviews * 100 > (select count(*) from live)",
    "p7_per_key": f"with {LIVE} {P7.format('count(*) as reviews, round(avg(stars), 6) as mean_stars, min(stars) as least, max(stars) as most')}",
}
