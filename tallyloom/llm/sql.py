"""DuckDB SQL for the queries of this folder, written independently of the operators."""

from tallyloom.plans.sql import BASKETS, BLANK, LIVE, terms

P1 = f"""with {LIVE}, t as (select review_id, {terms('text')} as ts from live where text is not null),
n as (select count(*) as total from t where len(ts) > 0),
e as (select review_id, unnest(ts) as term from t),
c as (select term, count(*) as occurrences, count(distinct review_id) as records from e group by term)
select term, occurrences, records, case when records <= 2 then 'rare' when records * 10 > total then 'common' end as mark from c, n"""

P2 = f"""with {BASKETS},
n as (select count(distinct u) as total from k), m as (select b, count(*) as n from k group by b),
p as (select x.b as a, y.b as b, count(*) as n from k x join k y on x.u = y.u and x.b < y.b group by 1, 2)
select a as item_a, p.b as item_b, p.n as together, ma.n as baskets_a, mb.n as baskets_b, total as baskets,
  p.n * total / (ma.n * mb.n) as lift, log2(p.n * total / (ma.n * mb.n)) as pmi
from p join m ma on ma.b = p.a join m mb on mb.b = p.b cross join n"""

P3 = f"""with {LIVE}, t as (select review_id, business_id, list_distinct({terms('text')}) as ts from live where business_id is not null and text is not null),
r as (select business_id, count(*) as in_group from t where len(ts) > 0 group by 1),
g as (select count(*) as groups, sum(in_group) as records from r),
e as (select business_id, unnest(ts) as term from t), c as (select business_id, term, count(*) as k from e group by 1, 2),
d as (select term, count(*) as df, sum(k) as w from c group by 1),
s as (select c.business_id, c.term, c.k, r.in_group as n, d.df, g.groups, d.w - c.k as k2, g.records - r.in_group as n2
  from c join r using (business_id) join d on d.term = c.term cross join g),
x as (select *, 2 * (k * ln(k / (n * (k + k2) / (n + n2))) + case when n > k then (n - k) * ln((n - k) / (n * (n + n2 - k - k2) / (n + n2))) else 0 end
  + case when k2 > 0 then k2 * ln(k2 / (n2 * (k + k2) / (n + n2))) else 0 end
  + case when n2 > k2 then (n2 - k2) * ln((n2 - k2) / (n2 * (n + n2 - k - k2) / (n + n2))) else 0 end) as g2 from s)
select business_id, term, k as with_term, n as in_group, df as groups_with_term, groups,
  round(case when k * n2 >= k2 * n then 1 else -1 end * greatest(g2, 0), 4) as llr from x"""

P4 = f"""with {LIVE}, t as (select business_id, review_id, len({terms('text')}) as n from live where business_id is not null and text is not null)
select business_id, review_id from (select *, row_number() over (partition by business_id order by n desc, review_id) as k from t where n > 0) where k <= 3"""

P6 = f"""{LIVE}, k as (select distinct business_id as b, user_id as u from live where business_id is not null and user_id is not null),
m as (select b, count(*) as n, list_sort(list(u)) as us from k group by b having count(*) >= 8),
x as (select x.b as a, y.b as b, count(*) as n from k x join k y on x.u = y.u and x.b < y.b group by 1, 2),
pairs as (select a, x.b as b from x join m ma on ma.b = a join m mb on mb.b = x.b where x.n * 2 >= ma.n + mb.n - x.n)"""

P6_CLASSES = f"""with {P6}, c as (select b, n, min(b) over (partition by us) as class from m),
l as (select distinct cx.class as x, cy.class as y from pairs join c cx on cx.b = pairs.a join c cy on cy.b = pairs.b where cx.class <> cy.class),
e as (select class, count(*) as links from (select distinct least(x, y) as x, greatest(x, y) as y from l) u, unnest([u.x, u.y]) as t(class) group by class)
select b as business_id, c.class, n as size, coalesce(links, 0) as links from c left join e using (class)"""

P10 = f"""with t as (select doc_id, coalesce(text, '') as text, {terms("coalesce(text, '')")} as ts from documents),
e as (select doc_id, generate_subscripts(ts, 1) as i, ts from t where len(ts) >= 5),
g as (select doc_id, i, list_aggregate(ts[i : i + 4], 'string_agg', ' ') as gram from e where i + 4 <= len(ts)),
s as (select doc_id, i from (select *, row_number() over (partition by doc_id, gram order by i) as k from g) where k > 1),
c as (select doc_id, count(distinct p) as repeated from (select doc_id, unnest(range(i, i + 5)) as p from s) group by doc_id),
w as (select list(distinct lower(trim(word))) filter (where trim(word) <> '') as words from stopwords),
l as (select doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\r\\n\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^{BLANK}|{BLANK}$', '', 'g')), lambda x: x <> '') as lines from t)
select t.doc_id, len(ts)::int as n_terms, coalesce(repeated, 0)::int as repeated_terms,
  case when len(ts) > 0 then round(len(list_distinct(ts)) / len(ts), 6) else 0.0 end as distinct_share,
  case when len(ts) > 0 then round(len(list_filter(ts, lambda x: list_contains(words, x))) / len(ts), 6) else 0.0 end as stopword_share,
  case when len(lines) > 0 then round((len(lines) - len(list_distinct(lines))) / len(lines), 6) else 0.0 end as repeated_line_share
from t left join c using (doc_id) join l using (doc_id) cross join w"""

SQL = {
    "p1_found": f"select term, mark from ({P1}) where mark is not null",
    "p1_terms": P1,
    "p10_found": f"select doc_id from ({P10}) where n_terms >= 20 and repeated_terms * 4 >= n_terms",
    "p10_measures": P10,
    "p2_found": f"select item_a as business_a, item_b as business_b from ({P2}) where together >= 8 and together * baskets >= 3 * baskets_a * baskets_b",
    "p2_pairs": P2,
    "p3_found": f"select business_id, term from ({P3}) where with_term >= 3 and (with_term / in_group) * log2(groups / groups_with_term) >= 1.37",
    "p3_scores": P3,
    "p4_found": P4,
    "p6_classes": P6_CLASSES,
    "p9_checked": "select doc_id, true as whole, true as fits from documents",
    "p6_found": f"with {P6} select a as business_a, b as business_b from pairs",
}
