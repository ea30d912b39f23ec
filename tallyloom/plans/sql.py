"""Pieces of SQL that several oracles share (DuckDB's dialect)."""

LIVE = """live as (
  select * from (select *, row_number() over (partition by review_id order by loaded_at desc) as version_rank from review)
  where version_rank = 1)"""

#: The terms of ``{0}`` as a list. RE2 can't subtract from a class, so single characters are set apart by blanks first.
TERMS = (
    "regexp_extract_all(regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[\\x{{27}}\\x{{2019}}\\x{{AD}}\\x{{200B}}]', '', 'g'), "
    "'([\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}])', ' \\1 ', 'g'), '[\\p{{L}}\\x{{3040}}-\\x{{30FF}}]+')"
)


def terms(text: str) -> str:
    return TERMS.format(text)


BLANK = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def trimmed(key: str) -> str:
    return f"regexp_replace({key}, '^{BLANK}|{BLANK}$', '', 'g')"


#: Distinct (u, b) of the basket table.
BASKETS = f"""k as (select distinct {trimmed('user_id')} as u, {trimmed('business_id')} as b from small2
  where user_id is not null and business_id is not null)"""


def graph(k: int) -> str:
    """Users of the basket table that share at least ``k`` items."""
    return f"""{BASKETS},
edges as (select x.u as src, y.u as dst, count(*) as shared from k x join k y on x.b = y.b and x.u < y.u group by 1, 2 having count(*) >= {k}),
arcs as (select src, dst from edges union all select dst, src from edges)"""


#: One rating per user and item.
RATINGS = LIVE + """,
r as (select user_id as u, business_id as i, max(stars) as stars from live
  where user_id is not null and business_id is not null and stars is not null group by 1, 2)"""

STOPWORDS = "stop as (select distinct lower(trim(word)) as word from stopwords where trim(word) <> '')"
