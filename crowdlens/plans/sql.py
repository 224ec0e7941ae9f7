"""SQL text for the DuckDB oracle: fixtures, the text pipeline and unrolled
inference rounds.  Every string here is an independent restatement of a
Spark plan in ``crowdlens.plans.catalog`` (same semantics, other engine)."""

from __future__ import annotations

from crowdlens.functions.special import digamma_sql
from crowdlens.functions.stem import stem_sql
from crowdlens.functions.text import DELIMITERS
from crowdlens.operators.model import DIAG_PRIOR, OFF_PRIOR
from crowdlens.sources.stopwords import STOP_WORDS

FIXTURE_D = """
select doc_id as row_id, 'w0' as worker_id, cast(doc_id as varchar) as task_id,
       cast(0 as int) as worker_label, text as body_text, cast(null as int) as gold_label
from documents
"""

# documents with faults by number (every 11th, 13th, ... document)
FIXTURE_F = """
select doc_id as row_id,
       case when doc_id % 11 = 0 then '  ' else concat('w', cast(doc_id % 7 as varchar)) end as worker_id,
       case when doc_id % 13 <> 0 then cast(cast(floor(doc_id / 3) as bigint) as varchar) end as task_id,
       cast(case when doc_id % 17 = 0 then 7 else doc_id % 2 end as int) as worker_label,
       case when doc_id % 19 = 0 then ' ' || chr(9) || ' ' when doc_id % 23 = 0 then '12 34'
            when doc_id % 29 = 0 then 'a1 b' else text end as body_text,
       cast(case when doc_id % 31 = 0 then 9 end as int) as gold_label
from documents
"""

FIXTURE_A = """
select cast(d.doc_id*100 + w.k as bigint) as row_id,
       concat('w', cast(w.k as varchar)) as worker_id,
       cast(d.doc_id as varchar) as task_id,
       cast(case when (d.doc_id*31 + w.k*17) % 100 < 5 + 3*w.k
                 then 1 - l.quality else l.quality end as int) as worker_label,
       d.text as body_text,
       cast(case when d.doc_id % 3 <> 0 then null
                 when d.doc_id % 17 = 0 and w.k % 2 = 0 then 1 - l.quality
                 else l.quality end as int) as gold_label
from documents d join labels l on d.doc_id = l.doc_id
cross join (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11)) as w(k)
where (d.doc_id*7 + w.k*13) % 12 < 4
"""

FIXTURE_B = """
select (li.l_orderkey*8 + li.l_linenumber)*100000000
         + cast(round(li.l_extendedprice*100) as bigint) as row_id,
       cast(li.l_suppkey as varchar) as worker_id,
       cast(li.l_orderkey as varchar) as task_id,
       cast(case when (li.l_orderkey*31 + li.l_suppkey*17) % 10 < 6 then g.gold
                 else case li.l_returnflag when 'A' then 0 when 'N' then 1 else 2 end
            end as int) as worker_label,
       p.p_name as body_text,
       cast(case when li.l_orderkey % 4 = 0 then g.gold end as int) as gold_label
from lineitem li
join (select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as gold
      from orders) g on li.l_orderkey = g.o_orderkey
join part p on li.l_partkey = p.p_partkey
"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SPLIT_RE = "[" + "".join("\\" + ch if ch in "[]\\-^&" else ch for ch in DELIMITERS) + "]"
STOP_LIST = ", ".join(q(w) for w in STOP_WORDS)


def clean_sql(x: str) -> str:
    t = f"lower({x})"
    t = f"regexp_replace({t}, '<[^<>]+>', '', 'g')"
    t = f"regexp_replace({t}, '[0-9]+', 'number', 'g')"
    t = f"regexp_replace({t}, '(http|https)://[^\\s]*', 'httpaddr', 'g')"
    t = f"regexp_replace({t}, '[^\\s]+@[^\\s]+', 'emailaddr', 'g')"
    t = f"regexp_replace({t}, '[$]+', 'dollar', 'g')"
    t = f"regexp_replace({t}, '@[^\\s]+', 'username', 'g')"
    return t


def tokens_sql(src: str, key: str, text: str = "body_text", keep_empty: bool = False) -> str:
    """``key, pos (0-based), token`` from a relation ``src``."""
    inner = (f"select {key}, string_split_regex({clean_sql(text)}, {q(SPLIT_RE)}) as parts "
             f"from {src}")
    exploded = (f"select {key}, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as pos "
                f"from ({inner})")
    out = (f"select {key}, cast(pos as int) as pos, "
           f"regexp_replace(part, '[^a-zA-Z0-9]', '', 'g') as token from ({exploded})")
    return out if keep_empty else f"select * from ({out}) where length(token) > 0"


def vocab_ctes(src: str = "a", cap: int | None = None, min_count: int = 1,
               prefix_rows: int | None = None, stem: bool = False) -> str:
    """CTEs ``docs, dterm, tcount, vocab`` (first-seen order)."""
    rows = src
    if prefix_rows is not None:
        rows = (f"(select * from {src} where row_id <= (select max(row_id) from "
                f"(select row_id from {src} order by row_id limit {prefix_rows})))")
    capf = f"where word_idx < {cap}" if cap is not None else ""
    return f"""
docs as materialized (select body_text, min(row_id) as doc_order, count(*) as n_rows
                      from {rows} where body_text is not null group by body_text),
dtoken as materialized (select doc_order, pos, token
                        from ({tokens_sql('docs', 'doc_order', keep_empty=True)})
                        where token not in ({STOP_LIST}) and length(token) > 0),
{_terms_cte('dterm', 'dtoken', 'doc_order, pos', stem)},
tcount as materialized (
  select g.term, g.n, g.df, f.doc_order as first_doc, f.pos as first_pos
  from (select term, count(*) as n, count(distinct doc_order) as df from dterm group by term) g
  join (select term, doc_order, pos from (
          select term, doc_order, pos,
                 row_number() over (partition by term order by doc_order, pos) as rn
          from dterm) where rn = 1) f on g.term = f.term),
vocab as materialized (
  select * from (select row_number() over (order by first_doc, first_pos) - 1 as word_idx, term
                 from tcount where n >= {min_count}) {capf})"""


def _terms_cte(name: str, tokens: str, keys: str, stem: bool) -> str:
    """``keys, term`` of a token relation: the token, or its stem."""
    if not stem:
        return f"{name} as materialized (select {keys}, token as term from {tokens})"
    return f"""{name}_stems as materialized ({stem_sql(f'(select distinct token from {tokens})')}),
{name} as materialized (select {keys}, s.term from {tokens} t
                        join {name}_stems s on s.token = t.token where length(s.term) > 0)"""


def task_words_ctes(src: str = "a", stem: bool = False) -> str:
    """CTEs ``ttext, tw`` (distinct task words against ``vocab``)."""
    return f"""
ttext as materialized (select task_id, arg_min(body_text, row_id) as body_text
                       from {src} group by task_id),
ttoken as materialized ({tokens_sql('ttext', 'task_id')}),
{_terms_cte('tterm', 'ttoken', 'task_id', stem)},
tw as materialized (select distinct t.task_id, v.word_idx
                    from tterm t join vocab v on t.term = v.term)"""


def _prior(label: str, t: int, c: int) -> str:
    return f"(case when {label} = {t} then {DIAG_PRIOR} else {OFF_PRIOR} end)"


def _dg(x: str) -> str:
    return digamma_sql(x)


def vb_ctes(c: int, rounds: int, words: bool, ann: str = "ann",
            prior_diag: float = DIAG_PRIOR, clamp: str | None = None) -> str:
    """Unrolled rounds: CTEs ``q{r}``, ``pi{r}``, ``rows{r}``, ``kappa{r}`` and
    (with words) ``phi{r}``, ``tot{r}`` for r = 1..rounds.  ``clamp``: relation
    ``task_id, label`` whose tasks have a fixed class."""
    def prior(label: str, t: int) -> str:
        return f"(case when {label} = {t} then {prior_diag} else {OFF_PRIOR} end)"

    row0 = prior_diag + OFF_PRIOR * (c - 1)
    T = range(c)
    out = []
    out.append(f"""pi0 as materialized (select worker_id, label, {', '.join(
        f'{prior("label", t)} as a_{t}' for t in T)} from (select distinct worker_id, label from {ann})),
rows0 as materialized (select distinct worker_id, {', '.join(f'{row0} as s_{t}' for t in T)} from {ann}),
kappa0 as materialized (select {', '.join(f'1.0 as k_{t}' for t in T)})""")
    if words:
        out.append(f"""phi0 as materialized (select distinct word_idx, {', '.join(
            f'1.0 as a_{t}' for t in T)} from tw),
tot0 as materialized (select {', '.join(f'cast((select count(*) from vocab) as double) as t_{t}' for t in T)})""")
    for r in range(1, rounds + 1):
        p = r - 1
        epi = (f"epi{r} as materialized (select p.worker_id, p.label, {', '.join(f'{_dg(f"p.a_{t}")} - {_dg(f"w.s_{t}")} as e_{t}' for t in T)} "
               f"from pi{p} p join rows{p} w on p.worker_id = w.worker_id)")
        ksum = " + ".join(f"k_{t}" for t in T)
        ek = f"ek{r} as materialized (select {', '.join(f'{_dg(f"k_{t}")} - {_dg(ksum)} as ek_{t}' for t in T)} from kappa{p})"
        parts = [f"select a.task_id, {', '.join(f'e.e_{t}' for t in T)} from {ann} a join epi{r} e "
                 f"on a.worker_id = e.worker_id and a.label = e.label"]
        extra = ""
        if words:
            extra = (f",\nephi{r} as materialized (select f.word_idx, {', '.join(f'{_dg(f"f.a_{t}")} - {_dg(f"o.t_{t}")} as e_{t}' for t in T)} "
                     f"from phi{p} f, tot{p} o)")
            parts.append(f"select w.task_id, {', '.join(f'e.e_{t}' for t in T)} from tw w join ephi{r} e "
                         f"on w.word_idx = e.word_idx")
        union = " union all ".join(parts)
        sc = (f"sc{r} as materialized (select s.task_id, {', '.join(f's.e_{t} + k.ek_{t} as e_{t}' for t in T)} "
              f"from (select task_id, {', '.join(f'sum(e_{t}) as e_{t}' for t in T)} from ({union}) group by task_id) s, ek{r} k)")
        m = f"greatest({', '.join(f'e_{t}' for t in T)})" if c > 1 else "e_0"
        z = " + ".join(f"exp(e_{t} - {m})" for t in T)
        qq = f"q{r} as materialized (select task_id, {', '.join(f'exp(e_{t} - {m}) / ({z}) as p_{t}' for t in T)} from sc{r})"
        if clamp is not None:
            ps = ", ".join(f"exp(e_{t} - {m}) / ({z}) as p_{t}" for t in T)
            fixed = ", ".join(f"case when c.label is null then s.p_{t} when c.label = {t} then 1.0 else 0.0 end as p_{t}"
                              for t in T)
            qq = (f"q{r} as materialized (select s.task_id, {fixed} from (select task_id, {ps} from sc{r}) s "
                  f"left join {clamp} c on c.task_id = s.task_id)")
        pi = (f"pi{r} as materialized (select a.worker_id, a.label, {', '.join(f'{prior("a.label", t)} + sum(q.p_{t}) as a_{t}' for t in T)} "
              f"from {ann} a join q{r} q on a.task_id = q.task_id group by a.worker_id, a.label)")
        rows = (f"rows{r} as materialized (select worker_id, {', '.join(f'{row0} + sum(a_{t} - {prior("label", t)}) as s_{t}' for t in T)} "
                f"from pi{r} group by worker_id)")
        kap = f"kappa{r} as materialized (select {', '.join(f'1.0 + sum(p_{t}) as k_{t}' for t in T)} from q{r})"
        block = f"{epi},\n{ek}{extra},\n{sc},\n{qq},\n{pi},\n{rows},\n{kap}"
        if words:
            block += (f",\nphi{r} as materialized (select w.word_idx, {', '.join(f'1.0 + sum(q.p_{t}) as a_{t}' for t in T)} "
                      f"from tw w join q{r} q on w.task_id = q.task_id group by w.word_idx)"
                      f",\ntot{r} as materialized (select {', '.join(f'(select count(*) from vocab) + sum(a_{t} - 1.0) as t_{t}' for t in T)} from phi{r})")
        out.append(block)
    return ",\n".join(out)


def predicted_sql(c: int, digits: int = 9) -> str:
    """Arg-max with ties to the lowest class, on rounded probabilities."""
    expr = "0"
    best = f"round(p_0, {digits})"
    for t in range(1, c):
        p = f"round(p_{t}, {digits})"
        expr = f"(case when {p} > {best} then {t} else {expr} end)"
        best = f"greatest({best}, {p})"
    return f"cast({expr} as int)"
