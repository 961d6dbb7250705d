"""The registered queries once more as DuckDB SQL, by plain definitions over whole tables."""

from __future__ import annotations

from scenelake.llm import mixing, phrases, quality, secrets
from scenelake.llm.common import WORD

TEXT = "coalesce(text,'')"
WORDS = f"regexp_extract_all({TEXT}, '{WORD}')"


def _mixing(target: mixing.MixTarget = mixing.PRODUCTION) -> str:
    levels = list(mixing.LEVELS)
    parts = [
        f"""docs as (select doc_id, 'd'||(coalesce(try_cast(nullif(regexp_extract(source,'([0-9]{{1,9}})$',1),'') as int),0)%4) as domain,
  coalesce(lang,'unknown') as lang, coalesce(source,'unknown') as source, len({WORDS})::bigint as tokens from documents)""",
        f"""leaf as (select domain, lang, source, sum(tokens)::bigint as supply, (sum(tokens)*{target.max_epochs})::bigint as most
from docs group by all having sum(tokens)>0)""",
        f"given0 as (select least(sum(supply)*{target.budget_percent}/100.0, sum(most))::double as given from leaf)",
    ]
    for depth, level in enumerate(levels):
        parent, own = levels[:depth], levels[: depth + 1]
        cases = " ".join(f"when '{v}' then {w!r}" for v, w in target.weights.get(level, {}).items())
        weight = f"(case {level} {cases} else 1.0 end)::double" if cases else "1.0::double"
        join = f"join given{depth} using ({', '.join(parent)})" if parent else "cross join given0"
        family = f"partition by {', '.join(parent)}" if parent else ""
        parts += [
            f"""node{depth} as (select n.*, given as above, {weight} as w, most/{weight} as ratio
from (select {', '.join(own)}, sum(most)::bigint as most from leaf group by all) n {join})""",
            f"""rate{depth} as (select *, ratio <= rate as filled from (select *, (above-coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding),0))
  /sum(w) over (o rows between current row and unbounded following) as rate from node{depth} window o as ({family} order by ratio, {level})) q)""",
            f"""given{depth + 1} as (select {', '.join(own)}, case when filled then most::double
  else w*first_value(rate) over ({family} order by filled, ratio, {level}) end as given from rate{depth})""",
        ]
    names = ", ".join(levels)
    parts += [
        f"budget as (select {names}, supply, least(floor(round(given,3)), most)::bigint as b from leaf join given{len(levels)} using ({names}))",
        f"""drawn as (select doc_id, {names}, tokens, coalesce(b//supply,0) as epochs, b-(b//supply)*supply as rest,
  md5('{target.seed}:'||coalesce(b//supply,0)||':'||doc_id) as h from docs left join budget using ({names}))""",
    ]
    return f"""with {', '.join(parts)}
select doc_id, {names}, tokens as n_tokens, (epochs+case when rest is not null and
  sum(tokens) over (partition by {names} order by h, doc_id, tokens rows unbounded preceding) <= rest then 1 else 0 end)::bigint as copies from drawn"""


def _secrets(rules: secrets.EntropyRules = secrets.EntropyRules()) -> str:
    w = rules.window
    sums = [0]
    for gain in rules.gains:
        sums.append(sums[-1] + gain)
    run = f"[{secrets.ALPHABET.replace('-', '')}-]{{{w},}}"
    quoted = lambda p: p.replace("'", "''")

    def found(kind: int, pattern: str, value: str) -> str:
        p = quoted(pattern)
        return f"""select doc_id, {kind} as kind, unnest(regexp_extract_all(text,'{p}')) as s, unnest(regexp_extract_all(text,'{p}',{value})) as v,
  unnest(list_transform(string_split_regex(text,'{p}')[:-2], lambda x: length(x))) as gap, generate_subscripts(regexp_extract_all(text,'{p}'),1) as i
from docs where regexp_matches(text,'{p}')"""

    # These regular expressions look neither ahead nor back: a cutting "=" is marked first, and only what ends in
    # "/" can be followed by parts of a path.
    words = "(?:[A-Za-z_-]{1,19}[0-9]{0,3}(?:/|$))*"
    whole_first = sorted(rules.allowed, key=lambda a: not a.startswith("^"))
    cuts = quoted("|".join([*(f"(?:{a})" + (words if a.endswith("/){3}") else "") for a in whole_first), "\x01"]))
    upto = lambda values: f"coalesce(list_sum(list_transform({values}[:j-1], lambda x: length(x))),0)"
    return f"""with docs as (select doc_id, {TEXT} as text from documents),
raw as ({found(0, secrets.ASSIGN, '2')} union all {found(1, secrets.ACCESS, '0')} union all {found(2, secrets.HEX, '0')} union all {found(3, run, '0')}),
placed as (select doc_id, kind, i, s, v, (sum(gap+length(s)) over (partition by doc_id, kind order by i))::bigint as fin from raw),
cand as (select doc_id, i, fin-length(s) as pos, regexp_replace(s,'=([^=])',chr(1)||'\\1','g') as s from placed where kind=3 and regexp_matches(s,'[0-9]')),
parts as (select *, string_split_regex(s,'{cuts}') as p, regexp_extract_all(s,'{cuts}') as m from cand),
part as (select *, unnest(p) as t, generate_subscripts(p,1) as j from parts),
token as (select doc_id, i, j, t, (pos+{upto('p')}+{upto('m')})::bigint as a from part where length(t)>={w} and regexp_matches(t,'[0-9]')),
win as (select *, substr(t,o+1,{w}) as x from (select *, unnest(range(0,length(t)-{w}+1)) as o from token) q),
chars as (select doc_id, i, j, a, t, o, x, c, count(*) as n from (select *, unnest(string_split(x,'')) as c from win) q group by all),
high as (select doc_id, i, j, a, a+length(t) as b from chars group by doc_id, i, j, a, t, o, x
  having sum(({sums})[n+1]) <= case when regexp_full_match(x,'[0-9a-fA-F]+') then {rules.most(rules.hex_bits)}
    when regexp_full_match(x,'[A-Z0-9]+') then {rules.most(rules.upper_bits)} when regexp_matches(x,'[a-z]') and regexp_matches(x,'[A-Z]') then {rules.most(rules.mixed_bits)}
    else {rules.most(rules.base64_bits)} end and regexp_matches(x,'[0-9]') and regexp_matches(x,'[^0-9]')),
span as (select doc_id, fin-length(s) as a, kind, fin as b from placed where kind<3 and (kind>0 or length(v)>=6)
  union all select distinct doc_id, a, 3, b from high),
named as (select *, ({list(secrets.KINDS)})[kind+1]||':'||a||':'||b as t from span)
select d.doc_id, count(*) filter (kind=0)::bigint as n_assign, count(*) filter (kind=1)::bigint as n_access, count(*) filter (kind=2)::bigint as n_hex,
  sha256(coalesce(string_agg(t, ',' order by a, kind, b) filter (kind<3),'')) as base_sha256, coalesce(string_agg(t, ',' order by a, kind, b),'') as spans
from docs d left join named using (doc_id) group by d.doc_id"""


_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
WARC = f"""with p as (select page_id, coalesce(html,'') as h, sha1(coalesce(html,'')) as x from pages),
largest as (select x, max(page_id) as first_ from p group by x)
select page_id, strlen(h)::bigint as payload_bytes,
  array_to_string(list_transform(range(0,32), lambda i: substr({_BASE32}, (((('0x'||substr(x,(5*(i//4)+1)::int,5))::int >> (15-5*(i%4))::int) & 31)+1)::int, 1)),'') as payload_digest,
  case when page_id=first_ then 'response' else 'revisit' end as record_type, case when page_id<>first_ then first_ end as refers_to,
  case when page_id=first_ then x end as read_sha1
from p join largest using (x)"""

TOP_K = """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024*x::double)) as v from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))))
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank
  from (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id<>c.vec_id where q.vec_id%100=0) s) r
where rank<=10"""

JOIN = f"""with recursive docs as (select doc_id, regexp_extract_all(translate({TEXT},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
gram as (select distinct doc_id, array_to_string(w[i:i+3],' ') as g from (select *, unnest(range(1, greatest(len(w)-3,1)+1)) as i from docs where len(w)>0) q),
size as (select doc_id, count(*) as n from gram group by 1),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from gram a join gram b on a.g=b.g and a.doc_id<b.doc_id group by all),
link as (select x, y from shared join size s on s.doc_id=x join size t on t.doc_id=y where 100*c >= 85*(s.n+t.n-c)),
both_ as (select x, y from link union all select y, x from link),
reach(doc_id, r) as (select doc_id, doc_id from docs union select b.x, r from reach join both_ b on b.y=reach.doc_id)
select d.doc_id, coalesce(n,0)::bigint as n_shingles, c as component_id
from docs d left join size using (doc_id) join (select doc_id, min(r) as c from reach group by 1) m on m.doc_id=d.doc_id"""

LINKS = JOIN.rpartition("\nselect d.doc_id")[0] + """
select d.doc_id, coalesce(n,0)::bigint as n_shingles, c as component_id, coalesce(l,0)::bigint as n_links
from docs d left join size using (doc_id) join (select doc_id, min(r) as c from reach group by 1) m on m.doc_id=d.doc_id
left join (select x as doc_id, count(*) as l from both_ group by 1) k on k.doc_id=d.doc_id"""


def _quality_histograms(rules: quality.QualityRules) -> str:
    left, steps = "text", []
    for name, pattern in quality.CHARACTER_CLASSES.items():
        steps.append(f"regexp_replace({left},'{pattern.replace(chr(39), chr(39) * 2)}','','g') as _{name}")
        left = f"_{name}"
    names = ["text", *(f"_{n}" for n in quality.CHARACTER_CLASSES)]
    chain = f"select doc_id, lang, {TEXT} as text, {WORDS} as ws from documents"
    for step in steps:
        chain = f"select *, {step} from ({chain}) q"
    sizes = [f"length({a})-length({b})" for a, b in zip(names, names[1:])] + [f"length({names[-1]})"]
    place = list(quality.CHARACTER_CLASSES).index
    listed = "[" + ",".join(f"'{w}'" for w in rules.words) + "]"
    k, near = rules.window, []
    for kind in ("classes", "commons"):
        near.append(f"""{kind}_at as (select doc_id, lang, unnest({kind}) as n, generate_subscripts({kind},1) as i from counted),
{kind}_ref as (select lang, i, sum(n)/sum(sum(n)) over (partition by lang) as q from {kind}_at where lang is not null group by lang, i),
{kind}_own as (select doc_id, i, n/nullif(sum(n) over (partition by doc_id),0) as p from {kind}_at),
{kind}_d as (select doc_id, min(d) as d from (select doc_id, r.lang, sqrt(greatest(0,sum(coalesce(p*log2(nullif(p,0)/((p+q)/2)),0)+coalesce(q*log2(nullif(q,0)/((p+q)/2)),0))/2)) as d
  from {kind}_own o join {kind}_ref r using (i) where p is not null group by all) x group by 1)""")
    return f"""with raw as ({chain}),
repeated as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i,i+{k})) as j from (select doc_id, i, count(*) over (partition by doc_id, g) as c
  from (select doc_id, i, array_to_string(ws[i:i+{k - 1}],' ') as g from (select doc_id, ws, unnest(range(1,len(ws)-{k}+2)) as i from raw where len(ws)>{k}) a) b) c where c>1) d group by 1),
counted as (select doc_id, lang, len(ws)::bigint as n_words, [{', '.join(sizes)}]::bigint[] as classes,
  list_transform({listed}, lambda w: len(list_filter(ws, lambda x: x=w))) || [len(list_filter(ws, lambda x: not list_contains({listed},x)))] as commons,
  (length(text)-({sizes[place('blank')]}))::bigint as word_chars, ({sizes[place('symbol')]})::bigint as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x,'{WORD}')) as lines, length(text) as chars from raw),
{', '.join(near)},
judged as (select c.*, coalesce(r.n,0)::bigint as n_repeat_words, (len(lines)-len(list_distinct(lines)))::bigint as n_dup_lines,
  n_words<{rules.min_words} or 100*coalesce(r.n,0)>{rules.max_repeat_percent}*n_words as base_failed, x.d as cd, y.d as wd
from counted c left join repeated r using (doc_id) left join classes_d x using (doc_id) left join commons_d y using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(chars>={rules.min_chars} and cd>{rules.max_class_distance!r},false) and not coalesce(n_words>={rules.min_words_compared} and wd>{rules.max_word_distance!r},false) as kept,
  round(cd,6) as class_distance, round(wd,6) as word_distance from judged"""


def _quality(columns: str, rules: quality.QualityRules = quality.QualityRules()) -> str:
    """The verdict by all rules, and by the whole histograms alone."""
    listed = "[" + ",".join(f"'{w}'" for w in rules.words) + "]"
    return f"""with base as ({_quality_histograms(rules)}),
words as (select doc_id, lang, {WORDS} as ws from documents),
own as (select doc_id, lang, ws, list_transform({listed}, lambda w: len(list_filter(ws, lambda x: x=w)))::bigint[] as h from words),
at_ as (select doc_id, lang, unnest(h) as n, generate_subscripts(h,1) as i from own),
ref as (select lang, i, sum(n)/sum(sum(n)) over (partition by lang) as q from at_ where lang is not null group by lang, i),
shares as (select sum(n) filter (i>0)/sum(n) as s from (select lang, 1 as i, sum(n) as n from at_ where lang is not null group by lang
  union all select lang, 0, sum(len(ws)-list_sum(h)) from own where lang is not null group by lang) g group by lang having sum(n) filter (i>0)>0),
between as (select sqrt(greatest(0,sum(coalesce(a.q*log2(nullif(a.q,0)/((a.q+b.q)/2)),0)+coalesce(b.q*log2(nullif(b.q,0)/((a.q+b.q)/2)),0))/2)) as d from ref a join ref b on a.i=b.i and a.lang<b.lang group by a.lang, b.lang),
bounds as (select coalesce(round({rules.listed_part!r}*(select min(s) from shares),4),0) as least, coalesce(round({rules.distance_part!r}*(select min(d) from between),4),{rules.lone_distance!r}) as most),
share as (select doc_id, i, n/nullif(sum(n) over (partition by doc_id),0) as p from at_),
near as (select doc_id, min(d) as d from (select doc_id, r.lang, sqrt(greatest(0,sum(coalesce(p*log2(nullif(p,0)/((p+q)/2)),0)+coalesce(q*log2(nullif(q,0)/((p+q)/2)),0))/2)) as d
  from share join ref r using (i) where p is not null group by all) x group by 1),
all_ as (select b.* exclude (kept), list_sum(o.h)::bigint as n_listed, b.kept as kept_histograms, round(n.d,6) as listed_distance, b.kept and not list_sum(o.h)+{rules.listed_slack}<least*b.n_words
  and not coalesce(list_sum(o.h)>={rules.min_listed} and n.d>most,false) as kept from base b join own o using (doc_id) left join near n using (doc_id), bounds)
select {columns} from all_"""


def _phrases(p: phrases.PhraseParameters = phrases.PhraseParameters()) -> str:
    return f"""with pieces as (select coalesce(lang,'und') as lang, unnest(string_split_regex(translate({TEXT},
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
spans as (select lang, w, unnest(range(1, {p.longest + 1})) as m from words where len(w) > 0),
begins as (select lang, w, m, unnest(range(1, len(w)-m+2)) as i from spans where len(w) >= m),
f as (select lang, m, array_to_string(w[i:i+m-1], ' ') as phrase, count(*)::hugeint as f from begins group by all),
total as (select lang, sum(f)::hugeint as n from f where m = 1 group by 1),
cand as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1 and f >= {p.least}),
cut as (select lang, m, phrase, a, w, unnest(range(1, m)) as k from cand),
part as (select c.lang, c.m, c.phrase, c.a, c.k, x.f as l, y.f as r, n, 1000*c.a*n//(x.f*y.f) as score from cut c join total using (lang)
  join f x on x.lang=c.lang and x.phrase=array_to_string(c.w[1:k], ' ') join f y on y.lang=c.lang and y.phrase=array_to_string(c.w[k+1:c.m], ' ')),
best as (select * from part qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (select distinct b.lang, b.phrase from cand b join cand o on o.lang=b.lang and o.m>b.m and 100*o.a>=100*b.a and contains(' '||o.phrase||' ', ' '||b.phrase||' '))
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best anti join held using (lang, phrase)) where rank <= {p.top}"""


ORACLES = {
    "op2_mixing": _mixing(),
    "op3_secret_scans": _secrets(),
    "op4_warc": WARC,
    "op5_exact_top_k": TOP_K,
    "op9_ngram_jaccard_join": LINKS,
    "op9_ngram_jaccard_links": LINKS,
    "op10_quality_rules": _quality(
        "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance, n_listed, listed_distance"
    ),
    "op10_quality_listed": _quality("doc_id, n_words, n_listed, kept_histograms, kept, listed_distance"),
    "op11_phrases": _phrases(),
}
