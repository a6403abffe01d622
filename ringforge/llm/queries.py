"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_text, langid, lm_score, mixing, ngram_join, pii, quality, sharding
from .common import read_table


def op1_html_extraction(spark, sf_dir):
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark, sf_dir):
    # sums of logarithms depend on their order in the last places
    return lm_score.score(read_table(spark, sf_dir, "documents")).withColumns({"log_prob": F.round("log_prob", 4), "score": F.round("score", 6)})


def op5_quality(spark, sf_dir):
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_language_id(spark, sf_dir):
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_pii(spark, sf_dir):
    return pii.find(read_table(spark, sf_dir, "documents"))


def op9_mix_sources(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.shard(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_ngram_jaccard_join, op3_exact_dedup, op4_lm_scoring, op5_quality, op6_language_id, op7_decontaminate, op8_pii, op9_mix_sources, op10_sharding)}

#: Words of each document, ASCII letters lower-cased.
_WORDS = """
    w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents)"""

SQL = {
    "op2_ngram_jaccard_join": f"""
        with recursive {_WORDS},
          s as (select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                                    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
          n as (select doc_id, len(sh) as n_shingles from s),
          x as (select doc_id, unnest(sh) as g from s),
          p as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
          e as (select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * p.c >= 75 * (na.n_shingles + nb.n_shingles - p.c)),
          r as (select doc_id as d, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.d)
        select n.doc_id, n.n_shingles, min(r.c) as component_id from n join r on r.d = n.doc_id group by 1, 2""",
    "op3_exact_dedup": """
        with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
             g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, d.text_sha256
        from d join g using (text_sha256)""",
    "op4_lm_scoring": f"""
        with {_WORDS},
          t as (select doc_id, ws[i] as x, case when i > 1 then ws[i - 1] end as v, case when i > 2 then ws[i - 2] end as u from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w)),
          one as (select x, count(*) as c from t group by 1),
          two as (select v, x, count(*) as c from t where v is not null group by 1, 2),
          three as (select u, v, x, count(*) as c from t where u is not null group by 1, 2, 3),
          total as (select count(*) as n from t),
          l as (select t.doc_id, case when t.v is null then ln(o.c / n) when t.u is null then ln(p.c / h.c) else ln(q.c / g.c) end as s
                from t join one o on o.x = t.x left join one h on h.x = t.v left join two p on p.v = t.v and p.x = t.x
                left join two g on g.v = t.u and g.x = t.v left join three q on q.u = t.u and q.v = t.v and q.x = t.x, total),
          g as (select doc_id, count(*) as n_tokens, sum(s) as log_prob from l group by 1)
        select d.doc_id, coalesce(g.n_tokens, 0) as n_tokens, round(coalesce(g.log_prob, 0.0), 4) as log_prob, round(g.log_prob / g.n_tokens, 6) as score
        from documents d left join g on g.doc_id = d.doc_id""",
    "op9_mix_sources": """
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
                          cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) as h from documents),
          s0 as (select source, cast(sum(size) as bigint) as source_size from d group by 1),
          s1 as (select *, cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as w from s0),
          s2 as (select *, 2.0::double * source_size as cap, sum(w) over () as all_w, 1.5::double * sum(source_size) over () as pool,
                   coalesce(sum(w) over (order by 2.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as w_before,
                   coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as cap_before from s1),
          s3 as (select *, (pool - cap_before) / (all_w - w_before) as lev from s2),
          lv as (select min_by(lev, cap_before) as lev from s3 where lev * w < cap),
          s4 as (select source, source_size, case when lv.lev is null then cap else least(cap, lv.lev * w) end as target from s3, lv),
          s5 as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as times from s4),
          c as (select d.*, s5.source_size, s5.target, s5.times, s5.target - s5.times * s5.source_size as budget,
                  sum(size) over (partition by d.source order by h) as upto from d join s5 on d.source is not distinct from s5.source),
          b as (select source, min(h) as bound, min(upto) as upto from c where budget > 0 and upto > budget group by 1),
          e as (select c.source, c.h, sum(c.size) as words from c join b on b.source is not distinct from c.source and c.h = b.bound group by 1, 2),
          k as (select c.*, b.bound, case when b.upto - budget < budget - (b.upto - e.words) then 1 else 0 end as take
                from c left join b on b.source is not distinct from c.source left join e on e.source is not distinct from c.source)
        select doc_id, size, source_size, target, cast(size * copies as bigint) as taken, copies from (
          select *, cast(times + case when budget <= 0 then 0 when bound is null or h < bound then 1 when h = bound then take else 0 end as bigint) as copies from k)""",
}
