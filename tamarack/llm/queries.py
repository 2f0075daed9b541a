"""Queries p1_ to p10_ and the SQL of those that SQL can state."""

from __future__ import annotations

from . import cross_split, history, leaks, lookalikes, mojibake, near_duplicates, newtext, personal, residue, tokens


def queries():
    return {
        "p1_found": lookalikes.p1_found,
        "p1_normalized": lookalikes.p1_normalized,
        "p3_found": mojibake.p3_found,
        "p3_repaired": mojibake.p3_repaired,
        "p5_found": newtext.p5_found,
        "p5_new_text": newtext.p5_new_text,
        "p7_found": personal.p7_found,
        "p7_redacted": personal.p7_redacted,
        "p6_found": history.p6_found,
        "p6_accepted": history.p6_accepted,
        "p8_ids": tokens.p8_ids,
        "p9_found": leaks.p9_found,
        "p9_near": leaks.p9_near,
        "p10_found": residue.p10_found,
        "p10_clean": residue.p10_clean,
        "p2_found": near_duplicates.p2_found,
        "p4_found": cross_split.p4_found,
        "p4_report": cross_split.p4_report,
    }


_SHINGLED = r"""
w as (select id, side, split, source, regexp_extract_all(lower(t), '[\pL\pN]+') as w from t),
sh as (select id, side, hash(w[i], w[i + 1], w[i + 2]) as s from (select id, side, w, unnest(range(1, len(w) - 1)) as i from w) group by all),
n as (select id, count(*) as n from sh group by 1),
c as (select a.id as a, b.id as b, count(*) as k from sh a join sh b on a.s = b.s and a.side = 'train' and b.side = 'eval' group by 1, 2),
p as (select least(a, b) as rec_id_a, greatest(a, b) as rec_id_b, b as e, a as tr from c join n x on x.id = a join n y on y.id = b where 10 * k >= 6 * (x.n + y.n - k))"""
_SPLIT_TEXT = r"""t as (select rec_id as id, case when split = 'train' then 'train' else 'eval' end as side, split, source, coalesce(subject, '') || ' ' || body_text as t from emails
 where split in ('train', 'val', 'test') and len(regexp_extract_all(lower(body_text), '[\pL\pN]+')) >= 20)"""


def oracle_sql():
    """SQL of the queries that SQL states plainly; word shingles are compared as 64-bit hashes."""
    return {
        "p4_found": f"with {_SPLIT_TEXT}, {_SHINGLED} select rec_id_a, rec_id_b from p",
        "p4_report": f"with {_SPLIT_TEXT}, {_SHINGLED} select t.split, t.source, count(*) as pairs, count(distinct e) as evaluation_rows, count(distinct tr) as train_rows from p join t on t.id = e group by 1, 2",
        "p2_found": r"""
with recursive b as (select rec_id as id, regexp_extract_all(lower(body_text), '[\pL\pN]+') as w from emails), s as (select id, regexp_extract_all(lower(subject), '[\pL\pN]+') as w from triage_log),
 x as (select distinct 'body_text' as field, id, hash(w[i], w[i + 1], w[i + 2]) as x from (select id, w, unnest(range(1, len(w) - 1)) as i from b where len(w) >= 20) union all select distinct 'subject', id, hash(v) from (select id, unnest(w) as v from s where len(list_distinct(w)) >= 5)),
 n as (select field, id, count(*) as n from x group by 1, 2), c as (select p.field, p.id as a, q.id as b, count(*) as k from x p join x q on p.field = q.field and p.x = q.x and p.id < q.id group by 1, 2, 3),
 e as (select c.field, a, b from c join n p on p.field = c.field and p.id = a join n q on q.field = c.field and q.id = b where 10 * k >= 6 * (p.n + q.n - k)), f as (select field, a, b from e union all select field, b, a from e),
 r as (select field, a, b from f union select r.field, r.a, f.b from r join f on f.field = r.field and f.a = r.b)
select field, a as row_id, least(a, min(b)) as group_id from r group by 1, 2""",
        "p9_found": r"""
with i as (select item_id, regexp_extract_all(lower(passage), '[\pL\pN]+') as w from eval_items where passage is not null),
 g as (select item_id, least(12, len(w)) as n, array_to_string(list_slice(w, k, k + least(12, len(w)) - 1), ' ') as g from (select item_id, w, unnest(range(1, len(w) - least(12, len(w)) + 2)) as k from i where len(w) > 0)),
 d as (select doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') as w from documents where text is not null), s as (select distinct n from g),
 x as (select doc_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, s where len(w) >= n))
select distinct doc_id, item_id from x join g using (n, g)""",
    }
