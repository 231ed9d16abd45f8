"""Queries of the loader of dropped lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import rejects
from .tables import table


def p4_found(s, d):
    return rejects.rejected(table(s, d, "raw_lines")).select("line_id")


def p4_rejected(s, d):
    return rejects.rejected(table(s, d, "raw_lines"))


def p4_reasons(s, d):
    return rejects.rejected(table(s, d, "raw_lines")).groupBy("kind", "reason").agg(F.count("*").alias("lines"))


def p4_loaded(s, d):
    return rejects.loaded(table(s, d, "raw_lines"))


def queries():
    return {"p4_found": p4_found, "p4_rejected": p4_rejected, "p4_reasons": p4_reasons, "p4_loaded": p4_loaded}


_NUMBER = r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
_STRAINS = r"S\(P\([012],[012],[012],[012]\),P\([012],[012],[012],[012]\)"
_ONCE = rf"""o as (select line_id, any_value(kind) kind, any_value(line) line from raw_lines where line is not null group by line_id),
    t as (select line_id, kind, trim(line, ' ' || chr(9) || chr(13)) x from o), b as (select * from t where x <> ''),
    u as (select line_id, kind, case when length(x) >= 2 and x[1] = '"' and x[-1] = '"' then x[2:-2] else x end x from b),
    v as (select line_id, kind, x, case when kind = 'strains' then regexp_full_match(x, '[0-9]+;{_STRAINS}\)?')
        and length(ltrim(split_part(x, ';', 1), '0')) between 1 and 10 and coalesce(try_cast(ltrim(split_part(x, ';', 1), '0') as bigint), 0) between 1 and 2147483647
        when kind = 'knowledge' then regexp_full_match(x, 'MS\(M\({_NUMBER}(,{_NUMBER}){{17}}\);{_STRAINS}\)\)?') else false end ok from u)"""


_CELLS = r"[^()]*"
_AREAS = rf"S\(P\(({_CELLS})\),P\(({_CELLS})\)"
_FRAME = {"strains": rf"^([^;]*);{_AREAS}\)?$", "knowledge": rf"^MS\(M\(({_CELLS})\);{_AREAS}\)\)?$"}
_PART = lambda i: "case kind " + " ".join(f"when '{k}' then regexp_extract(x, '{p.replace('$', chr(92) + 'z')}', {i})" for k, p in _FRAME.items()) + " end"
_JUDGED = rf"""o as (select * from (select line_id, kind, file_name, line_no, line, row_number() over (partition by line_id order by kind nulls first, file_name nulls first, line_no nulls first, line) k from raw_lines
        where line is not null and trim(line, ' ' || chr(9) || chr(13)) <> '') where k = 1),
    t as (select *, trim(line, ' ' || chr(9) || chr(13)) y from o), u as (select *, case when length(y) >= 2 and y[1] = '"' and y[-1] = '"' then y[2:-2] else y end x from t),
    f as (select *, {" or ".join(f"(kind = '{k}' and regexp_matches(x, '{p.replace('$', chr(92) + 'z')}'))" for k, p in _FRAME.items())} fits from u),
    p as (select *, case when kind = 'knowledge' then string_split({_PART(1)}, ',') else [{_PART(1)}] end m, string_split({_PART(2)}, ',') a, string_split({_PART(3)}, ',') b from f),
    s as (select *, case when kind is null or kind not in ('strains', 'knowledge') then 'unknown kind' when not fits then 'frame' when kind = 'knowledge' and len(m) <> 18 then 'number of measurements' when len(a) <> 4 or len(b) <> 4 then 'number of strains' end structure,
        list_concat(list_concat(m, a), b) c from p),
    x as (select line_id, kind, unnest(c) raw, generate_subscripts(c, 1) - 1 pos from s where structure is null),
    z as (select line_id, pos, raw, case when pos >= case when kind = 'knowledge' then 18 else 1 end then case when not regexp_full_match(raw, '[012]') then 'strain is not 0, 1 or 2' end
        when kind = 'knowledge' then case when not regexp_full_match(raw, '{_NUMBER}') then 'measurement is not a number' end
        when not regexp_full_match(raw, '[0-9]+') then 'image is not a number' when length(ltrim(raw, '0')) not between 1 and 10 or coalesce(try_cast(ltrim(raw, '0') as bigint), 0) > 2147483647 then 'image out of range' end why from x),
    w as (select line_id, arg_min(raw, pos) raw, arg_min(why, pos) why from z where why is not null group by line_id),
    j as (select s.*, coalesce(structure, why) reason, raw detail from s left join w using (line_id))"""
_NUMBERS = "case when kind = 'knowledge' then [coalesce(try_cast(v as double), case when v[1] = '-' then '-inf' else 'inf' end::double) for v in c[1:18]] end"


def oracle_sql():
    strains = ", ".join(f"cast(c[case when kind = 'strains' then {i + 2} else {i + 19} end] as integer) {n}" for i, n in enumerate(rejects.STRAIN_COLUMNS))
    return {
        "p4_found": f"with {_ONCE} select line_id from v where not ok",
        "p4_rejected": f"with {_JUDGED} select line_id, kind, file_name, line_no, line, reason, detail from j where reason is not null",
        "p4_reasons": f"with {_JUDGED} select kind, reason, count(*) lines from j where reason is not null group by 1, 2",
        "p4_loaded": f"with {_JUDGED} select line_id, kind, file_name, line_no, case when kind = 'strains' then cast(ltrim(c[1], '0') as integer) end image, {_NUMBERS} mm, {strains} from j where reason is null",
    }
