"""Queries pN_... of the training-data operators, over whole tables, and SQL for those that SQL can say."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neighbours, overlap, packing, percentiles, reading, sampling, terms, tokenise
from .common import OUTCOMES, feature_names, materialise, table


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return neighbours.collection((table(s, d, "measurements"), "mm_id", "vals"), (table(s, d, "knowledge"), "mm_id", "mm"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    documents = table(s, d, "documents")
    return reading.levels(documents, reading.fit(documents, table(s, d, "reading_labels")))


def _packed(s: SparkSession, d: str) -> DataFrame:
    return packing.packed_documents(tokenise.token_counts(table(s, d, "documents")))


def p1_found(s, d):
    return terms.not_useful(table(s, d, "records"), table(s, d, "unique_vals"))


def p1_frequencies(s, d):
    return terms.value_frequencies(table(s, d, "records"), table(s, d, "unique_vals"))


def p2_found(s, d):
    return neighbours.similar_pairs(neighbours.knn(_vectors(s, d)))


def p2_neighbours(s, d):
    return neighbours.knn(_vectors(s, d)).withColumn("dist", F.round("dist", 6))


def p2_recall(s, d):
    """One row: recall against brute force on queries the fit hasn't seen, the index's median reach, and how many queries were left after each round."""
    share, asked, info = neighbours.recall(_vectors(s, d))
    row = (int(info["points"]), int(asked), float(share), float(info["reach"]), [int(n) for n in info["left"]], int(info["exactly_answered"]))
    return s.createDataFrame([row], "points bigint, held_out bigint, recall double, reach double, left_after_round array<bigint>, exactly_answered bigint")


def p3_percentiles(s, d):
    return percentiles.record_percentiles(table(s, d, "records"))


def p3_coarse(s, d):
    """The same with a hundredth of relative error: a sketch of under a thousand buckets whatever the range of values."""
    return percentiles.record_percentiles(table(s, d, "records"), accuracy=0.01).withColumn("value", F.round("value", 6))


def p3_sketches(s, d):
    return percentiles.record_sketch(table(s, d, "records"))


def p5_found(s, d):
    return sampling.draw(table(s, d, "records"), table(s, d, "targets"))[1].where("short").select("batch_id", "outcome")


def p5_sample(s, d):
    return sampling.draw(table(s, d, "records"), table(s, d, "targets"))[0]


def p5_report(s, d):
    return sampling.draw(table(s, d, "records"), table(s, d, "targets"))[1]


def p5_provision(s, d):
    """What the report says of the batches' records, without what is drawn by chance."""
    return sampling.draw(table(s, d, "records"), table(s, d, "targets"))[1].select("batch_id", "outcome", "wanted", "available", "short")


def p5_totals(s, d):
    return sampling.totals(table(s, d, "records"), table(s, d, "targets"))


def p5_balance(s, d):
    """Drawn shares against ``target_pct`` and drawn totals against ``n_wanted``, per batch and outcome."""
    targets = table(s, d, "targets")
    return sampling.balance(sampling.draw(table(s, d, "records"), targets)[0], targets)


def p6_found(s, d):
    return overlap.record_pairs(table(s, d, "records"))


def p6_shifted(s, d):
    """Pairs that are near only if cells may have moved by one column: ``rec_id_a, rec_id_b, edits``."""
    return overlap.shifted_pairs(table(s, d, "records"))


def p6_report(s, d):
    return overlap.overlap_report(table(s, d, "records"))


def p7_ids(s, d):
    return tokenise.token_ids(table(s, d, "documents"))


def p7_profile(s, d):
    sizes = tokenise.token_counts(table(s, d, "documents"))
    return sizes.groupBy(tokenise.size_class(F.col("n_tokens")).alias("tokens_from")).agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))


def p8_found(s, d):
    return _packed(s, d).where("piece_no = 1").select("doc_id")


def p8_packed(s, d):
    return _packed(s, d)


def p8_fill(s, d):
    return packing.fill_report(_packed(s, d))


def p8_methods(s, d):
    """Containers with and without the fitted patterns."""
    return packing.methods_report(tokenise.token_counts(table(s, d, "documents")))


def p8_characters(s, d):
    """The packing of texts measured in characters, by what must hold of any: nothing lost, none over capacity, under a hundredth unused beyond the bound."""
    capacity = 65_536
    sizes = materialise(table(s, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_tokens")))
    r = packing.fill_report(packing.pack(sizes, capacity=capacity), capacity)
    tight = F.col("containers") <= F.ceil(F.col("containers_at_least") * 1.01) + 1
    return r.select("items", "tokens", "containers_at_least", (F.col("fullest") <= capacity).alias("fits"), tight.alias("tight"))


def p9_found(s, d):
    return reading.easy_throughout(_scored(s, d))


def p9_levels(s, d):
    return _scored(s, d)


def p9_profile(s, d):
    return reading.profile(_scored(s, d))


def p9_cross_validation(s, d):
    model = reading.fit(table(s, d, "documents"), table(s, d, "reading_labels"))
    return s.createDataFrame(model.report, "source string, texts bigint, mean_error double, same_level double, level1 bigint, called1 bigint, right1 bigint, precision double, recall double")


def queries():
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1].isdigit() and callable(f)}


def _cells() -> str:
    """(rec_id, feature, val) of distinct records."""
    cols = ", ".join(f"min({f}) {f}" for f in feature_names())
    cells = " union all ".join(f"select rec_id, {i} feature, {f} val from r where {f} is not null and {f} <> -1" for i, f in enumerate(feature_names()))
    return f"r as (select rec_id, {cols} from records group by rec_id), cells as ({cells})"


def _frequencies() -> str:
    return f"""with {_cells()},
    lists as (select uv_id, feature, any_value(vals) vals from unique_vals where vals is not null group by uv_id, feature),
    items as (select uv_id, feature, unnest(vals) val from lists),
    a as (select 'feature' src, feature, val, count(*) occurrences, count(*) in_records from cells group by feature, val),
    b as (select 'vals' src, feature, val, count(*) occurrences, count(distinct uv_id) in_records from items where val is not null group by feature, val),
    m as (select a.*, 0.05 * (select count(*) from r) top from a
          union all select b.*, 0.90 * n top from b join (select feature, count(*) n from lists group by feature) t using (feature))
    select src, feature, val, cast(occurrences as bigint) occurrences, cast(in_records as bigint) in_records,
           case when in_records < 3 then 'rare' when in_records > top then 'common' else 'useful' end mark from m"""


_NAME = "case " + " ".join(f"when lower(trim(outcome, ' ' || chr(9) || chr(10) || chr(13))) = '{n.lower()}' then '{n}'" for n in OUTCOMES) + " end"

_SHORT = f"""with t as (select batch_id, {_NAME} outcome, max(greatest(coalesce(min_rows, 0), target_pct * n_wanted / 100.0)) wanted from targets
        where batch_id is not null and {_NAME} is not null group by 1, 2),
    r as (select distinct rec_id, batch_id, {_NAME} outcome from records), c as (select batch_id, outcome, count(*) n from r group by 1, 2)
    select t.batch_id, t.outcome from t left join c on t.batch_id = c.batch_id and t.outcome = c.outcome where coalesce(n, 0) < wanted"""


_PROVISION = f"""with t as (select batch_id, {_NAME} outcome, max(greatest(coalesce(min_rows, 0), target_pct * n_wanted / 100.0)) wanted from targets where batch_id is not null and {_NAME} is not null group by 1, 2),
    r as (select distinct rec_id, batch_id, {_NAME} outcome from records), c as (select batch_id, outcome, count(*) n from r group by 1, 2)
    select t.batch_id, t.outcome, cast(wanted as double) wanted, coalesce(n, 0) available, coalesce(n, 0) < wanted short
    from t left join c on t.batch_id = c.batch_id and t.outcome = c.outcome"""

# listed cells: minima, then shares as far as records go; other outcomes: the share left open
_TOTALS = f"""with t as (select batch_id, {_NAME} outcome, max(coalesce(target_pct, 0)) pct, max(coalesce(min_rows, 0)) low, max(n_wanted) n from targets where batch_id is not null and {_NAME} is not null group by 1, 2),
    b as (select batch_id, max(n) n from t group by 1),
    r as (select distinct rec_id, batch_id, {_NAME} outcome from records), c as (select batch_id, outcome, count(*) has from r where outcome is not null group by 1, 2),
    l as (select t.batch_id, t.outcome, pct, low, b.n, coalesce(has, 0) has from t join b using (batch_id) left join c on t.batch_id = c.batch_id and t.outcome = c.outcome),
    s as (select batch_id, max(n) n, least(1, sum(pct) / 100.0) share, sum(least(low, has)) least_, sum(least(greatest(low, pct * n / 100.0), has)) own, sum(case when pct > 0 then has else least(low, has) end) most, max(pct) any_ from l group by 1),
    g as (select *, case when any_ = 0 or least_ >= least(n, greatest(own, n * share)) then least_ else least(least(n, greatest(own, n * share)), most) end listed from s),
    o as (select c.batch_id, sum(has) has from c where not exists (select 1 from t where t.batch_id = c.batch_id and t.outcome = c.outcome) group by 1)
    select g.batch_id, cast(n as bigint) n_wanted, round(cast(listed + least(greatest(0, least(n - listed, n * (1 - share))), coalesce(has, 0)) as double), 4) expected, true met from g left join o on o.batch_id = g.batch_id"""


def _day_cells() -> str:
    """(outcome, d, feature, val) of distinct records."""
    cols = ", ".join(f"min({f}) {f}" for f in feature_names())
    cells = " union all ".join(f"select outcome, d, {i} feature, {f} val from r where {f} is not null and {f} <> -1" for i, f in enumerate(feature_names()))
    return f"r as (select rec_id, coalesce(min({_NAME}), 'None') outcome, cast(min(captured_at) as date) d, {cols} from records where rec_id is not null group by rec_id), cells as ({cells})"


def _bucket_sql(accuracy: float) -> tuple[str, str]:
    """Bucket of ``val``, and the value that stands for bucket ``b``, held within ``low`` and ``high``."""
    gamma = (1 + accuracy) / (1 - accuracy)
    shift = math.ceil(math.log(1e-9) / math.log(gamma)) - 1
    return (
        f"cast(case when val = 0 then 0 else sign(val) * (ceil(ln(abs(val)) / {math.log(gamma)!r} - 1e-9) - ({shift})) end as integer)",
        f"least(greatest(case when b = 0 then 0.0 else sign(b) * exp((abs(b) + ({shift})) * {math.log(gamma)!r}) * {2 / (1 + gamma)!r} end, low), high)",
    )


def _percentiles(accuracy: float | None = None) -> str:
    """Nearest-rank percentiles from counts of every value, or of every bucket of the given accuracy."""
    bucket, stand_in = ("val", "cast(b as double)") if accuracy is None else _bucket_sql(accuracy)
    ranks = ", ".join(f"({float(q)})" for q in percentiles.PERCENTILES)
    return f"""with {_day_cells()},
    both_levels as (select 'all' "level", outcome, cast(null as date) "day", feature, val from cells union all select 'day', outcome, d, feature, val from cells),
    c as (select level, outcome, day, feature, {bucket} b, count(*) n, min(val) low, max(val) high from both_levels group by 1, 2, 3, 4, 5),
    w as (select *, sum(n) over (partition by level, outcome, day, feature order by b) hi, sum(n) over (partition by level, outcome, day, feature) total from c)
    select level, outcome, day, feature, cast(pct as double) pct, round({stand_in}, 6) "value", cast(hi - n + 1 as bigint) rank_low, cast(hi as bigint) rank_high, cast(case when low = high then 0 else n - 1 end as bigint) rank_error, cast(total as bigint) n_values
    from w join (values {ranks}) as q(pct) on greatest(1, ceil(pct * total / 100.0)) <= hi and greatest(1, ceil(pct * total / 100.0)) > hi - n"""


_AGREE = " + ".join(f"case when a.{f} is not distinct from b.{f} or abs(a.{f} - b.{f}) <= 2 then 1 else 0 end" for f in feature_names())
_SAME = " and ".join(f"a.{f} is not distinct from b.{f}" for f in feature_names())
_OVERLAPS = f"""r as (select rec_id, min(sensor_id) sensor_id, min(lower(trim(data_split))) data_split, min({_NAME}) outcome, {', '.join(f'min(nullif({f}, -1)) {f}' for f in feature_names())} from records where rec_id is not null group by rec_id),
    pairs as (select a.rec_id t, b.rec_id e, {_SAME} same from r a join r b on a.outcome = b.outcome where a.data_split = 'train' and b.data_split in ('validation', 'test') and {_AGREE} >= 23)"""

_KNN = f"""v as (select id, min(vec) vec from (select mm_id id, vals vec from measurements union all select mm_id, mm from knowledge)
        where len(vec) = 18 and len([x for x in vec if x is not null and isfinite(x)]) = 18 and len([x for x in vec if x <> 0]) > 0 group by id),
    d as (select a.id, b.id neighbour, sqrt({' + '.join(f'(a.vec[{i}] - b.vec[{i}]) * (a.vec[{i}] - b.vec[{i}])' for i in range(1, 19))}) dist from v a join v b on a.id <> b.id),
    k as (select *, row_number() over (partition by id order by dist, neighbour) rank from d), n as (select * from k where rank <= 5)"""


def oracle_sql():
    frequencies = _frequencies()
    return {
        "p1_frequencies": frequencies,
        "p1_found": f"select src, feature, val from ({frequencies}) where mark <> 'useful'",
        "p2_neighbours": f"with {_KNN} select id, neighbour, round(dist, 6) dist, cast(rank as integer) rank from n",
        "p2_found": f"with {_KNN} select distinct least(id, neighbour) mm_id_a, greatest(id, neighbour) mm_id_b from n",
        "p3_percentiles": _percentiles(),
        "p3_coarse": _percentiles(0.01),
        "p3_sketches": f"with {_day_cells()} select outcome, d \"day\", feature, {_bucket_sql(percentiles.ACCURACY)[0]} bucket, count(*) n, min(val) low, max(val) high from cells group by 1, 2, 3, 4",
        "p8_characters": """select cast(coalesce(sum((n + 65535) // 65536), 0) as bigint) items, cast(coalesce(sum(n), 0) as bigint) tokens, cast(coalesce((sum(n) + 65535) // 65536, 0) as bigint) containers_at_least, true fits, true tight
            from (select length(text) n from documents where text is not null)""",
        "p5_found": _SHORT,
        "p5_provision": _PROVISION,
        "p5_totals": _TOTALS,
        "p6_found": f"with {_OVERLAPS} select least(t, e) rec_id_a, greatest(t, e) rec_id_b from pairs",
        "p6_report": f"""with {_OVERLAPS}, m as (select e, max(case when same then 1 else 0 end) same from pairs group by e)
            select data_split, sensor_id, count(*) records, count(case when same = 1 then 1 end) same, count(case when same = 0 then 1 end) near
            from r left join m on e = rec_id where data_split in ('validation', 'test') and outcome is not null group by 1, 2""",
    }
