"""Queries of the pipeline's own operators over whole tables, each with the SQL that says the same.

Inputs: ``records`` (labelled pixels; rows as delivered), grids made of ``embeddings`` (64 x 64 images: row of the image, position in the vector,
value ``floor((e + 1) * 500)``, foreground over 500), frames made of ``events``, and the posture tables.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import forest, grid, joins, posture, stats
from ..schema import CATEGORIES, MEASUREMENTS, PARTS, STRAINS, Settings, features
from ..sources import frames
from ..streaming import background
from . import pipeline, train
from .tables import materialise, table

FEATURES = features()
SIDE = 64

# --- inputs -------------------------------------------------------------------------------------------------------------------


def records(s, d) -> DataFrame:
    """Labelled records as delivered: missing cells null, ``label`` the code of the outcome, those without one left out."""
    cells = [F.when(F.col(f) != -1, F.col(f)).alias(f) for f in FEATURES]
    code = scalar.category_code("outcome")
    return table(s, d, "records").select("rec_id", "image", "batch_id", "sensor_id", "data_split", *cells, code.alias("label")).where("label < 99")


def named(s, d) -> DataFrame:
    return records(s, d).withColumn("label", scalar.category_name("label"))


def pixels(s, d) -> DataFrame:
    e = table(s, d, "embeddings").select(F.col("vec_id"), F.posexplode("embedding").alias("col", "e"))
    value = F.floor((F.col("e").cast("double") + 1) * 500).cast("int")
    at = e.select(F.floor(F.col("vec_id") / SIDE).cast("bigint").alias("image"), F.pmod("vec_id", F.lit(SIDE)).cast("int").alias("row"), "col", value.alias("value"))
    return at.withColumn("subj", F.when(F.col("value") > 500, F.col("value")).otherwise(0)).withColumn("depth", 5000 + 10 * F.col("value"))


def classified(s, d) -> DataFrame:
    """Foreground pixels in bands of value as the five parts; four streams of frames."""
    part = F.element_at(F.array(*map(F.lit, PARTS)), F.least(F.floor((F.col("subj") - 501) / 40), F.lit(4)).cast("int") + 1)
    return pixels(s, d).where("subj <> 0").withColumn("category", part).withColumns({"stream": F.pmod("image", F.lit(4)), "frame": F.floor(F.col("image") / 4)})


def clips(s, d) -> DataFrame:
    return table(s, d, "events").where("ts is not null").select("event_id", "user_id", "ts", F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("bigint").alias("value"))


def joints(s, d) -> DataFrame:
    """Five 3-D points per embedding: consecutive triples of its first 15 numbers."""
    xyz = lambda k: F.struct(*[F.col("embedding")[3 * k + i].cast("double").alias(a) for i, a in enumerate("xyz")])
    return table(s, d, "embeddings").select("vec_id", *[xyz(i).alias(p) for i, p in enumerate(PARTS)])


_CODE = "case lower(trim(outcome, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) " + " ".join(f"when '{n.lower()}' then {i}" for i, n in enumerate(CATEGORIES)) + " end"
_NAMES = "case label " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(CATEGORIES)) + " end"
_R = f"r as (select * from (select rec_id, image, batch_id, sensor_id, data_split, {', '.join(f'case when {f} <> -1 then {f} end {f}' for f in FEATURES)}, {_CODE} \"label\" from records) where label is not null)"
_LONG = "long as (" + " union all ".join(f"select rec_id, image, label, {i} feature, {f} val from r where {f} is not null" for i, f in enumerate(FEATURES)) + ")"
_G = """g as (select image, "row", col, v "value", case when v > 500 then v else 0 end subj, 5000 + 10 * v depth from (
    select cast(floor(vec_id / 64) as bigint) image, cast(vec_id % 64 as integer) "row", cast(i - 1 as integer) col, cast(floor((cast(embedding[i] as double) + 1) * 500) as integer) v
    from (select vec_id, embedding, unnest(range(1, 65)) i from embeddings)))"""
_V = "v as (select event_id, user_id, ts, cast(floor(coalesce(value, 0.0) * 100) as bigint) \"value\" from events where ts is not null)"
_C = _G + ", c as (select *, case least(floor((subj - 501) / 40.0), 4) " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(PARTS)) + ' end category from g where subj <> 0)'

REGISTRY: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- statistics and split search ------------------------------------------------------------------------------------------------


@query(f"with {_R} select label, count(*) n from r group by label")
def class_histogram(s, d):
    return stats.class_histogram(records(s, d))


@query(f"with {_R}, h as (select image, label, count(*) n from r group by 1, 2) select image, cast(sum(n) as bigint) n, round(1.0 - cast(sum(n * n) as double) / cast(sum(n) * sum(n) as double), 9) impurity from h group by image")
def gini_by_image(s, d):
    return stats.gini(records(s, d), by=("image",)).withColumn("impurity", F.round("impurity", 9))


@query(f"with {_R} select image, min(label) = max(label) is_pure from r group by image")
def is_pure(s, d):
    return stats.purity(records(s, d), by=("image",))


@query(f"with {_R}, {_LONG} select distinct feature, val \"value\" from long")
def unique_values(s, d):
    return stats.unique_values(records(s, d), FEATURES)


@query(f"with {_R}, {_LONG}, u as (select distinct image, feature, val from long) select image, feature, string_agg(cast(val as varchar), ',' order by val) vals, count(*) num_vals from u group by 1, 2")
def unique_lists(s, d):
    return stats.unique_lists(records(s, d), FEATURES, ("image",)).withColumn("vals", F.array_join("vals", ","))


def _gains_sql(source: str, op: str, node: str = "0") -> str:
    """Common table expressions t, w, q: counts, prefix sums and gains of all candidates of ``source (node, feature, val, label)``."""
    frame = "rows between unbounded preceding and " + ("current row" if op == "le" else "1 preceding")
    counts = ", ".join(f"count(*) filter (where label = {i}) n{i}" for i in range(6))
    left = ", ".join(f"coalesce(sum(n{i}) over (partition by node, feature order by val {frame}), 0) l{i}, sum(n{i}) over (partition by node, feature) t{i}" for i in range(6))
    nl, n = "+".join(f"l{i}" for i in range(6)), "+".join(f"t{i}" for i in range(6))
    sq = lambda p: "+".join(f"cast({p(i)} as double) * cast({p(i)} as double)" for i in range(6))
    return f"""t{node} as (select node, feature, val, {counts} from {source} group by 1, 2, 3), w{node} as (select node, feature, val, {left} from t{node}),
        q{node} as (select node, feature, val, cast({nl} as bigint) n_true, cast({n} as bigint) - cast({nl} as bigint) n_false,
            (({sq(lambda i: f"l{i}")}) / ({nl}) + ({sq(lambda i: f"t{i}-l{i}")}) / ({n} - ({nl})) - ({sq(lambda i: f"t{i}")}) / ({n})) / ({n}) gain
            from w{node} where {nl} > 0 and {nl} < {n})"""


_ROOT = "src as (select 1 node, feature, val, label from long)"


@query(f"with {_R}, {_LONG}, {_ROOT}, {_gains_sql('src', 'le')} select feature, val \"value\", n_true, n_false, round(gain, 9) gain from q0")
def split_candidates(s, d):
    return _gains(s, d, "le").withColumn("gain", F.round("gain", 9))


@query(f"with {_R}, {_LONG}, {_ROOT}, {_gains_sql('src', 'lt')} select feature, val \"value\", n_true, n_false, round(gain, 9) gain from q0")
def split_candidates_lt(s, d):
    return _gains(s, d, "lt").withColumn("gain", F.round("gain", 9))


def _gains(s, d, op):
    return stats.candidate_gains(stats.candidate_counts(records(s, d), FEATURES, range(6)), 6, op=op)


_BEST = "order by floor(gain * 1e6) desc, feature desc, val desc"


@query(f"with {_R}, {_LONG}, {_ROOT}, {_gains_sql('src', 'le')}, x as (select *, row_number() over (partition by feature {_BEST}) k from q0) select feature, val \"value\", n_true, n_false, round(gain, 9) gain from x where k = 1")
def best_split_per_feature(s, d):
    return stats.best_split_per_feature(_gains(s, d, "le")).withColumn("gain", F.round("gain", 9))


@query(f"with {_R}, {_LONG}, {_ROOT}, {_gains_sql('src', 'le')} select feature, val \"value\", n_true, n_false, round(gain, 9) gain from q0 {_BEST} limit 1")
def best_split(s, d):
    return stats.best_split(_gains(s, d, "le")).withColumn("gain", F.round("gain", 9))


@query(f"with {_R}, {_LONG}, {_ROOT}, {_gains_sql('src', 'lt')} select feature, val \"value\", n_true, n_false, round(gain, 9) gain from q0 order by floor(gain * 1e6) desc, feature, val limit 1")
def best_split_lt_first(s, d):
    return stats.best_split(_gains(s, d, "lt"), settings=Settings(op="lt", tie="first")).withColumn("gain", F.round("gain", 9))


@query(f"with {_R} select rec_id, cast(case when f20 <= 320 then 2 else 3 end as bigint) node_id from r")
def partition_rows(s, d):
    return train.partition_rows(records(s, d), "f20", 320).select("rec_id", "node_id")


@query(f"with {_R} select cast(case when f20 < 320 then 2 else 3 end as bigint) node_id, count(*) n from r group by 1")
def partition_sizes(s, d):
    return train.partition_rows(records(s, d), "f20", 320, "lt").groupBy("node_id").agg(F.count("*").alias("n"))


@query(f"with {_R}, h as (select sensor_id, label, count(*) n from r group by 1, 2) select sensor_id, {_NAMES} outcome, round(n / sum(n) over (partition by sensor_id), 9) probability from h")
def leaf_distribution(s, d):
    rows = stats.leaf_distribution(named(s, d), by=("sensor_id",)).select("sensor_id", F.explode("results").alias("r"))
    return rows.select("sensor_id", "r.outcome", F.round("r.probability", 9).alias("probability"))


@query(f"with {_R}, h as (select data_split, label, count(*) n from r group by 1, 2) select data_split, label, n, round(1.0 - sum(n * n) over (partition by data_split) / (sum(n) over (partition by data_split) * 1.0 * sum(n) over (partition by data_split)), 9) impurity from h")
def root_statistics(s, d):
    h = stats.class_histogram(records(s, d), by=("data_split",))
    return h.join(stats.gini(records(s, d), by=("data_split",)).select("data_split", F.round("impurity", 9).alias("impurity")), "data_split")


@query(f"with {_G}, h as (select image, depth, count(*) n from g where depth <> 0 group by 1, 2), k as (select *, sum(n) over (partition by image order by depth) run, sum(n) over (partition by image) total from h) select image, depth, n, cast(run as bigint) running, cast(floor(256 * (1 - cast(run as double) / total)) as integer) \"level\" from k")
def depth_histogram(s, d):
    return stats.depth_histogram(pixels(s, d), "depth", ("image",))


@query(f"with {_G} select image, min(case when subj <> 0 then subj end) low, max(case when subj <> 0 then subj end) high, round(avg(subj), 6) mean from g group by image")
def value_range(s, d):
    return stats.value_range(pixels(s, d), "subj", ("image",)).withColumn("mean", F.round("mean", 6))


# --- trees --------------------------------------------------------------------------------------------------------------------------


def _two_levels_sql(r: str) -> str:
    """The nodes of a tree of two levels over the common table expression ``r``."""
    return f"""with {r}, {_LONG}, {_ROOT}, {_gains_sql('src', 'le')}, b0 as (select feature, val from q0 where gain > 0 {_BEST} limit 1),
    side as (select rec_id, case when coalesce((list_value({', '.join(FEATURES)}))[b0.feature + 1] <= b0.val, false) then 2 else 3 end node, label, {', '.join(FEATURES)} from r, b0),
    lower as ({' union all '.join(f'select node, {i} feature, {f} val, label from side where {f} is not null' for i, f in enumerate(FEATURES))}), {_gains_sql('lower', 'le', '1')},
    b1 as (select node, feature, val from (select *, row_number() over (partition by node {_BEST}) k from q1 where gain > 0) where k = 1)
    select 1 node_id, 'D' kind, val ref_val, feature, 2 true_id, 5 false_id from b0 union all select case node when 2 then 2 else 5 end, 'D', val, feature, case node when 2 then 3 else 6 end, case node when 2 then 4 else 7 end from b1
    union all select unnest([3, 4, 6, 7]), 'R', null, null, null, null"""


_TWO, _TWO_ONCE = _two_levels_sql(_R), _two_levels_sql(f"{_R.replace('r as (', 'every_ as (', 1)}, r as (select distinct on (rec_id) * from every_)")


@query(_TWO)
def train_two_levels(s, d):
    """Level by level, whatever the size."""
    return train.train(records(s, d), FEATURES, settings=Settings(max_depth=2), local_rows=0).drop("tree_id", "results")


@query(_TWO)
def train_two_levels_local(s, d):
    """The same tree from one task."""
    return train.train(records(s, d), FEATURES, settings=Settings(max_depth=2), local_rows=sys.maxsize).drop("tree_id", "results")


@query(_TWO_ONCE)
def train_ordered(s, d):
    """The same from columns of (feature, record, value) and a label map; records delivered twice are one record there."""
    once = records(s, d).dropDuplicates(["rec_id"])
    ordered, labels = stats.long_cells(once, FEATURES, ("rec_id",)), once.select("rec_id", "label")
    return train.train(train.from_ordered(ordered, labels, len(FEATURES)), FEATURES, settings=Settings(max_depth=2), local_rows=0).drop("tree_id", "results")


@query("select true same_nodes, true deep_enough")
def train_paths(s, d):
    """Six levels grown level by level, and by tasks of at most a twentieth of the records: both trees must have the same nodes."""
    rows = materialise(named(s, d))
    settings = Settings(max_depth=6)
    by_level = materialise(train.train(rows, FEATURES, settings=settings, local_rows=0))
    by_task = materialise(train.train(rows, FEATURES, settings=settings, local_rows=max(1, rows.count() // 20)))
    differing = by_level.exceptAll(by_task).unionByName(by_task.exceptAll(by_level)).agg(F.count("*").alias("n"))
    return differing.select((F.col("n") == 0).alias("same_nodes"), F.lit(by_level.count() > 31).alias("deep_enough"))


@query()
def train_tree(s, d):
    """Grown by the reference's rule alone: a node closes at impurity <= 0.03, at one record or where no split gains; no limit of depth."""
    return train.train(named(s, d), FEATURES, settings=Settings(op="le", max_depth=sys.maxsize))


#: Two small trees over the records' features, for evaluation and voting.
TREES = [
    [("1", "D", 320, 20, 2, 5, None), ("2", "D", 300, 24, 3, 4, None), ("3", "R", None, None, None, None, [("LeftShoulder", 0.5), ("Other", 0.5)]), ("4", "R", None, None, None, None, [("Head", 0.6), ("Neck", 0.4)]),
     ("5", "D", 250, 22, 6, 7, None), ("6", "R", None, None, None, None, [("Other", 0.7), ("RightShoulder", 0.3)]), ("7", "R", None, None, None, None, [("Sternum", 1.0)])],
    [("1", "D", 700, 0, 2, 3, None), ("2", "R", None, None, None, None, [("Head", 0.3), ("LeftShoulder", 0.3), ("Other", 0.4)]), ("3", "D", 100, 25, 4, 5, None), ("4", "R", None, None, None, None, [("RightShoulder", 1.0)]),
     ("5", "R", None, None, None, None, [("Other", 0.6), ("Sternum", 0.4)])],
]


def trees() -> list[list[dict]]:
    return [[{"tree_id": f"t{i}", "node_id": int(n), "kind": k, "ref_val": v, "feature": f, "true_id": t, "false_id": e, "results": r and [{"outcome": o, "probability": p} for o, p in r]} for n, k, v, f, t, e, r in tree] for i, tree in enumerate(TREES)]


def _case(tree: list[dict]) -> str:
    by = {r["node_id"]: r for r in tree}
    say = lambda k: str(k) if by[k]["kind"] == "R" else f"case when f{by[k]['feature']} <= {by[k]['ref_val']} then {say(by[k]['true_id'])} else {say(by[k]['false_id'])} end"
    return say(1)


def _leaves(tree: list[dict]) -> str:
    return "(values " + ", ".join(f"({r['node_id']}, '{x['outcome']}', cast({x['probability']} as double))" for r in tree if r["kind"] == "R" for x in r["results"]) + ") as p(leaf, outcome, p)"


_E = f"{_R}, e as (select rec_id, {_NAMES} \"label\", {_case(trees()[0])} leaf_id, {_case(trees()[1])} leaf2 from r)"
_LEAF_LABELS = f"select e.label, p.leaf is not null hit from e left join {_leaves(trees()[0])} on e.leaf_id = p.leaf and p.outcome = e.label"
_VOTES = f"""{_E}, ids as (select distinct leaf_id, leaf2 from e), pair as (select leaf_id, leaf2, outcome, p from ids join {_leaves(trees()[0])} on leaf = leaf_id union all select leaf_id, leaf2, outcome, p from ids join {_leaves(trees()[1])} on leaf = leaf2),
    sums as (select leaf_id, leaf2, outcome, round(sum(p), 9) p from pair group by 1, 2, 3), top as (select *, row_number() over (partition by leaf_id, leaf2 order by p desc, outcome) k from sums),
    voted as (select rec_id, label, outcome vote from e join top using (leaf_id, leaf2) where k = 1)"""


@query(f"with {_E} select rec_id, leaf_id from e")
def tree_evaluate(s, d):
    return forest.evaluate(records(s, d), trees()[0], FEATURES).select("rec_id", "leaf_id")


@query(f"with {_E}, a as ({_LEAF_LABELS}) select count(*) n, round(avg(case when hit then 1 else 0 end), 9) accuracy from a")
def accuracy_lenient(s, d):
    return forest.accuracy_lenient(forest.with_results(named(s, d), trees()[0], FEATURES)).withColumn("accuracy", F.round("accuracy", 9))


@query(f"with {_E}, f as (select leaf, min(outcome) outcome from {_leaves(trees()[0])} group by leaf) select count(*) n, round(avg(case when f.outcome = e.label then 1 else 0 end), 9) accuracy from e join f on leaf = leaf_id")
def accuracy_first(s, d):
    return forest.accuracy_first(forest.with_results(named(s, d), trees()[0], FEATURES)).withColumn("accuracy", F.round("accuracy", 9))


@query(f"with {_VOTES} select rec_id, vote from voted")
def forest_vote(s, d):
    return forest.vote(named(s, d), trees(), FEATURES).select("rec_id", "vote")


@query(f"with {_VOTES} select count(*) n, round(avg(case when vote = label then 1 else 0 end), 9) accuracy from voted")
def accuracy_vote(s, d):
    return forest.accuracy_vote(forest.vote(named(s, d), trees(), FEATURES)).withColumn("accuracy", F.round("accuracy", 9))


@query(f"with {_VOTES} select label, vote, count(*) n from voted group by 1, 2")
def confusion(s, d):
    return forest.confusion(forest.vote(named(s, d), trees(), FEATURES))


@query(f"with {_VOTES} select distinct e.rec_id, e.label, vote, vote = e.label correct from e join voted v on v.rec_id = e.rec_id where e.rec_id = 100")
def check_record(s, d):
    return forest.check_record(named(s, d), 100, trees(), FEATURES).distinct()


_NODE_VALUES = ", ".join(f"('{r['tree_id']}', {r['node_id']}, '{r['kind']}', {r['true_id'] or 'null'}, {r['false_id'] or 'null'})" for t in trees() for r in t)
_PATHS = f"""with recursive n(tree_id, node_id, kind, true_id, false_id) as (values {_NODE_VALUES}),
    p as (select tree_id, node_id, 1 depth, '' path from n where node_id = 1 union all
    select n.tree_id, c.node_id, p.depth + 1, p.path || case when c.node_id = n.true_id then '0' else '1' end from p join n on n.tree_id = p.tree_id and n.node_id = p.node_id join n c on c.tree_id = n.tree_id and c.node_id in (n.true_id, n.false_id))"""


def _nodes(s):
    return train.nodes_table(s, [r for t in trees() for r in t])


@query(f"{_PATHS} select * from p")
def node_depths(s, d):
    return forest.node_depths(_nodes(s))


@query(f"{_PATHS} select tree_id, max(depth) depth from p group by tree_id")
def tree_depth(s, d):
    return forest.tree_depth(_nodes(s))


@query("select 't0' tree_id, 5 node_id, 7 child_id")
def tree_unlinked(s, d):
    return forest.unlinked(_nodes(s).where("not (tree_id = 't0' and node_id = 7)"))


@query("""select * from (values ('t0', 1, 'D(1,320,20,2,5)'), ('t0', 2, 'D(2,300,24,3,4)'), ('t0', 3, 'R(3,C(LeftShoulder,0.500000),C(Other,0.500000))'), ('t0', 4, 'R(4,C(Head,0.600000),C(Neck,0.400000))'), ('t0', 5, 'D(5,250,22,6,7)'),
    ('t0', 6, 'R(6,C(Other,0.700000),C(RightShoulder,0.300000))'), ('t0', 7, 'R(7,C(Sternum,1.000000))')) as t(tree_id, node_id, line)""")
def tree_text(s, d):
    from ..sources.text import tree_lines

    return tree_lines(_nodes(s).where("tree_id = 't0'"))


@query("select rec_id, ((rec_id * 7919 + 104729) % 10000 + 10000) % 10000 < 8000 in_training from records")
def train_test_split(s, d):
    return table(s, d, "records").select("rec_id", scalar.in_training("rec_id", 0.8).alias("in_training"))


@query(f"with {_R} select rec_id, cast(label as integer) \"label\" from r where ((rec_id * 7919 + 104729 + 155) % 10000 + 10000) % 10000 / 10000.0 < case when label = 5 then 0.4 else 0.5 end")
def down_sampled(s, d):
    """Half of all records by a hash of the id, and of those of Other four fifths."""
    keep = F.when(F.col("label") == 5, 0.4).otherwise(0.5)
    return records(s, d).where(scalar.key_share("rec_id", seed=5) < keep).select("rec_id", "label")


# --- grids ------------------------------------------------------------------------------------------------------------------------------


@query(f'with {_G} select image, "row", col, sum(case when subj <> 0 then 1 else 0 end) over (partition by image, "row" order by col) h from g')
def horizontal_integral(s, d):
    return grid.horizontal_counts(pixels(s, d)).select("image", "row", "col", "h")


@query(f'with {_G} select image, "row", col, sum(case when subj <> 0 then 1 else 0 end) over (partition by image, col order by "row") v from g')
def vertical_integral(s, d):
    return grid.vertical_counts(pixels(s, d)).select("image", "row", "col", "v")


@query(f'with {_G}, h as (select *, sum(case when subj <> 0 then 1 else 0 end) over (partition by image, "row" order by col) h from g) select image, "row", col, cast(sum(h) over (partition by image, col order by "row") as bigint) integral from h')
def integral(s, d):
    return grid.integral(pixels(s, d)).select("image", "row", "col", "integral")


@query(f'with {_G}, b as (select *, sum(case when subj <> 0 then 1 else 0 end) over (partition by image, "row" order by col rows between 10 preceding and 10 following) s from g) select image, "row", col, cast(sum(s) over (partition by image, col order by "row" rows between 10 preceding and 10 following) as bigint) box from b')
def box_counts(s, d):
    return grid.box_counts(pixels(s, d), 20).select("image", "row", "col", "box")


def _balance_sql(line: str, at: str, size: int, offset: int) -> str:
    w = f"partition by image, {line} order by {at}"
    on = "case when subj <> 0 then 1 else 0 end"
    return f"""with {_G} select image, "row", col, cast({size} + coalesce(sum({on}) over ({w} rows between 1 following and {offset} following), 0) - sum({on}) over ({w} rows between {offset} preceding and current row)
        + case when {at} <= {offset} then first_value({on}) over ({w}) else 0 end as integer) b from g"""


@query(_balance_sql('"row"', "col", SIDE, 20))
def balance_horizontal(s, d):
    return grid.balance(pixels(s, d), "h", 20, SIDE, "b").select("image", "row", "col", "b")


@query(_balance_sql("col", '"row"', SIDE, 20))
def balance_vertical(s, d):
    return grid.balance(pixels(s, d), "v", 20, SIDE, "b").select("image", "row", "col", "b")


def _fetch_sql(offset: int, steps: dict[str, tuple[int, int]], value: str) -> str:
    joined = " ".join(f'left join g {n} on {n}.image = p.image and {n}."row" = p."row" + ({a}) * p.t and {n}.col = p.col + ({b}) * p.t' for n, (a, b) in steps.items())
    refs = ", ".join(f"coalesce({n}.subj, 0) {n}" for n in steps)
    return f"""with {_G}, o as (select *, cast(round({offset} / (depth / 10000.0)) as integer) t from g where subj <> 0), x as (select p.image, p."row", p.col, p.subj p, {refs} from o p {joined}) select image, "row", col, cast({value} as integer) f from x"""


@query(_fetch_sql(15, {"lu": (-1, -1), "ld": (1, -1), "ru": (-1, 1), "rd": (1, 1)}, "case when lu = 0 or ld = 0 or ru = 0 or rd = 0 then 1000 else floor(abs(lu + rd - ld - ru) / 2) end"))
def feature_corners(s, d):
    return grid.corner_feature(pixels(s, d), 30).select("image", "row", "col", "f")


def _one_sided(step):
    return _fetch_sql(20, {"r1": step}, "round_even(cast(max(greatest(abs(p - r1), 1)) over (partition by image) as double) / greatest(abs(p - r1), 1), 0)")


@query(_one_sided((-1, 0)))
def feature_above(s, d):
    return grid.one_sided_feature(pixels(s, d), 20, (-1, 0)).select("image", "row", "col", "f")


@query(_one_sided((0, -1)))
def feature_left(s, d):
    return grid.one_sided_feature(pixels(s, d), 20, (0, -1)).select("image", "row", "col", "f")


@query(_one_sided((0, 1)))
def feature_right(s, d):
    return grid.one_sided_feature(pixels(s, d), 20, (0, 1)).select("image", "row", "col", "f")


def _pair(offset, first, second, least=0):
    return _fetch_sql(offset, {"r1": first, "r2": second}, f"greatest(abs(r2 - r1), {least})")


@query(_pair(20, (0, -1), (0, 1), 1))
def feature_left_right(s, d):
    return grid.two_sided_feature(pixels(s, d), 20, (0, -1), (0, 1), 1).select("image", "row", "col", "f")


@query(_pair(30, (-1, 0), (1, 0)))
def feature_up_down(s, d):
    return grid.two_sided_feature(pixels(s, d), 30, (-1, 0), (1, 0)).select("image", "row", "col", "f")


@query(_pair(30, (-1, 0), (0, -1)))
def feature_up_left(s, d):
    return grid.two_sided_feature(pixels(s, d), 30, (-1, 0), (0, -1)).select("image", "row", "col", "f")


@query(_pair(30, (-1, 0), (0, 1)))
def feature_up_right(s, d):
    return grid.two_sided_feature(pixels(s, d), 30, (-1, 0), (0, 1)).select("image", "row", "col", "f")


@query(_pair(17, (-1, -1), (1, 1)))
def feature_diagonal_down(s, d):
    return grid.two_sided_feature(pixels(s, d), grid.diagonal_offset(50), (-1, -1), (1, 1)).select("image", "row", "col", "f")


@query(_pair(17, (1, -1), (-1, 1)))
def feature_diagonal_up(s, d):
    return grid.two_sided_feature(pixels(s, d), grid.diagonal_offset(50), (1, -1), (-1, 1)).select("image", "row", "col", "f")


def _features_sql() -> str:
    """Common table expressions up to ``feat (image, row, col, value, f0..f25)``."""
    refs: dict[tuple, str] = {}
    out = []

    def ref(step, offset):
        return refs.setdefault((step, offset), f"k{len(refs)}")

    for half in (1, 2):
        for kind, offset, *steps in grid.PLAN:
            o = offset // half
            if kind == "corner":
                lu, ld, ru, rd = (ref(x, o // 2) for x in ((-1, -1), (1, -1), (-1, 1), (1, 1)))
                out.append(f"case when {lu} = 0 or {ld} = 0 or {ru} = 0 or {rd} = 0 then 1000 else abs({lu} + {rd} - {ld} - {ru}) // 2 end")
            elif kind == "side":
                v = f"greatest(abs(p - {ref(steps[0], o)}), 1)"
                out.append(f"round_even(cast(max({v}) over (partition by image) as double) / {v}, 0)")
            else:
                t = o // 2 if kind == "pair" else o if kind == "full" else grid.diagonal_offset(o)
                out.append(f"greatest(abs({ref(steps[1], t)} - {ref(steps[0], t)}), {steps[2]})")
    joined = " ".join(f'left join g {n} on {n}.image = p.image and {n}."row" = p."row" + ({a}) * p.t{o} and {n}.col = p.col + ({b}) * p.t{o}' for ((a, b), o), n in refs.items())
    ts = ", ".join(f"cast(round({o} / (depth / 10000.0)) as integer) t{o}" for o in sorted({o for _, o in refs}))
    on = "case when subj <> 0 then 1 else 0 end"

    def line(by, at, o):
        w = f"partition by image, {by} order by {at}"
        return f"{SIDE} + coalesce(sum({on}) over ({w} rows between 1 following and {o} following), 0) - sum({on}) over ({w} rows between {o} preceding and current row) + case when {at} <= {o} then first_value({on}) over ({w}) else 0 end"

    fixed = [line('"row"', "col", SIDE), line('"row"', "col", 20), line("col", '"row"', SIDE), line("col", '"row"', 20)]
    boxes = [f"sum(s{h}) over (partition by image, col order by \"row\" rows between {h} preceding and {h} following)" for h in (10, 21)]
    sums = ", ".join(f"sum({on}) over (partition by image, \"row\" order by col rows between {h} preceding and {h} following) s{h}" for h in (10, 21))
    return f"""{_G}, o as (select *, {ts} from g where subj <> 0),
        x as (select p.image, p."row", p.col, p.value, p.subj p, {", ".join(f"coalesce({n}.subj, 0) {n}" for n in refs.values())} from o p {joined}),
        near as (select image, "row", col, value, {", ".join(f"cast({e} as integer) f{i}" for i, e in enumerate(out))} from x),
        sq as (select *, {sums} from g), flat as (select image, "row", col, subj, {", ".join(f"cast({e} as integer) f{20 + i}" for i, e in enumerate(fixed + boxes))} from sq),
        feat as (select near.*, f20, f21, f22, f23, f24, f25 from near join flat using (image, "row", col))"""


def _label_colours(s, d) -> DataFrame:
    """A label image over the grid: colours of the categories by the value modulo 7."""
    colour = scalar.category_colour(scalar.category_name(F.pmod("value", F.lit(7)).cast("int")))
    return pixels(s, d).withColumn("_c", colour).select("image", "row", "col", "subj", "depth", "_c.r", "_c.g", "_c.b")


_FEATURES = _features_sql()
_LABELLED = f"select image, \"row\", col, {', '.join(FEATURES)}, case value % 7 {' '.join(f'when {i} then {chr(39)}{n}{chr(39)}' for i, n in enumerate(CATEGORIES))} end \"label\" from feat where value % 7 < 6"


@query(f'with {_FEATURES} select image, "row", col, {", ".join(FEATURES)} from feat')
def features26(s, d):
    return grid.features26(pixels(s, d), SIDE, SIDE)


@query(f"with {_FEATURES} {_LABELLED}")
def labelled_features(s, d):
    """Features joined with label colours by position; unlabelled pixels dropped."""
    label = scalar.colour_category("r", "g", "b").alias("label")
    return joins.positional(grid.features26(pixels(s, d), SIDE, SIDE), _label_colours(s, d).select("image", "row", "col", label)).where(scalar.is_labelled("label"))


@query(f"with {_FEATURES} {_LABELLED} and not image between 49 and 146")
def frames_to_records(s, d):
    """From frames with label colours to training records, by the pipeline."""
    return pipeline.records_from_frames(_label_colours(s, d), SIDE, SIDE, segmented=True)


def _around(cells: str, take: str, out: str) -> str:
    return f'select p.image, p."row", p.col, {take} {out} from g p join (values {cells}) as n(dr, dc) on true left join g q on q.image = p.image and q."row" = p."row" + dr and q.col = p.col + dc group by 1, 2, 3'


_SQUARE = ", ".join(f"({a}, {b})" for a in range(-2, 3) for b in range(-2, 3))


@query(f"with {_G} {_around(_SQUARE, 'min(q.value)', 'eroded')}")
def erode5(s, d):
    return grid.morph(pixels(s, d), "value", "erode", 5, out="eroded").select("image", "row", "col", "eroded")


@query(f"with {_G} {_around(_SQUARE, 'max(q.value)', 'dilated')}")
def dilate5(s, d):
    return grid.morph(pixels(s, d), "value", "dilate", 5, out="dilated").select("image", "row", "col", "dilated")


@query(f"with {_G} {_around('(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)', 'min(q.value)', 'eroded')}")
def erode_cross(s, d):
    return grid.morph(pixels(s, d), "value", "erode", 3, "cross", out="eroded").select("image", "row", "col", "eroded")


@query(f'''with {_G}, e as (select image, max("row") bottom from g group by image) select p.image, p."row", p.col, cast(case when sum(case when q.subj <> 0 then 1 else 0 end) >= 5 then 1 else 0 end as integer) median from g p join e on e.image = p.image
    join (values {", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1))}) as n(dr, dc) on true join g q on q.image = p.image and q."row" = least(greatest(p."row" + dr, 0), bottom) and q.col = least(greatest(p.col + dc, 0), 63) group by 1, 2, 3''')
def median3(s, d):
    return grid.median3(pixels(s, d).withColumn("on", (F.col("subj") != 0).cast("int")), "on").select("image", "row", "col", "median")


_PROFILE = f'{_G}, t as (select image, "row", cast(sum(subj) as bigint) total from g group by 1, 2), f as (select *, avg(total) over (partition by image order by "row" rows between 4 preceding and 4 following) smooth from t)'


@query(f'with {_PROFILE} select image, "row", total, round(smooth, 6) smooth from f')
def row_profile(s, d):
    return grid.row_profile(pixels(s, d)).withColumn("smooth", F.round("smooth", 6))


@query(f'with {_PROFILE}, k as (select *, row_number() over (partition by image order by round(smooth, 6) desc, "row") k from f) select image, "row" peak_row from k where k = 1')
def profile_peak(s, d):
    return grid.profile_peak(grid.row_profile(pixels(s, d)).withColumn("smooth", F.round("smooth", 6)))


@query(f'with {_PROFILE} select image, "row", cast(coalesce(total - lag(total) over (partition by image order by "row"), 0) as bigint) gradient from f')
def profile_gradient(s, d):
    return grid.profile_gradient(grid.row_profile(pixels(s, d))).select("image", "row", "gradient")


@query(f'''with {_PROFILE}, d as (select image, "row", coalesce(total - lag(total) over (partition by image order by "row"), 0) v from f), e as (select *, min(case when v > 0 then "row" end) over (partition by image) first_up from d)
    select image, "row", round(avg(case when "row" = first_up then 0 else v end) over (partition by image order by "row" rows between 2 preceding and 2 following), 6) gradient from e''')
def profile_gradient_smooth(s, d):
    """The gradient without its first rise, averaged over five rows."""
    return grid.profile_gradient(grid.row_profile(pixels(s, d)), clear_first=True, taps=5).select("image", "row", F.round("gradient", 6).alias("gradient"))


@query(f'with {_G} select image, "row", min(case when subj > 600 then col end) first_pos, max(case when subj > 600 then col end) last_pos from g group by 1, 2')
def extent(s, d):
    return grid.extent(pixels(s, d), ["image", "row"], "col", F.col("subj") > 600)


@query(f'with {_G} select image, "row", col, case when depth < 9000 or depth > avg(depth) over (partition by image) then 0 else depth end masked from g')
def depth_mask(s, d):
    return grid.depth_mask(pixels(s, d), 9000).select("image", "row", "col", "masked")


@query(f'''with {_G}, m as (select *, min(case when subj <> 0 then value end) over (partition by image) lo, max(case when subj <> 0 then value end) over (partition by image) hi from g)
    select image, "row", col, cast(case when subj <> 0 then least(greatest(coalesce(round_even(cast((value - lo) * 1000.0 as double) / nullif(hi - lo, 0), 0), 0), 0), 1000) else 0 end as integer) norm from m''')
def normalised(s, d):
    return grid.normalised(pixels(s, d), "value", "subj").select("image", "row", "col", "norm")


@query(f'with {_G} select image, "row", col, cast(floor(coalesce(cast((depth - min(depth) over (partition by image)) * 255.0 as double) / nullif(max(depth) over (partition by image), 0), 0)) as integer) gray from g')
def view8(s, d):
    return grid.view8(pixels(s, d)).select("image", "row", "col", "gray")


@query(f'with {_G} select image, "row", col, subj > 520 and value % 2 = 0 both_masks, subj > 520 or value % 2 = 0 either_mask, subj > 520 and not value % 2 = 0 only_first from g')
def mask_operations(s, d):
    a, b = F.col("subj") > 520, F.col("value") % 2 == 0
    return pixels(s, d).select("image", "row", "col", grid.mask_both(a, b).alias("both_masks"), grid.mask_either(a, b).alias("either_mask"), grid.mask_minus(a, b).alias("only_first"))


def _components_sql(source: str, name: str = "cc") -> str:
    """``name (image, row, col, lab)``: every pixel of ``source`` with the raster position of its component's first pixel."""
    around = ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
    return f"""{name}(image, "row", col, lab) using key (image, "row", col) as (select image, "row", col, "row" * {SIDE} + col from {source} union
        select n.image, n."row", n.col, min(w.lab) from {name} w join (values {around}) as a(dr, dc) on true join recurring.{name} n on n.image = w.image and n."row" = w."row" + dr and n.col = w.col + dc where w.lab < n.lab group by 1, 2, 3)"""


@query(f'with recursive {_G}, fg as (select image, "row", col from g where subj <> 0), {_components_sql("fg")} select image, "row", col, cast(dense_rank() over (partition by image order by lab) as integer) component from cc')
def connected_components(s, d):
    return grid.connected_components(pixels(s, d), "subj", SIDE, SIDE)


@query(f"""with recursive {_G}, mean as (select image, sum(depth) / {SIDE * SIDE}.0 mean from g group by image), m as (select g.image, "row", col, case when depth < 5000 or depth > mean then 0 else depth end d from g join mean using (image)),
    fg as (select image, "row", col from m where d <> 0), {_components_sql("fg")}, size as (select image, lab, count(*) n from cc group by 1, 2), big as (select image, arg_min(lab, (-n, lab)) lab from size group by 1),
    body as (select cc.* from cc join big using (image, lab)), edge as (select image, b."row" + dr y, b.col + dc x, 1 k from body b join (values {", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1))}) as a(dr, dc) on true),
    near as (select m.image, m."row", m.col, m.d, (select count(*) from (values {", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1))}) as a(dr, dc)
        join body b on b.image = m.image and b."row" = least(greatest(m."row" + dr, 0), {SIDE - 1}) and b.col = least(greatest(m.col + dc, 0), {SIDE - 1})) n from m),
    kept as (select *, min(d) over (partition by image) lo, max(d) over (partition by image) hi from near where n >= 5),
    norm as (select image, "row", col, cast(case when hi > lo then least(greatest(round_even((d - lo) * (1000 / cast(hi - lo as double)), 0), 0), 1000) else 0 end as integer) subj from kept)
    select * from norm where subj <> 0""")
def subject(s, d):
    return grid.subject(pixels(s, d), SIDE, SIDE)


@query(f"""with {_G}, every_ as (select image, y "row", x col from (select distinct image from g) join (select unnest(range({SIDE})) y) on true join (select unnest(range({SIDE})) x) on true),
    fg as (select image, "row", col from g where subj <> 0), bg as (select image, "row", col from every_ anti join fg using (image, "row", col)),
    away as (select f.image, f."row", f.col, min(abs(f."row" - b."row") + abs(f.col - b.col)) n from fg f join bg b using (image) group by 1, 2, 3)
    select image, "row", col from away a where n >= coalesce((select max(q.n) from away q where q.image = a.image and abs(q."row" - a."row") + abs(q.col - a.col) = 1), 0)""")
def skeleton(s, d):
    return grid.skeleton(pixels(s, d), "subj", SIDE, SIDE)


@query(f"""with {_G}, k as (select image, "row" y, count(*) n, min(col) l, max(col) r, cast(floor(avg(col)) as integer) m from g where subj <> 0 group by 1, 2),
    w as (select *, n - coalesce(lag(n) over (partition by image order by y), n) up, min(y) over (partition by image) top from k),
    s as (select * from (select *, row_number() over (partition by image order by up desc, y) z from w) where z = 1), h as (select image, y hy, m hm from w where y = top),
    c as (select * from (select w.image, w.y ny, w.m nm, row_number() over (partition by w.image order by w.n, w.y desc) z from w join s using (image) where w.y < s.y and w.y >= floor((w.top + s.y) / 2)) where z = 1)
    select s.image, hy head_row, hm head_col, coalesce(ny, hy) neck_row, coalesce(nm, hm) neck_col, s.y shoulder_row, s.l left_col, s.r right_col, 2 * s.y - hy sternum_row, s.m sternum_col from s join h using (image) left join c using (image)""")
def silhouette(s, d):
    return grid.silhouette(pixels(s, d))


# --- parts, tracking, posture ---------------------------------------------------------------------------------------------------------------


@query(f'with {_C} select image, category, cast(floor(cast(sum("row") as double) / count(*)) as integer) "row", cast(floor(cast(sum(col) as double) / count(*)) as integer) col, count(*) n from c group by 1, 2')
def class_centroids(s, d):
    return posture.class_centroids(classified(s, d))


@query()
def tracker(s, d):
    return posture.track(classified(s, d), SIDE, SIDE)


@query()
def tracker_drift(s, d):
    return posture.drift_flags(posture.track(classified(s, d), SIDE, SIDE))


@query(f"""with {_C}, k as (select image % 4 stream, image // 4 frame, category part, cast(floor(cast(sum("row") as double) / count(*)) as integer) "row", cast(floor(cast(sum(col) as double) / count(*)) as integer) col from c group by 1, 2, 3),
    l as (select *, lag("row") over w r, lag(col) over w c from k window w as (partition by stream, part order by frame)) select stream, frame, part, "row", col, coalesce(abs("row" - r) > 10 or abs(col - c) > 10, false) drifted from l""")
def drift_flag(s, d):
    located = posture.class_centroids(classified(s, d), ("stream", "frame")).withColumnRenamed("category", "part").drop("n")
    return posture.drift_flags(located)


@query(f"""with {_C}, k as (select image, category part, cast(floor(cast(sum("row") as double) / count(*)) as integer) "row", cast(floor(cast(sum(col) as double) / count(*)) as integer) col from c group by 1, 2)
    select k.image, k.part, k."row", k.col, coalesce(g.depth, 0) depth from k left join g on g.image = k.image and g."row" = k."row" and g.col = k.col""")
def depth_at_parts(s, d):
    located = posture.class_centroids(classified(s, d)).withColumnRenamed("category", "part").drop("n")
    return posture.depth_at(located, pixels(s, d))


def _xyz(part: str) -> dict[str, str]:
    k = PARTS.index(part)
    return {a: f"cast(embedding[{3 * k + i + 1}] as double)" for i, a in enumerate("xyz")}


def _measure_sql() -> str:
    p = {"head": "Head", "neck": "Neck", "sternum": "Sternum", "l_shoulder": "LeftShoulder", "r_shoulder": "RightShoulder"}
    out = []
    for m in MEASUREMENTS:
        kind, rest = m.split("_", 1)
        a = next(k for k in p if rest.startswith(k + "_"))
        x, y = _xyz(p[a]), _xyz(p[rest[len(a) + 1 :]])
        sq = " + ".join(f"({x[c]} - {y[c]}) * ({x[c]} - {y[c]})" for c in "xyz")
        out.append(f"round({ {'dist': f'sqrt({sq})', 'off': f'{x['x']} - {y['x']}', 'dep': f'{x['z']} - {y['z']}'}[kind] }, 6) {m}")
    return f"select vec_id, {', '.join(out)} from embeddings"


@query(_measure_sql())
def measurements18(s, d):
    rows = joints(s, d)
    return rows.select("vec_id", *posture.measurements({p: F.col(p) for p in PARTS})).withColumns({m: F.round(m, 6) for m in MEASUREMENTS})


@query(f'with {_G} select image, "row", col, round((col / 64.0 - 0.5) * depth * (2 * tan(0.5)), 6) x, round((0.5 - "row" / 64.0) * depth * (2 * tan(0.4)), 6) y, cast(depth as double) z from g')
def to_world(s, d):
    w = scalar.to_world("row", "col", "depth", SIDE, SIDE, 1.0, 0.8)
    return pixels(s, d).select("image", "row", "col", w.alias("w")).select("image", "row", "col", F.round("w.x", 6).alias("x"), F.round("w.y", 6).alias("y"), "w.z")


_USABLE = "select distinct mm_id, vals from measurements where len(vals) = 18 and len([v for v in vals if v is not null and isfinite(v)]) = 18"
_NEAREST = f"""m as ({_USABLE}), d as (select m.mm_id, k.mm_id entry_id, sqrt({' + '.join(f'(vals[{i}] - mm[{i}]) * (vals[{i}] - mm[{i}])' for i in range(1, 19))}) dist from m, knowledge k),
    x as (select *, row_number() over (partition by mm_id order by dist, entry_id) rank from d)"""


def _neighbours(s, d):
    v = table(s, d, "measurements").where((F.size("vals") == 18) & F.forall("vals", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).select("mm_id", "vals").distinct()
    k = table(s, d, "knowledge").withColumnRenamed("mm_id", "entry_id")
    return posture.nearest(v, k, 5, "mm_id", "vals"), k


@query(f"with {_NEAREST} select mm_id, entry_id, round(dist, 4) dist, cast(rank as integer) rank from x where rank <= 5")
def knn_knowledge(s, d):
    return _neighbours(s, d)[0].withColumn("dist", F.round("dist", 4))


@query(f"with {_NEAREST} select x.mm_id, {', '.join(f'cast(sum({c}) as bigint) {c}' for c in STRAINS)} from x join knowledge k on k.mm_id = entry_id where rank <= 5 group by 1")
def strain_totals(s, d):
    near, k = _neighbours(s, d)
    return posture.strain_totals(near, k, "mm_id")


# --- joins ---------------------------------------------------------------------------------------------------------------------------------


@query("select a.rec_id, b.mm_id, a.image from (select distinct image, rec_id from records) a join (select distinct image, mm_id from measurements where image is not null) b on a.image = b.image")
def same_name(s, d):
    """Whole listings of both tables."""
    a = table(s, d, "records").select("image", "rec_id").distinct()
    b = table(s, d, "measurements").where("image is not null").select("image", "mm_id").distinct()
    return joins.same_name(a, b, "image")


_FIRST = f"f as (select image, {', '.join(STRAINS)} from (select *, row_number() over (partition by image order by line_no) k from strains) where k = 1)"


@query(f"with i as (select distinct image from records), {_FIRST} select i.image, {', '.join(STRAINS)}, f.image is not null found from i left join f on i.image = f.image")
def strains_lookup(s, d):
    return joins.looked_up(table(s, d, "records").select("image").distinct(), table(s, d, "strains")).drop("line_no")


@query(f"with i as (select distinct image from records), {_FIRST} select count(f.image) processed, count(*) - count(f.image) unprocessed from i left join f on i.image = f.image")
def strains_counts(s, d):
    return joins.lookup_counts(joins.looked_up(table(s, d, "records").select("image").distinct(), table(s, d, "strains")))


@query("select distinct image from records where image not in (select image from strains where image is not null)")
def strains_missing(s, d):
    return joins.missing(table(s, d, "records").select("image").distinct(), table(s, d, "strains"))


@query(f"with {_FIRST} select * from f")
def strains_first(s, d):
    return joins.first_wins(table(s, d, "strains"), "image", "line_no").drop("line_no")


@query("select rec_id, image from records where not image between 49 and 146")
def image_range(s, d):
    return table(s, d, "records").where(scalar.outside_images("image")).select("rec_id", "image")


@query(f"with {_R}, {_LONG}, l as (select distinct rec_id, label lab from r) select feature, lab, count(*) n, cast(sum(val) as bigint) total from long join l using (rec_id) group by 1, 2")
def record_lookup(s, d):
    r = records(s, d)
    cells = stats.long_cells(r, FEATURES, ("rec_id",))
    return joins.record_lookup(cells, r.select("rec_id", F.col("label").alias("lab")).distinct()).groupBy("feature", "lab").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"with {_R}, p as (select rec_id, case when f20 <= 320 then 2 else 3 end node_id from r) select rec_id, 7 node_id from p where node_id = 2")
def node_remap(s, d):
    mapping = s.createDataFrame([(2, 7), (3, None)], "old bigint, new int")
    return joins.remapped(train.partition_rows(records(s, d), "f20", 320).select("rec_id", "node_id"), mapping)


@query(f"with {_G} select image, \"row\", col, subj, case value % 7 {' '.join(f"when {i} then '{n}'" for i, n in enumerate(CATEGORIES))} else 'None' end \"label\" from g where subj <> 0")
def positional_join(s, d):
    """Foreground pixels with the category of their place in the label image."""
    foreground = pixels(s, d).where(scalar.is_foreground("subj")).select("image", "row", "col", "subj")
    return joins.positional(foreground, _label_colours(s, d).select("image", "row", "col", scalar.colour_category("r", "g", "b").alias("label")))


# --- frames ----------------------------------------------------------------------------------------------------------------------------------


def _numbered(s, d):
    return frames.numbered(clips(s, d), ["user_id"], ["ts", "event_id"])


_N_EVENTS = f"{_V}, q as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 seq from v)"


@query(f"with {_N_EVENTS} select event_id, user_id, cast(seq as bigint) seq from q where seq % 5 = 0")
def frame_sample(s, d):
    return frames.every_nth(_numbered(s, d), 5).select("event_id", "user_id", F.col("seq").cast("bigint").alias("seq"))


@query(f"with {_N_EVENTS} select event_id, user_id from q where seq in (1, 3)")
def frame_snapshots(s, d):
    return frames.snapshots(_numbered(s, d), [1, 3]).select("event_id", "user_id")


@query(f"with {_V} select event_id, sum(value) over (partition by user_id order by ts, event_id rows between 3 preceding and current row) / 4.0 model from v")
def ring_mean(s, d):
    return background.ring_mean(clips(s, d), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "model")


@query(f"with {_V}, m as (select event_id, value, sum(value) over (partition by user_id order by ts, event_id rows between 3 preceding and current row) / 4.0 model from v) select event_id, cast(case when abs(value - model) > 500 and abs(value - model) <= 3500 then 1 else 0 end as integer) motion from m")
def motion_mask(s, d):
    modelled = background.ring_mean(clips(s, d), "value", ["user_id"], ["ts", "event_id"])
    return background.motion_mask(modelled, "value").select("event_id", "motion")


@query(f'with {_G} select image, cast(coalesce(max(case when subj <> 0 and depth > 5000 and depth <= 20000 then depth end), 0) as integer) greatest from g group by image')
def frame_maxima(s, d):
    return background.frame_maxima(pixels(s, d), ("image",), "subj")


_RING = """with recursive {source}, a(stream, frame, ring, distance) as (
    select stream, frame, [case when i = 1 then case when floor(greatest / 8) < 10000 then 10000 else greatest end else 0 end::double for i in range(1, 9)], cast(greatest(floor(greatest / 8), 10000) as bigint) from v0 where k = 0
    union all select stream, frame, [case when i - 1 = slot and mean < 10000 then 10000 else laid[i] end::double for i in range(1, 9)], cast(greatest(mean, 10000) as bigint)
    from (select *, floor(list_sum(laid) / 8) mean from (select v.stream, v.frame, v.k % 8 slot, [case when i - 1 = v.k % 8 then v.greatest else a.ring[i] end::double for i in range(1, 9)] laid from a join v0 p on p.stream = a.stream and p.frame = a.frame join v0 v on v.stream = a.stream and v.k = p.k + 1)))"""
_DISTANCES = _RING.format(source=f"{_N_EVENTS}, v0 as (select user_id stream, seq frame, seq k, cast(value + 5000 as double) greatest from q)") + " select stream, frame, distance from a"


@query(_DISTANCES)
def adaptive_distance(s, d):
    rows = _numbered(s, d).select(F.col("user_id").alias("stream"), F.col("seq").alias("frame"), (F.col("value") + 5000).alias("greatest"))
    return background.adaptive_distance(rows)


@query(f'with {_G} select image, "row", col, depth > 5000 and depth <= 10200 + 1000 in_view from g')
def view_mask(s, d):
    return background.view_mask(pixels(s, d).withColumn("distance", F.lit(10_200))).select("image", "row", "col", "in_view")


@query(f'with {_G}, f as (select image % 4 stream, image // 4 frame, "row", col, depth from g) select stream, frame, "row", col, sum(depth) over (partition by stream, "row", col order by frame rows between 3 preceding and current row) / 4.0 model from f where frame % 2 = 0')
def background_model(s, d):
    """Frames are the images of each of four streams; every second is sampled."""
    rows = pixels(s, d).withColumns({"stream": F.pmod("image", F.lit(4)), "frame": F.floor(F.col("image") / 4)})
    return background.background_model(rows, sample=2).select("stream", "frame", "row", "col", "model")


_SHOWN = f"""{_G}, f as (select image % 4 stream, image // 4 frame, "row", col, cast(depth - 7000 as bigint) depth from g),
    m as (select *, sum(depth) over (partition by stream, "row", col order by frame rows between 3 preceding and current row) / 4.0 model from f), n as (select *, case when abs(depth - model) > 500 and abs(depth - model) <= 3500 then 1 else 0 end raw from m),
    h as (select *, min(raw) over (partition by stream, frame, "row" order by col rows between 2 preceding and 2 following) hm from n), e as (select *, min(hm) over (partition by stream, frame, col order by "row" rows between 2 preceding and 2 following) motion from h),
    top as (select stream, frame, coalesce(max(case when motion <> 0 and depth > 5000 and depth <= 20000 then depth end), 0) greatest from e group by 1, 2),
    v0 as (select stream, frame, row_number() over (partition by stream order by frame) - 1 k, cast(greatest as double) greatest from top)"""


@query(_RING.format(source=_SHOWN) + ' select e.stream, e.frame, e."row", e.col, e.depth, model, motion, distance, e.depth > 5000 and e.depth <= distance + 1000 in_view from e join a using (stream, frame)')
def background_chain(s, d):
    """Model, eroded motion, adaptive distance and view mask of four streams of frames; every frame is sampled."""
    rows = pixels(s, d).withColumns({"stream": F.pmod("image", F.lit(4)), "frame": F.floor(F.col("image") / 4)})
    return background.background_chain(rows.select("stream", "frame", "row", "col", (F.col("depth") - 7000).cast("bigint").alias("depth")), sample=1)


@query(f'with {_G}, f as (select image % 4 stream, image // 4 frame, "row", col, depth from g) select * from f where frame = (select max(frame) from f l where l.stream = f.stream)')
def last_frame(s, d):
    rows = pixels(s, d).withColumns({"stream": F.pmod("image", F.lit(4)), "frame": F.floor(F.col("image") / 4)})
    return frames.last_frame(rows.select("stream", "frame", "row", "col", "depth"))


@query("select event_id, user_id * 2 + event_id % 7 code from events")
def row_callback(s, d):
    """A callback over all rows of a scan, block by block."""
    return frames.per_row(table(s, d, "events").select("event_id", "user_id"), lambda b: b.assign(code=b["user_id"] * 2 + b["event_id"] % 7)[["event_id", "code"]], "event_id bigint, code bigint")


def _streamed(s, d, rows: DataFrame, schema: str, run, out_schema: str, parts: int = 3, files: int = 4) -> DataFrame:
    """``rows`` dropped as files in order of their frames, read as a stream in ``parts`` micro-batches, results read back. State passes from batch to batch."""
    from .tables import shared_dir

    rows = materialise(rows)
    last = rows.agg(F.max("frame")).collect()[0][0] or 0
    import uuid

    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    part = F.floor(F.col("frame") * parts / (last + 1))
    for k in range(parts):  # files are taken in the order in which they were written
        rows.where(part == k).repartition(files).write.mode("append").parquet(base + "/in")
    stream = run(frames.read_frames(s, base + "/in", schema, files_per_trigger=files))
    q = stream.writeStream.format("parquet").option("checkpointLocation", base + "/state").option("path", base + "/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(out_schema).parquet(base + "/out")


@query(_DISTANCES)
def stream_distance(s, d):
    from ..streaming.tracking import distance_stream

    rows = _numbered(s, d).select(F.col("user_id").cast("bigint").alias("stream"), F.col("seq").cast("bigint").alias("frame"), (F.col("value") + 5000).cast("double").alias("greatest"))
    return _streamed(s, d, rows, "stream bigint, frame bigint, greatest double", distance_stream, "stream bigint, frame bigint, distance bigint")


@query()
def stream_tracker(s, d):
    from ..schema import LOCATIONS
    from ..streaming.tracking import track_stream

    schema = "stream bigint, frame bigint, row int, col int, depth int, category string"
    rows = classified(s, d).selectExpr("cast(stream as bigint) stream", "cast(frame as bigint) frame", "row", "cast(col as int) col", "cast(depth as int) depth", "category")
    return _streamed(s, d, rows, schema, lambda x: track_stream(x, SIDE, SIDE), LOCATIONS)


@query(f"with {_C}, f as (select distinct image from c) select count(*) * 5 locations, true same_rows from f")
def stream_tracker_twin(s, d):
    """The streamed tracker against the one over the whole table: the same rows, five for every frame."""
    streamed, whole = materialise(stream_tracker(s, d)), materialise(posture.track(classified(s, d), SIDE, SIDE))
    differing = streamed.exceptAll(whole).unionByName(whole.exceptAll(streamed)).count()
    return whole.agg(F.count("*").alias("locations")).withColumn("same_rows", F.lit(differing == 0))


@query()
def frames_to_strains(s, d):
    """A tree grown on labelled frames, then from frames of four streams to summed strains: features, vote, tracker, measurements, nearest knowledge."""
    tree = train.grow(materialise(frames_to_records(s, d)), FEATURES, settings=Settings(max_depth=5))
    rows = pixels(s, d).withColumns({"stream": F.pmod("image", F.lit(4)), "frame": F.floor(F.col("image") / 4)})
    return pipeline.strains_from_frames(rows, [tree], table(s, d, "knowledge").withColumnRenamed("mm_id", "entry_id"), rows=SIDE, cols=SIDE, segmented=True)


# --- scalar functions -------------------------------------------------------------------------------------------------------------------------


def _colour_sql(low: int, high: int, yellow: str) -> str:
    on, off = f"between {low} and {high}", "<= 5"
    rows = (("Head", off, off, on), ("Neck", off, on, on), ("LeftShoulder", off, on, off), ("RightShoulder", on, off, off), (yellow, on, on, off), ("Other", on, on, on))
    return "case " + " ".join(f"when r {a} and g {b} and b {c} then '{n}'" for n, a, b, c in rows) + " else 'None' end"


_RGB = "select l_orderkey, (l_partkey % 3) * 45 r, (l_suppkey % 3) * 45 g, (l_linenumber % 3) * 45 b from lineitem"


@query(f"select l_orderkey, r, g, b, {_colour_sql(85, 95, 'Sternum')} category, {_colour_sql(85, 95, 'Neck')} older from ({_RGB})")
def colour_category(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3 * 45).alias("r"), (F.col("l_suppkey") % 3 * 45).alias("g"), (F.col("l_linenumber") % 3 * 45).alias("b"))
    return x.withColumns({"category": scalar.colour_category("r", "g", "b"), "older": scalar.colour_category("r", "g", "b", yellow_is_neck=True)})


@query("""select label, case when label in ('RightShoulder', 'Sternum', 'Other') then 255 when label is null or label = 'None' then 127 else 0 end r, case when label in ('Neck', 'LeftShoulder', 'Sternum', 'Other') then 255 when label is null or label = 'None' then 127 else 0 end g,
    case when label in ('Head', 'Neck', 'Other') then 255 when label is null or label = 'None' then 127 else 0 end b, count(*) n from (select coalesce(case lower(trim(outcome, ' ' || chr(9))) when 'head' then 'Head' when 'neck' then 'Neck' when 'leftshoulder' then 'LeftShoulder' when 'rightshoulder' then 'RightShoulder' when 'sternum' then 'Sternum' when 'other' then 'Other' end, 'None') "label" from records) group by 1, 2, 3, 4""")
def category_colour(s, d):
    x = table(s, d, "records").select(scalar.category_name(scalar.category_code("outcome")).alias("label"))
    return x.groupBy("label").agg(F.count("*").alias("n")).withColumn("c", scalar.category_colour("label", "real")).select("label", "c.r", "c.g", "c.b", "n")


@query("""select event_id, user_id * 256 + (event_id % 2) * 128 + event_id % 100 packed, user_id node, cast(event_id % 2 as integer) flag, cast(event_id % 100 as integer) category from events""")
def lookup_packing(s, d):
    x = table(s, d, "events").select("event_id", scalar.pack_lookup("user_id", F.col("event_id") % 2, F.col("event_id") % 100).alias("packed"))
    return x.withColumn("u", scalar.unpack_lookup("packed")).select("event_id", "packed", "u.node", "u.flag", "u.category")


@query(f"with {_R} select lpad(cast(rec_id as varchar), 12, '0') || ' ' || {' || chr(32) || '.join(f'''case when length(cast(coalesce({f}, 65535) as varchar)) >= 4 then cast(coalesce({f}, 65535) as varchar) else lpad(cast(coalesce({f}, 65535) as varchar), 4, '0') end''' for f in FEATURES)} || ' ' || cast(label as varchar) line from r")
def record_text(s, d):
    return records(s, d).select(scalar.record_text(FEATURES, "label", "rec_id").alias("line"))


@query(f"select line_no, 'S(P(' || concat_ws(',', {', '.join(STRAINS[:4])}) || '),P(' || concat_ws(',', {', '.join(STRAINS[4:])}) || '))' line from strains")
def strains_text(s, d):
    return table(s, d, "strains").select("line_no", scalar.strains_text(STRAINS).alias("line"))


@query(f"select mm_id, 'MS(M(' || array_to_string(mm, ',') || ');S(P(' || concat_ws(',', {', '.join(STRAINS[:4])}) || '),P(' || concat_ws(',', {', '.join(STRAINS[4:])}) || ')))' line from knowledge")
def knowledge_lines(s, d):
    return table(s, d, "knowledge").select("mm_id", scalar.knowledge_text("mm", STRAINS).alias("line"))


@query("""select l_orderkey, l_linenumber, cast(round(20 / (l_quantity * 100 / 10000.0)) as integer) shifted, cast(floor(l_quantity / 3) as integer) third, least(greatest(cast(floor(l_extendedprice) as bigint) - 30000, 0), 65535) saturated,
    cast(ceil(l_discount * 10) as integer) up from lineitem""")
def scalar_arithmetic(s, d):
    whole = F.floor("l_extendedprice").cast("bigint") - 30_000
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.depth_offset(20, F.col("l_quantity") * 100).alias("shifted"), F.floor(F.col("l_quantity") / 3).cast("int").alias("third"), scalar.saturated16(whole).alias("saturated"), F.ceil(F.col("l_discount") * 10).cast("int").alias("up"))


@query("select l_orderkey, cast(l_partkey as integer) image from lineitem")
def file_numbers(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("/data/"), F.col("l_partkey").cast("string"), F.lit(".png")).alias("path"))
    return joins.numbered_files(x).select("l_orderkey", "image")


@query(f"select a.vec_id, round(sqrt({' + '.join(f'(cast(a.embedding[{i}] as double) - cast(b.embedding[{i}] as double)) * (cast(a.embedding[{i}] as double) - cast(b.embedding[{i}] as double))' for i in range(1, 65))}), 5) dist, round(cast(a.embedding[1] as double) + cast(b.embedding[1] as double), 6) first_sum from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def pair_distance(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(scalar.distance_array("a", "b"), 5).alias("dist"), F.round(scalar.add_arrays("a", "b")[0], 6).alias("first_sum"))


def queries():
    return dict(REGISTRY)


def oracle_sql():
    return dict(SQL)
