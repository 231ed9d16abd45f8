"""Names, codes, settings and table layouts of the data model.

Tables: records ``(rec_id, f0.., label)``, pixels ``(image, row, col, depth, subj[, r, g, b])``, nodes ``(tree_id, node_id, kind, ref_val,
feature, true_id, false_id, results)``, locations ``(stream, frame, part, row, col, depth, accuracy)``, measurements as arrays of 18.
Missing cells are null; readers of old files turn the sentinel 65535 (or -1) into null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Category names by code, and the code of unlabelled pixels.
CATEGORIES = ("LeftShoulder", "RightShoulder", "Head", "Neck", "Sternum", "Other")
NONE, NONE_CODE = "None", 99
N_FEATURES = 26

# The five tracked parts, in the order of their codes.
PARTS = ("Head", "Neck", "LeftShoulder", "RightShoulder", "Sternum")

# Order of the 18 measurements.
MEASUREMENTS = (
    "dist_head_l_shoulder", "dist_head_r_shoulder", "dist_head_sternum", "dist_sternum_l_shoulder", "dist_sternum_r_shoulder", "dist_neck_l_shoulder", "dist_neck_r_shoulder",
    "off_head_neck", "off_head_l_shoulder", "off_head_r_shoulder", "off_sternum_l_shoulder", "off_sternum_r_shoulder",
    "dep_head_neck", "dep_neck_sternum", "dep_head_sternum", "dep_l_shoulder_r_shoulder", "dep_l_shoulder_sternum", "dep_r_shoulder_sternum",
)
STRAINS = ("neck_left", "neck_back", "neck_right", "neck_front", "upper_left", "upper_back", "upper_right", "upper_front")

# Image size, depth unit, largest normalised depth, sentinel of background.
ROWS, COLS, ONE_METER, NORM, BACKGROUND = 240, 320, 10_000, 1000, 65_535


@dataclass(frozen=True)
class Settings:
    """How trees are grown. ``op``: ``le`` or ``lt`` (true branch: feature <= or < value); ``tie``: which of equally good splits wins, the
    ``last`` or ``first`` in order of (feature, value); a node of at most ``min_node`` records or of impurity at most ``min_impurity`` is a leaf, so
    that ``min_impurity=0`` stops at pure nodes only. ``least_gain``: a split must have a ``positive`` gain, or one that is positive when ``quantised``.
    ``leaf_order``: a leaf's outcomes by ``name``, or by ``code`` (position among the six categories, unknown names last)."""

    op: str = "le"
    min_node: int = 1
    min_impurity: float = 0.03
    tie: str = "last"
    max_depth: int = 64
    quantum: float = 1e6
    least_gain: str = "positive"
    leaf_order: str = "name"

    def __post_init__(self):
        if self.op not in ("le", "lt") or self.tie not in ("last", "first"):
            raise ValueError("op is 'le' or 'lt', tie is 'last' or 'first'")
        if self.least_gain not in ("positive", "quantised") or self.leaf_order not in ("name", "code"):
            raise ValueError("least_gain is 'positive' or 'quantised', leaf_order is 'name' or 'code'")


RESULT = T.ArrayType(T.StructType([T.StructField("outcome", T.StringType()), T.StructField("probability", T.DoubleType())]))
NODES = T.StructType(
    [T.StructField("tree_id", T.StringType()), T.StructField("node_id", T.IntegerType()), T.StructField("kind", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("ref_val", "feature", "true_id", "false_id")]
    + [T.StructField("results", RESULT)]
)
LOCATIONS = "stream bigint, frame bigint, part string, row int, col int, depth int, accuracy double, status string"


def features(n: int = N_FEATURES) -> list[str]:
    return [f"f{i}" for i in range(n)]
