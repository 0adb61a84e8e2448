"""Fixed table layouts.

Ids are ``long``: the model allows 32-bit ids, a cluster-sized collection
does not fit them. Missing ids and unknown times are NULL inside the package;
``functions.sentinels`` turns them into -1 / NaN at the boundary.
"""

from pyspark.sql import types as T

_L, _D, _S = T.LongType(), T.DoubleType(), T.StringType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


NODES = _struct(("id", _L), ("flags", _L), ("time", _D), ("population", _L),
                ("individual", _L), ("metadata_json", _S))
EDGES = _struct(("id", _L), ("left", _D), ("right", _D), ("parent", _L), ("child", _L))
SITES = _struct(("id", _L), ("position", _D), ("ancestral_state", _S), ("metadata_json", _S))
MUTATIONS = _struct(("id", _L), ("site_id", _L), ("node_id", _L), ("parent_id", _L),
                    ("time", _D), ("derived_state", _S), ("metadata_json", _S))
INDIVIDUALS = _struct(("id", _L), ("flags", _L), ("location", T.ArrayType(_D)),
                      ("parents", T.ArrayType(_L)), ("metadata_json", _S))
POPULATIONS = _struct(("id", _L), ("metadata_json", _S))
PROVENANCES = _struct(("id", _L), ("timestamp", _S), ("record", _S))
INTERVALS = _struct(("tree_index", _L), ("left", _D), ("right", _D))

TABLES = {
    "nodes": NODES, "edges": EDGES, "sites": SITES, "mutations": MUTATIONS,
    "individuals": INDIVIDUALS, "populations": POPULATIONS, "provenances": PROVENANCES,
}

# Boundary tables. Ids stay long: those of a cluster-sized collection do not fit 32 bits.
LAYOUT_NODES = _struct(("node_id", _L), ("parent_id", _L),
                       ("is_tip", T.BooleanType()), ("tree_idx", _L),
                       ("x", T.FloatType()), ("y", T.FloatType()))
LAYOUT_MUTATIONS = _struct(
    ("mut_x", T.FloatType()), ("mut_y", T.FloatType()), ("mut_tree_idx", _L),
    ("mut_node_id", _L), ("mut_id", _L),
    ("mut_site_id", _L), ("mut_position", _D), ("mut_time", _D),
    ("mut_ancestral_state", _S), ("mut_derived_state", _S), ("mut_inherited_state", _S))
MUTATION_RESULT = _struct(
    ("position", _L), ("mutation", _S), ("node_id", _L),
    ("site_id", _L), ("ancestral_state", _S), ("derived_state", _S),
    ("distance", _L), ("tree_index", _L), ("interval_left", _D), ("interval_right", _D))
NEWICK_NODES = _struct(
    ("tree_index", _L), ("postorder", _L), ("parent_postorder", _L), ("sibling", _L),
    ("internal_rank", _L), ("parent_internal_rank", _L), ("is_tip", T.BooleanType()),
    ("name", _S), ("branch_length", _D), ("root_distance", _D))
