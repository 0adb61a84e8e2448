"""Newick collections: CSV tables, paired line files, windowed tables, node rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from copse.functions import text as X
from copse.operators.layout import layout_x
from copse.operators.ordered import global_rank
from copse.operators.skew import few
from copse.schemas import NEWICK_NODES
from copse.session import cut

# Column names, outgroup name, first inner id, folder prefixes.
REQUIRED = ("genomic_positions", "newick")
HEIGHT = "max_branch_length"
INFO_COLUMNS = ("tree_info", "tree info")
OUTGROUP = "etal"
INTERNAL_BASE = 1_000_000
SHIFTED_PREFIXES: tuple[str, ...] = ()


# ---- file order -----------------------------------------------------------

def in_file_order(df: DataFrame) -> DataFrame:
    """Add sortable columns ``_file, _block, _line`` that follow the input order."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_line"))


ORDER = ("_file", "_block", "_line")


# ---- CSV with one tree per row -------------------------------------------

def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, with input-order columns."""
    raw = spark.read.options(header=True, sep=sep, escape='"').csv(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return in_file_order(raw)


def tree_rows(raw: DataFrame) -> DataFrame:
    """Rows with a position: numbered by (position, input order) from 0.

    ``tree_index, position, newick, max_branch_length, tree_info`` plus the
    metadata columns. A position that is not a number is an error, and so is
    an empty table.
    """
    have = raw.columns
    position = F.col("genomic_positions")
    number = position.try_cast("double")
    checked = F.when(number.isNull(), F.raise_error(
        F.concat(F.lit("position is not a number: "), position)).cast("double")).otherwise(number)
    info = F.lit(None).cast("string")
    for name in reversed([c for c in INFO_COLUMNS if c in have]):
        info = F.col(f"`{name}`")
    height = F.col(HEIGHT) if HEIGHT in have else F.lit(None).cast("string")
    order = [c for c in ORDER if c in have]
    rows = raw.where(~X.is_blank(position)).select(
        checked.alias("position"), "newick", height.alias(HEIGHT), info.alias("tree_info"),
        *[F.col(f"`{c}`") for c in metadata_columns(raw)], *order)
    ranked = global_rank(rows, "position", *order, out="tree_index")
    if ranked.isEmpty():
        raise ValueError("no rows")
    return ranked.drop(*order)


def metadata_columns(raw: DataFrame) -> list[str]:
    """Columns after ``max_branch_length``, tree info left out."""
    have = [c for c in raw.columns if c not in ORDER]
    if HEIGHT not in have:
        return []
    return [c for c in have[have.index(HEIGHT) + 1:] if c not in INFO_COLUMNS]


def file_metadata(raw: DataFrame) -> DataFrame:
    """File-level values ``(key, value, <input order>)`` from rows without a tree.

    Such rows are blank in all columns up to ``max_branch_length``.
    """
    have = [c for c in raw.columns if c not in ORDER]
    if HEIGHT not in have:
        return raw.limit(0).select(F.lit("").alias("key"), F.lit("").alias("value"), *ORDER)
    at = have.index(HEIGHT)
    blank = F.lit(True)
    for name in have[:at + 1]:
        blank = blank & X.is_blank(F.col(f"`{name}`"))
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value"))
                      for c in have[at + 1:]])
    return raw.where(blank).select(F.explode(pairs).alias("e"), *ORDER).select(
        "e.key", "e.value", *ORDER).where(~X.is_blank(F.col("value")))


def tree_info(rows: DataFrame) -> DataFrame:
    """``(tree_index, tree_info)`` of rows with a tree and a non-blank info."""
    return rows.where(~X.is_blank(F.col("newick")) & ~X.is_blank(F.col("tree_info"))).select(
        "tree_index", "tree_info")


def global_height(rows: DataFrame) -> DataFrame:
    """One row ``(height)``: largest valid column value, else the longest edge."""
    trees = rows.where(~X.is_blank(F.col("newick")))
    given = F.col(HEIGHT).try_cast("double")
    return trees.agg(F.greatest(F.lit(0.0), F.coalesce(
        F.max(given), F.max(X.longest_edge(F.col("newick"))), F.lit(0.0))).alias("height"))


def sample_order(rows: DataFrame, meta: DataFrame | None = None,
                 outgroup: str = OUTGROUP) -> DataFrame:
    """``(name, sample_id)``: file metadata in input order, else all names sorted.

    The outgroup is left out.
    """
    kept = F.lower("name") != outgroup.lower()
    listed = None
    if meta is not None:
        listed = cut(meta.where(F.col("key") == "samples").groupBy(
            F.col("value").alias("name")).agg(F.min(F.struct(*ORDER)).alias("_o")).where(kept))
    if listed is not None and not listed.isEmpty():
        return global_rank(listed, "_o", out="sample_id").select("name", "sample_id")
    names = rows.where(~X.is_blank(F.col("newick"))).select(
        F.explode(X.labels(F.col("newick"))).alias("name")).distinct().where(kept)
    return global_rank(names, "name", out="sample_id").select("name", "sample_id")


# ---- lines paired with positions -----------------------------------------

def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their number from 0."""
    raw = in_file_order(spark.read.text(path))
    return global_rank(raw, *ORDER, out="line").select("line", F.trim("value").alias("value"))


def read_paired(spark: SparkSession, trees_path: str, positions_path: str,
                final_window: int = 10_000) -> DataFrame:
    """``(tree_index, newick, left, right)`` from two files of equal length.

    Positions are whole, strictly increasing numbers and no line is blank;
    anything else is refused. The last interval is ``final_window`` long.
    """
    trees, places = cut(numbered_lines(spark, trees_path)), cut(numbered_lines(spark, positions_path))
    value = F.col("value").try_cast("long")
    nxt = places.select((F.col("line") - 1).alias("line"), value.alias("_next"))
    typed = places.select("line", "value", value.alias("left")).join(nxt, "line", "left")
    bad = typed.agg(
        F.count_if(F.col("value") == "").alias("blank"),
        F.count_if((F.col("value") != "") & F.col("left").isNull()).alias("not whole numbers"),
        F.count_if(F.col("_next") <= F.col("left")).alias("not increasing"),
        F.count("*").alias("n")).first()
    for problem in ("blank", "not whole numbers", "not increasing"):
        if bad[problem]:
            raise ValueError(f"{positions_path}: {bad[problem]} lines are {problem}")
    lines = trees.agg(F.count("*").alias("n"), F.count_if(F.col("value") == "").alias("blank")).first()
    if lines["blank"]:
        raise ValueError(f"{trees_path}: {lines['blank']} lines are blank")
    if lines["n"] != bad["n"] or not bad["n"]:
        raise ValueError(f"{lines['n']} trees and {bad['n']} positions")
    return trees.join(typed.drop("value"), "line").select(
        F.col("line").alias("tree_index"), F.col("value").alias("newick"),
        F.col("left").cast("double").alias("left"),
        F.coalesce(F.col("_next"), F.col("left") + final_window).cast("double").alias("right"))


# ---- windowed tables ------------------------------------------------------

def read_windows(spark: SparkSession, path: str, sep: str = "\t",
                 window: int = 50_000) -> DataFrame:
    """``chrom_index <sep> newick`` rows -> windows."""
    raw = spark.read.option("sep", sep).schema("position_id string, newick string").csv(path)
    return windows(raw, window)


def windows(raw: DataFrame, window: int = 50_000) -> DataFrame:
    """``(chrom, idx, start, end, newick)``; the id splits at its first underscore."""
    ident = F.trim("position_id")
    at = F.instr(ident, "_")
    idx = F.substring(ident, at + 1, F.length(ident)).try_cast("long")
    idx = F.when((at == 0) | idx.isNull(), F.raise_error(F.concat(
        F.lit("bad window id: "), ident)).cast("long")).otherwise(idx)
    return raw.where(~X.is_blank(F.col("position_id"))).select(
        F.substring(ident, F.lit(1), at - 1).alias("chrom"), idx.alias("idx"),
        F.coalesce(F.trim("newick"), F.lit("")).alias("newick")).select(
        "chrom", "idx", ((F.col("idx") - 1) * window).alias("start"),
        (F.col("idx") * window).alias("end"), "newick")


# ---- tree text -> node rows ----------------------------------------------

#: Comments, quoted labels (a doubled quote is a quote), signs, and plain text.
_TOKENS = re.compile(r"\[[^\]]*\]?|'(?:[^']|'')*'?|[(),:;]|[^\['(),:;]+")


def parse_newick(text: str) -> list[list]:
    """Nodes ``[parent, name, length, children]`` of one tree; node 0 is the root."""
    nodes = [[-1, "", 0.0, []]]
    at, held, is_length = 0, "", False

    def close():
        nonlocal held
        word, held = held.strip(), ""
        if is_length:
            nodes[at][2] = float(word) if word else 0.0
        elif word:
            nodes[at][1] = word

    def child_of(parent):
        nodes.append([parent, "", 0.0, []])
        nodes[parent][3].append(len(nodes) - 1)
        return len(nodes) - 1

    for token in _TOKENS.findall(text.strip()):
        sign = token[0]
        if sign == "(":
            at, held, is_length = child_of(at), "", False
        elif sign in ",)":
            close()
            is_length, up = False, nodes[at][0]
            if up < 0:
                raise ValueError("unbalanced tree text")
            at = child_of(up) if sign == "," else up
        elif sign == ":":
            close()
            is_length = True
        elif sign == ";":
            break
        elif sign == "'":
            held += token[1:-1].replace("''", "'") if len(token) > 1 and token[-1] == "'" else token[1:]
        elif sign != "[":
            held += token
    close()
    if at != 0:
        raise ValueError("unbalanced tree text")
    return nodes


def drop_outgroup(nodes: list[list], outgroup: str) -> int:
    """Re-root on the outgroup leaf and remove it; returns the new root.

    The side of the tree that the leaf hung from becomes the only child of the
    root, without a length. Each node between it and the old root loses the
    child on the way and gains its former parent as last child; an old root
    left with one child gives way to it. Unchanged if there is no such leaf.
    """
    hits = [i for i, n in enumerate(nodes) if not n[3] and n[1].lower() == outgroup.lower()]
    if not hits or nodes[hits[0]][0] < 0:
        return 0
    way = [hits[0]]
    while nodes[way[-1]][0] >= 0:
        way.append(nodes[way[-1]][0])
    for below, above in zip(way, way[1:]):
        nodes[above][3].remove(below)
    old_root = way[-1]
    rest = way[1:]
    if len(nodes[old_root][3]) == 1:
        only = nodes[old_root][3][0]
        rest[-1] = only
        if len(rest) > 1:
            nodes[only][2] += nodes[way[-2]][2]
        lengths = [nodes[i][2] for i in way[1:-2]]
    else:
        lengths = [nodes[i][2] for i in way[1:-1]]
    for i, (near, far) in enumerate(zip(rest, rest[1:])):
        nodes[near][3].append(far)
        nodes[far][0] = near
        if i < len(lengths):
            nodes[far][2] = lengths[i]
    nodes.append([-1, "", 0.0, [rest[0]]])
    nodes[rest[0]][0], nodes[rest[0]][2] = len(nodes) - 1, 0.0
    return len(nodes) - 1


def _postorder(nodes: list[list], root: int) -> list[int]:
    order, stack = [], [root]
    while stack:
        at = stack.pop()
        order.append(at)
        stack.extend(nodes[at][3])
    return order[::-1]


def _node_rows(tree_index: int, text: str, outgroup: str | None) -> Iterator[tuple]:
    """Node rows of one tree in post-order, in the column order of the schema."""
    nodes = parse_newick(text)
    root = drop_outgroup(nodes, outgroup) if outgroup else 0
    order = _postorder(nodes, root)
    place = {at: i for i, at in enumerate(order)}
    rank = {at: i for i, at in enumerate(a for a in order if nodes[a][3])}
    distance, sibling = {root: 0.0}, {root: 0}
    for at in reversed(order):
        for i, child in enumerate(nodes[at][3]):
            distance[child] = distance[at] + nodes[child][2]
            sibling[child] = i
    for at in order:
        up = nodes[at][0] if at != root else None
        yield (tree_index, place[at], place.get(up), sibling[at], rank.get(at), rank.get(up),
               not nodes[at][3], nodes[at][1] or None, nodes[at][2], distance[at])


def newick_nodes(rows: DataFrame, outgroup: str | None = OUTGROUP,
                 on_error: str = "fail") -> DataFrame:
    """One row per node of every tree text (see ``schemas.NEWICK_NODES``).

    Only the text is taken apart in Python, tree by tree in Arrow batches; ids,
    heights and coordinates follow as joins and windows. ``on_error='skip'``
    leaves trees out that cannot be read.
    """
    columns = NEWICK_NODES.fieldNames()
    whole = [f.name for f in NEWICK_NODES if f.dataType.typeName() == "long"]

    def frame(pending: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(pending, columns=columns).astype({c: "Int64" for c in whole})

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list[tuple] = []
        for batch in batches:
            for index, text in zip(batch["tree_index"], batch["newick"]):
                try:
                    pending.extend(list(_node_rows(index, text, outgroup)))
                except ValueError:
                    if on_error != "skip":
                        raise
                if len(pending) >= 50_000:
                    yield frame(pending)
                    pending = []
        if pending:
            yield frame(pending)

    # Spread by tree: numbered rows may sit in few partitions, and text is heavy.
    trees = rows.where(~X.is_blank(F.col("newick"))).select("tree_index", "newick").repartition(
        "tree_index")
    return trees.mapInPandas(explode, NEWICK_NODES)


def with_sample_ids(parsed: DataFrame, order: DataFrame, base: int | None = None) -> DataFrame:
    """Add ``node_id`` / ``parent_id``: tips by sample order, inner nodes after them.

    Inner ids follow the tree's own post-order, starting at the number of
    samples or at ``base``. A tip that is not in the order is an error.
    """
    names = order.select("name", "sample_id")
    first = (order.agg(F.count("*")).scalar() if base is None else F.lit(base)).cast("long")
    missing = F.raise_error(F.concat(F.lit("tip not among the samples: "),
                                     F.coalesce("name", F.lit("")))).cast("long")
    tip_id = F.when(F.col("sample_id").isNull(), missing).otherwise(F.col("sample_id"))
    # Few names may label very many nodes, inner ones too: by name these would meet in a few tasks.
    return parsed.join(few(names), "name", "left").select(
        "tree_index", "postorder", "parent_postorder", "sibling", "is_tip", "name",
        "branch_length", "root_distance",
        F.when(F.col("is_tip"), tip_id).otherwise(first + F.col("internal_rank")).alias("node_id"),
        (first + F.col("parent_internal_rank")).alias("parent_id"))


def with_postorder_ids(parsed: DataFrame) -> DataFrame:
    """The same without a sample order: ids are post-order numbers."""
    return parsed.select(
        "tree_index", "postorder", "parent_postorder", "sibling", "is_tip", "name",
        "branch_length", "root_distance", F.col("postorder").alias("node_id"),
        F.col("parent_postorder").alias("parent_id"))


# ---- heights and coordinates ---------------------------------------------

def tree_heights(parsed: DataFrame) -> DataFrame:
    """Largest root distance per tree."""
    return parsed.groupBy("tree_index").agg(F.max("root_distance").alias("height"))


def with_node_height(parsed: DataFrame) -> DataFrame:
    """Add ``node_height``: tree height minus root distance."""
    return parsed.join(tree_heights(parsed), "tree_index").withColumn(
        "node_height", F.col("height") - F.col("root_distance"))


def newick_y(parsed: DataFrame, rows: DataFrame, height: Column,
             shift_tips: bool = False) -> DataFrame:
    """Add ``y``: 1 at the tip furthest from the root, lower towards the root.

    Scaled by the global ``height`` (all 1 without one); a positive height in
    the tree's own column replaces the height of the text. ``shift_tips``
    moves each tree so that its highest tip is at 1.
    """
    own = rows.select("tree_index", F.col(HEIGHT).try_cast("double").alias("_own"))
    tops = tree_heights(parsed).join(own, "tree_index", "left").select(
        "tree_index", F.when(F.col("_own") > 0, F.col("_own")).otherwise(F.col("height"))
        .alias("_top"))
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    raw = F.lit(1.0) - (F.col("_top") - F.col("root_distance")) / height
    placed = parsed.join(tops, "tree_index").withColumn(
        "y", F.when(height > 0, clip(raw)).otherwise(F.lit(1.0))).drop("_top")
    if not shift_tips:
        return placed
    tips = placed.where("is_tip").groupBy("tree_index").agg(F.max("y").alias("_tip"))
    return placed.join(tips, "tree_index", "left").withColumn(
        "y", clip(F.col("y") + (F.lit(1.0) - F.coalesce("_tip", F.lit(1.0))))).drop("_tip")


def shifts_tips(path: str, prefixes=SHIFTED_PREFIXES) -> bool:
    """Whether a part of the path starts with one of the configured prefixes."""
    parts = [p.lower() for p in path.replace("\\", "/").split("/") if p]
    return any(part.startswith(p.strip().lower()) for part in parts for p in prefixes if p.strip())


def newick_x(placed: DataFrame, **options) -> DataFrame:
    """Layout x with tips in text order."""
    return layout_x(placed, visit=F.col("sibling"), **options)


def tip_positions(placed: DataFrame, names: DataFrame) -> DataFrame:
    """Tips with exactly one of the given names, per tree."""
    return placed.where("is_tip").join(names.select("name").distinct(), "name", "left_semi")


def require_lengths(parsed: DataFrame) -> DataFrame:
    """Refuse negative or non-finite branch lengths."""
    length = F.col("branch_length")
    bad = F.isnan(length) | (length < 0) | (length == F.lit(float("inf")))
    return parsed.withColumn("branch_length", F.when(bad, F.raise_error(F.concat(
        F.lit("invalid branch length in tree "), F.col("tree_index").cast("string")))
        .cast("double")).otherwise(length))
