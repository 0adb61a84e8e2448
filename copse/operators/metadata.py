"""Sample metadata: precedence of sources, search, encoding, posting lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copse.functions import json as J
from copse.operators.ordered import global_rank
from copse.operators.blocks import cover, holding

SOURCES = ("individual", "node", "population")
LIST_CHUNK = 65_536


def samples_with_metadata(nodes: DataFrame, individuals: DataFrame,
                          populations: DataFrame) -> DataFrame:
    """Samples with their name and one map per source
    ``(node_id, name, individual_meta, node_meta, population_meta)``."""
    samples = nodes.where(F.col("flags").bitwiseAND(1) == 1).select(
        F.col("id").alias("node_id"), "individual", "population",
        J.decode(F.col("metadata_json")).alias("node_meta"))
    of = lambda df, key, name: df.select(
        F.col("id").alias(key), J.decode(F.col("metadata_json")).alias(name))
    # Parquet files are many times smaller than their rows; without the hint all individuals are sent to the driver.
    return (samples
            .join(of(individuals, "individual", "individual_meta").hint("merge"), "individual", "left")
            .join(of(populations, "population", "population_meta"), "population", "left")
            .select("node_id", sample_name().alias("name"), "individual_meta", "node_meta",
                    "population_meta"))


def sample_name() -> Column:
    """``name`` of the node metadata, else the node id."""
    return F.coalesce(F.col("node_meta")["name"], F.col("node_id").cast("string"))


def value_of(key: str, sources=SOURCES) -> Column:
    """Value of a key; the first source that has the key wins, even with null."""
    if key == "sample":
        return F.col("name")
    unknown = set(sources) - set(SOURCES)
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    choice = F.lit(None).cast("string")
    for source in reversed(list(sources)):
        meta = F.col(f"{source}_meta")
        choice = F.when(F.coalesce(F.map_contains_key(meta, key), F.lit(False)),
                        meta[key]).otherwise(choice)
    return choice


def sample_values(samples: DataFrame, key: str, sources=SOURCES) -> DataFrame:
    """``(node_id, name, value)``; NULL where no source has a value."""
    return samples.select("node_id", "name", value_of(key, sources).alias("value"))


def search_samples(samples: DataFrame, key: str, value, sources=SOURCES) -> DataFrame:
    """Samples whose value equals ``value`` as text."""
    return sample_values(samples, key, sources).where(F.col("value") == F.lit(str(value)))


def metadata_keys(nodes: DataFrame, individuals: DataFrame, populations: DataFrame,
                  sample_rows: int | None = None) -> DataFrame:
    """``(source, key)`` over all rows, or the first ``sample_rows`` non-empty ones."""
    out = None
    frames = {"individual": individuals,
              "node": nodes.where(F.col("flags").bitwiseAND(1) == 1), "population": populations}
    for source, df in frames.items():
        keys = F.map_keys(J.decode(F.col("metadata_json")))
        if sample_rows is not None:
            df = df.where(F.size(keys) > 0).orderBy("id").limit(sample_rows)
        found = df.select(F.lit(source).alias("source"), F.explode(keys).alias("key")).distinct()
        out = found if out is None else out.unionByName(found)
    return out


def key_menu(keys: DataFrame) -> DataFrame:
    """All keys in menu order: ``sample`` first, the rest sorted: ``(rank, key)``."""
    rest = keys.select("key").where(F.col("key") != "sample").distinct()
    ranked = global_rank(rest, "key", out="rank").select((F.col("rank") + 1).alias("rank"), "key")
    first = keys.sparkSession.range(1).select(F.col("id").alias("rank"),
                                              F.lit("sample").alias("key"))
    return first.unionByName(ranked)


def encode(values: DataFrame) -> DataFrame:
    """Dictionary code per sample, codes in first-seen (node id) order.

    ``(node_id, value, code)``; missing values are encoded as ``""``. Ranking
    runs over distinct values only.
    """
    text = values.select("node_id", F.coalesce("value", F.lit("")).alias("value"))
    first = text.groupBy("value").agg(F.min("node_id").alias("first_node"))
    codes = global_rank(first, "first_node", out="code").drop("first_node")
    return text.join(codes, "value").select("node_id", "value", "code")


def posting_lists(values: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """value -> samples: ``(value, chunk, n, node_ids)``.

    Missing values have no list; an explicit ``""`` has one. A chunk covers
    ``chunk`` consecutive node ids, so a value shared by a third of all samples
    becomes many bounded lists.
    """
    return values.where(F.col("value").isNotNull()).groupBy(
        "value", F.floor(F.col("node_id") / F.lit(chunk)).cast("long").alias("chunk")
    ).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("node_id")).alias("node_ids"))


def metadata_rows(samples: DataFrame) -> DataFrame:
    """Long inverted index ``(source, key, value, node_id, name)``."""
    each = F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"{s}_meta").alias("m"))
                     for s in SOURCES])
    flat = samples.select("node_id", "name", F.explode(each).alias("e"))
    return flat.select("node_id", "name", "e.source", F.explode("e.m").alias("key", "value")
                       ).select("source", "key", "value", "node_id", "name")


def metadata_index(rows: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """Inverted index with bounded lists
    ``(source, key, value, chunk, sample_node_ids, sample_names)``."""
    pair = F.struct("node_id", "name")
    grouped = rows.groupBy("source", "key", "value",
                           F.floor(F.col("node_id") / F.lit(chunk)).cast("long").alias("chunk")
                           ).agg(F.array_sort(F.collect_list(pair)).alias("_p"))
    return grouped.select(
        "source", "key", "value", "chunk",
        F.transform("_p", lambda p: p["node_id"]).alias("sample_node_ids"),
        F.transform("_p", lambda p: p["name"]).alias("sample_names"))


def values_from_rows(rows: DataFrame, key: str, sources=SOURCES) -> DataFrame:
    """Value per sample read from the inverted index, same precedence."""
    rank = F.lit(None).cast("int")
    for i, source in enumerate(sources):
        rank = F.when(F.col("source") == source, F.lit(i)).otherwise(rank)
    picked = rows.where(F.col("key") == key).withColumn("_rank", rank).where(
        F.col("_rank").isNotNull())
    best = picked.groupBy("node_id").agg(F.min(F.struct("_rank", "value")).alias("_b"))
    return best.select("node_id", F.col("_b.value").alias("value"))


def name_index(samples: DataFrame) -> DataFrame:
    """``(normalized_name, display_name, node_id)``."""
    return samples.select(F.lower("name").alias("normalized_name"),
                          F.col("name").alias("display_name"), "node_id")


def names_containing(index: DataFrame, query: str) -> DataFrame:
    """Samples whose name contains the text, ignoring case."""
    return index.where(F.contains(F.col("normalized_name"), F.lit(query.lower()))).select(
        "node_id", F.col("display_name").alias("name"))


def name_lookup(index: DataFrame) -> DataFrame:
    """Name -> node; of equal names the later node wins."""
    return index.groupBy("normalized_name").agg(F.max("node_id").alias("node_id"))


def find_names(index: DataFrame, names: DataFrame) -> DataFrame:
    """Requested names (column ``name`` and extras) with their node."""
    asked = names.withColumn("normalized_name", F.lower("name"))
    return asked.join(name_lookup(index).hint("merge"), "normalized_name").drop("normalized_name")


def positions_of(hits: DataFrame, placed: DataFrame) -> DataFrame:
    """Place matching samples in the trees they are members of."""
    return hits.join(placed.select("tree_index", "node_id", "x", "y"), "node_id")


def multi_value_hits(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """Samples per requested value (column ``value``, repeats ignored).

    Values nobody has stay as one row with a NULL node.
    """
    asked = wanted.select(F.col("value").cast("string").alias("value")).distinct()
    return asked.join(values.select("value", "node_id"), "value", "left")


def trees_of_nodes(ranges: DataFrame, hits: DataFrame, trees: DataFrame) -> DataFrame:
    """Requested trees that hold at least one of the nodes, from membership runs.

    Runs of the hit nodes are cut into blocks of trees, the same blocks of
    several nodes become one, and a tree asks for the few blocks that hold it:
    no run is ever made into its trees.
    """
    near = ranges.join(hits.select("node_id").distinct(), "node_id", "left_semi")
    held = near.select(F.inline(cover(F.col("first_tree"), F.col("last_tree")))).distinct()
    asked = trees.select("tree_index", F.inline(holding(F.col("tree_index")))).distinct()
    found = asked.join(held, ["level", "block"], "left_semi").select("tree_index").distinct()
    return trees.select("tree_index").join(found, "tree_index", "left_semi")


def values_matching(values: DataFrame, text: str | None) -> DataFrame:
    """Distinct values containing the text, ignoring case and outer blanks."""
    distinct = values.select("value").where(F.col("value").isNotNull()).distinct()
    term = (text or "").strip().lower()
    if not term:
        return distinct
    return distinct.where(F.contains(F.lower("value"), F.lit(term)))


def tip_labels(tips: DataFrame, values: DataFrame, enabled: DataFrame | None = None,
               default: str = "other") -> DataFrame:
    """Value of the chosen key per tip; the default for unknown or disabled values."""
    out = tips.join(values.select("node_id", F.col("value").alias("label")), "node_id", "left")
    if enabled is not None:
        on = enabled.select(F.col("value").alias("label"), F.lit(True).alias("_on")).distinct()
        out = out.join(on, "label", "left").withColumn(
            "label", F.when(F.col("_on"), F.col("label"))).drop("_on")
    return out.withColumn("label", F.coalesce("label", F.lit(default)))


def presets_for(presets: DataFrame, project: str, filename: str) -> DataFrame:
    """Saved presets of exactly this project and file."""
    return presets.where((F.col("project") == project) & (F.col("filename") == filename))
