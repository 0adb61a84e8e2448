import gzip
import random

import pytest
from pyspark.sql import functions as F

from copse.functions import text as X
from copse.operators import topology as TOP
from copse.operators.compare import edge_differences, request_pairs
from copse.sources import newick as N


def rows_of(spark, *texts, heights=None):
    heights = heights or [None] * len(texts)
    return spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, heights))],
                                 "tree_index long, newick string, max_branch_length string")


def test_ids_follow_post_order_and_sample_order(spark):
    rows = rows_of(spark, "((B:0.1,A:0.2):0.3,C:0.5);")
    order = N.sample_order(rows)
    assert [r.name for r in order.orderBy("sample_id").collect()] == ["A", "B", "C"]
    tree = N.with_sample_ids(N.newick_nodes(rows), order).orderBy("postorder").collect()
    assert [(r.name, r.node_id, r.parent_id) for r in tree] == [
        ("B", 1, 3), ("A", 0, 3), (None, 3, 4), ("C", 2, 4), (None, 4, None)]
    assert [r.root_distance for r in tree] == pytest.approx([0.4, 0.5, 0.3, 0.5, 0])
    based = N.with_sample_ids(N.newick_nodes(rows), order, N.INTERNAL_BASE)
    assert {r.node_id for r in based.where("not is_tip").collect()} == {1_000_000, 1_000_001}
    plain = N.with_postorder_ids(N.newick_nodes(rows))
    assert {(r.node_id, r.parent_id) for r in plain.collect()} == {
        (0, 2), (1, 2), (2, 4), (3, 4), (4, None)}
    with pytest.raises(Exception, match="not among the samples"):
        N.with_sample_ids(N.newick_nodes(rows), order.where("name <> 'C'")).collect()


def test_names_comments_and_bad_text(spark):
    tree = N.newick_nodes(rows_of(spark, " ('a b':1e-1 [x],B)95 : 2 ; ")).collect()
    assert [(r.name, r.branch_length) for r in tree] == [("a b", 0.1), ("B", 0.0), ("95", 2.0)]
    mixed = rows_of(spark, "(A,B);", "((A,B);", "(A,B));", "  ", "(C:x,D);")
    assert N.newick_nodes(mixed, on_error="skip").select("tree_index").distinct().count() == 1
    with pytest.raises(Exception, match="unbalanced"):
        N.newick_nodes(mixed).collect()
    with pytest.raises(Exception, match="invalid branch length"):
        N.require_lengths(N.newick_nodes(rows_of(spark, "(A:-1,B:2);"))).collect()


def test_coordinates(spark):
    rows = rows_of(spark, "((A:0.1,B:0.2):0.3,C:0.5);", heights=[None])
    parsed = N.newick_nodes(rows)
    y = {r.postorder: r.y for r in N.newick_y(parsed, rows, F.lit(0.5)).collect()}
    assert y[4] == pytest.approx(0) and max(y.values()) == pytest.approx(1)
    rows = rows_of(spark, "((A:0.1,B:0.2):0.3,C:0.5);", heights=["0.5"])
    y = {r.postorder: r.y for r in N.newick_y(parsed, rows, F.lit(0.7)).collect()}
    assert y[4] == pytest.approx(1 - 0.5 / 0.7)
    short = rows_of(spark, "((A:0.1,B:0.2):0.3,C:0.5);", heights=["1.0"])
    shifted = {r.postorder: r.y for r in N.newick_y(parsed, short, F.lit(1.0), True).collect()}
    assert shifted[4] == pytest.approx(0.5) and shifted[3] == pytest.approx(1)
    assert {r.y for r in N.newick_y(parsed, rows, F.lit(0.0)).collect()} == {1.0}
    x = {r.node_id: r.x for r in N.newick_x(N.with_postorder_ids(parsed)).collect()}
    assert [x[i] for i in range(5)] == pytest.approx([0, 0.5, 0.25, 1, 0.625])
    moths = ("moths",)
    assert N.shifts_tips("/data/Moths_v2/file.csv", moths) and not N.shifts_tips("/data/human/x.csv", moths)
    assert not N.shifts_tips("/data/Moths_v2/file.csv")
    assert N.with_node_height(parsed).where("name = 'A'").first().node_height == pytest.approx(0.1)


def leaf_distances(nodes, root):
    """{pair of leaf names: path length} by walking the links."""
    near = {}
    for at in N._postorder(nodes, root):
        for child in nodes[at][3]:
            near.setdefault(at, []).append((child, nodes[child][2]))
            near.setdefault(child, []).append((at, nodes[child][2]))
    leaves = [at for at in N._postorder(nodes, root) if not nodes[at][3]]
    out = {}
    for leaf in leaves:
        seen, todo = {leaf: 0.0}, [leaf]
        while todo:
            at = todo.pop()
            for nxt, d in near.get(at, []):
                if nxt not in seen:
                    seen[nxt] = seen[at] + d
                    todo.append(nxt)
        for other in leaves:
            out[frozenset((nodes[leaf][1], nodes[other][1]))] = seen[other]
    return out


def random_text(rnd, names):
    if len(names) == 1:
        return f"{names[0]}:{rnd.randint(1, 9)}"
    cuts = sorted(rnd.sample(range(1, len(names)), min(len(names) - 1, rnd.choice([1, 1, 2]))))
    parts = [names[a:b] for a, b in zip([0, *cuts], [*cuts, len(names)])]
    return "(" + ",".join(random_text(rnd, p) for p in parts) + f"):{rnd.randint(1, 9)}"


@pytest.mark.parametrize("seed", range(12))
def test_outgroup_removal_keeps_the_rest(seed):
    rnd = random.Random(seed)
    names = [*"ABCDEFG"[:rnd.randint(2, 7)], "Etal"]
    rnd.shuffle(names)
    text = random_text(rnd, names) + ";"
    before = N.parse_newick(text)
    after = N.parse_newick(text)
    root = N.drop_outgroup(after, "etal")
    old, new = leaf_distances(before, 0), leaf_distances(after, root)
    assert {n for pair in new for n in pair} == set(names) - {"Etal"}
    # Lengths between leaves whose path avoids the cleared branch are unchanged.
    assert all(new[p] <= old[p] + 1e-9 for p in new)
    assert after[root][2] == 0 and all(after[c][2] == 0 for c in after[root][3])
    order = N._postorder(after, root)
    assert len(order) == len(set(order))


def test_outgroup_absent_or_present(spark):
    rows = rows_of(spark, "((Etal:0.1,A:0.2):0.3,B:0.4);", "(A:1,B:1);")
    names = N.newick_nodes(rows).where("is_tip").groupBy("tree_index").agg(
        F.sort_array(F.collect_list("name")).alias("n")).collect()
    assert {r.tree_index: r.n for r in names} == {0: ["A", "B"], 1: ["A", "B"]}
    kept = N.newick_nodes(rows, outgroup=None).where("name = 'Etal'").count()
    assert kept == 1


CSV = """genomic_positions,newick,max_branch_length,tree info,samples
2000,"((B:.1,C:.2):.3,A:.4);",,r2,
0,"((A:.1,B:.2):.3,C:.4);",0.5,r0,
1000,"((A:.1,C:.2):.3,B:.4);",bad,,
1000,"((A:.1,C:.2):.3,B:.4);",0.9,dup,
,,,,C
,,,,A
,,,,B
,,,,A
,,,,etal
"""


def test_csv_collection(spark, tmp_path):
    path = tmp_path / "trees.csv"
    path.write_text(CSV)
    raw = N.read_csv(spark, str(path))
    rows = N.tree_rows(raw)
    got = [(r.tree_index, r.position, r.tree_info) for r in rows.orderBy("tree_index").collect()]
    assert got == [(0, 0, "r0"), (1, 1000, None), (2, 1000, "dup"), (3, 2000, "r2")]
    meta = N.file_metadata(raw)
    assert sorted(r.value for r in meta.collect()) == ["A", "A", "B", "C", "etal"]
    order = N.sample_order(rows, meta).orderBy("sample_id").collect()
    assert [r.name for r in order] == ["C", "A", "B"]
    assert N.global_height(rows).first().height == 0.9
    assert N.global_height(rows.withColumn("max_branch_length", F.lit("x"))).first().height == 0.4
    assert {r.tree_index for r in N.tree_info(rows).collect()} == {0, 2, 3}
    placed = N.newick_x(N.with_sample_ids(N.newick_nodes(rows), N.sample_order(rows)))
    assert placed.count() == 20
    pairs = request_pairs(rows, [0, 1, 3], 4)
    edges = placed.where("parent_id is not null").select(
        "tree_index", F.col("parent_id").alias("parent"), F.col("node_id").alias("child"))
    assert {r.pair for r in edge_differences(edges, pairs).collect()} == {0, 1}


def test_csv_refusals(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,parent,left,right,time\n1,2,0,1,3\n")
    with pytest.raises(ValueError, match="missing required"):
        N.read_csv(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("genomic_positions,newick\nhere,(A,B);\n")
    with pytest.raises(Exception, match="not a number"):
        N.tree_rows(N.read_csv(spark, str(tmp_path / "b.csv"))).collect()
    (tmp_path / "c.csv").write_text("genomic_positions,newick\n")
    with pytest.raises(ValueError, match="no rows"):
        N.tree_rows(N.read_csv(spark, str(tmp_path / "c.csv")))


def test_paired_lines(spark, tmp_path):
    def pair(trees, positions):
        t, p = tmp_path / "t.nwk.gz", tmp_path / "p.txt.gz"
        for path, lines in ((t, trees), (p, positions)):
            with gzip.open(path, "wt") as out:
                out.write("".join(f"{line}\n" for line in lines))
        return N.read_paired(spark, str(t), str(p))

    got = pair(["(A,B);", "(B,A);", "(A,(B,C));"], [5, 70, 100]).orderBy("tree_index").collect()
    assert [(r.left, r.right) for r in got] == [(5, 70), (70, 100), (100, 10_100)]
    assert got[2].newick == "(A,(B,C));"
    for trees, positions, problem in (
            (["(A);"] * 2, [5, 5], "not increasing"), (["(A);"] * 2, [5, "x"], "whole numbers"),
            (["(A);"] * 2, [5, ""], "blank"), (["(A);", " "], [5, 6], "blank"),
            (["(A);"] * 3, [5, 6], "3 trees and 2")):
        with pytest.raises(ValueError, match=problem):
            pair(trees, positions)


def test_windows(spark, tmp_path):
    path = tmp_path / "w.tsv"
    path.write_text("chr2_3\t(A:1,B:2);\nchr2_1\t(A:3,B:1);\n\nchr2_2\t(B:1,A:2);\nchr2_6\t(A:1,D:2);\nZ_un_1\t\n")
    with pytest.raises(Exception, match="bad window id"):
        N.read_windows(spark, str(path)).collect()
    path.write_text(path.read_text().replace("Z_un_1", "Z_1"))
    rows = N.read_windows(spark, str(path))
    assert {(r.chrom, r.idx): (r.start, r.end) for r in rows.collect()} == {
        ("chr2", 1): (0, 50_000), ("chr2", 2): (50_000, 100_000), ("chr2", 3): (100_000, 150_000),
        ("chr2", 6): (250_000, 300_000), ("Z", 1): (0, 50_000)}
    runs = TOP.topology_runs(TOP.shape_keys(rows.where("chrom = 'chr2'"))).orderBy("run_id").collect()
    assert [(r.start_idx, r.n_rows, r.topology) for r in runs] == [
        (1, 1, "(A,B);"), (2, 1, "(B,A);"), (3, 1, "(A,B);"), (6, 1, "(A,D);")]
    gaps = {r.idx: r.after_gap for r in TOP.with_gaps(rows.where("chrom = 'chr2'")).collect()}
    assert gaps == {1: False, 2: False, 3: False, 6: True}
    chr2 = rows.where("chrom = 'chr2'")
    down = TOP.samples_down_rows(TOP.with_gaps(chr2, True), TOP.first_seen_samples(chr2))
    assert [(r.idx, r.samples) for r in down.orderBy("idx").collect()] == [(1, "A"), (2, "B"), (3, "D")]


def test_topologies(spark):
    rows = rows_of(spark, "((A:1,B:2):3,Etal:4);", "((B,A),Etal);", "((A,C),Etal);",
                   heights=["0.4", "0.8", "0.6"])
    keyed = TOP.topology_keys(rows)
    ranked = TOP.ranked_topologies(keyed).orderBy("tree_index").collect()
    assert [(r.topology, r.topology_rank, r.length_share) for r in ranked] == [
        ("(A,B)", 0, 0.0), ("(A,B)", 0, 1.0), ("(A,C)", 1, 0.5)]
    assert tuple(TOP.topology_summary(keyed, F.lit(True)).first()) == (3, 2, 3)
    same = TOP.topology_keys(rows_of(spark, "((C,(B,A)),D);", "(D,((A,B)x:1,C));", "((((A,B)),C),D);"))
    assert {r.topology for r in same.collect()} == {"((((A,B),C),D)"[1:]}


def test_text_functions(spark):
    df = spark.createDataFrame([("((s_1:1.5,B.2:2)95:100,C);",)], "t string")
    r = df.select(X.labels(F.col("t")).alias("labels"), X.leaf_names(F.col("t")).alias("leaves"),
                  X.longest_edge(F.col("t")).alias("longest"), X.shape_key(F.col("t")).alias("key")).first()
    assert r.labels == ["s_1", "B.2"] and r.leaves == ["s_1", "B.2", "C"] and r.longest == 100.0
    # Both patterns read text, not trees: the tail of 2e-3 looks like a name.
    odd = spark.createDataFrame([("(A:2e-3,B:1E2);",)], "t string").select(
        X.leaf_names(F.col("t")).alias("n"), X.longest_edge(F.col("t")).alias("l")).first()
    assert odd.n == ["A", "e-3", "B", "E2"] and odd.l == 100.0


def test_quotes_and_broken_texts():
    parse = lambda text: [n[1:3] for n in N.parse_newick(text)]
    assert parse("('it''s':1,b c:2)r;") == [["r", 0.0], ["it's", 1.0], ["b c", 2.0]]
    assert parse("('':1,''''[note]:2,a'b'c:3);") == [["", 0.0], ["", 1.0], ["'", 2.0], ["abc", 3.0]]
    assert parse("(a[x:1,(]:1,[b]b:2.5e-1);") == [["", 0.0], ["a", 1.0], ["b", 0.25]]
    for text in ("(a,b", "a,b)", "((a,b);"):
        with pytest.raises(ValueError):
            N.parse_newick(text)


def test_few_names_are_sent_to_the_nodes(spark):
    rows = spark.createDataFrame([(0, "((A:1,B:1)1:1,C:2);"), (1, "(A:1,C:1)1;")], "tree_index long, newick string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # as for a large table
    try:
        placed = N.with_sample_ids(N.newick_nodes(rows), N.sample_order(rows))
        plan = placed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {(r.tree_index, r.name, r.node_id) for r in placed.where("is_tip").collect()} == {
        (0, "A", 0), (0, "B", 1), (0, "C", 2), (1, "A", 0), (1, "C", 2)}
