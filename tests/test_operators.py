import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspan.functions import recode as R, sequence as Q
from regspan.operators import (corpus as K, crossgroup as X, evaluation as E, itemsets as M, joint as J, presence as P,
                               sequence as G, sets as S, tf as T)
from regspan.sources import bed as B, tables as TB
from regspan.streaming.incremental import incr_new_cells, read_counts, write_delta


def values(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "x string")


def test_recode_order(spark):
    cases = {"Enhancer_blocking;enhancer": "insulator", "promoter;uncharacterized": "uncharacterized",
             "gene_body;promoter": "promoter", "silencer;enhancer": "enhancer", "gene_body": "gene_body",
             "gene_body;response_element": "gene_body", "tata_box": "other_regulatory"}
    got = {r.x: r.t for r in values(spark, cases).select("x", R.recode_simplify_type("x").alias("t")).collect()}
    assert got == cases


def test_regulome_labels(spark):
    cases = {"Enhancer": "enhancer", "PROTEIN_BIND_7": "TFBS", "cage_cluster": "other_regulatory",
             "transcriptional_cis_regulatory_region": "cis_regulatory", "odd": "other_regulatory"}
    got = {r.x: r.t for r in values(spark, cases).select("x", R.recode_regulome("x").alias("t")).collect()}
    assert got == cases


def test_groups(spark):
    rows = [("ITL23_rows_part7", "s", "ITL23"), ("MBGA", "CTXMIX", "CTXMIX"), ("MBGA", "MDGA", None), ("VIP", "s", "VIP"),
            ("AMY_rows", "s", "AMY"), ("new", "s", None), ("cspmei_ASCT_rows_part1", "s", "ASCT")]
    df = spark.createDataFrame(rows, "source string, subtype string, want string")
    assert df.where(~R.recode_group("source", "subtype").eqNullSafe(F.col("want"))).count() == 0


def test_chrom_codes(spark):
    cases = {"chr1": 1, "chr22": 22, "chrX": 23, "chrY": 24, "chrM": 25, "chr23": 0, "chr01": 0, "GL000": 0}
    got = {r.x: r.c for r in values(spark, cases).select("x", R.chrom_code("x").alias("c")).collect()}
    assert got == cases


def test_regulatory_filters_differ_on_compounds(spark):
    df = spark.createDataFrame([("gene_body",), ("gene_body;response_element",), ("promoter",)], "region_type string")
    assert {r[0] for r in P.filter_regulatory_multi(df).collect()} == {"promoter"}
    assert {r[0] for r in P.filter_regulatory_single(df).collect()} == {"gene_body;response_element", "promoter"}


def test_source_map_names_blank_types(spark):
    base = spark.createDataFrame([("c1",)], "cell_id string")
    reg = spark.createDataFrame([("c1", " "), ("c2", "nan"), ("c3", "None"), ("c4", None), ("c5", " silencer ")],
                                "cell_id string, regulome_type string")
    got = TB.scan_source_map(base, base, base, reg, base)
    assert Counter(r.tag for r in got.collect()) == Counter(
        {"regulome": 4, "silencer": 1, "enhancer": 1, "gene_body": 1, "promoter": 1, "uncharacterized": 1})


def test_chromosome_names_with_underscore(spark):
    got = [r[0] for r in values(spark, ["Chr_10", "chr10", "Chr10"]).select(R.fix_chrom("x")).collect()]
    assert got == ["chr10", "chr10", "Chr10"]


def test_cell_and_sample_from_path(spark):
    paths = ["/a/VIP_sorted_scBAMs_merged_beds/sub1/MM_429_D12_ACGT_BD_merged.bed", "/a/X_sorted_y/s/S7_q.csv"]
    df = B.scan_path_columns(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert [(r.grp, r.subtype, r.cell, r.sample) for r in df] == [
        ("VIP", "sub1", "MM_429_D12_ACGT", "MM_429"), ("X", "s", "S7_q", "S7")]


def counts(spark):
    cells = [("g", "s1", i) for i in range(4)] + [("g", "s2", i) for i in range(4, 9)] + [("g", "s3", 9)]
    rows = [("g", "s1", i, "chr1", 10, 20, "enhancer") for i in range(3)] + [("g", "s1", 0, "chr1", 10, 20, "gene_body")]
    rows += [("g", "s2", 5, "chr1", 10, 20, "enhancer"), ("g", "s2", 5, "chr2", 1, 2, "promoter")]
    sizes = P.group_sizes(spark.createDataFrame(cells, "grp string, subtype string, cell_id long"))
    tags = spark.createDataFrame(rows, "grp string, subtype string, cell_id long, chrom string, r_start long, r_end long, tag string")
    return P.agg_presence_counts(tags, sizes), sizes


def test_presence_counts_a_cell_once_and_unites_tags(spark):
    c, _ = counts(spark)
    got = {(r.subtype, r.chrom): (r.cnt, r.global_count, r.n_cells, r.region_type) for r in c.collect()}
    assert got == {("s1", "chr1"): (3, 4, 4, "enhancer;gene_body"), ("s2", "chr1"): (1, 4, 5, "enhancer;gene_body"),
                   ("s2", "chr2"): (1, 1, 5, "promoter")}


def test_metrics_fill_absent_subtypes_with_zero(spark):
    c, sizes = counts(spark)
    got = {r.chrom: r for r in P.agg_pct_metrics(c, sizes).collect()}
    assert got["chr1"].max_pct == 75 and got["chr1"].min_pct == 0 and got["chr1"].max_subtype == "s1"
    assert got["chr1"].exclusive_subtype == "" and got["chr2"].exclusive_subtype == "s2"
    assert math.isclose(got["chr2"].log2fc, math.log2(20.1 / 0.1))
    assert math.isclose(got["chr1"].mean_pct, (75 + 20) / 3)


def test_jaccard_is_symmetric_with_full_diagonal(spark):
    c, _ = counts(spark)
    got = {(r.a, r.b): r.jaccard_pct for r in P.sim_jaccard_subtypes(c).collect()}
    assert got == {("s1", "s1"): 100.0, ("s2", "s2"): 100.0, ("s1", "s2"): 50.0}


def test_jaccard_between_cells_any_block_size(spark):
    rng = np.random.default_rng(0)
    rows = [("t", int(c), "chr1", int(r), int(r) + 5) for c in range(40) for r in rng.integers(0, 30, 8)]
    rows += [("t", c, "chr1", 999, 1000) for c in range(0, 40, 3)]  # a region held by a third of all cells
    df = spark.createDataFrame(rows, "subtype string, cell_id long, chrom string, r_start long, r_end long")
    held = {}
    for _, c, _, r, _ in rows:
        held.setdefault(c, set()).add(r)
    want = {(a, b): len(held[a] & held[b]) * 100 / len(held[a] | held[b])
            for a, b in combinations(sorted(held), 2) if held[a] & held[b]}
    for block, shard in ((256, 8192), (7, 2)):
        got = {(r.cell_a, r.cell_b): r.jaccard_pct for r in S.sim_jaccard_cells(df, "subtype", block, shard).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k]) for k in want)


def tf_table(spark, n=60, k=6, seed=0):
    rng = np.random.default_rng(seed)
    m = np.round(rng.uniform(0, 1, (n, k)) * (rng.uniform(0, 1, (n, k)) < 0.6), 1) * 10
    rows = [("g", f"s{i % 3}", i, f"TF{j}_MA{j}", float(m[i, j])) for i in range(n) for j in range(k) if m[i, j] > 0 or j == 0]
    return spark.createDataFrame(rows, "grp string, subtype string, nucleus long, tf string, pct double"), m


def dense_ranks(m):
    return np.array([[(row > v).sum() + ((row == v).sum() + 1) / 2 for v in row] for row in m])


def test_tf_ranks_and_spread_match_the_dense_matrix(spark):
    df, m = tf_table(spark)
    r = dense_ranks(m)
    got = {(x.nucleus, x.tf): x.rank for x in T.win_rank_within_nucleus(df).collect()}
    assert len(got) == m.size and all(got[(i, f"TF{j}_MA{j}")] == r[i, j] for i in range(len(m)) for j in range(m.shape[1]))
    for x in T.win_divergence(df).collect():
        sel = r[int(x.subtype[1])::3, int(x.tf_short[2:])]
        assert math.isclose(x.divergence_std, sel.std(ddof=1), rel_tol=1e-9) and math.isclose(x.mean_rank, sel.mean())


def test_permuted_labels_keep_sizes(spark):
    df, _ = tf_table(spark)
    nuclei = df.select("grp", "subtype", "nucleus").distinct()
    got = T.permuted_labels(nuclei, 5, 3)
    rows = [r.labels for r in got.collect()]
    assert len(rows) == 60 and all(Counter(column) == Counter({0: 20, 1: 20, 2: 20}) for column in zip(*rows))
    again = T.permuted_labels(nuclei.repartition(3), 5, 3)
    assert again.exceptAll(got).count() == 0  # not a matter of partitioning


def test_permutation_p_values(spark, monkeypatch):
    df, m = tf_table(spark)
    r = np.array([[sum(row > x) + (sum(row == x) + 1) / 2 for x in row] for row in m])
    labels = {x.nucleus: x.labels for x in T.permuted_labels(df.select("grp", "subtype", "nucleus").distinct(), 30, 2).collect()}
    by_perm = np.array([labels[i] for i in range(len(m))]).T
    t = np.array([np.std([r[row == k].std(axis=0, ddof=1) for k in range(3)], axis=0, ddof=1) for row in by_perm])
    for held in (T.NUCLEI_HELD, 7):  # one block, and blocks and hash buckets of few nuclei
        monkeypatch.setattr(T, "NUCLEI_HELD", held)
        got = T.test_permutation(df, perms=30, seed=2).collect()
        assert len(got) == 6
        for x in got:
            own = t[:, int(x.tf[2:].split("_")[0])]
            assert x.n_ge == (own[1:] >= own[0] - 1e-9).sum() and math.isclose(x.t_obs, own[0], rel_tol=1e-9)
            assert math.isclose(x.perm_p, (x.n_ge + 1) / 31) and x.perm_fdr >= x.perm_p - 1e-12


def test_itemsets_match_counting(spark):
    df, m = tf_table(spark, 120, 7, 5)
    got = {(r.subtype, r.size, frozenset(r.tfs.split(" + "))): r.support_count for r in M.fim_cozero(df).collect()}
    want = {}
    for s in range(3):
        z = m[s::3] == 0
        n = len(z)
        low = max(10, round(0.02 * n))
        use = [j for j in range(m.shape[1]) if 0.05 <= z[:, j].mean() <= 0.95]
        for size in (1, 2, 3):
            for c in combinations(use, size):
                k = int(z[:, list(c)].all(axis=1).sum())
                if k >= low:
                    want[(f"s{s}", size, frozenset(f"TF{j}" for j in c))] = k
    assert got == want


def test_sparse_spearman_is_the_dense_one(spark):
    rng = np.random.default_rng(1)
    m = np.round(rng.uniform(0, 5, (4, 30)) * (rng.uniform(0, 1, (4, 30)) < 0.5), 1)
    m = np.vstack([m, np.zeros(30)])
    rows = [(f"m{i}", f"r{j}", float(m[i, j])) for i in range(5) for j in range(30) if m[i, j] > 0]
    v = spark.createDataFrame(rows, "member string, region_id string, pct double")
    members = spark.createDataFrame([(f"m{i}",) for i in range(5)], "member string")
    got = {(r.a, r.b): r.divergence for r in X.div_spearman(v, members, 30).collect()}
    rk = np.array([[(row < x).sum() + ((row == x).sum() + 1) / 2 for x in row] for row in m])
    for a, b in combinations(range(5), 2):
        if b == 4:
            assert got[(f"m{a}", "m4")] is None
        else:
            assert math.isclose(got[(f"m{a}", f"m{b}")], 1 - np.corrcoef(rk[a], rk[b])[0, 1], rel_tol=1e-9, abs_tol=1e-12)
    flat = {(r.a, r.b): r.divergence for r in X.div_spearman(v, members, 30, undefined_as_zero=True).collect()}
    assert flat[("m0", "m4")] == 1.0


def test_pca_matches_the_svd(spark):
    rng = np.random.default_rng(2)
    m = rng.uniform(0, 5, (5, 40))
    rows = [(f"m{i}", f"r{j}", float(m[i, j])) for i in range(5) for j in range(40)]
    prof = spark.createDataFrame(rows, "member string, region_id string, pct double")
    got = {r.member: (r.pc1, r.pc2) for r in X.reduce_pca(prof, prof.select("member")).collect()}
    u, s, _ = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    co = u[:, :2] * s[:2]
    for j in range(2):
        mine = np.array([got[f"m{i}"][j] for i in range(5)])
        assert np.allclose(mine, co[:, j]) or np.allclose(mine, -co[:, j])
        assert mine[np.abs(mine).argmax()] > 0


def test_pca_without_products_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(12)
    m = rng.uniform(0, 9, (9, 3)) @ rng.uniform(0, 1, (3, 40)) + rng.uniform(0, 0.1, (9, 40))
    rows = [(f"m{i}", f"r{j}", float(m[i, j])) for i in range(9) for j in range(40)]
    prof = spark.createDataFrame(rows, "member string, region_id string, pct double").repartition(3)
    whole = {r.member: r for r in X.reduce_pca(prof, prof.select("member"), 9).collect()}
    total = sum(r[c] ** 2 for r in whole.values() for c in r.__fields__[1:])
    assert math.isclose(total, ((m - m.mean(axis=0)) ** 2).sum(), rel_tol=1e-9)
    for r in X.pca_distances(spark.createDataFrame([*whole.values()])).collect():
        assert math.isclose(r.distance2, ((m[int(r.a[1:])] - m[int(r.b[1:])]) ** 2).sum(), rel_tol=1e-9)
    monkeypatch.setattr(X, "GRAM_MEMBERS", 4)
    for r in X.reduce_pca(prof, prof.select("member"), 2).collect():
        assert np.allclose((r.pc1, r.pc2), (whole[r.member].pc1, whole[r.member].pc2), atol=1e-5)


def test_consensus_ties_and_rebinning(spark):
    rows = [("g", "s", 1, "chr1", 0, 200, 0.9, 0.1, 1, "enhancer"), ("g", "s", 1, "chr1", 300, 500, 0.1, 0.9, 2, "silencer"),
            ("g", "s", 2, "chr1", 100, 1700, 0.1, 0.1, 3, "neither")]
    p = spark.createDataFrame(rows, "grp string, subtype string, cell_id long, chrom string, peak_start long, peak_end long, "
                                    "p_enhancer double, p_silencer double, n_tfs long, category string")
    sizes = P.group_sizes(p.select("grp", "subtype", "cell_id"))
    loci = J.agg_bin_consensus(p, sizes)
    r = loci.collect()
    assert len(r) == 1 and r[0].n_cells == 2 and r[0].consensus_category == "enhancer" and (r[0].r_start, r[0].r_end) == (0, 1700)
    assert math.isclose(r[0].mean_p_enhancer, 1.1 / 3) and math.isclose(r[0].pct, 100)
    assert J.agg_novel_merge(loci, sizes, "max", 3).count() == 0
    assert J.agg_novel_merge(loci, sizes, "max", 2).first().region_class == "novel|enhancer"


def test_sequence_windows(spark):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("acgtN"), 3000))
    genome = spark.createDataFrame([("c", text), ("short", "ACGT" * 30)], "chrom string, seq string")
    at = [("c", s, s + 100) for s in (0, 10, 206, 500, 974, 1024, 2500, 2990)] + [("short", 0, 10)]
    peaks = spark.createDataFrame(at, "chrom string, peak_start long, peak_end long")
    full = {"c": text, "short": "ACGT" * 30}
    for tile in (512, 1000, 65536):
        got = {(r.chrom, r.peak_start): r.sequence
               for r in G.seq_window(peaks, G.tile_genome(genome, tile), tile=tile).collect()}
        for c, s, e in at:
            left = (s + e) // 2 - 256
            want = full[c][max(0, left):max(0, min(len(full[c]), left + 512))].upper()
            assert got[(c, s)] == want + "N" * (512 - len(want))


def test_kmers_and_codes(spark):
    df = spark.createDataFrame([("a", "ACGTNACG"), ("b", "ACG")], "k string, s string")
    got = {(r.k, r.kmer): r.freq for r in G.seq_kmer(df, ["k"], "s", 6).collect()}
    assert got == {("a", "ACGTAA"): 1 / 3, ("a", "CGTAAC"): 1 / 3, ("a", "GTAACG"): 1 / 3}
    r = df.select(Q.seq_base_codes("s").alias("c"), Q.seq_revcomp("s").alias("r")).first()
    assert list(r.c) == [0, 1, 2, 3, 255, 0, 1, 2] and r.r == "CGTNACGT"


def test_balanced_sample_draws_every_class(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = E.sample_balanced(df, "label", ["id"], 600, 4).collect()
    by = Counter(r.label for r in got)
    assert len(got) == 600 and abs(by["small"] - 300) < 80
    assert len({r.id for r in got if r.label == "small"}) == 40
    assert all((r.id % 10 == 0) == (r.label == "small") for r in got)


def test_loco_folds_cover_all_chromosomes():
    f = E.loco_folds()
    assert len(f) == 23 and f["chr1"] == 0 and f["chrX"] == 7 and f["chr8"] == 8 and f["chr10"] == 0


def test_priority_label(spark):
    rows = [("chr1", 1, 2, "TF1", 1.0, 0.5, x) for x in ("genic", "TFBS", "silencer")] + [
        ("chr1", 1, 2, "TF2", 3.0, None, "genic"), ("chr2", 1, 2, "TF1", 1.0, 0.5, "genic")]
    df = spark.createDataFrame(rows, "chrom string, peak_start long, peak_end long, tf_motif string, motif_score double, "
                                     "fp_score double, label string")
    got = {r.chrom: r for r in K.agg_peak_corpus(df).collect()}
    assert got["chr1"].primary_label == "silencer" and got["chr1"].n_tfs == 2 and got["chr1"].mean_motif_score == 1.5
    assert got["chr1"].mean_fp_score == 0.5 and got["chr2"].primary_label == "genic"


def test_results_do_not_depend_on_partitions(spark):
    df, _ = tf_table(spark)
    a, b = (sorted(map(str, T.win_divergence(x).drop("cv").select(
        "subtype", "tf", F.round("divergence_std", 9), F.round("mean_rank", 9)).collect())) for x in (
        df.coalesce(1), df.repartition(13)))
    assert a == b


def test_stream_counts_each_cell_once(spark, tmp_path):
    rows = [("s", c, "chr1", 1, 2) for c in range(5)]
    schema = "subtype string, cell_id long, chrom string, r_start long, r_end long"
    src, table, log = (str(tmp_path / x) for x in ("in", "table", "log"))
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(src)
    kind = spark.createDataFrame(rows, schema).schema
    incr_new_cells(spark, src, kind, table, log, 1)
    incr_new_cells(spark, src, kind, table, log, 1)
    assert read_counts(spark, table).first().cnt == 5
    spark.createDataFrame([("s", 9, "chr1", 1, 2)], schema).write.mode("append").parquet(src)
    incr_new_cells(spark, src, kind, table, log, 1)
    r = read_counts(spark, table).first()
    assert (r.cnt, r.n_cells, r.pct) == (6, 6, 100.0)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("s", 1, "chr1", 1, 2)], "subtype string, cell_id long, chrom string, r_start long, r_end long")
    for _ in range(2):
        write_delta(batch, 0, str(tmp_path / "t"))
    assert read_counts(spark, str(tmp_path / "t")).first().cnt == 1


def test_a_cell_in_two_batches_is_an_error(spark, tmp_path):
    batch = spark.createDataFrame([("s", 1, "chr1", 1, 2)], "subtype string, cell_id long, chrom string, r_start long, r_end long")
    write_delta(batch, 0, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="earlier batch"):
        write_delta(batch, 1, str(tmp_path / "t"))
    assert read_counts(spark, str(tmp_path / "t")).first().cnt == 1
