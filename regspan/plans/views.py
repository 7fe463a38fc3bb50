"""SQL views for the checking engine: the driver's tables as the fixtures see them."""

from __future__ import annotations

import re

_SRC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DST = ("ACGT" * 7)[:26] * 2

VIEWS: dict[str, str] = {
    "cells": """
SELECT concat('G', CAST(n_regionkey AS VARCHAR)) AS grp, c_mktsegment AS subtype, n_name AS sample,
       c_custkey AS cell_id
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "footprints": """
SELECT k.grp, k.subtype, k.sample, k.cell_id,
       concat('chr', CAST(1 + l_partkey % 22 AS VARCHAR)) AS chrom,
       1000 + (l_partkey // 22) * 700 + 20 * l_linenumber AS fp_start,
       1010 + (l_partkey // 22) * 700 + 21 * l_linenumber AS fp_end,
       concat('TF', CAST(l_suppkey % 40 AS VARCHAR), '_MA', CAST(1000 + l_suppkey % 40 AS VARCHAR)) AS tf_motif,
       l_quantity AS motif_score, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
       1000 + (l_partkey // 22) * 700 AS peak_start,
       1200 + (l_partkey // 22) * 700 + l_partkey % 100 AS peak_end,
       l_discount AS fp_score, l_returnflag AS flag, l_tax AS tax
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cells k ON o_custkey = k.cell_id""",
    "annotations": """
SELECT concat('chr', CAST(1 + o_orderkey % 22 AS VARCHAR)) AS chrom, (o_orderkey // 22) * 90 AS ann_start,
       (o_orderkey // 22) * 90 + 30 + o_custkey % 120 AS ann_end,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'enhancer' WHEN '2-HIGH' THEN 'silencer'
            WHEN '3-MEDIUM' THEN 'promoter' WHEN '4-NOT SPECIFIED' THEN 'response_element'
            ELSE 'protein_bind_x' END AS ann_class
FROM orders""",
    "genes": """
SELECT concat('chr', CAST(1 + c_custkey % 22 AS VARCHAR)) AS chrom, (c_custkey // 22) * 900 + 1 AS gene_start,
       (c_custkey // 22) * 900 + 401 + c_custkey % 300 AS gene_end,
       CASE WHEN c_acctbal >= 5000 THEN '-' ELSE '+' END AS strand, c_name AS gene_name,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'protein_coding' ELSE 'lncRNA' END AS gene_type
FROM customer""",
    "genes_tss": """
SELECT *, CASE WHEN strand = '+' THEN gene_start ELSE gene_end END AS tss FROM genes""",
    "tf_pct": """
SELECT grp, subtype, cell_id AS nucleus, tf_motif AS tf,
       CAST(100 * SUM(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS pct
FROM footprints GROUP BY 1, 2, 3, 4""",
    "predictions": """
SELECT *, CASE WHEN p_enhancer >= 0.5 AND p_silencer >= 0.5 THEN 'enhancer_silencer'
               WHEN p_enhancer >= 0.5 THEN 'enhancer' WHEN p_silencer >= 0.5 THEN 'silencer'
               ELSE 'neither' END AS category
FROM (SELECT grp, subtype, sample, cell_id, chrom, peak_start, peak_end, MAX(fp_score) * 10 AS p_enhancer,
             MAX(tax) * 12.5 AS p_silencer, COUNT(DISTINCT tf_motif) AS n_tfs
      FROM footprints GROUP BY ALL)""",
    "rna": """
SELECT user_id AS cell_id, concat('C', CAST(user_id % 10 AS VARCHAR)) AS cluster_id, event_type AS gene,
       CAST(SUM(FLOOR(value)) AS BIGINT) AS umi
FROM events GROUP BY 1, 2, 3""",
    "rna_cells": """
SELECT cell_id, cluster_id, CAST(SUM(umi) AS BIGINT) AS total_umis,
       CASE cell_id % 3 WHEN 0 THEN 'Midbrain (M) - Substantia' WHEN 1 THEN 'Septal nuclei' ELSE 'Pons' END
           AS dissection
FROM rna GROUP BY 1, 2""",
    "scored": """
SELECT l.doc_id, quality AS y_a, toxic AS y_b, CAST(n_chars % 997 AS DOUBLE) / 997 AS p_a,
       CAST(d.doc_id % 89 AS DOUBLE) / 89 AS p_b
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "scored_long": """
SELECT doc_id AS row_id, 'is_enhancer' AS head, y_a AS y, p_a AS p FROM scored
UNION ALL SELECT doc_id, 'is_silencer', y_b, p_b FROM scored""",
    "genome": f"""
SELECT concat('doc', CAST(doc_id AS VARCHAR)) AS chrom,
       regexp_replace(translate(text, '{_SRC}', '{_DST}'), '[^ACGT]', 'N', 'g') AS seq
FROM documents""",
    "peaks": """
SELECT DISTINCT grp, subtype, sample, cell_id, chrom, peak_start AS r_start, peak_end AS r_end FROM footprints""",
    "tags": """
SELECT DISTINCT p.chrom, p.r_start, p.r_end, a.ann_class AS raw
FROM (SELECT DISTINCT chrom, r_start, r_end FROM peaks) p JOIN annotations a
  ON p.chrom = a.chrom AND p.r_start < a.ann_end AND a.ann_start < p.r_end
UNION
SELECT DISTINCT p.chrom, p.r_start, p.r_end, 'gene_body'
FROM (SELECT DISTINCT chrom, r_start, r_end FROM peaks) p JOIN genes g
  ON p.chrom = g.chrom AND p.r_start < g.gene_end AND g.gene_start - 1 < p.r_end""",
    "source_tags": """
SELECT p.*, COALESCE(t.raw, 'uncharacterized') AS tag
FROM peaks p LEFT JOIN tags t ON p.chrom = t.chrom AND p.r_start = t.r_start AND p.r_end = t.r_end""",
    "region_types": """
SELECT chrom, r_start, r_end, string_agg(tag, ';' ORDER BY tag) AS region_type
FROM (SELECT DISTINCT chrom, r_start, r_end, tag FROM source_tags) GROUP BY 1, 2, 3""",
    "corpus_rows": """
SELECT f.chrom, peak_start, peak_end, tf_motif, motif_score, fp_score,
       CASE WHEN lower(ann_class) IN ('enhancer', 'silencer', 'promoter') THEN lower(ann_class)
            WHEN lower(ann_class) LIKE 'protein_bind%' THEN 'TFBS' ELSE 'other_regulatory' END AS label
FROM footprints f JOIN annotations a ON f.chrom = a.chrom AND fp_start < ann_end AND ann_start < fp_end
UNION ALL
SELECT f.chrom, peak_start, peak_end, tf_motif, motif_score, fp_score, 'genic'
FROM footprints f JOIN genes g ON f.chrom = g.chrom AND fp_start < gene_end AND gene_start - 1 < fp_end""",
    "corpus": """
SELECT chrom, peak_start, peak_end, string_agg(DISTINCT label, '|' ORDER BY label) AS all_labels,
       CASE MIN(CASE label WHEN 'enhancer' THEN 1 WHEN 'silencer' THEN 2 WHEN 'promoter' THEN 3 WHEN 'TFBS' THEN 4
                WHEN 'cis_regulatory' THEN 5 WHEN 'other_regulatory' THEN 6 ELSE 7 END)
         WHEN 1 THEN 'enhancer' WHEN 2 THEN 'silencer' WHEN 3 THEN 'promoter' WHEN 4 THEN 'TFBS'
         WHEN 5 THEN 'cis_regulatory' WHEN 6 THEN 'other_regulatory' ELSE 'genic' END AS primary_label,
       COUNT(DISTINCT tf_motif) AS n_tfs, MAX(motif_score) AS max_motif_score, MAX(fp_score) AS max_fp_score,
       AVG(motif_score) AS mean_motif_score, AVG(fp_score) AS mean_fp_score
FROM corpus_rows GROUP BY 1, 2, 3""",
}


def add_views(more: dict[str, str]) -> None:
    clash = VIEWS.keys() & more.keys()
    if clash:
        raise ValueError(f"views defined twice: {sorted(clash)}")
    VIEWS.update(more)


def _used(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_]\w*", sql))
    return [name for name in VIEWS if name in words]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, and those they name, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _used(VIEWS[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for name in _used(sql):
        visit(name)
    if not order:
        return sql.strip()
    body = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in order)
    rest = sql.strip()
    if rest.startswith("WITH "):
        return f"WITH {body},\n{rest[5:]}"
    return f"WITH {body}\n{rest}"
