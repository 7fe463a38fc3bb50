"""Label vocabularies and the rules that map raw classes onto them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values: vocabularies that results must agree on ----
STANDARD_CHROMS = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY"]

REGULOME_LABELS = {
    "enhancer": "enhancer",
    "silencer": "silencer",
    "promoter": "promoter",
    "transcriptional_cis_regulatory_region": "cis_regulatory",
}
TFBS_PREFIX = "protein_bind"
OTHER_LABEL = "other_regulatory"

LABEL_PRIORITY = ["enhancer", "silencer", "promoter", "TFBS", "cis_regulatory", "other_regulatory", "genic"]

FIVE_CLASS = {"TFBS": "other_regulatory", "cis_regulatory": "other_regulatory"}

CATEGORIES = ["enhancer", "silencer", "enhancer_silencer", "neither"]
NOVEL_CLASS = {
    "enhancer": "novel|enhancer",
    "silencer": "novel|silencer",
    "enhancer_silencer": "novel|dual",
    "neither": "novel|nonregulatory",
}

SOURCE_PREFIX_GROUPS = {"ITL23_rows_part": "ITL23", "cspmei_ASCT_rows_part": "ASCT"}
SOURCE_NAME_GROUPS = {
    "L6B_rows": "L6B", "ITL34_rows": "ITL34", "ITL4_rows": "ITL4",
    "ITL45_rows": "ITL45", "CHO_rows": "CHO", "AMY_rows": "AMY",
}
PLAIN_GROUPS = ["Dopaminergic", "MSN", "FOXP2", "PVALB", "VIP", "CNGA", "BFEXA", "BNGA", "CNMIX", "MGC_1",
                "MGC_2", "PV_ChCs", "MDGA", "ICGA_1", "ICGA_2", "SEPGA", "SIGA"]
ROSTER_GROUPS = ["ITL23", "ASCT", "L6B", "ITL34", "ITL4", "ITL45", "CHO", "AMY", "Dopaminergic", "MSN", "FOXP2", "PVALB",
                 "VIP", "CNGA", "BFEXA", "BNGA", "CNMIX", "MGC_1", "MGC_2", "PV_ChCs"]
SPLIT_SOURCE, SPLIT_SUBTYPE = "MBGA", "CTXMIX"

TRAIN_CHROMS = [f"chr{i}" for i in range(1, 18)]
VALID_CHROMS = ["chr18", "chr19", "chr20"]
TEST_CHROMS = ["chr21", "chr22", "chrX"]
CHROMS_BY_SIZE = [f"chr{i}" for i in range(1, 8)] + ["chrX"] + [f"chr{i}" for i in range(8, 23)]
# ---- end of fixed values ----


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(x: str | Column, table: dict[str, object], default: Column | None = None) -> Column:
    """Small fixed table as an expression; no join."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    hit = F.element_at(F.create_map(*pairs), _col(x))
    return hit if default is None else F.coalesce(hit, default)


def recode_regulome(raw: str | Column) -> Column:
    low = F.lower(_col(raw))
    rest = F.when(low.startswith(TFBS_PREFIX), "TFBS").otherwise(OTHER_LABEL)
    return lookup(low, REGULOME_LABELS, rest)


def fix_chrom(x: str | Column) -> Column:
    """``Chr_10`` and ``chr10`` are the same chromosome."""
    return F.regexp_replace(_col(x), "^Chr_", "chr")


def first_match(rules: list[tuple[Column, str]], default: str | Column) -> Column:
    """Label of the first rule that holds."""
    out = default if isinstance(default, Column) else F.lit(default)
    for test, label in reversed(rules):
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


def recode_simplify_type(raw: str | Column) -> Column:
    """Compound region type to one of seven; insulators are tested before enhancers."""
    t = F.lower(_col(raw))
    has = t.contains
    return first_match([
        (has("uncharacterized"), "uncharacterized"),
        (has("insulator") | has("enhancer_blocking"), "insulator"),
        (has("enhancer"), "enhancer"),
        (has("silencer"), "silencer"),
        (has("promoter"), "promoter"),
        (has("gene_body"), "gene_body"),
    ], "other_regulatory")


def recode_known_class(raw: str | Column) -> Column:
    t = F.lower(_col(raw))
    has = t.contains
    return first_match([
        (has("enhancer"), "known|enhancer"),
        (has("silencer"), "known|silencer"),
        (has("promoter"), "known|promoter"),
        (has("gene_body"), "known|gene_body"),
    ], "known|other_regulatory")


def recode_group(source: str | Column, subtype: str | Column | None = None, keep_unknown: bool = False) -> Column:
    """Source part to its canonical group.

    An unknown source keeps its name or becomes NULL. Of the split source only
    one subtype counts, because its others repeat standalone sources.
    """
    s = _col(source)
    names = SOURCE_NAME_GROUPS | {g: g for g in PLAIN_GROUPS}
    hit = lookup(s, names)
    if subtype is not None:
        hit = F.when((s == SPLIT_SOURCE) & (_col(subtype) == SPLIT_SUBTYPE), SPLIT_SUBTYPE).otherwise(hit)
    rules = [(s.startswith(prefix), grp) for prefix, grp in SOURCE_PREFIX_GROUPS.items()]
    return first_match(rules, F.coalesce(hit, s) if keep_unknown else hit)


def recode_5class(label: str | Column) -> Column:
    return lookup(label, FIVE_CLASS, _col(label))


def categorize_2head(p_enh: str | Column, p_sil: str | Column, t_enh: float = 0.5, t_sil: float = 0.5) -> Column:
    e, s = _col(p_enh) >= t_enh, _col(p_sil) >= t_sil
    return (F.when(e & s, "enhancer_silencer").when(e, "enhancer").when(s, "silencer").otherwise("neither"))


def novel_class(category: str | Column) -> Column:
    return lookup(category, NOVEL_CLASS)


def chrom_code(chrom: str | Column) -> Column:
    """chr1..chr22 are 1..22, X 23, Y 24, M 25, anything else 0."""
    c = _col(chrom)
    num = F.regexp_extract(c, "^chr([1-9]|1[0-9]|2[0-2])$", 1)
    return (F.when(num != "", num.try_cast("int"))
            .when(c == "chrX", 23).when(c == "chrY", 24).when(c == "chrM", 25).otherwise(0))


def priority_rank(label: str | Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LABEL_PRIORITY]), _col(label)).cast("int")


def priority_label(rank: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABEL_PRIORITY]), _col(rank))


def category_order(category: str | Column) -> Column:
    """Ties between categories go to the earlier one in this order."""
    return F.array_position(F.array(*[F.lit(x) for x in CATEGORIES]), _col(category)).cast("int")
