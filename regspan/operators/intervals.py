"""Interval joins: both sides are cut into nested bins and joined on (chrom, level, bin).

Each level's bins are eight times as wide as those of the level below. A span belongs to the lowest level whose bins are
as long as itself, so it lies in two of them at most, however long it is. Two spans meet on the higher one's level: a
probe looks at its own level and at those above it that the other side has. A pair that shares two bins is kept in the
first of them, so every pair comes out once.

The right side is the reference side (annotation, genes, known regions). A bin that holds very many left rows is spread
over tasks by salts that a histogram of the bins plans; only the right rows of such a bin are repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regspan.operators.scale import HOT_ROWS, dealt, salted_join, spread_keys

BIN = 1024
#: Levels of nested bins; the widest of 1,024 * 8^7 bases hold any chromosome. 8 = 2^_STEP.
LEVELS, _STEP = 8, 3
POINT_BIN = 16384
FAR = 300_000_000


def _level(lo: Column, hi: Column, width: int, levels: int) -> Column:
    level = F.lit(0)
    for i in range(levels - 1):
        level = level + (hi - lo + 1 > F.lit(width << _STEP * i)).cast("int")
    return level


def _wide(width: int, level: Column) -> Column:
    return F.lit(width).cast("bigint") * F.element_at(F.array(*[F.lit(1 << _STEP * i).cast("bigint") for i in range(LEVELS)]), level + 1)


def _spots(lo: Column, hi: Column, width: int, levels: Column, role: int) -> Column:
    """The bins of some levels that a span touches, as (_key, _bin); _key holds the level and the role that the span has there."""

    def of_level(level: Column) -> Column:
        first, last = (F.floor(x / _wide(width, level)).cast("bigint") for x in (lo, hi))
        return F.transform(F.sequence(first, F.greatest(first, last)), lambda b: F.struct((level * 2 + role).alias("_key"), b.alias("_bin")))

    return F.flatten(F.transform(levels, of_level))


def _present(df: DataFrame, level: Column) -> Column:
    """The levels that ``df`` has, as an array that a subquery finds."""
    return df.agg(F.array_sort(F.collect_set(level)).alias("levels")).scalar()


def _nested(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: int,
            left_levels: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (_key, _bin): equal keys and bins are where their spans may meet, with the first shared bin among them.

    Role 0 of a level: the right side's own spans, met by left ones of that level and below. Role 1: the left side's own
    spans, met by right ones from below. ``left_levels=1`` says that left spans are short; longer ones are then cut into
    as many bins of the lowest level as they cover, and right spans have no role 1.
    """
    ours, theirs = _level(*left_span, width, left_levels), _level(*right_span, width, LEVELS)
    a = left.withColumn("_levels", _present(right, theirs)).withColumn("_own", ours)
    spots = _spots(*left_span, width, F.filter("_levels", lambda x: x >= F.col("_own")), 0)
    b = right.withColumn("_own", theirs)
    back = _spots(*right_span, width, F.array("_own"), 0)
    if left_levels > 1:
        below = F.filter(F.array("_own"), lambda x: F.exists("_levels", lambda y: y < x))
        spots = F.concat(spots, _spots(*left_span, width, below, 1))
        b = b.withColumn("_levels", _present(left, ours))
        back = F.concat(back, _spots(*right_span, width, F.filter("_levels", lambda x: x > F.col("_own")), 1))
    return (a.select(*left.columns, F.inline(spots)), b.select(*right.columns, F.inline(back)))


def _first_shared(lo: Column, other: Column, width: int) -> Column:
    return F.floor(F.greatest(lo, other) / _wide(width, F.expr("_key div 2").cast("int")))


def join_interval(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str],
                  bin_size: int = BIN, closed: bool = False, hot_rows: int = HOT_ROWS, left_levels: int = LEVELS,
                  tasks: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Pairs whose half-open spans overlap on the same ``chrom``.

    ``closed`` treats both ends as part of the span. Column names other than
    ``chrom`` must differ between the sides. ``left_levels=1`` saves a look at
    the left side's lengths where they are known to be short. ``tasks`` is the
    number of tasks that both sides are dealt over (Spark's own if None).
    Salts are planned from a pass over ``left``, or over ``seen`` where that is
    cheaper: the spans of about the same rows; what comes out is the same.
    """
    (ls, le), (rs, re) = left_span, right_span
    edge = 0 if closed else 1
    spans = (F.col(ls), F.col(le) - edge), (F.col(rs), F.col(re) - edge)
    a, b = _nested(left, right, *spans, bin_size, left_levels)
    key = ["chrom", "_key", "_bin"]
    a, b = spread_keys(a, b, key, hot_rows, seen=None if seen is None else _nested(seen, right, *spans, bin_size, left_levels)[0])
    if closed:
        meet = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le))
    else:
        meet = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    a, b = (dealt(x, tasks, *key, "_salt") for x in (a, b))
    j = a.join(b, [*key, "_salt"]).where(meet & (F.col("_bin") == _first_shared(F.col(ls), F.col(rs), bin_size)))
    return j.select(*left.columns, *[c for c in right.columns if c != "chrom"])


def join_interval_exists(left: DataFrame, right: DataFrame, left_span: tuple[str, str],
                         right_span: tuple[str, str], bin_size: int = BIN, keep: str = "left_semi",
                         on: tuple[str, ...] = ("chrom",), left_levels: int = LEVELS,
                         tasks: int | None = None) -> DataFrame:
    """Left rows that meet any right span with equal ``on`` columns.

    A right span that starts exactly where the left one ends counts as met, so
    the left side is binned up to and including its end. ``keep="left_anti"``
    gives the rows that meet none. ``tasks`` as in ``join_interval``.
    """
    (ls, le), (rs, re) = left_span, right_span
    on = list(on)
    spans = left.select(*on, ls, le).distinct()
    refs = right.select(*on, F.col(rs).alias("_rs"), F.col(re).alias("_re")).distinct()
    a, b = _nested(spans, refs, (F.col(ls), F.col(le)), (F.col("_rs"), F.greatest("_rs", F.col("_re") - 1)), bin_size, left_levels)
    a, b = (dealt(x, tasks, *on, "_key", "_bin") for x in (a, b))
    met = a.join(b, [*on, "_key", "_bin"]).where(
        (F.col("_rs") <= F.col(le)) & (F.col("_re") > F.col(ls))).select(*on, ls, le)
    return dealt(left, tasks, *on, ls, le).join(dealt(met, tasks, *on, ls, le).distinct(), [*on, ls, le], keep)


def point_in_interval(points: DataFrame, spans: DataFrame, pos: str, span: tuple[str, str],
                      bin_size: int = POINT_BIN, how: str = "inner", hot_rows: int = HOT_ROWS,
                      tasks: int | None = None) -> DataFrame:
    """Points with the spans (both ends included) that hold them; a point stays in one bin.

    Spans are a dimension (genes, or stretches that part a chromosome), so cutting them into flat bins gives few rows and
    the points, which are many, are never repeated. A bin with very many points is spread by planned salts.
    ``tasks`` is the number of tasks that both sides are dealt over (Spark's own if None).
    """
    lo, hi = span
    last = FAR // bin_size
    p = points.withColumn("_bin", F.least(F.expr(f"{pos} div {bin_size}"), F.lit(last)))
    cut = spans.withColumn("_bin", F.explode(F.sequence(
        F.least(F.expr(f"greatest({lo}, 0) div {bin_size}"), F.lit(last)),
        F.least(F.expr(f"greatest({hi}, 0) div {bin_size}"), F.lit(last)))))
    p, s = spread_keys(p, cut, ["chrom", "_bin"], hot_rows, tasks=tasks)
    same = [p[c] == s[c] for c in ("chrom", "_bin", "_salt")]
    inside = (p[pos] >= s[lo]) & (p[pos] <= s[hi])
    j = p.join(s, same + [inside], how)
    return j.select(*[p[c] for c in points.columns], *[s[c] for c in spans.columns if c != "chrom"])


def tss_territories(genes: DataFrame, first_by: str = "gene_name", shared_edges: bool = False) -> DataFrame:
    """The stretch of a chromosome nearest to each TSS.

    A point halfway between two TSS belongs to the lower one, or to both with
    ``shared_edges``. Genes are a dimension (one row per gene), so a window per
    chromosome is small. Of genes that share a TSS the first by ``first_by``
    stands for all.
    """
    fields = F.struct("gene_name", "gene_type", "gene_start")
    one = genes.groupBy("chrom", "tss").agg(F.min_by(fields, F.struct(first_by, "gene_name")).alias("_g"))
    w = W.partitionBy("chrom").orderBy("tss")
    edge = 0 if shared_edges else 1
    d = one.select("chrom", F.col("tss").alias("near_tss"), F.col("_g.gene_name").alias("near_gene"),
                   F.col("_g.gene_type").alias("near_type"), F.col("_g.gene_start").alias("near_start"),
                   F.lag("tss").over(w).alias("_prev"), F.lead("tss").over(w).alias("_next"))
    below = F.expr("(_prev + near_tss) div 2") + (F.expr("(_prev + near_tss) % 2") if shared_edges else F.lit(edge))
    return d.select(
        "chrom", "near_tss", "near_gene", "near_type", "near_start",
        F.coalesce(below, F.lit(-(2 ** 40))).cast("bigint").alias("_lo"),
        F.coalesce(F.expr("(near_tss + _next) div 2"), F.lit(2 ** 40)).cast("bigint").alias("_hi"))


def with_tss(genes: DataFrame) -> DataFrame:
    return genes.withColumn("tss", F.when(F.col("strand") == "+", F.col("gene_start")).otherwise(F.col("gene_end")))


def join_nearest_tss(points: DataFrame, genes: DataFrame, mid: str = "mid", tasks: int | None = None) -> DataFrame:
    """Nearest TSS over all genes and over protein-coding genes, with signed distance ``mid - tss``.

    Each TSS owns the stretch of chromosome nearest to it, so the search is a
    point-in-interval join and needs no ordered window over the points.
    ``tasks`` as in ``point_in_interval``.
    """
    g = with_tss(genes)
    out = points
    for prefix, side in (("", g), ("pc_", g.where("gene_type = 'protein_coding'"))):
        t = tss_territories(side).select(
            "chrom", "_lo", "_hi", F.col("near_gene").alias(f"{prefix}nearest_gene"),
            F.col("near_tss").alias("_tss"), F.col("near_type").alias(f"{prefix}nearest_type"))
        out = point_in_interval(out, t, mid, ("_lo", "_hi"), how="left", tasks=tasks).withColumn(
            f"{prefix}dist_to_tss", F.col(mid) - F.col("_tss")).drop("_tss", "_lo", "_hi")
    return out.drop("pc_nearest_type")


def join_gene_body(points: DataFrame, genes: DataFrame, mid: str = "mid", tasks: int | None = None) -> DataFrame:
    """Gene whose body holds the point: protein-coding first, then the lowest TSS. Adds ``within_gene``.

    The gene is found once per place; every row of ``points`` gets it, equal rows included. ``tasks`` as in
    ``point_in_interval``.
    """
    g = with_tss(genes).select("chrom", "gene_start", "gene_end", "gene_name", "gene_type", "tss")
    places = dealt(points.select("chrom", mid), tasks, "chrom", mid).distinct()
    rank = F.struct((F.col("gene_type") != "protein_coding").alias("np"), "tss", "gene_name")
    met = dealt(point_in_interval(places, g, mid, ("gene_start", "gene_end"), tasks=tasks), tasks, "chrom", mid)
    hit = met.groupBy("chrom", mid).agg(F.min_by("gene_name", rank).alias("within_gene"))
    return salted_join(points, hit, ["chrom", mid], "left", tasks=tasks).select(*points.columns, "within_gene")


def join_locus_genes(loci: DataFrame, genes: DataFrame) -> DataFrame:
    """Protein-coding genes that touch a locus (ends included) and the nearest such TSS.

    ``loci`` has locus, chrom, l_start, l_end. Distance is unsigned; of two
    equally near genes the one that starts first wins.
    """
    pc = with_tss(genes.where("gene_type = 'protein_coding'"))
    g = pc.select("chrom", "gene_start", "gene_end", "gene_name")
    touch = join_interval(loci, g, ("l_start", "l_end"), ("gene_start", "gene_end"), closed=True)
    named = touch.groupBy("locus").agg(F.array_join(F.sort_array(F.collect_set("gene_name")), ",").alias("genes"))
    mids = loci.select("locus", "chrom", F.expr("(l_start + l_end) div 2").alias("mid"))
    near = point_in_interval(mids, tss_territories(pc, "gene_start", True), "mid", ("_lo", "_hi"), how="left").select(
        "locus", "near_gene", "near_start", F.abs(F.col("mid") - F.col("near_tss")).alias("d"))
    near = near.groupBy("locus").agg(F.min_by("near_gene", F.struct("d", "near_start", "near_gene")).alias(
        "nearest_gene"), F.min("d").alias("distance"))
    return loci.join(named, "locus", "left").join(near, "locus", "left").select(
        "locus", "chrom", "l_start", "l_end", F.coalesce("genes", F.lit("")).alias("genes"),
        "nearest_gene", "distance")
