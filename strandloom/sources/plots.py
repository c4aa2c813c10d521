"""Figures as SVG: tracks of bins, segments and arcs along the genome.

Points are averaged by pixel column, or counted by pixel where they lie in several bands, before they leave the cluster, so
what is drawn is bounded by the size of the figure; segments and arcs are as many as a profile and a list of structural variants have.
"""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.scalar import is_masked

WIDTH, HEIGHT, MARGIN = 1600, 420, 50
COLORS = {"hp1": "#b2502e", "hp2": "#3b6ea5", "coverage": "#555555", "unphased": "#999999", "het": "#c08a2d", "hom": "#2f6f73"}
#: Columns and rows of a figure of SNPs.
ACROSS, UP = 800, 100


def columns(bins: DataFrame, offsets: DataFrame, kinds: tuple[str, ...], total: int) -> DataFrame:
    """kind, column, y: the mean of each kind of depth in each pixel column; masked bins are left out."""
    rows = bins.join(F.broadcast(offsets.select("chr", "offset")), "chr")
    kind = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("y")) for k in kinds))).alias("v")
    at = F.floor((F.col("offset") + F.col("start")) * WIDTH / F.lit(max(1, total))).cast("int")
    return rows.select(at.alias("column"), kind).select("column", "v.*").where(F.col("y").isNotNull() & ~is_masked(F.col("y"))).groupBy("kind", "column").agg(F.avg("y").alias("y"))


def raster(points: DataFrame, offsets: DataFrame, total: int) -> DataFrame:
    """kind, column, row, n: points (chr, pos, kind, y from 0 to 1) in each pixel; others and nulls are left out.

    Counts are partial aggregates, at most one row for each pixel and kind, so bands of frequencies stay apart.
    """
    rows = points.where("y >= 0 AND y <= 1").join(F.broadcast(offsets.select("chr", "offset")), "chr")
    column = F.floor((F.col("offset") + F.col("pos")) * ACROSS / F.lit(max(1, total))).cast("int")
    row = F.least(F.floor(F.col("y") * UP), F.lit(UP - 1)).cast("int")
    return rows.groupBy("kind", column.alias("column"), row.alias("row")).agg(F.count("*").alias("n"))


def bars(segments: DataFrame, offsets: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """kind, x1, x2, y: segments along the genome; ``kinds`` names the column of each kind."""
    rows = segments.join(F.broadcast(offsets.select("chr", "offset")), "chr")
    kind = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("y")) for k, c in kinds.items()))).alias("v")
    return rows.select((F.col("offset") + F.col("start")).alias("x1"), (F.col("offset") + F.col("end")).alias("x2"), kind).select("v.kind", "x1", "x2", "v.y").where(~is_masked(F.col("y")))


def draw(offsets: DataFrame, points: list, lines: list, curves: list, title: str) -> str:
    """The figure from rows of ``columns`` and ``bars`` and the curves of arcs; a row for each contig is read."""
    contigs = sorted((r.offset, r.chr, r.len) for r in offsets.collect())
    total = max((o + n for o, _, n in contigs), default=1)
    top = max([p.y for p in points] + [s.y for s in lines] + [1.0]) * 1.05
    plain = HEIGHT - 2 * MARGIN
    x = lambda v: MARGIN + v * WIDTH / total
    y = lambda v: MARGIN + plain * (1 - v / top)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH + 2 * MARGIN}" height="{HEIGHT}" font-family="sans-serif" font-size="11">', f'<text x="{MARGIN}" y="18" font-size="14">{escape(title)}</text>']
    for offset, name, length in contigs:
        out.append(f'<line x1="{x(offset):.1f}" x2="{x(offset):.1f}" y1="{MARGIN}" y2="{MARGIN + plain}" stroke="#dddddd"/>')
        out.append(f'<text x="{x(offset + length / 2):.1f}" y="{HEIGHT - MARGIN + 16}" text-anchor="middle">{escape(name)}</text>')
    for k in range(5):
        out.append(f'<text x="{MARGIN - 6}" y="{y(top * k / 4) + 4:.1f}" text-anchor="end">{top * k / 4:.1f}</text>')
    for p in points:
        out.append(f'<circle class="{p.kind}" cx="{MARGIN + p.column + 0.5:.1f}" cy="{y(p.y):.1f}" r="1.2" fill="{COLORS.get(p.kind, "#000000")}" fill-opacity="0.5"/>')
    for s in lines:
        out.append(f'<line class="segment {s.kind}" x1="{x(s.x1):.1f}" x2="{max(x(s.x2), x(s.x1) + 1):.1f}" y1="{y(s.y):.1f}" y2="{y(s.y):.1f}" stroke="{COLORS.get(s.kind, "#000000")}" stroke-width="3"/>')
    for c in curves:
        high = max([p.y for p in c.curve] + [1.0])
        path = " ".join(f"{x(p.x):.1f},{MARGIN - 2 - p.y / high * (MARGIN - 26):.1f}" for p in c.curve)
        out.append(f'<polyline class="arc" points="{path}" fill="none" stroke="#7a5195" stroke-opacity="0.6"/>')
    return "\n".join([*out, "</svg>"])


def write_genome(path: str, offsets: DataFrame, bins: DataFrame, kinds: tuple[str, ...], segments: DataFrame | None = None, levels: dict[str, str] | None = None, arcs: DataFrame | None = None, title: str = "") -> None:
    """A figure of bins, and of segments and arcs where there are any, as a text of one row."""
    total = offsets.agg(F.max(F.col("offset") + F.col("len")).alias("n")).first()["n"] or 1
    points = columns(bins, offsets, kinds, total).collect()  # at most WIDTH for each kind
    lines = bars(segments, offsets, levels).collect() if segments is not None else []
    curves = arcs.select("curve").collect() if arcs is not None else []
    svg = draw(offsets, points, lines, curves, title)
    bins.sparkSession.createDataFrame([(svg,)], "value STRING").coalesce(1).write.mode("overwrite").text(path)


def write_snps(path: str, offsets: DataFrame, points: DataFrame, title: str = "") -> None:
    """A figure of the frequencies of SNPs (chr, pos, kind, y), as a text of one row; a pixel with more of them is darker."""
    total = offsets.agg(F.max(F.col("offset") + F.col("len")).alias("n")).first()["n"] or 1
    pixels = raster(points, offsets, total).collect()  # at most ACROSS * UP for each kind
    most = max((p.n for p in pixels), default=1)
    wide, high = WIDTH / ACROSS, (HEIGHT - 2 * MARGIN) / UP
    marks = [
        f'<rect class="{escape(p.kind)}" x="{MARGIN + p.column * wide:.1f}" y="{HEIGHT - MARGIN - (p.row + 1) * high:.1f}" width="{wide:.1f}" height="{high:.1f}" fill="{COLORS.get(p.kind, "#000000")}" fill-opacity="{0.25 + 0.75 * p.n / most:.2f}"/>'
        for p in sorted(pixels, key=lambda p: (p.kind, p.column, p.row))
    ]
    svg = draw(offsets, [], [], [], title).replace("</svg>", "\n".join([*marks, "</svg>"]))
    points.sparkSession.createDataFrame([(svg,)], "value STRING").coalesce(1).write.mode("overwrite").text(path)
