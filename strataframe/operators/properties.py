"""Physical properties of layers, the grids made of them, and the text forms that simulators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Default Vp, Vs and rho of six named colours, and of cells without properties.
DEFAULTS = {
    "red": (6500.0, 3750.0, 2800.0),
    "orange": (5500.0, 3200.0, 2700.0),
    "yellow": (4500.0, 2600.0, 2500.0),
    "green": (3500.0, 2000.0, 2300.0),
    "blue": (2500.0, 1500.0, 2100.0),
    "purple": (7500.0, 4300.0, 3000.0),
}
CELL = (3000.0, 1732.0, 2200.0)


def defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in DEFAULTS.items()], "name string, vp double, vs double, rho double")


def assign(names: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Properties of each name: its own if given, else the defaults, else none. The default table has six rows."""
    spark = names.sparkSession
    d = defaults(spark).withColumnsRenamed({"vp": "dvp", "vs": "dvs", "rho": "drho"})
    out = names.join(F.broadcast(d), "name", "left")
    if custom is not None:
        out = out.join(custom.withColumnsRenamed({"vp": "cvp", "vs": "cvs", "rho": "crho"}), "name", "left")
        return out.select(*names.columns, *[F.coalesce(f"c{k}", f"d{k}").alias(k) for k in ("vp", "vs", "rho")])
    return out.select(*names.columns, *[F.col(f"d{k}").alias(k) for k in ("vp", "vs", "rho")])


def missing(names: DataFrame) -> DataFrame:
    """Names without properties: in strict use there must be none."""
    return names.join(F.broadcast(defaults(names.sparkSession)), "name", "left_anti")


def ramp(names: DataFrame) -> DataFrame:
    """Properties rising with a layer's place: (figure_id, ord, name) to vp, vs, rho."""
    f = Window.partitionBy("figure_id")
    n, i = F.count(F.lit(1)).over(f), F.row_number().over(f.orderBy("ord")) - 1
    t = F.when(n == 1, 0.5).otherwise(i / F.greatest(n - 1, F.lit(1)))
    p = names.withColumn("t", t)
    return p.select("figure_id", "ord", "name", F.round(F.col("t") * 3000 + 3000, 2).alias("vp"), F.round((F.col("t") * 3000 + 3000) / 1.732, 2).alias("vs"), F.round(F.col("t") * 600 + 2200, 2).alias("rho"))


def grids(lb: DataFrame, layers: DataFrame) -> DataFrame:
    """(figure_id, z, x, vp, vs, rho): a cell's layer properties, else the cell defaults; label 0 has these too."""
    p = lb.join(layers.select("figure_id", "lbl", "vp", "vs", "rho").where("lbl <> 0"), ["figure_id", "lbl"], "left")
    return p.select("figure_id", F.col("y").alias("z"), "x", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in zip(("vp", "vs", "rho"), CELL, strict=True)])


def tomography_lines(grid: DataFrame, dx: float = 1.0, dz: float = 1.0) -> DataFrame:
    """A text line per node, rows of one depth together; the reader orders them by (figure_id, z, x)."""
    line = F.format_string("%.6f %.6f %.4f %.4f %.4f", F.col("x") * dx, F.col("z") * dz, "vp", "vs", "rho")
    return grid.select("figure_id", "z", "x", line.alias("line"))


# The text of a parameter snippet before its layers, and the first line of a tomography file.
SNIPPET = """# Place these lines into your SPECFEM2D Par_file

MODEL                           = tomo
TOMOGRAPHY_FILE                 = ./DATA/tomo_file.xyz

# Model dimensions (must match tomography_file grid)
nx_tomo                         = {nx}
nz_tomo                         = {nz}
dx_tomo                         = {dx:.6f}
dz_tomo                         = {dz:.6f}

# Color zone -> property mapping (for reference)
"""
TOMOGRAPHY_HEADER = "#x #z #Vp #Vs #rho"


def parameter_lines(layers: DataFrame, nx: int = 100, nz: int = 50, dx: float = 1.0, dz: float = 1.0) -> DataFrame:
    """The parameter snippet of each figure: sizes, then a comment per layer in order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", F.format_string("#   %-10s:  Vp=%.1f  Vs=%.1f  rho=%.1f\n", "name", "vp", "vs", "rho").alias("l"))))
    head = F.lit(SNIPPET.format(nx=nx, nz=nz, dx=dx, dz=dz))
    return layers.groupBy("figure_id").agg(rows.alias("r")).select("figure_id", F.concat(head, F.array_join(F.transform("r", lambda x: x.l), "")).alias("snippet"))


def ascii_rows(grid: DataFrame, dx: float = 1.0, dz: float = 1.0) -> DataFrame:
    """Lines of an external model by (block, z): sizes (-3), columns (-2), rows (-1), then the three properties' rows (0 to 2).

    A row of the grid is gathered once for all three properties, and the first lines come from these rows.
    """
    cells = F.array_sort(F.collect_list(F.struct("x", *[F.format_string("%.4f", k).alias(k) for k in ("vp", "vs", "rho")])))
    rows = grid.groupBy("figure_id", "z").agg(cells.alias("c"))
    joined = lambda a, f: F.array_join(F.transform(a, f), " ")
    field = lambda k: lambda s: s[k]
    line = lambda block, text: F.struct(F.lit(block).alias("block"), text.alias("line"))
    body = rows.select("figure_id", F.col("z").cast("int").alias("z"), F.explode(F.array(*[line(i, joined("c", field(k))) for i, k in enumerate(("vp", "vs", "rho"))])).alias("b"))
    sizes = rows.groupBy("figure_id").agg(F.array_sort(F.collect_list("z")).alias("zs"), F.max_by(F.col("c.x"), F.size("c")).alias("xs"))
    at = lambda step: lambda v: F.format_string("%.6f", v * step)
    first = F.array(line(-3, F.format_string("%d %d", F.size("xs"), F.size("zs"))), line(-2, joined("xs", at(dx))), line(-1, joined("zs", at(dz))))
    head = sizes.select("figure_id", F.lit(0).alias("z"), F.explode(first).alias("b"))
    return head.unionByName(body).select("figure_id", "b.block", "z", "b.line")
