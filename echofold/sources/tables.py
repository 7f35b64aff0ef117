"""Readers and writers: line products, text tables, pair outputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions.columns import finite, steady_mean
from echofold.params import UNIX_DATENUM
from echofold.session import cut_lineage

NUMERIC = ("double", "float", "int", "bigint", "smallint")

# Columns every line product has to bring and their types, per table. `key` is a whole number or a text.
PRODUCT_SCHEMA = {
    "product": {"line_id": "key", "fc": "double", "t0": "double", "dt": "double", "nt": "bigint", "main_pass": "int", "zmotion_applied": "boolean"},
    "pass": {"line_id": "key", "pass_idx": "int", "day_seg": "string", "enabled": "boolean"},
    "pass_track": {"line_id": "key", "pass_idx": "int", "col": "bigint", "along_m": "double", "gps_time_s": "double", "lat": "double", "lon": "double", "elev": "double",
                   "ref_y": "double", "ref_z": "double", "surface_twtt_s": "double"},
    "slc": {"line_id": "key", "pass_idx": "int", "col": "bigint", "re": "array<double>", "im": "array<double>"},
}
_SMALL, _FLOATS = ["tinyint", "smallint", "int"], ["float", "double"]
#: What a declared type takes: itself and what it holds without loss.
TAKES = {"key": [*_SMALL, "bigint", "string"], "int": _SMALL, "bigint": [*_SMALL, "bigint"], "double": _FLOATS,
         "array<double>": [f"array<{t}>" for t in _FLOATS]}


def deviations(df: DataFrame, name: str, columns: dict[str, str | None]) -> list[str]:
    """How a table departs from its declared columns, one line each; a type of None is not looked at."""
    have, out = dict(df.dtypes), []
    for c, want in columns.items():
        if c not in have:
            out.append(f"{name}.{c}: required column missing")
        elif want is not None and have[c] not in TAKES.get(want, [want]):
            out.append(f"{name}.{c}: {want} wanted, {have[c]} found")
    return out


def read_products(spark: SparkSession, root: str, lines: list | None = None, tables: dict | None = None,
                  key: str = "line_id", suffix: str = "") -> dict[str, DataFrame]:
    """The tables of a product folder (`root`/name + `suffix`), only the needed columns, only the named lines.

    Columns are declared with their types (or named only, in a list). Everything in which the
    tables depart from that is listed in one error before a row is read. NaN and infinity become
    NULL on the way in, in numbers and within arrays of numbers.
    """
    found, wrong, out = {}, [], {}
    for name, cols in (tables or PRODUCT_SCHEMA).items():
        df = spark.read.parquet(f"{root}/{name}{suffix}")
        cols = cols if isinstance(cols, dict) else dict.fromkeys(cols)
        wrong += deviations(df, name, cols)
        found[name] = (df, list(cols))
    if wrong:
        raise ValueError("; ".join(wrong))
    for name, (df, cols) in found.items():
        kinds = dict(df.dtypes)
        df = df.select(*[finite(F.col(c)).alias(c) if kinds[c] in ("double", "float")
                         else F.transform(c, finite).alias(c) if kinds[c] in ("array<double>", "array<float>") else F.col(c) for c in cols])
        if lines is not None and key in cols:
            df = df.where(F.col(key).isin(list(lines)))
        out[name] = df
    return out


def repeat_products(passes: DataFrame, key: str = "line_id", pass_col: str = "pass_idx") -> DataFrame:
    """Lines with at least two passes; a single-pass product cannot be paired."""
    n = passes.groupBy(key).agg(F.countDistinct(pass_col).alias("n_pass"))
    return n.where("n_pass >= 2")


def parse_pair_names(files: DataFrame, line: str, name: str = "name", tag: str = "pair") -> DataFrame:
    """Pair indices from output names '<line>_<tag>_<ref>_<sec>'; the line must match whole.

    `line` names the column that holds the wanted line, so a line that is only a
    prefix of another does not pick up its files.
    """
    pat = rf"^(.+)_{tag}_(\d+)_(\d+)(\.\w+)?$"
    return files.select(
        F.col(line), F.regexp_extract(name, pat, 1).alias("_stem"),
        F.regexp_extract(name, pat, 2).alias("_i"), F.regexp_extract(name, pat, 3).alias("_j"),
    ).where((F.col("_stem") == F.col(line)) & (F.col("_i") != "")).select(
        F.col(line), F.col("_i").cast("int").alias("ref_idx"), F.col("_j").cast("int").alias("sec_idx"))


def read_pair_outputs(spark: SparkSession, root: str, lines: list | None = None, build: str | None = None) -> DataFrame:
    """One partitioned dataset of pair results; line and build prune partitions."""
    df = spark.read.parquet(root)
    if lines is not None:
        df = df.where(F.col("line_id").isin(list(lines)))
    if build is not None:
        df = df.where(F.col("build") == build)
    return df


def _fields(lines: DataFrame, col: str, sep: str) -> DataFrame:
    """Text lines to trimmed fields; comment and blank lines fall out."""
    text = F.trim(F.col(col))
    return lines.where((text != "") & ~text.startswith("#")).select(F.split(text, sep).alias("f"))


def _number(c):
    """Field to a finite double, NULL for blanks, NaN and anything unparseable."""
    return finite(c.try_cast("double"))


def datenum_to_unix(c):
    return (c - UNIX_DATENUM) * 86400.0


def parse_tide(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines 'datenum,iso,tide' to (ts_s, tide_m); the header line is not a number and falls out."""
    f = _fields(lines, col, ",")
    return f.select(datenum_to_unix(_number(F.get("f", F.lit(0)))).alias("ts_s"),
                    _number(F.get("f", F.lit(2))).alias("tide_m")).where("ts_s is not null and tide_m is not null")


def read_tide(spark: SparkSession, path: str) -> DataFrame:
    return parse_tide(spark.read.text(path))


def parse_tide_sites(lines: DataFrame, sites: list[str], col: str = "value") -> DataFrame:
    """Lines 'datenum,iso,<one value per site>' to long (site, ts_s, tide_m); blanks and NaN are NULL."""
    f = _fields(lines, col, ",")
    wide = f.select(datenum_to_unix(_number(F.get("f", F.lit(0)))).alias("ts_s"), *[
        _number(F.get("f", F.lit(2 + k))).alias(s) for k, s in enumerate(sites)]).where("ts_s is not null")
    return wide.unpivot("ts_s", sites, "site", "tide_m")


def read_tide_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site names come from the header, the first line that is not a comment."""
    text = spark.read.text(path)
    head = text.where(~F.trim("value").startswith("#") & F.col("value").contains("datenum")).first()
    if head is None:
        raise ValueError(f"{path}: no header line")
    sites = [c.strip() for c in head[0].split(",") if c.strip() not in ("datenum", "iso")]
    return parse_tide_sites(text, sites)


def parse_stations(lines: DataFrame, names: list[str], numeric: list[str], col: str = "value") -> DataFrame:
    """Whitespace-separated table; rows whose numbers do not parse (a header) fall out."""
    f = _fields(lines, col, r"\s+")
    out = f.select(*[(_number(F.get("f", F.lit(k))) if n in numeric else F.get("f", F.lit(k))).alias(n)
                     for k, n in enumerate(names)])
    ok = F.lit(True)
    for n in numeric:
        ok = ok & F.col(n).isNotNull()
    return out.where(ok)


def read_stations(spark: SparkSession, path: str, names=("x", "y", "site"), numeric=("x", "y")) -> DataFrame:
    """Station table; a missing file is an empty table, not an error."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        schema = ", ".join(f"{n} {'double' if n in numeric else 'string'}" for n in names)
        return spark.createDataFrame([], schema)
    return parse_stations(lines, list(names), list(numeric))


def pick_layer(picks: DataFrame, layer: str) -> DataFrame:
    return picks.where(F.col("layer_name") == layer)


def read_layers(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """Picks of one named layer; the filter reaches the Parquet scan."""
    return pick_layer(spark.read.parquet(root), layer)


def parse_station_pairs(lines: DataFrame, col: str = "value", dt_lo: float = 0.01, dt_hi: float = 0.1) -> DataFrame:
    """Lines 'site,t1,dt_days,rate': unparseable rows are skipped, short pairs kept.

    Times without a zone are UTC.
    """
    f = _fields(lines, col, ",")
    out = f.select(F.get("f", F.lit(0)).alias("site"),
                   F.expr("try_cast(replace(f[1], 'T', ' ') as timestamp_ntz)").alias("t1"),
                   _number(F.get("f", F.lit(2))).alias("dt_days"), _number(F.get("f", F.lit(3))).alias("vsr"))
    return out.where((F.col("dt_days") > dt_lo) & (F.col("dt_days") < dt_hi)
                     & F.col("vsr").isNotNull() & F.col("t1").isNotNull())


def read_station_pairs(spark: SparkSession, path: str, dt_lo: float = 0.01, dt_hi: float = 0.1) -> DataFrame:
    return parse_station_pairs(spark.read.text(path), dt_lo=dt_lo, dt_hi=dt_hi)


def station_lines(df: DataFrame) -> DataFrame:
    """Admittance rows as text lines: site, response, sigma, R2, count."""
    return df.select(F.format_string("%s %.3f %.3f %.3f %d", F.col("site"), F.col("mm_per_m"), F.col("sigma"),
                                     F.col("r2"), F.col("n").cast("long")).alias("value"))


def write_station_table(df: DataFrame, path: str, notes: list[str] = ()) -> None:
    """Commented text table, one row per included station (a survey has few)."""
    spark = df.sparkSession
    head = spark.createDataFrame([(0, f"# {n}") for n in [*notes, "site mm_per_m sigma r2 n"]], "k int, value string")
    body = station_lines(df).select(F.lit(1).alias("k"), "value")
    (head.unionByName(body).repartitionByRange(1, "k").sortWithinPartitions("k", "value")
     .select("value").write.mode("overwrite").text(path))


def differing_ranges(a: DataFrame, b: DataFrame, keys: list[str], line: list[str], levels: tuple[int, ...] = (1, 64, 4096)) -> DataFrame:
    """Key ranges in which two builds of a table are not the same: `line` and _range, of the last level's number of ranges a line.

    A tree of checksums: first one for each line, then, of the lines that differ, one for each of 64
    ranges of their keys, then of 4096. A level moves one row per range and task. Ranges nest, being
    remainders of one hash of the key; a checksum is the count and the exact sum of two hashes of the row.
    """
    cols = sorted(a.columns)
    def rows(d: DataFrame) -> DataFrame:
        # A type is part of a value: 1 and 1.0 differ.
        every = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]
        return d.select(*line, F.xxhash64(*keys).alias("_k"), (F.xxhash64(*every).cast("decimal(38,0)") * 4294967296 + F.hash(*every)).alias("_s"))

    def sums(d: DataFrame, m: int, among: DataFrame | None, before: int) -> DataFrame:
        if among is not None:
            d = _semi(d.withColumn("_range", F.pmod("_k", F.lit(before))), among, [*line, "_range"])
        return d.groupBy(*line, F.pmod("_k", F.lit(m)).alias("_range")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_s").alias("_t"))

    bad, before = None, 1
    for m in levels:
        x, y = sums(rows(a), m, bad, before), sums(rows(b), m, bad, before)
        both = x.withColumn("_f", F.lit(1)).unionByName(y.withColumn("_f", F.lit(-1)))
        bad = both.groupBy(*line, "_range").agg(F.sum(F.col("_n") * F.col("_f")).alias("_dn"), F.sum(F.col("_t") * F.col("_f")).alias("_dt"))
        bad = cut_lineage(bad.where("_dn <> 0 or _dt <> 0").select(*line, "_range"))
        before = m
        if bad.isEmpty():
            break
    return bad


def _semi(d: DataFrame, among: DataFrame, cols: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose columns are among others (or not), NULL equal to NULL."""
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_a_{c}"))
    return d.join(among.select(*[F.col(c).alias(f"_a_{c}") for c in cols]), on, how)


def verify_rerun(a: DataFrame, b: DataFrame, keys: list[str], line: list[str], tol: dict[str, float] | None = None, levels: tuple[int, ...] = (1, 64, 4096)) -> DataFrame:
    """`rerun_diff`, joining rows only in the key ranges in which the checksums of the two builds differ; `line` is among the keys, a key has one row.

    Where a column of `a` is lost all rows count, so all are joined. With a tolerance, values that differ
    within it still make their range differ; it is joined and they are found equal.
    """
    if [c for c in a.columns if c not in b.columns]:
        return rerun_diff(a, b, keys, tol)
    b = b.select(*a.columns)
    bad = differing_ranges(a, b, keys, line, levels)
    ranged = lambda d: d.withColumn("_range", F.pmod(F.xxhash64(*keys), F.lit(levels[-1])))
    got = rerun_diff(*[_semi(ranged(d), bad, [*line, "_range"]).drop("_range") for d in (a, b)], keys, tol)
    # What the equal ranges add: no differing row, and a gap of zero where there is a value.
    same = _semi(ranged(a), bad, [*line, "_range"], "left_anti")
    kinds, fields = dict(a.dtypes), [c for c in a.columns if c not in keys]
    zero = same.agg(F.lit(0).alias("_"), *[F.max(F.when(F.col(c).isNotNull(), 0.0)).alias(c) for c in fields if kinds[c] in NUMERIC])
    items = [F.struct(F.lit(c).alias("field"), F.lit(0).cast("long").alias("n_diff"), (F.col(c) if kinds[c] in NUMERIC else F.lit(None).cast("double")).alias("max_abs")) for c in fields]
    items.append(F.struct(F.lit("(rows)").alias("field"), F.lit(0).cast("long").alias("n_diff"), F.lit(None).cast("double").alias("max_abs")))
    base = zero.select(F.explode(F.array(*items)).alias("i")).select("i.*")
    return got.unionByName(base).groupBy("field").agg(F.sum("n_diff").alias("n_diff"), F.max("max_abs").alias("max_abs"))


def rerun_diff(a: DataFrame, b: DataFrame, keys: list[str], tol: dict[str, float] | None = None) -> DataFrame:
    """Compare two builds row by row: per common column, rows that differ and the largest gap.

    Values must be identical (NULL equals NULL) unless `tol` names a tolerance.
    A row or a column lost from `b` counts; a new column in `b` does not.
    """
    tol = tol or {}
    common = [c for c in a.columns if c in b.columns and c not in keys]
    lost = [c for c in a.columns if c not in b.columns]
    kinds = dict(a.dtypes)
    x = a.select(*keys, F.struct(*[F.col(c) for c in common]).alias("_a"))
    y = b.select(*keys, F.struct(*[F.col(c) for c in common]).alias("_b"))
    j = x.join(y, keys, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    items = []
    for c in common:
        u, v = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        num = kinds[c] in NUMERIC
        gap = F.abs(u.cast("double") - v.cast("double")) if num else F.lit(None).cast("double")
        same = u.eqNullSafe(v)
        if c in tol:
            same = same | F.coalesce(gap < tol[c], F.lit(False))
        items.append(F.struct(F.lit(c).alias("field"), (both & ~same).cast("long").alias("d"),
                              F.when(both, gap).alias("g")))
    items.append(F.struct(F.lit("(rows)").alias("field"), (~both).cast("long").alias("d"),
                          F.lit(None).cast("double").alias("g")))
    for c in lost:
        items.append(F.struct(F.lit(f"(lost) {c}").alias("field"), F.lit(1).cast("long").alias("d"),
                              F.lit(None).cast("double").alias("g")))
    return (j.select(F.explode(F.array(*items)).alias("i")).groupBy(F.col("i.field").alias("field"))
            .agg(F.sum("i.d").alias("n_diff"), F.max("i.g").alias("max_abs")))


def without_duplicates(df: DataFrame, catalog: DataFrame) -> DataFrame:
    dup = catalog.where(F.col("duplicate_of").isNotNull()).select("line_id")
    return df.join(dup, "line_id", "left_anti")


def dedupe_passes(passes: DataFrame) -> DataFrame:
    """Distinct traverses over all products: same segment and same rounded mean time.

    `passes` has (product, day_seg, pass_idx, gps_time_s per fix); the first
    product and pass wins. Mean times do not depend on the order of the fixes.
    """
    one = passes.groupBy("product", "day_seg", "pass_idx").agg(
        steady_mean(F.col("gps_time_s")).alias("t_mean"), F.min("gps_time_s").alias("t_start"), F.max("gps_time_s").alias("t_end"))
    first = F.min(F.struct("product", "pass_idx", "t_start", "t_end")).alias("p")
    return (one.withColumn("t_key", F.round("t_mean").cast("long")).groupBy("day_seg", "t_key").agg(first)
            .select("day_seg", "t_key", "p.product", "p.pass_idx", "p.t_start", "p.t_end"))
