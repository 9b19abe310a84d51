"""Queries for projections, slices, casts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import paths, sql, vectors
from brindle.plans.registry import query
from brindle.plans.tables import DESCRIPTORS, IMAGES, descriptors, images, read

#: Each descriptor beside the next one.
PAIRS = f"{DESCRIPTORS}, pairs AS (SELECT a.kp_id, a.vec AS a, b.vec AS b FROM descriptors a JOIN descriptors b ON b.kp_id = a.kp_id + 1)"
SHARES = f"""{PAIRS}, abs_pairs AS (SELECT kp_id, [abs(x) for x in a] AS a, [abs(x) for x in b] AS b FROM pairs),
 shares AS (SELECT kp_id, [x / list_sum(a) for x in a] AS a, [x / list_sum(b) for x in b] AS b FROM abs_pairs)"""


def pairs(spark, sf_dir):
    d = descriptors(spark, sf_dir).select("kp_id", "vec")
    return d.select("kp_id", F.col("vec").alias("a")).join(d.select((F.col("kp_id") - 1).alias("kp_id"), F.col("vec").alias("b")), "kp_id")


def shares(spark, sf_dir):
    absolute = lambda c: vectors.normalise_l1(F.transform(c, lambda x: F.abs(x)))
    return pairs(spark, sf_dir).select("kp_id", absolute("a").alias("a"), absolute("b").alias("b"))


def _pairwise(name: str, column, sql: str, frame=pairs, source: str = PAIRS):
    @query(name, f"WITH {source} SELECT kp_id, round({sql}, 6) AS value FROM {'shares' if source is SHARES else 'pairs'}")
    def run(spark, sf_dir):
        return frame(spark, sf_dir).select("kp_id", F.round(column(F.col("a"), F.col("b")), 6).alias("value"))


SQUARED = "list_sum([(a[i] - b[i]) * (a[i] - b[i]) for i in range(1, len(a) + 1)])"
KL = "list_sum([CASE WHEN {p}[i] > 0 THEN CASE WHEN {q}[i] > 0 THEN {p}[i] * ln({p}[i] / {q}[i]) ELSE 1e20 END ELSE 0 END for i in range(1, len({p}) + 1)])"
MEAN = "[0.75 * a[i] + 0.25 * b[i] for i in range(1, len(a) + 1)]"
_pairwise("x7_squared_distance", vectors.squared_distance, SQUARED)
_pairwise("x8_distance", vectors.distance, f"sqrt({SQUARED})")
_pairwise("x9_dot", vectors.dot, "list_sum([a[i] * b[i] for i in range(1, len(a) + 1)])")
_pairwise("x13_expanded_distance", vectors.expanded_distance, SQUARED)
_pairwise("x14_exponential_kernel", lambda a, b: vectors.exponential_kernel(a, b, 1.5), f"exp(0.5 * {SQUARED} / 2.25)")
_pairwise("x15_polynomial_kernel", lambda a, b: vectors.polynomial_kernel(a, b, 1.0, 2), "pow(list_sum([a[i] * b[i] for i in range(1, len(a) + 1)]) + 1.0, 4)")
_pairwise("x11_kl_divergence", vectors.kl, f"least({KL.format(p='a', q='b')}, 1e20)", shares, SHARES)
_pairwise("x11_kl_smoothed", lambda a, b: vectors.kl_smoothed(a, b, 0.5), f"least(list_sum([a[i] * ln(a[i] / ((b[i] + 0.5 / len(b)) / 1.5)) for i in range(1, len(a) + 1) if a[i] > 0]), 1e20)", shares, SHARES)
_pairwise("x12_js_divergence", lambda a, b: vectors.js(a, b, F.lit(3.0), F.lit(1.0)), f"0.75 * {KL.format(p='a', q=f'({MEAN})')} + 0.25 * {KL.format(p='b', q=f'({MEAN})')}", shares, SHARES)


@query("x10_normalised", f"WITH {DESCRIPTORS} SELECT kp_id, [round(x / list_sum([abs(y) for y in vec]), 6) + 0.0 for x in vec] AS l1, [round(x / sqrt(list_sum([y * y for y in vec])), 6) + 0.0 for x in vec] AS l2 FROM descriptors")
def x10(spark, sf_dir):
    rounded = lambda v: F.transform(v, lambda x: F.round(x, 6) + 0.0)
    return descriptors(spark, sf_dir).select("kp_id", rounded(vectors.normalise_l1(F.col("vec"))).alias("l1"), rounded(vectors.normalise_l2(F.col("vec"))).alias("l2"))


@query("x7_x9_sql_functions", f"WITH {PAIRS} SELECT kp_id, round({SQUARED}, 6) AS squared, round(sqrt({SQUARED}), 6) AS distance, round(list_sum([a[i] * b[i] for i in range(1, len(a) + 1)]), 6) AS dot FROM pairs")
def x7_sql(spark, sf_dir):
    """The functions as a user of SQL calls them."""
    sql.register(spark)
    return spark.sql("SELECT kp_id, round(vec_squared_distance(a, b), 6) AS squared, round(vec_distance(a, b), 6) AS distance, round(vec_dot(a, b), 6) AS dot FROM {pairs}", pairs=pairs(spark, sf_dir))


@query(
    "x10_x12_sql_functions",
    f"""WITH {SHARES} SELECT kp_id, [round(x, 6) for x in a] AS l1, [round(x / sqrt(list_sum([y * y for y in a])), 6) for x in a] AS l2, round(least({KL.format(p='a', q='b')}, 1e20), 6) AS kl,
    round(least(list_sum([a[i] * ln(a[i] / ((b[i] + 0.5 / len(b)) / 1.5)) for i in range(1, len(a) + 1) if a[i] > 0]), 1e20), 6) AS smoothed,
    round(0.75 * {KL.format(p='a', q=f'({MEAN})')} + 0.25 * {KL.format(p='b', q=f'({MEAN})')}, 6) AS js FROM shares""",
)
def x10_sql(spark, sf_dir):
    sql.register(spark)
    text = """WITH absolute AS (SELECT kp_id, transform(a, x -> abs(x)) AS a, transform(b, x -> abs(x)) AS b FROM {pairs}),
      shares AS (SELECT kp_id, vec_normalise_l1(a) AS a, vec_normalise_l1(b) AS b FROM absolute)
    SELECT kp_id, transform(a, x -> round(x, 6)) AS l1, transform(vec_normalise_l2(a), x -> round(x, 6)) AS l2,
      round(vec_kl(a, b), 6) AS kl, round(vec_kl_smoothed(a, b, 0.5D), 6) AS smoothed, round(vec_js(a, b, 3D, 1D), 6) AS js FROM shares"""
    return spark.sql(text, pairs=pairs(spark, sf_dir))


@query("a24_row_norms", f"""WITH {DESCRIPTORS} SELECT kp_id, round(list_sum([abs(x) for x in vec]), 6) AS l1, round(list_sum([x * x for x in vec]), 6) AS l2_squared,
    round(list_sum([CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END for x in vec]), 6) AS entropy FROM descriptors""")
def a24(spark, sf_dir):
    v = F.col("vec")
    return descriptors(spark, sf_dir).select("kp_id", F.round(vectors.l1(v), 6).alias("l1"), F.round(vectors.dot(v, v), 6).alias("l2_squared"), F.round(vectors.entropy_norm(v), 6).alias("entropy"))


@query(
    "x1_x2_x3_path_parts",
    """SELECT page_id, CASE WHEN len(p) > 1 THEN p[-2] ELSE '' END AS category, split_part(CASE WHEN len(p) > 1 THEN p[-2] ELSE '' END, '_', 1) AS type, regexp_replace(p[-1], '\\.[^.]*$', '') AS base
    FROM (SELECT page_id, string_split(url, CASE WHEN contains(url, '/') THEN '/' ELSE '\\' END) AS p FROM pages)""",
)
def path_parts(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", paths.category(url).alias("category"), paths.object_type(url).alias("type"), paths.base_name(url).alias("base"))


@query("x4_moved_paths", f"WITH {IMAGES} SELECT fid, CASE WHEN starts_with(path, '/src1') THEN '/segments' || substr(regexp_replace(path, '\\.[^./\\\\]*$', ''), 6) || '_g2.ppm' END AS path FROM images")
def moved(spark, sf_dir):
    return images(spark, sf_dir).select("fid", paths.moved(F.col("path"), "/src1", "/segments", "_g2.ppm").alias("path"))


@query(
    "x5_x6_name_matches",
    f"""WITH {IMAGES}, n AS (SELECT fid, path, '/q/' || CAST(fid // 10 AS VARCHAR) || '.jpg' AS asked, '/crop' || CASE fid % 4 WHEN 0 THEN '5' WHEN 1 THEN '50' WHEN 2 THEN '90' ELSE '1' END || '/' || CAST(fid // (10 + fid % 2) AS VARCHAR) || '_' || fid || '.jpg' AS found FROM images)
    SELECT fid, fid // (10 + fid % 2) = fid // 10 AS is_match,
     CASE WHEN fid // (10 + fid % 2) = fid // 10 THEN 1 ELSE -1 END * CASE fid % 4 WHEN 0 THEN {paths.CROPS['crop5']} WHEN 1 THEN {paths.CROPS['crop50']} WHEN 2 THEN {paths.CROPS['crop90']} ELSE 1 END AS crop FROM n""",
)
def name_matches(spark, sf_dir):
    size = F.when(F.expr("fid % 4 = 0"), "5").when(F.expr("fid % 4 = 1"), "50").when(F.expr("fid % 4 = 2"), "90").otherwise("1")
    found = F.concat(F.lit("/crop"), size, F.lit("/"), F.expr("cast(fid div (10 + fid % 2) as string)"), F.lit("_"), F.col("fid").cast("string"), F.lit(".jpg"))
    asked = F.concat(F.lit("/q/"), F.expr("cast(fid div 10 as string)"), F.lit(".jpg"))
    return images(spark, sf_dir).select("fid", paths.is_match(found, asked).alias("is_match"), paths.crop_class(found, asked).alias("crop"))


@query("x16_packed_rgb", "SELECT l_orderkey, l_linenumber, CAST((l_partkey % 256) * 65536 + (l_suppkey % 256) * 256 + CAST(l_quantity AS BIGINT) % 256 AS BIGINT) AS rgb FROM lineitem")
def rgb(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vectors.packed_rgb(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_quantity").cast("long") % 256).alias("rgb"))


@query("p1_vector_slice", f"WITH {DESCRIPTORS} SELECT kp_id, [round(x, 6) for x in vec] AS vec FROM descriptors WHERE kp_id BETWEEN 100 AND 299")
def p1(spark, sf_dir):
    from brindle.operators.slicing import vector_slice

    return vector_slice(descriptors(spark, sf_dir), 100, 200).select("kp_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("p2_info_slice", f"WITH {DESCRIPTORS} SELECT kp_id - 100 AS kp_id, fid FROM descriptors WHERE kp_id BETWEEN 100 AND 299")
def p2(spark, sf_dir):
    from brindle.operators.slicing import info_slice

    return info_slice(descriptors(spark, sf_dir).select("kp_id", "fid"), 100, 200)


@query("p3_element_cast", f"WITH {DESCRIPTORS} SELECT kp_id, [CAST(CAST(trunc(abs(x) * 512) AS INTEGER) AS FLOAT) for x in vec] AS vec FROM descriptors")
def p3(spark, sf_dir):
    small = descriptors(spark, sf_dir).select("kp_id", F.transform("vec", lambda x: (F.abs(x) * 512).cast("int")).alias("vec"))
    return small.select("kp_id", F.transform("vec", lambda x: x.cast("float")).alias("vec"))


@query("p4_text_matrix", f"WITH {DESCRIPTORS} SELECT kp_id, array_to_string([CAST(trunc(x * 512) AS INTEGER) for x in vec], ' ') AS line FROM descriptors WHERE kp_id >= 50")
def p4(spark, sf_dir):
    from brindle.operators.slicing import text_rows

    scaled = descriptors(spark, sf_dir).select("kp_id", F.transform("vec", lambda x: x * 512).alias("vec"))
    return text_rows(scaled, 50, 0)
