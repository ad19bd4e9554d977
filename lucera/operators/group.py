"""Group statistics, contrasts and least squares, by aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucera.functions.optics import chi2_sf_df4


def simple_group(effects: DataFrame, by: list[str]) -> DataFrame:
    """One-sample t of beta over subjects; t is null below two subjects."""
    n, mean, sd = F.count("beta"), F.avg("beta"), F.stddev_samp("beta")
    out = effects.groupBy(*by).agg(n.alias("n_subjects"), mean.alias("beta"), sd.alias("_sd"))
    se = F.col("_sd") / F.sqrt(F.col("n_subjects") + 1e-10)
    return out.withColumn("se", se).withColumn("t_stat", F.when(F.col("n_subjects") >= 2, F.col("beta") / (F.col("se") + 1e-10))).withColumn("df", F.col("n_subjects") - 1).drop("_sd")


def weighted_group(effects: DataFrame, by: list[str]) -> DataFrame:
    """DerSimonian-Laird random effects of (beta, var): two aggregate passes over subjects."""
    ok = effects.filter("beta IS NOT NULL AND var > 0").withColumn("_w", 1 / F.col("var"))
    one = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_subjects"), F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col("beta")).alias("swb"), F.sum(F.col("_w") ** 2).alias("sww"), F.sum(F.col("_w") * F.col("beta") ** 2).alias("swbb")
    )
    q = F.col("swbb") - F.col("swb") ** 2 / F.col("sw")
    c = F.col("sw") - F.col("sww") / F.col("sw")
    tau = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(q - (F.col("n_subjects") - 1), c), F.lit(0.0)))
    one = one.select(*by, "n_subjects", tau.alias("tau_sq"))
    two = ok.join(one, by).withColumn("_r", 1 / (F.col("var") + F.col("tau_sq")))
    out = two.groupBy(*by, "n_subjects", "tau_sq").agg(F.sum("_r").alias("_sr"), F.sum(F.col("_r") * F.col("beta")).alias("_srb"))
    beta, se = F.col("_srb") / F.col("_sr"), F.sqrt(1 / F.col("_sr"))
    return out.select(*by, "n_subjects", "tau_sq", beta.alias("beta"), se.alias("se"), F.when(F.col("n_subjects") >= 2, beta / se).alias("t_stat"), (F.col("n_subjects") - 1).alias("df"))


def glm_average(results: DataFrame, by: list[str]) -> DataFrame:
    """Pools runs or the channels of a region: mean beta, se of the mean, summed df."""
    n = F.count("beta")
    out = results.groupBy(*by).agg(F.avg("beta").alias("beta"), F.sqrt(F.try_divide(F.avg(F.col("se") ** 2), n)).alias("se"), F.sum("df").alias("df"), n.alias("n"))
    return out.withColumn("t_stat", F.try_divide("beta", "se"))


def contrasts(beta: DataFrame, cov: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, regressor, beta), (keys, r_i, r_j, cov), (contrast, regressor, weight) -> beta, se, t."""
    c = beta.join(weights, "regressor").groupBy("contrast", *keys).agg(F.sum(F.col("weight") * F.col("beta")).alias("beta"))
    wi = weights.select("contrast", F.col("regressor").alias("r_i"), F.col("weight").alias("_wi"))
    wj = weights.select(F.col("contrast").alias("_c"), F.col("regressor").alias("r_j"), F.col("weight").alias("_wj"))
    v = cov.join(wi, "r_i").join(wj, ["r_j"]).filter("contrast = _c").groupBy("contrast", *keys).agg(F.sum(F.col("_wi") * F.col("_wj") * F.col("cov")).alias("_v"))
    se = F.sqrt(F.greatest(F.col("_v"), F.lit(1e-15)))
    return c.join(v, ["contrast", *keys]).withColumn("se", se).withColumn("t_stat", F.col("beta") / F.col("se")).drop("_v")


def fdr_bh(p: DataFrame, by=(), order=("p", "id")) -> DataFrame:
    """Benjamini-Hochberg adjusted p_fdr of p within groups."""
    w = Window.partitionBy(*by)
    df = p.withColumn("_m", F.count("p").over(w)).withColumn("_k", F.row_number().over(w.orderBy(*order)))
    raw = F.col("p") * F.col("_m") / F.col("_k")
    down = w.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_raw", raw).withColumn("p_fdr", F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_m", "_k", "_raw")


def combine_hb(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(beta_hbo, beta_hbr, p_hbo, p_hbr) -> Fisher's combined p where HbO rises and HbR falls."""
    chi = -2 * (F.log("p_hbo") + F.log("p_hbr"))
    ok = (F.col("beta_hbo") > 0) & (F.col("beta_hbr") < 0)
    out = pairs.withColumn("beta", F.col("beta_hbo") - F.col("beta_hbr")).withColumn("chi2", chi)
    return out.withColumn("t_stat", F.sqrt("chi2")).withColumn("p_val", F.when(ok, chi2_sf_df4(F.col("chi2"))).otherwise(1.0)).withColumn("is_significant", F.col("p_val") < alpha)


def normal_equations(design: DataFrame, samples: DataFrame, keys=("recording", "channel")) -> tuple[DataFrame, DataFrame]:
    """X'X (recording, r_i, r_j, xx) and X'y (keys, regressor, xy) of a long design (recording,
    frame, regressor, x): joins on the frame and sums that combine map-side."""
    a = design.select("recording", "frame", F.col("regressor").alias("r_i"), F.col("x").alias("_a"))
    b = design.select("recording", "frame", F.col("regressor").alias("r_j"), F.col("x").alias("_b"))
    xx = a.join(b, ["recording", "frame"]).groupBy("recording", "r_i", "r_j").agg(F.sum(F.col("_a") * F.col("_b")).alias("xx"))
    xy = samples.join(design, ["recording", "frame"]).groupBy(*keys, "regressor").agg(F.sum(F.col("x") * F.col("v")).alias("xy"))
    return xx, xy


def sign_flip_t(effects: DataFrame, by: list[str], n_perm: int = 1000, seed: int = 0) -> DataFrame:
    """t of sign patterns of the subjects' beta (a row a subject); pattern 0 is the observed one.
    All 2^n of them for a group of n subjects if that is n_perm at most, in the order of subject;
    else pattern 0 and n_perm - 1 random ones, each sign a bit of the MD5 of seed, pattern and subject."""
    sizes = effects.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.lit(True))
    rows = effects.join(F.broadcast(sizes), same).select(*by, "subject", "beta", "_size")
    most = n_perm.bit_length() - 1  # 2^most <= n_perm
    few, many = rows.filter(F.col("_size") <= most), rows.filter(F.col("_size") > most)
    few = few.withColumn("_k", (F.row_number().over(Window.partitionBy(*by).orderBy("subject")) - 1).cast("int"))
    few = few.withColumn("flip", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, CAST(_size AS INT)) - 1"))))
    few = few.withColumn("_minus", F.getbit("flip", F.col("_k")))
    many = many.withColumn("flip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_perm - 1).cast("long"))))
    many = many.withColumn("_minus", F.when(F.col("flip") == 0, 0).otherwise(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "flip", "subject")), 1, 1), 16, 10).cast("int") % 2))
    x = (1 - 2 * F.col("_minus")) * F.col("beta")
    rows = few.select(*by, "flip", x.alias("_x")).unionByName(many.select(*by, "flip", x.alias("_x")))
    s = rows.groupBy(*by, "flip").agg(F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"), F.count("_x").alias("_n"))
    return s.select(*by, "flip", F.try_divide("_m", F.col("_s") / F.sqrt("_n")).alias("t_stat"))


def p_of_null(null: DataFrame, by: list[str]) -> DataFrame:
    """Share of patterns whose |t| reaches the observed one."""
    seen = null.filter("flip = 0").select(*by, F.abs("t_stat").alias("_o"))
    return null.join(seen, by).groupBy(*by).agg(F.avg((F.abs("t_stat") >= F.col("_o") - 1e-9).cast("int")).alias("p_val"))
