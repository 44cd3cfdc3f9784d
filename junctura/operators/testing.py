"""Differential testing between two groups of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cap_outliers(df: DataFrame, row: str, value: str, factor: str | None, times: float) -> DataFrame:
    """``capped``: values above p75 + times * IQR of the row's log2(x / factor + 1) come down to it."""
    sf = F.col(factor) if factor else F.lit(1.0)
    logged = df.withColumn("__l", F.log2(F.col(value) / sf + 1))
    q = logged.groupBy(row).agg(F.percentile("__l", F.lit(0.25)).alias("__q1"), F.percentile("__l", F.lit(0.75)).alias("__q3"))
    top = F.col("__q3") + times * (F.col("__q3") - F.col("__q1"))
    out = logged.join(q, row)
    capped = F.when((F.col("__q3") > F.col("__q1")) & (F.col("__l") > top), (F.pow(F.lit(2.0), top) - 1) * sf).otherwise(F.col(value))
    return out.withColumn("capped", capped).drop("__l", "__q1", "__q3")


def response(event_counts: DataFrame, gene_counts: DataFrame, event_sf: DataFrame, gene_sf: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each event and form: event_id, form, y, sf and in_a as arrays in group and sample order.

    event_counts: event_id, gene_id, form, sample_id, n.  gene_counts: gene_id,
    sample_id, raw_count.  groups: sample_id, in_a.  Samples are few, so an array
    holds one event's samples only; gene counts are rounded as rint(x + 0.5)."""
    order = F.struct(F.when(F.col("in_a"), 0).otherwise(1).alias("g"), F.col("sample_id"), F.col("n").cast("double").alias("n"), F.rint(F.coalesce(F.col("raw_count"), F.lit(0.0)) + 0.5).alias("x"), F.col("event_sf"), F.col("gene_sf"))
    small = groups.join(event_sf.select("sample_id", F.col("sf").alias("event_sf")), "sample_id").join(gene_sf.select("sample_id", F.col("sf").alias("gene_sf")), "sample_id")
    rows = event_counts.join(F.broadcast(small), "sample_id").join(gene_counts.select("gene_id", "sample_id", "raw_count"), ["gene_id", "sample_id"], "left")
    packed = rows.groupBy("event_id", "gene_id", "form").agg(F.sort_array(F.collect_list(order)).alias("s"))
    get = lambda f: F.transform("s", lambda x: x[f])
    return packed.select("event_id", "gene_id", "form", F.concat(get("n"), get("x")).alias("y"), F.concat(get("event_sf"), get("gene_sf")).alias("sf"), F.transform("s", lambda x: (x["g"] == 0).cast("double")).alias("in_a"))


def means(packed: DataFrame) -> DataFrame:
    """For each row of :func:`response`: counts over size factors of events and genes, their means in either group, log2 fold changes."""
    c = F.col
    half = F.size("in_a")
    scaled = packed.withColumn("z", F.transform(F.arrays_zip("y", "sf"), lambda x: x["y"] / x["sf"]))
    each = scaled.withColumn("event_counts", F.slice("z", F.lit(1), half)).withColumn("gene_counts", F.slice("z", half + 1, half))

    def mean(values: str, in_a: int) -> Column:
        of = F.filter(F.arrays_zip(c(values).alias("v"), c("in_a").alias("g")), lambda x: x["g"] == in_a)
        return F.try_divide(F.aggregate(of, F.lit(0.0), lambda s, x: s + x["v"]), F.size(of))

    out = each
    for values, name in (("event_counts", "event_count"), ("gene_counts", "gene_exp")):
        out = out.withColumn(f"mean_{name}_A", mean(values, 1)).withColumn(f"mean_{name}_B", mean(values, 0))
        out = out.withColumn(f"log2FC_{name}", F.log2(f"mean_{name}_A") - F.log2(f"mean_{name}_B"))
    return out.drop("y", "sf", "in_a", "z")


def _mapped(df: DataFrame, schema: str, one) -> DataFrame:
    import pandas as pd

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([one(r) for r in batch.itertuples(index=False)], columns=[c.split()[0] for c in schema.split(", ")])

    return df.mapInPandas(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's checkpoint folder, so that no later plan computes it again."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or "file:///tmp/checkpoints/junctura")
    return df.checkpoint()


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation of a column without nulls: near ones bound the few rows that are sorted."""
    n, out = df.count(), []
    for share in shares:
        at = share * (n - 1)
        k, part = int(at), at - int(at)
        low, high = (None, None) if n <= 10_000 else df.approxQuantile(value, [max(0.0, share - 0.002), min(1.0, share + 0.002)], 0.001)
        near, before = df, 0
        if low is not None:
            near, before = df.where(F.col(value).between(low, high)), df.where(F.col(value) < low).count()
        rows = [r[0] for r in near.select(value).orderBy(value).limit(k - before + 2).offset(max(0, k - before)).collect()]
        out.append(rows[0] + part * ((rows[1] if len(rows) > 1 else rows[0]) - rows[0]))
    return out


def trend(raw: DataFrame, samples: int, columns: int = 4, least: float = 0.1) -> tuple[float, float, float, float]:
    """(l0, l1, low, prior) from mean, disp (null: none) and ok of each row.

    dispersion = l0 / mean + l1 by a Gamma regression with identity link: each round is
    one aggregation of five sums.  ``low`` stands for missing dispersions.  The prior is
    the variance of the logarithms around the trend, by their median absolute deviation."""
    import numpy as np

    from junctura.functions import nbglm

    good = raw.where("ok AND disp IS NOT NULL").select("mean", "disp")
    distinct = good.select("disp").distinct()
    if distinct.isEmpty():
        return 0.0, 0.0, 0.0, least
    low, high = quantiles(distinct, "disp", [0.01, 0.99])
    used = good.where((F.col("disp") > low) & (F.col("disp") < high) & (F.col("mean") > 0)).select((1 / F.col("mean")).alias("x"), F.col("disp").alias("y"))
    if used.limit(2).count() < 2:
        l0, l1 = 0.0, quantiles(good, "disp", [0.5])[0]
    else:
        beta, mu = np.zeros(2), F.col("y")
        for _ in range(100):
            w = 1 / (mu * mu)
            xx, x1, xy, one, y = used.agg(F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("y")), F.sum(w), F.sum(w * F.col("y"))).first()
            new = np.linalg.lstsq(np.array([[xx, x1], [x1, one]]), np.array([xy, y]), rcond=None)[0]
            mu = F.greatest(F.col("x") * float(new[0]) + float(new[1]), F.lit(1e-8))
            done = np.allclose(new, beta, rtol=1e-8, atol=1e-12)
            beta = new
            if done:
                break
        l0, l1 = map(float, beta)
    fitted = F.when(F.col("mean") > 0, l0 / F.col("mean") + l1) if (l0, l1) != (0.0, 0.0) else F.lit(None).cast("double")
    filled = F.coalesce("disp", F.lit(low))
    gap = raw.select("mean", filled.alias("d"), fitted.alias("f")).where("d > 0 AND f > 0").select((F.ln("d") - F.ln("f")).alias("gap"))
    if gap.isEmpty():
        return l0, l1, low, least
    middle = quantiles(gap, "gap", [0.5])[0]
    mad = 1.4826 * quantiles(gap.select(F.abs(F.col("gap") - middle).alias("far")), "far", [0.5])[0]
    return l0, l1, low, max(mad * mad - nbglm.trigamma((samples - columns) / 2), least)


def differential(rows: DataFrame, min_count: float = 10, max_zero: float = 0.5) -> DataFrame:
    """event_id, gene_id, form, p, disp_raw, disp_adj from the rows of :func:`response`.

    Dispersions and tests run in tasks over the events, each dispersion once; the trend
    takes a few aggregations.  Of an event's two forms the one with the larger p is
    reported; without any, p = 1."""
    import numpy as np

    from junctura.functions import nbglm

    kinds = dict(rows.dtypes)
    key = ", ".join(f"{c} {kinds[c]}" for c in ("event_id", "gene_id", "form"))

    def first(r):
        y, sf, x = np.array(r.y), np.array(r.sf), nbglm.design(np.array(r.in_a))
        d, ok = nbglm.raw_dispersion(y, sf, x, min_count)
        return r.event_id, r.gene_id, r.form, float((y / sf).mean()), None if np.isnan(d) else d, bool(ok), len(y), r.y, r.sf, r.in_a

    data = "y array<double>, sf array<double>, in_a array<double>"
    raw = cut(_mapped(rows.select("event_id", "gene_id", "form", "y", "sf", "in_a"), f"{key}, mean double, disp double, ok boolean, n long, {data}", first))
    head = raw.select("n").first()
    l0, l1, low, prior = trend(raw.select("mean", "disp", "ok"), head[0] if head else 0)

    def second(r):
        y, sf, in_a = np.array(r.y), np.array(r.sf), np.array(r.in_a)
        start = r.disp if r.disp is not None and not np.isnan(r.disp) else low
        fitted = l0 / r.mean + l1 if r.mean > 0 else np.nan
        d, _ = nbglm.adjusted_dispersion(y, sf, nbglm.design(in_a), start, fitted, prior)
        p = nbglm.ratio_test(y, sf, in_a, d, max_zero)
        clean = lambda v: None if v is None or np.isnan(v) else float(v)
        return r.event_id, r.gene_id, r.form, clean(p), clean(r.disp), clean(d)

    tested = _mapped(raw.select("event_id", "gene_id", "form", "y", "sf", "in_a", "mean", "disp"), f"{key}, p double, disp_raw double, disp_adj double", second)
    best = tested.groupBy("event_id", "gene_id").agg(F.max(F.struct(F.col("p").isNotNull().alias("has"), F.col("p"), (-F.col("form")).alias("f"), "disp_raw", "disp_adj")).alias("b"))
    return best.select("event_id", "gene_id", (-F.col("b.f")).cast("int").alias("form"), F.coalesce("b.p", F.lit(1.0)).alias("p"), "b.disp_raw", "b.disp_adj")
