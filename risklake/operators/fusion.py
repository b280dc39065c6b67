"""Evidence fusion and consensus."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklake.functions.scalars import clamp, half_up

#: Reference model: mass of a severity; fixed.
SEVERITY_MASS = {"critical": 0.95, "high": 0.80, "medium": 0.60, "low": 0.40, "none": 0.05}
WEIGHT = {"critical": 4.0, "high": 2.0, "medium": 1.0, "low": 0.5}


def _r4(x: Column) -> Column:
    """4 decimals, halves up. The 9 decimals before are plain arithmetic: F.round goes through big decimals."""
    return half_up(F.rint(x * 1e9) / 1e9, 4)


def mass(confidence: Column, reliability: Column, count: Column, severity: Column) -> Column:
    """Masses for vulnerable (v), not vulnerable (n) and unknown (u), 4 decimals."""
    c, r = clamp(confidence, 0.0, 100.0) / 100, clamp(reliability, 0.0, 1.0)
    base = F.coalesce(F.create_map(*[F.lit(x) for pair in SEVERITY_MASS.items() for x in pair])[severity], F.lit(0.3))
    v = c * r * base * F.least(F.lit(1.0), count / 5)
    n = F.greatest(F.lit(0.01), (1 - c) * r * 0.5)
    u = F.greatest(F.lit(0.02), 1 - v - n)
    return F.struct(_r4(v).alias("v"), _r4(n).alias("n"), _r4(u).alias("u"), reliability.cast("double").alias("r"))


def evidence_mass(issues: DataFrame) -> DataFrame:
    """Adds masses: of the static, the dynamic and the model's evidence, in this order."""
    sev, conf, one = F.col("severity"), F.col("confidence").cast("double"), F.lit(1.0)
    located = F.col("file_path").isNotNull() & F.col("line_number").isNotNull()
    static = mass(F.when(F.col("source_evidence").isin("static", "deep_scan"), conf).otherwise(conf * 0.7), F.when(located, 0.90).otherwise(0.70), one, sev)
    dynamic = mass(F.when(F.col("has_repro"), F.least(F.lit(100.0), conf + 5)).otherwise(20.0), F.when(F.col("has_repro"), 0.85).otherwise(0.40), one, sev)
    model = mass(conf, F.when(F.col("source_evidence") == "ai_reasoning", 0.60).otherwise(0.45), F.lit(1.0), sev)
    return issues.withColumn("masses", F.array(static, dynamic, model))


def combine(a: Column, b: Column) -> Column:
    """Dempster's rule for two masses, rounded to 4 decimals; total conflict leaves all unknown."""
    left = 1 - (a["v"] * b["n"] + a["n"] * b["v"])
    v = a["v"] * b["v"] + a["v"] * b["u"] + a["u"] * b["v"]
    n = a["n"] * b["n"] + a["n"] * b["u"] + a["u"] * b["n"]
    share = lambda x, none: F.when(left > 0, _r4(x / left)).otherwise(F.lit(none))
    return F.struct(share(v, 0.0).alias("v"), share(n, 0.0).alias("n"), share(a["u"] * b["u"], 1.0).alias("u"))


def fuse(masses: Column) -> Column:
    """Ordered fold of an array of masses; reliability discounts each first. The order matters, since every step rounds."""
    weighed = F.transform(masses, lambda m: F.struct((m["v"] * m["r"]).alias("v"), (m["n"] * m["r"]).alias("n"), F.greatest(F.lit(0.02), 1 - (m["v"] + m["n"]) * m["r"]).alias("u")))
    return F.aggregate(F.slice(weighed, F.lit(2), F.size(weighed)), F.element_at(weighed, 1), combine)


def _fused(issues: DataFrame) -> DataFrame:
    """Adds _v, _n, _u, the fold of three masses in their order, and _k, the mean conflict of all pairs. The fold is written out
    in columns, a step of it a projection, so it runs in generated code; fuse() is the same for any number of masses."""
    names = [f"_{c}{k}" for k in (1, 2, 3) for c in "vnu"]
    weighed = []
    for k in range(3):
        m = F.col("masses")[k]
        weighed += [m["v"] * m["r"], m["n"] * m["r"], F.greatest(F.lit(0.02), 1 - (m["v"] + m["n"]) * m["r"])]
    steps = issues.select("*", *[x.alias(n) for n, x in zip(names, weighed, strict=True)])
    product = lambda a, b: F.col(a) * F.col(b)

    def step(df: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
        (av, an, au), (bv, bn, bu) = a, b
        df = df.withColumn("_left", 1 - (product(av, bn) + product(an, bv)))
        share = lambda x, none: F.when(F.col("_left") > 0, _r4(x / F.col("_left"))).otherwise(F.lit(none))
        both = [product(av, bv) + product(av, bu) + product(au, bv), product(an, bn) + product(an, bu) + product(au, bn), product(au, bu)]
        return df.withColumns({n: share(x, none) for n, x, none in zip(out, both, (0.0, 0.0, 1.0), strict=True)}).drop("_left")

    one, two, three = (tuple(names[k : k + 3]) for k in (0, 3, 6))
    steps = step(step(steps, one, two, ("_v", "_n", "_u")), ("_v", "_n", "_u"), three, ("_fv", "_fn", "_fu"))
    clash = lambda a, b: product(a[0], b[1]) + product(a[1], b[0])
    steps = steps.withColumn("_k", _r4((clash(one, two) + clash(one, three) + clash(two, three)) / 3))
    return steps.select(*issues.columns, F.col("_fv").alias("_v"), F.col("_fn").alias("_n"), F.col("_fu").alias("_u"), "_k")


def ds_fusion(issues: DataFrame) -> DataFrame:
    """issues with three masses -> belief, plausibility, conflict, uncertainty, confidence, verdict."""
    fused = _fused(issues)
    total = F.col("_v") + F.col("_n") + F.col("_u")
    fused = fused.withColumns({"_b": F.when(total > 0, F.col("_v") / total).otherwise(0.0), "_w": F.when(total > 0, F.col("_u") / total).otherwise(0.0)})
    belief, plausibility = F.col("_b"), F.col("_b") + F.col("_w")
    verdict = (
        F.when(F.col("_k") > 0.95, "inconclusive").when(belief >= 0.90, "vulnerable").when(belief >= 0.70, "likely_vulnerable").when(plausibility < 0.15, "safe").when(plausibility < 0.35, "likely_safe").otherwise("inconclusive")
    )
    confidence = clamp(half_up(F.rint(belief * (1 - F.col("_w") * 0.5) * 100 * 1e6) / 1e6), 0, 100)
    return fused.select(
        *[c for c in issues.columns if c != "masses"], _r4(belief).alias("belief"), _r4(plausibility).alias("plausibility"), F.col("_k").alias("conflict"), _r4(F.col("_w")).alias("uncertainty"), confidence.cast("long").alias("fused_confidence"), verdict.alias("verdict")
    )


def ds_scan(fused: DataFrame) -> DataFrame:
    """Per scan: mean belief and conflict, verdicts, and the confidence weighted by severity (as meant, and unweighted over the weights)."""
    w = F.create_map(*[F.lit(x) for pair in WEIGHT.items() for x in pair])[F.col("severity")]
    c = F.col("fused_confidence")
    return fused.groupBy("scan_id").agg(
        _r4(F.avg("belief")).alias("belief"),
        _r4(F.avg("plausibility")).alias("plausibility"),
        _r4(F.avg("conflict")).alias("conflict"),
        F.count_if(F.col("verdict") == "vulnerable").alias("vulnerable"),
        F.count_if(F.col("verdict") == "likely_vulnerable").alias("likely_vulnerable"),
        half_up(F.round(F.avg("fused_confidence"), 6)).alias("mean_confidence"),
        half_up(F.round(F.sum(c * w) / F.sum(w), 6)).alias("weighted_confidence"),
        half_up(F.round(F.sum(c) / F.sum(w), 6)).alias("weighted_confidence_ref"),
    )


def ds_group(rows: DataFrame, keys: list[str], order: list[str], mass_column: str = "mass") -> DataFrame:
    """Fuses all reports of the same finding in order."""
    told = F.transform(F.array_sort(F.collect_list(F.struct(*order, mass_column))), lambda x: x[mass_column])
    fused = rows.groupBy(*keys).agg(told.alias("_m")).withColumn("_f", fuse(F.col("_m")))
    return fused.select(*keys, F.size("_m").alias("reports"), _r4(F.col("_f.v")).alias("v"), _r4(F.col("_f.n")).alias("n"), _r4(F.col("_f.u")).alias("u"))


def debate(findings: DataFrame) -> DataFrame:
    """Agents' consensus on injection and authentication findings; a user or payment flow makes them critical."""
    grave = F.col("category").rlike("Injection|Auth")
    people = F.coalesce(F.lower("description").rlike("user|payment"), F.lit(False))
    escalated = F.when(grave & people, "critical").otherwise(F.col("severity"))
    step = F.when(people, 0.2).otherwise(-0.1) + F.when(escalated == "critical", 0.2).otherwise(0.0)
    score = clamp(F.round(F.when(grave, 0.5 + step).otherwise(0.6), 6), 0.0, 1.0)
    return findings.withColumn("consensus", score).withColumn("escalated", escalated).withColumn("regression", F.when(escalated == "critical", 0.65).otherwise(0.25))


def ds_udaf():
    """The same fold as a grouped-aggregate Arrow UDF: an array of v, n, u and the number of reports, from rows of one group in any order."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<double>")
    def fold(seq: pa.Array, v: pa.Array, n: pa.Array, u: pa.Array, r: pa.Array) -> pa.Scalar:
        rows = sorted(zip(*(c.to_pylist() for c in (seq, v, n, r)), strict=True))
        r4 = lambda x: math.floor(round(x, 9) * 10_000 + 0.5) / 10_000
        state = None
        for _, v1, n1, r1 in rows:
            b = (v1 * r1, n1 * r1, max(0.02, 1 - (v1 + n1) * r1))
            if state is None:
                state = b
                continue
            left = 1 - (state[0] * b[1] + state[1] * b[0])
            if left <= 0:
                state = (0.0, 0.0, 1.0)
                continue
            state = (r4((state[0] * b[0] + state[0] * b[2] + state[2] * b[0]) / left), r4((state[1] * b[1] + state[1] * b[2] + state[2] * b[1]) / left), r4(state[2] * b[2] / left))
        return pa.scalar([*map(float, state), float(len(rows))], pa.list_(pa.float64()))

    return fold
