"""Embedding quality: the gate and the six validators, as expressions over an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V

# Shares and thresholds of the validators in the overall score.
PROFILE = {"dimensionality": 0.25, "semantic": 0.25, "distribution": 0.15, "domain": 0.15, "consistency": 0.10, "dependency": 0.10}
OVERALL = 0.75


def ready(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with v (doubles), its mean, population variance and entropy, computed once for all checks."""
    out = df.withColumn("v", V.doubles(F.col(vector))).withColumn("mean", V.mean(F.col("v")))
    return out.withColumn("variance", V.moment(F.col("v"), F.col("mean"), 2)).withColumn("norm", V.norm(F.col("v"))).withColumn("entropy", V.entropy(F.col("v")))


def gate(dim: int) -> Column:
    """The first message that applies."""
    v = F.col("v")
    return (
        F.when(v.isNull() | (F.size(v) == 0), "Empty embedding")
        .when(F.size(v) != dim, "Wrong dimension")
        .when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "Non-finite value")
        .when(F.col("norm") < 0.1, "Embedding magnitude too low")
        .when(F.col("norm") > 1000, "Embedding magnitude too high")
        .when(F.col("variance") < 1e-4, "Embedding variance too low")
        .otherwise("Valid embedding")
    )


def dimensionality(dim: int) -> dict[str, Column]:
    v = F.col("v")
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return {
        "dimension_match": F.size(v) == dim,
        "is_finite": ~bad,
        "not_zero_vector": F.exists(v, lambda x: F.abs(x) > 1e-8),
        "not_constant_vector": F.sqrt("variance") > 1e-8,
        "reasonable_magnitude": (F.col("norm") > 0.01) & (F.col("norm") < 1000),
    }


def skewness() -> Column:
    return F.try_divide(V.moment(F.col("v"), F.col("mean"), 3), F.pow(F.col("variance"), 1.5))


def kurtosis() -> Column:
    return F.try_divide(V.moment(F.col("v"), F.col("mean"), 4), F.col("variance") * F.col("variance")) - 3


def outliers() -> Column:
    return F.size(F.filter("v", lambda x: F.abs(F.try_divide(x - F.col("mean"), F.sqrt("variance"))) > 3))


def distribution(least: int = 64) -> dict[str, Column]:
    """least: how many dimensions suffice (256 for production models)."""
    ordered = F.array_sort("v")
    return {
        "sufficient_dimensions": F.size("v") >= least,
        "no_excessive_outliers": F.try_divide(outliers(), F.size("v")) * 100 < 5,
        "balanced_distribution": V.quantile(ordered, 0.75) - V.quantile(ordered, 0.25) > 1e-6,
        "reasonable_skewness": F.abs(skewness()) < 7,
        "reasonable_kurtosis": F.abs(kurtosis()) < 7,
    }


def no_repeats(window: int = 10) -> Column:
    """No window equals the next one, within a hundredth."""
    v = F.col("v")

    def same(i: Column) -> Column:
        pairs = F.zip_with(F.slice(v, i, window), F.slice(v, i + window, window), lambda a, b: F.abs(a - b) <= 1e-8 + 0.01 * F.abs(b))
        return F.forall(pairs, lambda x: x)

    return F.when(F.size(v) <= 2 * window, True).otherwise(~F.exists(F.sequence(F.lit(1), F.greatest(F.size(v) - 2 * window, F.lit(1))), same))


def consistency() -> dict[str, Column]:
    steps = F.transform(V.differences(F.col("v")), F.abs)
    return {
        "no_repeating_patterns": no_repeats(),
        "sufficient_variance": F.col("variance") > 1e-6,
        "no_extreme_values": F.array_max(F.transform("v", F.abs)) <= 100,
        "smooth_distribution": F.array_max(steps) < 50 * V.mean(steps),
    }


def semantic(complexity: Column, tokens: Column) -> Column:
    ratio = F.col("variance") * 1000 / F.greatest(complexity, F.lit(1))
    dense = F.col("variance") / F.greatest(tokens, F.lit(1))
    return (dense > 1e-6) & (dense * F.col("entropy") > 1e-6) & (ratio > 0.01) & (ratio < 100) & (F.col("variance") > 1e-8)


def alignment(structure: Column, complexity: Column) -> Column:
    """How well the vector's complexity stands to the code's."""
    code = structure + complexity
    ratio = F.try_divide(F.col("variance") * F.col("entropy") * 1000, code)
    return F.when(code == 0, 0.0).when(ratio < 0.1, ratio / 0.1).when(ratio > 10, F.try_divide(F.lit(10.0), ratio)).otherwise(1.0)


def domain(structure: Column, complexity: Column, fits: Column) -> Column:
    positive = V.share(F.col("v"), lambda x: x > 0)
    right = (F.col("variance") > 1e-6) & (F.col("entropy") > 0.1) & (positive > 0.3) & (positive < 1)
    return (structure > 0) & fits & right & (alignment(structure, complexity) > 0.3)


def dependency(declared: Column, detected: Column) -> Column:
    """Nothing declared passes; else something declared must be found in the text."""
    return (F.size(declared) == 0) | (F.size(F.array_intersect(declared, detected)) > 0)


def all_of(checks: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in checks.values():
        out = out & c
    return out


def overall(passed: dict[str, Column], profile: dict[str, float] = PROFILE, threshold: float = OVERALL) -> tuple[Column, Column]:
    """The weighted score, and whether it and all validators pass."""
    score = sum((F.lit(profile[k]) * c.cast("double") for k, c in passed.items()), F.lit(0.0))
    return score, (score >= threshold) & all_of(passed)


# What is recommended, by validator and failed check.
ADVICE = {
    "dimension_match": "Embedding dimension mismatch - check model configuration",
    "not_zero_vector": "Zero vector detected - model may have failed to generate embedding",
    "reasonable_magnitude": "Unusual embedding magnitude: {} - investigate model output",
    "semantic_density": "Low semantic density - consider including more context in embedding_text",
    "complexity_ratio": "Embedding complexity too low for code complexity - model may not capture code structure",
    "no_excessive_outliers": "High outlier percentage detected - embedding may be unstable",
    "has_code_elements": "No code elements detected - ensure chunk contains actual code",
    "language_detected": "Language mismatch - verify chunk language metadata",
    "feature_alignment": "Poor alignment between code and embedding - model may not understand code structure",
    "consistency": "Consistency issues detected - verify model stability across batches",
    "dependency": "Dependencies not well represented - ensure dependency metadata is included in embedding_text",
    None: "All validations passed - embedding quality is good",
}
LEAST = 0.7  # what a single validator must score


def signals(declared: Column, detected: Column) -> dict[str, Column]:
    """Checks of the dependencies that a chunk declares (names, references) and that its code shows."""
    return {
        "has_dependency_info": (F.size(declared) > 0) | (F.size(detected) > 0),
        "dependencies_in_code": F.size(detected) > 0,
        "embedding_has_complexity": F.col("variance") * F.col("entropy") > 1e-6,
    }


def report(rows: DataFrame, dim: int = 64, least_dimensions: int = 64, profile: dict[str, float] = PROFILE, threshold: float = OVERALL) -> DataFrame:
    """rows of ready() with code, language, declared and detected (names), scored by all six validators.

    Adds scores (a struct), overall, passed, rejection_reasons and recommendations.  A validator scores
    1 if it passes, else 0; the vector passes if its overall score and every validator do.
    """
    code = F.col("code")
    # everything that several checks ask for is a column first
    tokens, syntax = T.token_count(code), T.syntax_complexity(code)
    hints = code.contains("import ").cast("int") + code.contains("from ").cast("int")
    branches = F.regexp_count(code, F.lit(r"(?U)\bif\b|\bfor\b|\bwhile\b|\bdef\b|\bclass\b"))
    base = rows.withColumns({"_tokens": tokens, "_syntax": syntax, "_hints": hints, "_branches": branches, "_fits": T.code_features(code, F.col("language"))["language_match"]})
    density = F.col("variance") / F.greatest("_tokens", F.lit(1))
    ratio = F.col("variance") * 1000 / F.greatest("_syntax", F.lit(1))
    checks = {
        "dimensionality": dimensionality(dim),
        "semantic": {},
        "distribution": distribution(least_dimensions),
        "domain": {"has_code_elements": F.col("_hints") > 0, "language_detected": F.col("_fits"), "feature_alignment": alignment(F.col("_hints"), F.col("_branches")) > 0.3},
        "consistency": consistency(),
        "dependency": signals(F.col("declared"), F.col("detected")),
    }
    passed = {name: all_of(own) for name, own in checks.items() if own}
    passed["semantic"] = (F.col("_tokens") > 0) & semantic(F.col("_syntax"), F.col("_tokens"))
    passed["domain"] = domain(F.col("_hints"), F.col("_branches"), F.col("_fits"))
    passed["dependency"] = (F.size("declared") == 0) | passed["dependency"]
    # a validator whose inputs are missing (null) fails
    named = [f"_{v}_{c}" for v, own in checks.items() for c in own]
    flat = base.withColumns({f"_{v}_{c}": F.coalesce(e, F.lit(False)) for v, own in checks.items() for c, e in own.items()} | {f"_ok_{v}": F.coalesce(passed[v], F.lit(False)) for v in checks})
    flat = flat.withColumns({"_thin": F.coalesce(density < 1e-6, F.lit(True)), "_simple": F.coalesce(ratio < 0.01, F.lit(True))})
    ok = {v: F.col(f"_ok_{v}") for v in checks}
    score, good = overall(ok, profile, threshold)

    def failed(v: str, c: str) -> Column:
        return ~ok[v] & ~F.col(f"_{v}_{c}")

    lines = []
    for v, own in checks.items():
        lines.append(F.when(~ok[v], F.lit(f"{v}_validation_failed: score 0.000 below threshold {LEAST}")))
        lines += [F.when(failed(v, c), F.lit(f"  - {v}.{c} failed")) for c in own]
    magnitude = F.concat(*[F.lit(part) if part else F.col("norm").cast("string") for part in (ADVICE["reasonable_magnitude"].split("{}")[0], "", ADVICE["reasonable_magnitude"].split("{}")[1])])
    advice = [
        F.when(failed("dimensionality", "dimension_match"), F.lit(ADVICE["dimension_match"])),
        F.when(failed("dimensionality", "not_zero_vector"), F.lit(ADVICE["not_zero_vector"])),
        F.when(failed("dimensionality", "reasonable_magnitude"), magnitude),
        F.when(~ok["semantic"] & F.col("_thin"), F.lit(ADVICE["semantic_density"])),
        F.when(~ok["semantic"] & F.col("_simple"), F.lit(ADVICE["complexity_ratio"])),
        F.when(failed("distribution", "no_excessive_outliers"), F.lit(ADVICE["no_excessive_outliers"])),
        *[F.when(failed("domain", c), F.lit(ADVICE[c])) for c in checks["domain"]],
        F.when(~ok["consistency"], F.lit(ADVICE["consistency"])),
        F.when(~ok["dependency"], F.lit(ADVICE["dependency"])),
    ]
    found = F.array_compact(F.array(*advice))
    return flat.withColumns(
        {
            "scores": F.struct(*[ok[v].cast("double").alias(v) for v in checks]),
            "overall": F.round(score, 6),
            "passed": good,
            "rejection_reasons": F.when(good, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*lines))),
            "recommendations": F.when(F.size(found) == 0, F.array(F.lit(ADVICE[None]))).otherwise(found),
        }
    ).drop("_tokens", "_syntax", "_hints", "_branches", "_fits", "_thin", "_simple", *named, *[f"_ok_{v}" for v in checks])


def validated(chunks: DataFrame, dim: int = 64, vector: str = "embedding") -> DataFrame:
    """The public form: chunks (code, language, dependencies, references and a vector) with report()'s columns and metadata."""
    empty = F.array().cast("array<string>")
    names = [F.coalesce(F.col(c), empty) for c in ("dependencies", "references") if c in chunks.columns]
    rows = ready(chunks, vector).withColumn("declared", F.concat(*names) if names else empty).withColumn("detected", T.detected_dependencies(F.col("code")))
    about = F.struct(F.current_timestamp().alias("validated_at"), F.size("v").alias("embedding_dimension"), F.col("language").alias("chunk_language"))
    return report(rows, dim).withColumn("validation", about).drop("v", "mean", "variance", "norm", "entropy", "declared", "detected")


def batches(n: int, size: int) -> int:
    """How many batches of a size hold n rows."""
    return -(-n // size)
