"""Exact sparse attention inside a scope, without listing all pairs of the scope."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.vectors import dot, norm, squared_distance, vector_mean
from tidewatch.operators.ordered import running_sums


def _block_of(key: str, bits: int) -> Column:
    """Sign pattern of the first key dimensions: 2^bits blocks per scope at most."""
    code = F.lit(0)
    for i in range(bits):
        code = code + F.when(F.get(key, i) >= 0, 1 << i).otherwise(0)
    return code


def scope_pairs(members: DataFrame, scope: Sequence[str], dims: int, bits: int = 4) -> DataFrame:
    """Candidates that can get a positive attention weight, with the multiplicity of equal keys.

    members: scope columns, row_id, query, key (arrays), null_score. Sparsemax gives no
    weight to a logit at or below the best logit minus one, where the null option also
    counts. Equal keys of a scope are merged first. The rest are put into blocks with
    a center and radius; a block whose upper bound q.c + |q| r stays below the best
    certain logit minus one cannot hold a supporter and is never joined.

    Returns scope, row_id, logit, copies; the row itself is not among the copies.
    """
    scope = list(scope)
    root = F.lit(float(dims) ** 0.5)
    distinct = members.groupBy(*scope, "key").agg(F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("one"))
    blocked = distinct.withColumn("block", _block_of("key", bits))
    centers = blocked.groupBy(*scope, "block").agg(vector_mean(F.col("key"), dims).alias("center"), F.sum("copies").alias("members"))
    sized = blocked.join(centers, [*scope, "block"]).groupBy(*scope, "block", "center", "members").agg(
        F.max(F.sqrt(squared_distance(F.col("key"), F.col("center")))).alias("radius"))
    asked = members.select(*scope, "row_id", "query", "null_score", F.col("key").alias("own_key"), _block_of("key", bits).alias("own_block"))
    # At most 2^bits rows per member.
    bounded = asked.join(sized, scope)
    reach = norm(F.col("query")) * F.col("radius")
    middle = dot(F.col("query"), F.col("center"))
    slack = F.lit(1e-9) * (1 + F.abs(middle) + reach)
    bounded = bounded.withColumns({
        "_upper": (middle + reach + slack) / root,
        # The own row is no candidate, so its block is certain only with a second member.
        "_lower": F.when((F.col("block") != F.col("own_block")) | (F.col("members") > 1), (middle - reach - slack) / root),
    })
    best = bounded.groupBy(*scope, "row_id").agg(F.max("_lower").alias("_certain"))
    kept = bounded.join(best, [*scope, "row_id"])
    floor = F.greatest(F.col("null_score"), F.coalesce("_certain", F.col("null_score"))) - 1
    kept = kept.where(F.col("_upper") > floor).select(*scope, "block", "row_id", "query", "null_score", "own_key")
    pairs = kept.join(blocked, [*scope, "block"])
    own = F.col("key") == F.col("own_key")
    pairs = pairs.withColumns({
        "copies": F.col("copies") - F.when(own, 1).otherwise(0), "logit": dot(F.col("query"), F.col("key")) / root})
    return pairs.where("copies > 0").select(*scope, "row_id", "null_score", "logit", "copies")


def sparse_attention(members: DataFrame, scope: Sequence[str], dims: int, epsilon: float = 1e-8, bits: int = 4) -> DataFrame:
    """Per member: null weight, support size, relevance, effective neighbours, observed intensity.

    Sparsemax over the null option and all other members of the scope.
    """
    scope = list(scope)
    target = [*scope, "row_id"]
    pairs = scope_pairs(members, scope, dims, bits)
    options = pairs.select(*target, "logit", "copies", F.lit(0).alias("null_copies")).unionByName(
        members.select(*target, F.col("null_score").alias("logit"), F.lit(0).cast("long").alias("copies"), F.lit(1).alias("null_copies")))
    steps = options.groupBy(*target, "logit").agg(F.sum("copies").alias("copies"), F.sum("null_copies").alias("null_copies"))
    top = steps.groupBy(*target).agg(F.max("logit").alias("_top"))
    steps = steps.join(top, target).withColumn("z", F.col("logit") - F.col("_top")).where("z > -1")
    n = F.col("copies") + F.col("null_copies")
    steps = running_sums(steps, target, [F.desc("z")], {"_rank": n, "_sum": n * F.col("z")})
    rank, cum = F.col("_rank") + n, F.col("_sum") + n * F.col("z")
    # Within equal logits the condition holds for all or none of the copies.
    supported = 1 + rank * F.col("z") > cum
    size = F.max(F.when(supported, rank))
    mass = F.max_by(cum, F.when(supported, rank))
    tau = steps.groupBy(*target).agg(((mass - 1) / size).alias("_tau"))
    weighed = steps.join(tau, target).withColumn("w", F.greatest(F.lit(0.0), F.col("z") - F.col("_tau")))
    out = weighed.groupBy(*target).agg(
        F.sum(F.col("w") * F.col("null_copies")).alias("null_weight"),
        F.sum(F.when(F.col("w") > 0, F.col("copies")).otherwise(0)).alias("support_size"),
        F.sum(F.col("w") * F.col("w") * F.col("copies")).alias("_squares"))
    relevance = 1 - F.col("null_weight")
    effective = relevance * relevance / (F.col("_squares") + epsilon)
    return out.select(*target, "null_weight", "support_size", relevance.alias("relevance"), effective.alias("effective_neighbors"),
                      F.log1p(relevance * effective).alias("observed_intensity"))
