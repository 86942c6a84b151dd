"""Work, memory and pressure proxies from a length table and a parameter table.

Summed over a group of request lengths every proxy is a polynomial of degree two
in the length, so count, sum, sum of squares and maximum per group are enough:
the request table is aggregated once (map-side) and never joined row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import finite, positive, safe_ratio


def c(name: str) -> Column:
    return F.col(name).cast("double")


def projection_work(length: Column, hidden: Column, heads: Column, kv_heads: Column, head_dim: Column) -> Column:
    """Multiply-add count of query, key, value and output projections (linear in length)."""
    return 4 * length * hidden * head_dim * (heads + kv_heads)


def attention_work(square: Column, heads: Column, head_dim: Column) -> Column:
    """Score and mix work; ``square`` is the length squared (or a sum of squares)."""
    return 4 * heads * head_dim * square


def mlp_work(length: Column, hidden: Column, width: Column, gated: Column, experts: Column | None = None,
             shared: Column | None = None, shared_width: Column | None = None) -> Column:
    factor = F.when(gated, 6.0).otherwise(4.0)
    routed = width if experts is None else width * experts
    extra = F.lit(0.0) if shared is None else F.when(shared > 0, shared * shared_width).otherwise(0.0)
    return factor * length * hidden * (routed + extra)


def cache_bytes(length: Column, layers: Column, kv_heads: Column, head_dim: Column, element_bytes: Column) -> Column:
    return 2 * layers * kv_heads * head_dim * length * element_bytes


def weight_bytes(params: Column, bits: Column) -> Column:
    return params * bits / 8


def per_unit(value: Column, units: Column, data_parallel: Column | None = None) -> Column:
    """value / units, or / (units / dp) where the value is replicated per replica; units must divide by dp."""
    if data_parallel is None:
        return F.when(units >= 1, value / units)
    ok = (units >= 1) & (data_parallel >= 1) & (F.try_mod(units, data_parallel) == 0)
    return F.when(ok, value * data_parallel / units)


def length_moments(lengths: DataFrame, by: Sequence[str], length: str) -> DataFrame:
    value = c(length)
    return lengths.groupBy(*by).agg(
        F.count(length).alias("n_requests"), F.sum(value).alias("sum_len"),
        F.sum(value * value).alias("sum_len_sq"), F.max(value).alias("max_len"))


# The columns a parameter row must fill before a proxy is computed.
REQUIRED = ("layers", "hidden", "heads", "kv_heads", "head_dim", "dense_width", "dense_layers", "moe_layers",
            "params", "precision_bits", "element_bits", "gated")
MOE_REQUIRED = ("moe_width", "active_experts")
UNSUPPORTED = ("mla", "hybrid")


def physics_features(runs: DataFrame) -> DataFrame:
    """Sum proxies per run from length moments and parameters already joined to the run.

    Needs the moment columns of ``length_moments`` plus ``repeats, output_cap,
    units, data_parallel`` and the parameter columns named in ``REQUIRED``.
    Rows that lack an input keep a status and a reason instead of numbers.
    """
    missing = F.array_compact(F.array(
        *[F.when(F.col(n).isNull(), F.lit(n)) for n in REQUIRED],
        *[F.when((F.col("moe_layers") > 0) & F.col(n).isNull(), F.lit(n)) for n in MOE_REQUIRED]))
    def bad(name: str) -> Column:
        return (F.col(name).cast("double") < 0) | (finite(F.col(name)).isNull() & F.col(name).isNotNull())
    wrong = F.array_compact(F.array(*[F.when(bad(n), F.lit(n)) for n in (*REQUIRED, "output_cap") if n != "gated"],
                                    *[F.when((F.col("moe_layers") > 0) & bad(n), F.lit(n)) for n in MOE_REQUIRED]))
    unsupported = F.coalesce(F.col("attention_variant").isin(*UNSUPPORTED), F.lit(False))
    no_lengths = F.coalesce(F.col("n_requests"), F.lit(0)) == 0
    status = (F.when(no_lengths, "missing").when(unsupported, "unsupported")
              .when((F.size(missing) > 0) | (F.size(wrong) > 0), "missing").otherwise("available"))
    reason = (F.when(no_lengths, F.lit("workload lengths unavailable"))
              .when(unsupported, F.concat(F.lit("unsupported_attention_variant: "), F.col("attention_variant")))
              .when(F.size(missing) > 0, F.concat(F.lit("missing canonical fields: "),
                                                  F.array_join(F.array_sort(missing), ", ")))
              .when(F.size(wrong) > 0, F.concat(F.lit("must be finite and nonnegative: "), F.array_join(F.array_sort(wrong), ", "))))
    ok = status == "available"
    n, s1, s2, top = c("n_requests"), c("sum_len"), c("sum_len_sq"), c("max_len")
    rep, cap, layers = c("repeats"), c("output_cap"), c("layers")
    hidden, heads, kv, dim = c("hidden"), c("heads"), c("kv_heads"), c("head_dim")
    gated, element = F.col("gated"), c("element_bits") / 8
    shared = F.when(F.col("shared_width").isNotNull(), F.coalesce(c("shared_experts"), F.lit(0.0))).otherwise(0.0)

    def stack(length: Column) -> Column:
        dense = c("dense_layers") * mlp_work(length, hidden, c("dense_width"), gated)
        moe = c("moe_layers") * mlp_work(length, hidden, c("moe_width"), gated, c("active_experts"),
                                         shared, F.coalesce(c("shared_width"), F.lit(0.0)))
        return dense + F.when(c("moe_layers") > 0, moe).otherwise(0.0)

    one = F.lit(1.0)
    contexts = cap * s1 + n * cap * (cap + 1) / 2
    values = {
        "prefill_projection": rep * layers * projection_work(s1, hidden, heads, kv, dim),
        "prefill_attention": rep * layers * attention_work(s2, heads, dim),
        "prefill_mlp": rep * stack(s1),
        "decode_upper_bound": rep * (n * cap * (layers * projection_work(one, hidden, heads, kv, dim) + stack(one))
                                     + layers * attention_work(contexts, heads, dim)),
        "kv_prefill_sum_bytes": rep * cache_bytes(s1, layers, kv, dim, element),
        "kv_prefill_max_bytes": cache_bytes(top, layers, kv, dim, element),
        "kv_cap_sum_bytes": rep * cache_bytes(s1 + n * cap, layers, kv, dim, element),
        "weight_bytes_total": weight_bytes(c("params"), c("precision_bits")),
    }
    out = runs.withColumns({"physics_status": status, "physics_missing_reason": reason})
    out = out.withColumns({k: F.when(ok, v) for k, v in values.items()})
    out = out.withColumn("prefill_total", F.col("prefill_projection") + F.col("prefill_attention") + F.col("prefill_mlp"))
    units, dp = c("units"), c("data_parallel")
    return out.withColumns({
        "prefill_total_per_unit": per_unit(F.col("prefill_total"), units),
        "decode_upper_bound_per_unit": per_unit(F.col("decode_upper_bound"), units),
        "kv_prefill_sum_bytes_per_unit": per_unit(F.col("kv_prefill_sum_bytes"), units),
        "weight_bytes_per_unit": per_unit(F.col("weight_bytes_total"), units, dp),
        "units_per_replica": F.when(F.try_mod(units, dp) == 0, units / dp),
        "shared_term_included": F.when(ok, shared > 0),
    })


def compact_physics(mean: Column, second_moment: Column, p95: Column, longest: Column, *, layers: Column,
                    hidden: Column, heads: Column, kv_heads: Column, head_dim: Column, width: Column,
                    active_experts: Column, mlp_terms: Column, element_bytes: Column) -> dict[str, Column]:
    """Per-request proxies from the moments of the length distribution."""
    projection = layers * projection_work(F.lit(1.0), hidden, heads, kv_heads, head_dim)
    mlp = 2 * mlp_terms * hidden * width * active_experts * layers
    attention = layers * attention_work(F.lit(1.0), heads, head_dim)
    out = {
        "prefill_projection_per_request": projection * mean,
        "prefill_attention_per_request": attention * second_moment,
        "prefill_mlp_per_request": mlp * mean,
        "kv_mean_request_bytes": cache_bytes(mean, layers, kv_heads, head_dim, element_bytes),
        "kv_p95_request_bytes": cache_bytes(p95, layers, kv_heads, head_dim, element_bytes),
        "kv_max_request_bytes": cache_bytes(longest, layers, kv_heads, head_dim, element_bytes),
        "decode_one_token_mean_context": projection + mlp + attention * (mean + 1),
    }
    out["prefill_total_per_request"] = projection * mean + attention * second_moment + mlp * mean
    return out


def deployment_ratios(units: Column, dp: Column, max_seqs: Column, weight: Column, active: Column,
                      capacity: Column) -> dict[str, Column]:
    """Per-replica ratios; null unless units is a positive multiple of dp and capacity positive."""
    ok = (units >= 1) & (dp >= 1) & (F.try_mod(units, dp) == 0) & (capacity > 0)
    parallel = F.when(ok, units / dp)
    return {
        "units_per_replica": parallel,
        "max_seqs_per_unit": F.when(ok, max_seqs / units),
        "weight_bytes_per_parallel_unit": weight / parallel,
        "active_bytes_per_parallel_unit": active / parallel,
        "weight_capacity_ratio": weight / parallel / capacity,
        "active_capacity_ratio": active / parallel / capacity,
    }


def hardware_proxies(df: DataFrame, peak_by_precision: dict[str, str]) -> DataFrame:
    """Precision-matched time, capacity, pressure and power-fraction proxies of a run joined to its unit profile.

    Expects ``precision, units, parallel_units, tensor_parallel, work, weight_bytes_per_unit,
    kv_mean_bytes, kv_max_bytes, observed_power`` and the profile columns ``rated_power,
    bandwidth_gb, capacity_gb`` plus the peak columns named in ``peak_by_precision``.
    """
    label = F.lower(F.col("precision"))
    peak = F.coalesce(*[F.when(label == p, positive(F.col(col))) for p, col in peak_by_precision.items()])
    parallel = F.coalesce(positive(F.col("parallel_units")), positive(F.col("tensor_parallel")))
    df = df.withColumns({"matched_peak": peak, "_parallel": parallel,
                         "aggregate_rated_power": positive(F.col("rated_power")) * positive(F.col("units"))})
    df = df.withColumns({
        "compute_time": safe_ratio(positive(F.col("work")), F.col("matched_peak") * 1e12 * F.col("_parallel")),
        "_kv_mean": safe_ratio(F.col("kv_mean_bytes"), F.col("_parallel")),
        "_kv_max": safe_ratio(F.col("kv_max_bytes"), F.col("_parallel")),
        "_capacity": positive(F.col("capacity_gb")) * 1e9,
    })
    weight = finite(F.col("weight_bytes_per_unit"))
    df = df.withColumns({
        "memory_time": safe_ratio(weight + F.col("_kv_mean"), positive(F.col("bandwidth_gb")) * 1e9),
        "weight_capacity_ratio": safe_ratio(weight, F.col("_capacity")),
        "kv_capacity_ratio_mean": safe_ratio(F.col("_kv_mean"), F.col("_capacity")),
        "kv_capacity_ratio_max": safe_ratio(F.col("_kv_max"), F.col("_capacity")),
        "power_fraction": safe_ratio(F.col("observed_power"), F.col("aggregate_rated_power")),
    })
    return df.withColumn("pressure_ratio", safe_ratio(F.col("compute_time"), F.col("memory_time"))).drop(
        "_parallel", "_kv_mean", "_kv_max", "_capacity")


def architecture_ratios(hidden: Column, width: Column, layers: Column, moe_layers: Column, dense_layers: Column,
                        params: Column, active: Column, heads: Column, kv_heads: Column,
                        is_grouped: Column) -> dict[str, Column]:
    grouped = F.coalesce(is_grouped, F.lit(False))
    return {
        "expansion_ratio": F.try_divide(width, hidden),
        "moe_layer_fraction": F.try_divide(moe_layers, layers),
        "dense_layer_fraction": F.try_divide(dense_layers, layers),
        "params_per_layer": F.try_divide(params, layers),
        "active_params_per_layer": F.try_divide(active, layers),
        "active_param_ratio": F.try_divide(active, params),
        "grouped_ratio_applicable": grouped,
        "grouped_ratio": F.when(grouped, F.try_divide(heads, kv_heads)).otherwise(0.0),
    }
