"""Behavioural copies: distances of distributions, closest stored rows, families, bank."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bound of the bank; candidates meet at most this many stored rows.
MAX_ENTRIES = 100
MAX_SIMILAR = 3
JS_LIMIT = 1e-3


def with_log_probabilities(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """rows with lp; the maximum and the norm are columns, so that no lambda computes them again."""
    x = rows.withColumn("_x", F.transform(logits, lambda v: v.cast("double"))).withColumn("_top", F.array_max("_x"))
    x = x.withColumn("_norm", F.log(F.aggregate("_x", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_top")))) + F.col("_top"))
    return x.withColumn("lp", F.transform("_x", lambda v: v - F.col("_norm"))).drop("_x", "_top", "_norm")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def probabilities(log: Column) -> Column:
    return F.transform(log, lambda v: F.exp(v))


def distances(pairs: DataFrame, a: str = "lp_a", b: str = "lp_b", p_a: str | None = None, p_b: str | None = None) -> DataFrame:
    """pairs with js, kl (symmetric), tv and top1 between two log-probability arrays.

    p_a and p_b: columns of the probabilities themselves, where they were made before the
    pairs were. What several sums need is made once for each pair of values.
    """
    own = lambda p, log: F.col(p) if p else probabilities(F.col(log))
    zipped = pairs.withColumn("_z", F.arrays_zip(F.col(a).alias("la"), F.col(b).alias("lb"), own(p_a, a).alias("a"), own(p_b, b).alias("b")))
    middle = lambda s: F.log(0.5 * (s["a"] + s["b"]))
    # Where both underflow, the larger logarithm stands for the middle; such terms are zero anyway.
    safe = lambda s: F.when(s["a"] + s["b"] > 0, middle(s)).otherwise(F.greatest(s["la"], s["lb"]))
    zipped = zipped.withColumn("_z", F.transform("_z", lambda s: F.struct(s["la"].alias("la"), s["lb"].alias("lb"), s["a"].alias("a"), s["b"].alias("b"), safe(s).alias("m"))))
    js = F.lit(0.5) * total(F.transform("_z", lambda s: s["a"] * (s["la"] - s["m"]) + s["b"] * (s["lb"] - s["m"])))
    kl = F.lit(0.5) * total(F.transform("_z", lambda s: (s["a"] - s["b"]) * (s["la"] - s["lb"])))
    tv = F.lit(0.5) * total(F.transform("_z", lambda s: F.abs(s["a"] - s["b"])))
    top = F.array_position(a, F.array_max(a)) == F.array_position(b, F.array_max(b))
    return zipped.withColumn("js", F.greatest(js, F.lit(0.0))).withColumn("kl", kl).withColumn("tv", tv).withColumn("top1", top.cast("double")).drop("_z")


def summary(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, median, 95th percentile (linear) and maximum."""
    return rows.groupBy(*(keys or [])).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.max(value).alias("max")
    )


def closest(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Each candidate's nearest stored row by js; the newest among equals. stored: MAX_ENTRIES rows at most."""
    newest = stored.orderBy(F.desc("stored_id")).limit(MAX_ENTRIES)
    # Probabilities are made once a row, not once a pair; the bank is MAX_ENTRIES rows.
    pairs = candidates.withColumn("p_a", probabilities(F.col("lp_a"))).crossJoin(F.broadcast(newest.withColumn("p_b", probabilities(F.col("lp_b")))))
    d = distances(pairs, p_a="p_a", p_b="p_b")
    return d.groupBy("candidate_id").agg(F.min(F.struct(F.round("js", 12).alias("js"), (-F.col("stored_id")).alias("neg"))).alias("m")).select(
        "candidate_id", (-F.col("m.neg")).alias("stored_id"), F.round("m.js", 9).alias("js")
    )


def trim_bank(rows: DataFrame, keep: int, order: str) -> DataFrame:
    """The newest ``keep`` rows over all versions and keys."""
    return rows.orderBy(F.desc(order)).limit(keep)


def family_sizes(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("family_size"))


def encode(logits) -> tuple[bytes, str]:
    """Half-precision payload and its SHA-256."""
    raw = np.ascontiguousarray(logits, dtype="<f2").tobytes()
    return raw, hashlib.sha256(raw).hexdigest()


def decode(payload: bytes, rows: int, vocabulary: int, digest: str) -> np.ndarray:
    """The payload as float32 rows; wrong size or digest is an error."""
    if len(payload) != rows * vocabulary * 2:
        raise ValueError("payload has the wrong size")
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload does not match its digest")
    return np.frombuffer(payload, "<f2").reshape(rows, vocabulary).astype(np.float32)


def js_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    def lp(v):
        v = v.astype(np.float64)
        v = v - v.max(1, keepdims=True)
        return v - np.log(np.exp(v).sum(1, keepdims=True))

    p, q = lp(x), lp(y)
    m = np.logaddexp(p, q) - np.log(2)
    return np.maximum(0.5 * (np.exp(p) * (p - m) + np.exp(q) * (q - m)).sum(1), 0)


class Bank:
    """Ordered decisions: compare within one (version, key, shape), merge families, store, trim over all keys."""

    def __init__(self, max_entries: int = MAX_ENTRIES, max_similar: int = MAX_SIMILAR, limit: float = JS_LIMIT):
        self.max_entries, self.max_similar, self.limit = max_entries, max_similar, limit
        self.rows: list[dict] = []

    def offer(self, digest: str, submission: str, logits: np.ndarray, key: tuple = ()) -> dict:
        peers = [r for r in self.rows if r["key"] == key]
        own = next((r for r in peers if r["digest"] == digest), None)
        if own and own["submission"] == submission:
            family = sum(r["group"] == own["group"] for r in peers)
            return {"detected": False, "stored": True, "too_similar": False, "family": family, "compared": 0, "match": None, "js": None}
        groups, best = set(), None
        for r in reversed(peers):
            js = float(np.quantile(js_rows(r["logits"], logits), 0.95))
            if best is None or js < best[0]:
                best = (js, r)
            if js <= self.limit:
                groups.add(r["group"])
        family = sum(r["group"] in groups for r in peers)
        group = best[1]["group"] if groups else digest
        if len(groups) > 1:  # one family from now on, even if this row is turned away
            for r in peers:
                if r["group"] in groups:
                    r["group"] = group
        detected = bool(groups) and family >= self.max_similar
        compared = len(peers)
        if not detected and own is None:
            self.rows.append({"key": key, "digest": digest, "submission": submission, "logits": logits, "group": group})
            self.rows = self.rows[-self.max_entries :]
        return {
            "detected": detected, "stored": not detected, "too_similar": bool(groups), "family": family, "compared": compared,
            "match": best[1]["digest"] if best else None, "js": best[0] if best else None,
        }


def fold_bank(arrivals: DataFrame, keys: list[str], max_similar: int = MAX_SIMILAR, limit: float = JS_LIMIT) -> DataFrame:
    """Decisions on arrivals (keys, ord, digest, submission, logits) in order.

    One ordered fold over all keys, as the bank is trimmed over all of them and the next
    decision needs the one before: rows stream through one task in sorted batches, and the
    state is MAX_ENTRIES rows. Arrivals are submissions, not a corpus.
    """
    names = ["ord", "digest", "detected", "stored", "too_similar", "family", "compared", "match", "js"]
    kinds = "ord long, digest string, detected boolean, stored boolean, too_similar boolean, family int, compared int, match string, js double"

    def run(batches):
        import pandas as pd

        bank = Bank(max_similar=max_similar, limit=limit)
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                d = bank.offer(r["digest"], r["submission"], np.asarray(r["logits"], np.float32).reshape(1, -1), tuple(r[k] for k in keys))
                out.append((r["ord"], r["digest"], d["detected"], d["stored"], d["too_similar"], d["family"], d["compared"], d["match"], d["js"]))
            yield pd.DataFrame(out, columns=names)

    return arrivals.select(*keys, "ord", "digest", "submission", "logits").repartition(1).sortWithinPartitions("ord").mapInPandas(run, kinds)


def modal_share(rows: DataFrame, value: Column) -> DataFrame:
    """The most common rounded value and its share."""
    counts = rows.groupBy(F.round(value, 4).alias("norm")).agg(F.count("*").alias("n"))
    every = W.partitionBy()
    ranked = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(every), 6))
    return ranked.orderBy(F.desc("n"), "norm").limit(1)


# Parts of parameter names and the bucket they mean, in the order they are tried.
PARAMETER_BUCKETS = [
    ("lm_head", ["lm_head"]),
    ("embed", ["embed_tokens", "wte", "embeddings"]),
    ("norm", ["norm", "layernorm", "rmsnorm", ".ln1.", ".ln2.", ".ln1_out.", ".ln2_out.", ".embed_norm."]),
    ("memory", [".memory.", "summary_proj", "summary_query", "compress_z", "w_qkv_mem", "eta_channels", "w_eta", "c_to_hidden", "w_alpha"]),
    ("moe_router", ["router", "router_weights"]),
    ("moe_routed", ["experts_w12", "experts_w3"]),
    ("moe_shared", ["shared_experts"]),
    ("moe_dcca", ["w_down_proj", "w_up_proj"]),
    ("moe_smebu", ["moe_bias", "moe_momentum", "max_vio", "expert_bias"]),
    ("looped_inject", ["injection_gate"]),
    ("attn", ["q_proj", "k_proj", "v_proj", "o_proj", "q_norm", "k_norm", "wq.", "wk.", "wv.", "wo.", "self_attn", "attention", "g_proj", "f_proj", "a_proj", "b_proj", ".attn."]),
    ("ffn", ["gate_proj", "up_proj", "down_proj", "mlp", "ffn", "fc1", "fc2", "feed_forward", ".w1.", ".w2.", ".w3.", "ffn.gate", "ffn.up", "ffn.down"]),
]
# The same for size reports; two patterns have capitals and so never fit a lowered name.
SIZE_BUCKETS = [
    ("embed", ["embed_tokens"]), ("lm_head", ["lm_head"]), ("moe_experts_routed", ["experts_w12", "experts_w3"]), ("moe_experts_shared", ["shared_experts"]),
    ("moe_dcca", ["w_down_proj", "w_up_proj"]), ("moe_router", ["router"]), ("moe_smebu_buffers", ["moe_bias", "moe_momentum", "max_vio"]),
    ("latent_memory", [".memory.", ".W_alpha", ".C_to_hidden"]), ("ffn_dense", ["ffn.gate", "ffn.up", "ffn.down"]), ("attn", ["attn.", "_proj"]),
    ("norm", ["norm", "ln1", "ln2"]), ("rope", ["rotary_emb"]), ("injection", ["injection_gate"]),
]


def bucket(name: Column, rules: list[tuple[str, list[str]]], bias: bool = False) -> Column:
    from ..functions.text import has_any

    n = F.lower(name)
    out = None
    for label, needles in rules:
        hit = has_any(n, needles)
        if bias and label == "embed":
            hit = hit | F.endswith(n, F.lit(".embedding.weight"))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    if bias:
        out = out.when(F.endswith(n, F.lit(".bias")), "bias")
    return out.otherwise("other")


def bucket_norms(rows: DataFrame, name: str, value: str) -> DataFrame:
    """sqrt of summed squares per bucket, over finite values."""
    finite = rows.where(~F.isnan(value) & (F.abs(value) < float("inf")))
    return finite.groupBy(bucket(F.col(name), PARAMETER_BUCKETS, True).alias("bucket")).agg(F.round(F.sqrt(F.sum(F.col(value) * F.col(value))), 6).alias("norm"))


def probe_verdict(steps: DataFrame, max_grad: float, max_loss_growth: float) -> DataFrame:
    """First, least and largest finite loss and largest norm of a probe's steps, and whether it passes."""
    fine = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    r = steps.agg(
        F.min_by("loss", "step").alias("first_loss"), F.min(F.when(fine("loss"), F.col("loss"))).alias("min_loss"), F.max(F.when(fine("loss"), F.col("loss"))).alias("max_loss"),
        F.max(F.when(fine("norm"), F.col("norm"))).alias("max_norm"), F.coalesce(F.bool_or(~fine("loss") | ~fine("norm")), F.lit(False)).alias("non_finite"),
    )
    ok = ~F.col("non_finite") & (F.col("max_norm") <= max_grad) & (F.col("max_loss") <= F.col("first_loss") + max_loss_growth)
    return r.withColumn("ok", ok)
