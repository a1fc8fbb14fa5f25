"""What a tensor's name says: its class, whether it is a control tensor, its layer, and how it is stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: parts of names of control tensors, which stay in full precision
CONTROL = ("attn_scale", "attn_scales", "mlp_scale", "mlp_scales", "resid_mix", "resid_mixes", "q_gain", "skip_weight", "skip_weights")


def tensor_class(name: str) -> Column:
    n = F.col(name)
    return F.when(n.contains("tok_emb") | n.contains("lm_head"), "embed").when(n.contains(".mlp"), "mlp").when(n.contains(".attn"), "attn").otherwise("other")


def is_control(name: str) -> Column:
    return F.col(name).rlike("|".join(CONTROL))


def layer_of(name: str) -> Column:
    """The number behind ``blocks.``; null without one."""
    found = F.regexp_extract(name, r"blocks\.(\d+)\.", 1)
    return F.when(found != "", found).cast("int")


def route(name: str, dims: str, numel: str, kind: str, keep: int = 65_536) -> Column:
    """exact: not a float; keep32, keep16: small; rows, tensor: quantized by row, as a whole."""
    small = F.when(is_control(name), "keep32").otherwise("keep16")
    return F.when(F.col(kind) != "float", "exact").when(F.col(numel) <= keep, small).when(F.col(dims) == 2, "rows").otherwise("tensor")


def payload_bytes(routed: str, numel: str) -> Column:
    """Bytes that a stored tensor takes, without its scales."""
    width = F.when(F.col(routed) == "exact", 8).when(F.col(routed) == "keep32", 4).when(F.col(routed) == "keep16", 2).otherwise(1)
    return (F.col(numel) * width).cast("long")
