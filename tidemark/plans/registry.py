"""Nodes by name, and plans as JSON: what a strategy is made of, to be kept beside its results."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass

from tidemark.operators import indicators, kernels, signals
from tidemark.operators.base import Node
from tidemark.operators.strategy import Rules, Weighted

NODES: dict[str, type[Node]] = {
    c.__name__: c
    for c in (
        signals.LogReturns, signals.HeikinAshi, signals.Cyclical, signals.External, indicators.SMA, indicators.EMA, indicators.WMA, indicators.CMA, indicators.DEMA, indicators.TEMA,
        indicators.RSI, indicators.MACD, indicators.Momentum, indicators.LarryWilliams, indicators.BollingerBands, indicators.CCI, indicators.Stochastic, indicators.ROC, indicators.TRIX, indicators.DPO,
        indicators.RVI, indicators.DeMarker, indicators.OBV, indicators.ForceIndex, indicators.CHO, indicators.ADX, indicators.ATR, indicators.MassIndex, kernels.KernelRegression,
    )
}
#: Nodes whose strength is unbounded, or reads all bars so far, so that where a series starts matters.
WARNINGS = {"MACD": "strength is not bounded", "CMA": "depends on where the series starts", "OBV": "depends on where the series starts", "CHO": "depends on where the series starts"}


def node_dict(node: Node) -> dict:
    """The node's name and parameters."""
    if type(node).__name__ not in NODES:
        raise KeyError(f"{type(node).__name__} is no registered node")
    out = {f.name: getattr(node, f.name) for f in fields(node)}
    if callable(out.get("normalization")):
        raise ValueError("a normalization can't be written down")
    return {"node": type(node).__name__, **out}


def node_of(d: dict) -> Node:
    d = dict(d)
    return NODES[d.pop("node")](**d)


def plan_json(strategy: Weighted) -> str:
    """Nodes, weights and rules of a strategy."""
    rules = {f.name: (v if not is_dataclass(v) else {"kind": type(v).__name__, **{x.name: getattr(v, x.name) for x in fields(v)}}) for f in fields(Rules) if (v := getattr(strategy.rules, f.name)) is not None}
    return json.dumps({"parts": [{**node_dict(n), "weight": w} for n, w in strategy.parts], "rules": rules}, sort_keys=True)


def plan_parts(text: str) -> tuple[tuple[Node, float], ...]:
    parts = json.loads(text)["parts"]
    return tuple((node_of({k: v for k, v in p.items() if k != "weight"}), p["weight"]) for p in parts)


def warnings(strategy: Weighted) -> list[str]:
    """What to mind about a strategy before its results are trusted."""
    out = [f"{type(n).__name__}: {WARNINGS[type(n).__name__]}" for n, _ in strategy.parts if type(n).__name__ in WARNINGS]
    if strategy.rules.stop_loss is None and strategy.rules.trailing_stop is None:
        out.append("no protective stop")
    if strategy.rules.exit_threshold > strategy.rules.entry_threshold:
        out.append("positions close sooner than they open")
    return out
