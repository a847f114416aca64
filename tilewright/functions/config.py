"""The short grammar of propagation settings: ``g0.5/abs0.8/b-2.0/a0.95/r3w0.5/t0.3``."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

_NUMBER = r"(-?\d+(?:\.\d+)?)"


@dataclass(frozen=True)
class Propagation:
    smoothing: float = 0.0
    mode: str = "row"  # how the link gate is taken: 'row' or 'abs'
    gate: float = 0.0
    bias: float = 0.0
    alpha: float = 0.9
    rounds: int = 0
    mixing: float = 0.0
    temperature: float = 1.0

    def text(self) -> str:
        out = f"g{self.smoothing:g}/{self.mode}{self.gate:g}/b{self.bias:g}/a{self.alpha:g}/r{self.rounds}w{self.mixing:g}"
        return out if self.temperature == 1.0 else f"{out}/t{self.temperature:g}"


def parse(text: str) -> Propagation:
    out = Propagation()
    for part in filter(None, text.strip().split("/")):
        if m := re.fullmatch(rf"(row|abs){_NUMBER}", part):
            out = replace(out, mode=m[1], gate=float(m[2]))
        elif m := re.fullmatch(rf"r(\d+)w{_NUMBER}", part):
            out = replace(out, rounds=int(m[1]), mixing=float(m[2]))
        elif m := re.fullmatch(rf"([gbat]){_NUMBER}", part):
            name = {"g": "smoothing", "b": "bias", "a": "alpha", "t": "temperature"}[m[1]]
            out = replace(out, **{name: float(m[2])})
        else:
            raise ValueError(f"unknown setting {part!r} in {text!r}")
    return out
