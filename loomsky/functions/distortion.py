"""Distortion of a detector as polynomials of the place in pixels about its reference pixel (the SIP convention; Shupe et al., 2005).

``undistorted`` is the convention's own direction. The way back has no polynomial that is exact: it is found by Newton's method from the place itself, with
a fixed number of steps, as one expression in which every step names the one before it once.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Terms = Mapping[tuple[int, int], float]


def _sum(terms: Terms, u: Column, v: Column) -> Column:
    """The sum of c u ** p v ** q, by Horner's rule in u of polynomials in v."""
    by_power: dict[int, dict[int, float]] = {}
    for (p, q), c in terms.items():
        by_power.setdefault(p, {})[q] = c
    return _horner({p: _horner({q: F.lit(float(c)) for q, c in row.items()}, v) for p, row in by_power.items()}, u)


def _horner(parts: Mapping[int, Column], x: Column) -> Column:
    total = None
    for k in range(max(parts, default=0), -1, -1):
        part = parts.get(k)
        if total is None:
            total = F.lit(0.0) if part is None else part
        else:
            total = total * x if part is None else total * x + part
    return total


def _slope(terms: Terms, which: int) -> Terms:
    """The derivative by u (0) or v (1)."""
    return {(p - (which == 0), q - (which == 1)): c * (p, q)[which] for (p, q), c in terms.items() if (p, q)[which]}


@dataclass(frozen=True)
class Sip:
    """``a`` and ``b``: what is added to u and to v, as coefficients of u ** p v ** q by (p, q)."""

    a: Terms = field(default_factory=dict)
    b: Terms = field(default_factory=dict)

    @classmethod
    def of(cls, header: Mapping[str, object]) -> Sip | None:
        """From a header's A_ORDER, A_p_q, B_ORDER and B_p_q; None where it has neither order. Terms that a header lacks are 0, those beyond its order
        don't count."""
        both = []
        for name in "AB":
            order = int(float(header.get(f"{name}_ORDER") or 0))
            places = [(p, q) for p in range(order + 1) for q in range(order + 1 - p)]
            both.append({(p, q): float(header[f"{name}_{p}_{q}"]) for p, q in places if header.get(f"{name}_{p}_{q}") is not None})
        return cls(*both) if header.get("A_ORDER") is not None or header.get("B_ORDER") is not None else None

    def scaled(self, f: float) -> Sip:
        """The same distortion in pixels smaller by ``f``."""
        return Sip(*({(p, q): c * f ** (1 - p - q) for (p, q), c in t.items()} for t in (self.a, self.b)))

    def undistorted(self, u: Column, v: Column) -> tuple[Column, Column]:
        return u + _sum(self.a, u, v), v + _sum(self.b, u, v)

    def slopes(self, u: Column, v: Column) -> tuple[Column, Column, Column, Column]:
        """Of ``undistorted``: du'/du, du'/dv, dv'/du, dv'/dv."""
        return (
            1 + _sum(_slope(self.a, 0), u, v), _sum(_slope(self.a, 1), u, v), _sum(_slope(self.b, 0), u, v), 1 + _sum(_slope(self.b, 1), u, v),
        )

    def distorted(self, u: Column, v: Column, *, steps: int = 5) -> tuple[Column, Column]:
        """The inverse of ``undistorted``, after ``steps`` of Newton's method. Errors are squared in each, so five bring a distortion of some percent to the last
        digits. Null where the polynomials turn over on the way, or where a place is null."""
        u, v = u.cast("double"), v.cast("double")
        start = F.struct(u.alias("u"), v.alias("v"), u.alias("to_u"), v.alias("to_v"))

        def step(s: Column, _: Column) -> Column:
            at_u, at_v = self.undistorted(s["u"], s["v"])
            left = F.struct((at_u - s["to_u"]).alias("du"), (at_v - s["to_v"]).alias("dv"), *[d.alias(n) for n, d in zip("abcd", self.slopes(s["u"], s["v"]))])
            # a lambda of one element gives what is left a name, so that each of its parts is worked out once
            moved = F.transform(F.array(left), lambda r: F.struct(
                (s["u"] - F.try_divide(r["d"] * r["du"] - r["b"] * r["dv"], r["a"] * r["d"] - r["b"] * r["c"])).alias("u"),
                (s["v"] - F.try_divide(r["a"] * r["dv"] - r["c"] * r["du"], r["a"] * r["d"] - r["b"] * r["c"])).alias("v"),
                s["to_u"].alias("to_u"), s["to_v"].alias("to_v"),
            ))
            return moved[0]

        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: F.struct(s["u"].alias("u"), s["v"].alias("v")))
        return found["u"], found["v"]
