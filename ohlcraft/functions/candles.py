"""Candle patterns as predicates over the current and the previous bars.

``PATTERNS[name]`` builds a column of 1.0, -1.0 or 0.0 stamped on the last bar of the
pattern. Signs follow the published definitions, where several bearish patterns also
report +1; :data:`BEARISH` names those, and :func:`direction` gives the trading sign.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.frames import Frame
from .rolling import c as col
from .rolling import mean

DEPTH = 5
EQUAL = 1e-12  # closes or opens this near count as equal


class Bars:
    """Columns of the bar ``k`` bars ago."""

    def __init__(self, frame: Frame, strict: bool = False, symmetric: bool = False, min_body: float | None = None,
                 max_shadow: float | None = None):
        names = {"o": "open", "h": "high", "l": "low", "c": "close"}
        self._made: dict = {}
        self.strict, self.symmetric, self.limits = strict, symmetric, (min_body, max_shadow)
        self.frame = frame.add(**{f"_{s}{k}": frame.lag(col(n), k) for k in range(DEPTH) for s, n in names.items()})

    def _once(self, name: str, k: int, make: Callable[[], Column]) -> Column:
        """Patterns share their building blocks, so each is made once."""
        key = (name, k)
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def o(self, k):
        return self._once("o", k, lambda: col(f"_o{k}"))

    def h(self, k):
        return self._once("h", k, lambda: col(f"_h{k}"))

    def l(self, k):
        return self._once("l", k, lambda: col(f"_l{k}"))

    def c(self, k):
        return self._once("c", k, lambda: col(f"_c{k}"))

    def white(self, *ks):
        return both(*[self._once("white", k, lambda k=k: self.c(k) > self.o(k)) for k in ks])

    def black(self, *ks):
        return both(*[self._once("black", k, lambda k=k: self.c(k) < self.o(k)) for k in ks])

    def body(self, k):
        return self._once("body", k, lambda: F.abs(self.c(k) - self.o(k)))

    def rng(self, k):
        return self._once("rng", k, lambda: self.h(k) - self.l(k))

    def top(self, k):
        return self._once("top", k, lambda: F.greatest(self.o(k), self.c(k)))

    def bot(self, k):
        return self._once("bot", k, lambda: F.least(self.o(k), self.c(k)))

    def up(self, k):
        return self._once("up", k, lambda: self.h(k) - self.top(k))

    def lo(self, k):
        return self._once("lo", k, lambda: self.bot(k) - self.l(k))

    def mid(self, k):
        return self._once("mid", k, lambda: (self.o(k) + self.c(k)) / 2)

    def big(self, k, share):
        return (self.rng(k) > 0) & (self.body(k) >= share * self.rng(k))

    def small(self, k, share):
        return (self.rng(k) > 0) & (self.body(k) <= share * self.rng(k))

    def factors(self, min_body, max_shadow):
        a, b = self.limits
        return (min_body if a is None else a), (max_shadow if b is None else b)

    def proportions(self, ks, min_body, max_shadow):
        """With ``strict``: bodies large enough and shadows short enough on every bar."""
        if not self.strict:
            return F.lit(True)
        mb, ms = self.factors(min_body, max_shadow)
        return both(*[(self.body(k) >= mb * self.rng(k)) & (self.up(k) + self.lo(k) <= ms * self.rng(k)) for k in ks])


def both(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def signed(bull: Column | None = None, bear: Column | None = None) -> Column:
    out = F.lit(0.0)
    if bear is not None:
        out = F.when(bear, -1.0).otherwise(out)
    if bull is not None:
        out = F.when(bull, 1.0).otherwise(out)
    return out


Pattern = Callable[[Bars], Column]
PATTERNS: dict[str, Pattern] = {}


def pattern(name: str):
    def wrap(fn: Pattern) -> Pattern:
        PATTERNS[name] = fn
        return fn

    return wrap


def _inside_body(b: Bars, x: Column, k: int) -> Column:
    return (x > b.bot(k)) & (x < b.top(k))


@pattern("2crows")
def two_crows(b):
    return signed(b.white(2) & b.black(1, 0) & (b.o(1) > b.c(2)) & (b.c(1) > b.o(2)) & (b.c(1) < b.c(2))
                  & (b.o(0) > b.c(1)) & (b.c(0) < b.c(1)))


@pattern("3blackcrows")
def three_black_crows(b):
    return signed(b.black(2, 1, 0) & _inside_body(b, b.o(1), 2) & _inside_body(b, b.o(0), 1)
                  & (b.c(2) > b.c(1)) & (b.c(1) > b.c(0)))


@pattern("3inside")
def three_inside(b):
    return signed(b.black(2) & b.white(1, 0) & (b.o(1) < b.o(2)) & (b.c(1) > b.c(2)) & (b.c(0) > b.c(1)),
                  b.white(2) & b.black(1, 0) & (b.o(1) > b.c(2)) & (b.c(1) < b.o(2)) & (b.c(0) < b.c(1)))


@pattern("3linestrike")
def three_line_strike(b):
    ok = b.proportions((3, 2, 1, 0), 0.0, 1.0)
    return signed(ok & b.white(3, 2, 1) & (b.c(2) > b.c(3)) & (b.c(1) > b.c(2)) & b.black(0) & (b.o(0) > b.c(1)) & (b.c(0) < b.c(3)),
                  ok & b.black(3, 2, 1) & (b.c(2) < b.c(3)) & (b.c(1) < b.c(2)) & b.white(0) & (b.o(0) < b.c(1)) & (b.c(0) > b.c(3)))


@pattern("3outside")
def three_outside(b):
    ok = b.proportions((2, 1, 0), 0.0, 1.0)
    return signed(ok & b.black(2) & b.white(1, 0) & (b.o(1) <= b.c(2)) & (b.c(1) >= b.o(2)) & (b.c(0) > b.c(1)),
                  ok & b.white(2) & b.black(1, 0) & (b.o(1) >= b.c(2)) & (b.c(1) <= b.o(2)) & (b.c(0) < b.c(1)))


@pattern("3starsinsouth")
def three_stars_in_south(b):
    ok = b.proportions((2, 1, 0), 0.0, 1.0)
    bear = ok & b.white(2, 1, 0) & (b.h(1) > b.h(2)) & (b.h(0) > b.h(1)) & (b.c(0) < b.c(1))
    return signed(ok & b.black(2, 1, 0) & (b.l(1) < b.l(2)) & (b.l(0) < b.l(1)) & (b.c(0) > b.c(1)), bear if b.symmetric else None)


@pattern("3whitesoldiers")
def three_white_soldiers(b):
    ok = b.proportions((2, 1, 0), 0.0, 1.0)
    rise = (b.c(1) > b.c(2)) & (b.c(0) > b.c(1)) & (b.o(1) > b.o(2)) & (b.o(0) > b.o(1))
    fall = (b.c(1) < b.c(2)) & (b.c(0) < b.c(1)) & (b.o(1) < b.o(2)) & (b.o(0) < b.o(1))
    return signed(ok & b.white(2, 1, 0) & rise, ok & b.black(2, 1, 0) & fall if b.symmetric else None)


@pattern("abandonedbaby")
def abandoned_baby(b):
    ok = b.proportions((2, 1, 0), 0.0, 1.0)
    doji = b.body(1) <= 0.1 * b.rng(1)
    return signed(ok & b.black(2) & doji & (b.l(1) > b.h(2)) & (b.o(0) > b.h(1)) & b.white(0),
                  ok & b.white(2) & doji & (b.h(1) < b.l(2)) & (b.o(0) < b.l(1)) & b.black(0))


@pattern("advanceblock")
def advance_block(b):
    ok = b.proportions((2, 1, 0), 0.0, 1.0)
    tiring = (b.body(1) < b.body(2)) & (b.body(0) < b.body(1))
    rise = (b.c(1) > b.c(2)) & (b.c(0) > b.c(1)) & (b.o(1) > b.o(2)) & (b.o(0) > b.o(1))
    fall = (b.c(1) < b.c(2)) & (b.c(0) < b.c(1)) & (b.o(1) < b.o(2)) & (b.o(0) < b.o(1))
    return signed(ok & b.black(2, 1, 0) & fall & tiring if b.symmetric else None, ok & b.white(2, 1, 0) & rise & tiring)


@pattern("belthold")
def belt_hold(b):
    ok = b.proportions((0,), 0.0, 1.0) & (b.body(0) > 0.5 * b.rng(0))
    return signed(ok & b.white(0) & (b.o(0) == b.l(0)), ok & b.black(0) & (b.o(0) == b.h(0)))


@pattern("breakaway")
def breakaway(b):
    ok = b.proportions((4, 3, 2, 1, 0), 0.0, 1.0)
    return signed(ok & b.black(4, 3, 2, 1) & (b.o(3) < b.l(4)) & b.white(0) & (b.c(0) > b.c(1)) & (b.c(0) > b.c(4)),
                  ok & b.white(4, 3, 2, 1) & (b.o(3) > b.h(4)) & b.black(0) & (b.c(0) < b.c(1)) & (b.c(0) < b.c(4)))


@pattern("closingmarubozu")
def closing_marubozu(b):
    ok = b.proportions((0,), 0.5, 0.2)
    return signed(ok & b.white(0) & (b.c(0) == b.h(0)), ok & b.black(0) & (b.c(0) == b.l(0)))


@pattern("concealbabyswall")
def conceal_babys_wall(b):
    ok = F.lit(True)
    if b.strict:
        mb, ms = b.factors(0.5, 0.3)
        ok = both(*[b.body(k) >= mb * b.rng(k) for k in (3, 2)], *[b.up(k) + b.lo(k) <= ms * b.rng(k) for k in range(4)])
    return signed(ok & b.black(3, 2, 1, 0) & (b.c(3) == b.h(3)) & (b.c(2) == b.h(2))
                  & _inside_body(b, b.o(1), 2) & (b.c(1) < b.c(2)) & _inside_body(b, b.o(0), 1) & (b.c(0) < b.c(1)))


@pattern("counterattack")
def counterattack(b):
    ok = b.proportions((1, 0), 0.3, 0.5) & (F.abs(b.c(0) - b.c(1)) <= 0.25 * (b.rng(0) + b.rng(1)))
    return signed(ok & b.black(1) & b.white(0) & (b.o(0) < b.l(1)) & (b.c(0) > b.c(1)),
                  ok & b.white(1) & b.black(0) & (b.o(0) > b.h(1)) & (b.c(0) < b.c(1)))


@pattern("darkcloudcover")
def dark_cloud_cover(b):
    return signed(None, b.proportions((1, 0), 0.5, 0.5) & b.white(1) & b.black(0) & (b.o(0) > b.h(1))
                  & (b.c(0) > b.o(1)) & (b.c(0) < b.mid(1)))


@pattern("dojistar")
def doji_star(b):
    mb, ms = b.factors(0.1, 1.0)
    ok = (b.rng(1) > 0) & (b.rng(0) > 0) & (b.body(0) <= mb * b.rng(0))
    if b.strict:
        ok = ok & (b.up(0) + b.lo(0) <= ms * b.rng(0))
    return signed(ok & (b.h(0) < b.l(1)), ok & (b.l(0) > b.h(1)))


def _one_sided_doji(b: Bars, edge: Column) -> Column:
    mb, ms = b.factors(0.1, 0.5)
    ok = (b.rng(0) > 0) & (b.body(0) <= mb * b.rng(0)) & (b.o(0) == edge) & (b.c(0) == edge)
    return ok & (b.rng(0) >= ms * b.rng(0)) if b.strict else ok


@pattern("dragonflydoji")
def dragonfly_doji(b):
    return signed(_one_sided_doji(b, b.h(0)))


@pattern("gravestonedoji")
def gravestone_doji(b):
    return signed(None, _one_sided_doji(b, b.l(0)))


@pattern("engulfing")
def engulfing(b):
    ok = b.proportions((1, 0), 0.3, 0.5)
    return signed(ok & b.black(1) & b.white(0) & (b.o(0) <= b.c(1)) & (b.c(0) >= b.o(1)),
                  ok & b.white(1) & b.black(0) & (b.o(0) >= b.c(1)) & (b.c(0) <= b.o(1)))


def _evening(b: Bars, small: float) -> Column:
    mb, ms = b.factors(small, 0.5)
    ok = (b.rng(1) > 0) & (b.body(1) <= mb * b.rng(1))
    if b.strict:
        ok = ok & both(*[b.up(k) + b.lo(k) <= ms * b.rng(k) for k in (2, 1, 0)])
    return signed(None, ok & b.white(2) & (b.l(1) > b.h(2)) & b.black(0) & (b.c(0) <= b.mid(2)))


@pattern("eveningdojistar")
def evening_doji_star(b):
    return _evening(b, 0.1)


@pattern("eveningstar")
def evening_star(b):
    return _evening(b, 0.3)


@pattern("gapsidesidewhite")
def gap_side_side_white(b):
    near = 0.25 * (b.rng(1) + b.rng(0))
    alike = (F.abs(b.o(0) - b.o(1)) <= near) & (F.abs(b.c(0) - b.c(1)) <= near)
    ok = b.proportions((2, 1, 0), 0.3, 0.5) & b.white(1, 0) & alike
    return signed(ok & b.white(2) & (b.l(1) > b.h(2)), ok & b.black(2) & (b.h(1) < b.l(2)))


def _tail(b: Bars) -> Column:
    """Distance from the low to the top of the body."""
    return b.top(0) - b.l(0)


def _hammer(b: Bars) -> Column:
    ok = (b.body(0) > 0) & (_tail(b) >= 2 * b.body(0)) & (b.up(0) <= b.body(0))
    if b.strict:
        mb, ms = b.factors(0.5, 0.3)
        ok = ok & (b.body(0) <= mb * b.rng(0)) & (b.up(0) <= ms * b.rng(0))
    return ok


@pattern("hammer")
def hammer(b):
    ok = _hammer(b)
    return signed(ok & ~b.black(0), ok & b.black(0)) if b.symmetric else signed(ok)


@pattern("hangingman")
def hanging_man(b):
    ok = _hammer(b)
    return signed(ok & ~b.black(0), ok & b.black(0)) if b.symmetric else signed(None, ok)


@pattern("harami")
def harami(b):
    ok = F.lit(True)
    if b.strict:
        mb, ms = b.factors(0.3, 0.5)
        ok = (b.body(1) >= mb * b.rng(1)) & (b.body(0) <= ms * b.rng(0)) & both(
            *[b.up(k) + b.lo(k) <= ms * b.rng(k) for k in (1, 0)])
    return signed(ok & b.black(1) & b.white(0) & (b.o(0) >= b.c(1)) & (b.c(0) <= b.o(1)),
                  ok & b.white(1) & b.black(0) & (b.o(0) <= b.c(1)) & (b.c(0) >= b.o(1)))


@pattern("haramicross")
def harami_cross(b):
    mb, ms = b.factors(0.1, 0.5)
    ok = (b.rng(0) > 0) & (b.body(0) <= mb * b.rng(0))
    if b.strict:
        ok = ok & (b.body(1) >= mb * b.rng(1)) & both(*[b.up(k) + b.lo(k) <= ms * b.rng(k) for k in (1, 0)])
    return signed(ok & b.black(1) & (b.o(0) >= b.c(1)) & (b.c(0) <= b.o(1)),
                  ok & b.white(1) & (b.o(0) <= b.c(1)) & (b.c(0) >= b.o(1)))


@pattern("highwave")
def high_wave(b):
    mb, ms = b.factors(0.1, 0.3)
    ok = b.small(0, mb) & (b.up(0) >= ms * b.rng(0)) & (_tail(b) >= ms * b.rng(0))
    if b.strict:
        ok = ok & (b.up(0) >= 2 * b.body(0)) & (_tail(b) >= 2 * b.body(0))
    return signed(ok & ~b.black(0), ok & b.black(0)) if b.symmetric else signed(ok)


def _hikkake(b: Bars, ahead: int, below: str, above: str, share: float) -> Column:
    f = b.frame
    nxt = f.next_rows(ahead)
    seen = F.count(below).over(nxt) == ahead
    ok = seen & (b.h(1) < b.h(2)) & (b.l(1) > b.l(2))
    if b.strict:
        ok = ok & (b.rng(1) > 0) & (b.rng(1) >= share * b.rng(2))
    return signed(ok & (b.l(0) < b.l(1)) & (b.h(0) <= b.h(1)) & (F.max(above).over(nxt) > b.h(1)),
                  ok & (b.h(0) > b.h(1)) & (b.l(0) >= b.l(1)) & (F.min(below).over(nxt) < b.l(1)))


@pattern("hikkake")
def hikkake(b, ahead: int = 3):
    """Looks ahead: stamped on the breaking bar, known ``ahead`` bars later."""
    return _hikkake(b, ahead, "low", "high", 0.2)


@pattern("hikkakemod")
def hikkake_mod(b, ahead: int = 3):
    return _hikkake(b, ahead, "close", "close", 0.25)


@pattern("homingpigeon")
def homing_pigeon(b):
    return signed(b.black(1, 0) & (b.o(0) <= b.o(1)) & (b.c(0) >= b.c(1)))


@pattern("identical3crows")
def identical_three_crows(b):
    tails = both(*[(b.rng(k) > 0) & (b.lo(k) <= 0.25 * b.rng(k)) for k in (2, 1, 0)])
    return signed(b.black(2, 1, 0) & (b.c(1) < b.c(2)) & (b.c(0) < b.c(1)) & tails
                  & (F.abs(b.o(1) - b.c(2)) <= 0.25 * b.rng(1)) & (F.abs(b.o(0) - b.c(1)) <= 0.25 * b.rng(0)))


@pattern("inneck")
def in_neck(b):
    return signed(b.black(1) & b.white(0) & (b.o(0) < b.l(1)) & (b.c(0) > b.c(1)) & (b.c(0) <= b.o(1))
                  & (b.c(0) - b.c(1) <= 0.25 * b.rng(1)))


@pattern("inside")
def inside(b):
    return signed((b.h(0) < b.h(1)) & (b.l(0) > b.l(1)))


@pattern("invertedhammer")
def inverted_hammer(b):
    return signed((b.body(0) > 0) & (b.up(0) >= 2 * b.body(0)) & (_tail(b) <= 0.25 * b.body(0)) & (b.body(0) <= 0.4 * b.rng(0)))


def _kick(b: Bars) -> Column:
    bare = both(*[(b.rng(k) > 0) & (b.up(k) <= 0.1 * b.rng(k)) & (b.lo(k) <= 0.1 * b.rng(k)) for k in (1, 0)])
    turned = (b.white(1) & b.black(0)) | (b.black(1) & b.white(0))
    return bare & turned & ((b.bot(0) > b.top(1)) | (b.top(0) < b.bot(1)))


@pattern("kicking")
def kicking(b):
    return signed(_kick(b))


@pattern("kickingbylength")
def kicking_by_length(b):
    return signed(_kick(b) & (b.body(0) > b.body(1)))


@pattern("ladderbottom")
def ladder_bottom(b):
    return signed(b.black(4, 3, 2, 1) & (b.lo(1) >= 2 * b.body(1)) & b.white(0) & (b.c(0) > b.o(1)))


@pattern("longleggeddoji")
def long_legged_doji(b):
    return signed(b.small(0, 0.1) & (b.up(0) >= 0.4 * b.rng(0)) & (_tail(b) >= 0.4 * b.rng(0)))


@pattern("longline")
def long_line(b):
    return signed(b.big(0, 0.6) & (b.up(0) <= 0.2 * b.rng(0)) & (b.lo(0) <= 0.2 * b.rng(0)))


@pattern("marubozu")
def marubozu(b):
    return signed(b.big(0, 0.9) & (b.up(0) <= 0.05 * b.rng(0)) & (b.lo(0) <= 0.05 * b.rng(0)))


@pattern("matchinglow")
def matching_low(b):
    return signed(b.black(1, 0) & (F.abs(b.l(0) - b.l(1)) <= EQUAL) & (b.c(0) > b.c(1)))


@pattern("mathold")
def mat_hold(b):
    rest = both(*[(b.rng(k) > 0) & (b.body(k) <= 0.4 * b.rng(4)) & (b.h(k) <= b.c(4)) & (b.l(k) >= b.o(4)) for k in (3, 2, 1)])
    return signed(b.white(4) & b.big(4, 0.6) & rest & b.white(0) & (b.c(0) > b.c(4)))


@pattern("morningdojistar")
def morning_doji_star(b):
    return signed(b.black(2) & b.big(2, 0.6) & b.small(1, 0.1) & (b.h(1) < b.c(2)) & b.white(0) & (b.c(0) > b.mid(2)))


@pattern("morningstar")
def morning_star(b):
    return signed(b.black(2) & b.big(2, 0.6) & (b.rng(1) > 0) & (b.body(1) <= 0.4 * b.body(2)) & (b.h(1) < b.c(2))
                  & b.white(0) & b.big(0, 0.6) & (b.c(0) > b.mid(2)))


@pattern("onneck")
def on_neck(b):
    return signed(b.black(1) & b.big(1, 0.6) & b.white(0) & (b.o(0) < b.l(1)) & (F.abs(b.c(0) - b.c(1)) <= 0.1 * b.body(1)))


@pattern("piercing")
def piercing(b):
    return signed(b.black(1) & b.big(1, 0.6) & b.white(0) & b.big(0, 0.6) & (b.o(0) < b.l(1))
                  & (b.c(0) > b.mid(1)) & (b.c(0) < b.o(1)))


@pattern("rickshawman")
def rickshaw_man(b):
    return signed(b.small(0, 0.1) & (b.up(0) >= 0.4 * b.rng(0)) & (b.lo(0) >= 0.4 * b.rng(0))
                  & (F.abs(b.up(0) - b.lo(0)) <= 0.2 * b.rng(0)))


@pattern("risefall3methods")
def rise_fall_three_methods(b):
    rest = both(*[(b.rng(k) > 0) & (b.body(k) <= 0.4 * b.body(4)) & (b.h(k) <= b.h(4)) & (b.l(k) >= b.l(4)) for k in (3, 2, 1)])
    rise = b.white(4, 0) & b.black(3, 2, 1) & (b.c(0) > b.c(4))
    fall = b.black(4, 0) & b.white(3, 2, 1) & (b.c(0) < b.c(4))
    return signed(b.big(4, 0.6) & b.big(0, 0.6) & rest & (rise | fall))


@pattern("separatinglines")
def separating_lines(b):
    same = F.abs(b.o(0) - b.o(1)) < EQUAL
    return signed(same & ((b.black(1) & b.white(0) & (b.c(0) > b.c(1))) | (b.white(1) & b.black(0) & (b.c(0) < b.c(1)))))


@pattern("shootingstar")
def shooting_star(b):
    return signed(b.small(0, 0.3) & (b.lo(0) <= 0.1 * b.rng(0)) & (b.up(0) >= 0.6 * b.rng(0)) & (b.up(0) >= 2 * b.body(0)))


@pattern("shortline")
def short_line(b):
    f = b.frame
    prior = f.rows(5, 1)

    def short(x: str, now: Column) -> Column:
        return now < 0.3 * F.avg(x).over(prior)

    return F.when((F.count("_sb").over(prior) == 5) & short("_sb", col("_sb")) & short("_su", col("_su")) & short("_sl", col("_sl")), 1.0).otherwise(0.0)


@pattern("spinningtop")
def spinning_top(b):
    return signed(b.small(0, 0.4) & (b.body(0) >= 0.1 * b.rng(0)) & (b.up(0) >= 0.2 * b.rng(0)) & (b.lo(0) >= 0.2 * b.rng(0)))


@pattern("stalledpattern")
def stalled_pattern(b):
    return signed(b.white(2, 1, 0) & b.big(2, 0.6) & b.big(1, 0.5) & (b.c(1) > b.c(2)) & (b.body(0) < b.body(1))
                  & (b.body(0) <= 0.5 * b.rng(0)) & (b.up(0) >= 0.3 * b.rng(0)) & (b.lo(0) <= 0.3 * b.rng(0))
                  & (b.c(0) > b.c(1)) & (b.c(0) - b.c(1) <= 0.5 * b.body(1)))


@pattern("sticksandwich")
def stick_sandwich(b):
    return signed(b.black(2, 0) & b.white(1) & b.big(2, 0.4) & b.big(0, 0.4) & _inside_body(b, b.c(1), 2)
                  & _inside_body(b, b.o(1), 2) & (F.abs(b.c(0) - b.c(2)) <= EQUAL))


@pattern("takuri")
def takuri(b):
    return signed(b.small(0, 0.2) & (b.up(0) <= 0.1 * b.rng(0)) & (b.lo(0) >= 0.6 * b.rng(0)) & (b.lo(0) >= 3 * b.body(0)))


@pattern("tasukigap")
def tasuki_gap(b):
    opens = _inside_body(b, b.o(0), 1)
    rise = b.white(2, 1) & (b.l(1) > b.h(2)) & b.black(0) & (b.c(0) > b.h(2)) & (b.c(0) < b.l(1))
    fall = b.black(2, 1) & (b.h(1) < b.l(2)) & b.white(0) & (b.c(0) > b.h(1)) & (b.c(0) < b.l(2))
    return signed(opens & (rise | fall))


@pattern("thrusting")
def thrusting(b):
    return signed(b.black(1) & b.big(1, 0.6) & b.white(0) & (b.o(0) < b.l(1)) & (b.c(0) > b.c(1)) & (b.c(0) < b.mid(1)))


@pattern("tristar")
def tri_star(b):
    gaps = both(*[(b.l(k) > b.h(k + 1)) | (b.h(k) < b.l(k + 1)) for k in (1, 0)])
    return signed(b.small(2, 0.1) & b.small(1, 0.1) & b.small(0, 0.1) & gaps)


@pattern("unique3river")
def unique_three_river(b):
    return signed(b.black(2, 1) & b.big(2, 0.6) & (b.body(1) <= 0.4 * b.body(2)) & (b.l(1) < b.l(2)) & b.white(0)
                  & b.small(0, 0.6) & (b.c(0) > b.c(1)) & (b.c(0) < b.o(2)) & (b.o(0) > b.l(1)))


@pattern("upsidegap2crows")
def upside_gap_two_crows(b):
    return signed(b.white(2) & b.big(2, 0.6) & b.black(1, 0) & b.big(1, 0.4) & (b.c(1) > b.c(2)) & (b.o(0) > b.o(1))
                  & (b.c(0) > b.c(2)) & (b.c(0) < b.c(1)))


@pattern("xsidegap3methods")
def xside_gap_three_methods(b):
    rise = b.white(2, 1) & (b.bot(1) > b.top(2)) & b.black(0) & (b.c(0) > b.top(2)) & (b.c(0) < b.bot(1))
    fall = b.black(2, 1) & (b.top(1) < b.bot(2)) & b.white(0) & (b.c(0) > b.top(1)) & (b.c(0) < b.bot(2))
    return signed(rise | fall)


# patterns that report +1 although they call for lower prices
BEARISH = {"2crows", "3blackcrows", "identical3crows", "inneck", "onneck", "thrusting", "shootingstar", "stalledpattern",
           "upsidegap2crows"}


def candle(f: Frame, name: str, out: str | None = None, strict: bool = False, symmetric: bool = False,
           min_body: float | None = None, max_shadow: float | None = None) -> Frame:
    """Add one pattern column; needs 5 bars back (6 for ``shortline``), 3 ahead for the hikkake pair."""
    b = Bars(f, strict, symmetric, min_body, max_shadow)
    b.frame = b.frame.add(_sb=b.body(0), _su=b.up(0), _sl=b.lo(0))
    return b.frame.add(**{out or name: PATTERNS[name](b)})


def all_candles(f: Frame, names: list[str] | None = None) -> Frame:
    """Every pattern in one pass over the same lag columns."""
    b = Bars(f)
    b.frame = b.frame.add(_sb=b.body(0), _su=b.up(0), _sl=b.lo(0))
    return b.frame.add(**{f"cdl_{n}": PATTERNS[n](b) for n in names or PATTERNS})


def direction(value: Column, name: str) -> Column:
    return -F.abs(value) if name in BEARISH else value


def doji(f: Frame, n: int = 10, factor: float = 10.0, scalar: float = 100.0, naive: bool = False, out: str = "doji") -> Frame:
    f = f.add(_rg=col("high") - col("low"))
    base = col("_rg") if naive else mean(f, "_rg", n)
    small = F.abs(col("close") - col("open")) < 0.01 * factor * base
    return f.add(**{out: F.when(small, scalar).otherwise(0.0)})
