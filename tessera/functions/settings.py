"""Settings of operators, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be within {low} and {high}, not {value}")


@dataclass(frozen=True)
class Region:
    """A region of interest: pixels, quality boost in percent, feather in pixels."""

    x: int
    y: int
    width: int
    height: int
    boost: float = 10.0
    feather: int = 0

    def check(self, image_width: int, image_height: int) -> Region:
        if self.width <= 0 or self.height <= 0:
            raise ValueError("a region needs a positive size")
        if self.x < 0 or self.y < 0 or self.x + self.width > image_width or self.y + self.height > image_height:
            raise ValueError("a region must lie within the picture")
        return self

    @classmethod
    def parse(cls, text: str) -> Region:
        """x,y,width,height"""
        parts = text.split(",")
        if len(parts) != 4:
            raise ValueError("a region is x,y,width,height")
        return cls(*(int(p) for p in parts))


@dataclass(frozen=True)
class Noise:
    amplitude: float
    luma: float = 1.0
    chroma: float = 0.5
    seed: int = 1  # the clock is never a seed: results would not repeat

    def __post_init__(self):
        _within("amplitude", self.amplitude, 0.0, 1.0)
        _within("luma", self.luma, 0.0, 2.0)
        _within("chroma", self.chroma, 0.0, 2.0)
        if self.seed < 1:
            raise ValueError("a seed is positive")


@dataclass(frozen=True)
class Layers:
    count: int
    distance: float

    def __post_init__(self):
        _within("count", self.count, 2, 8)
        _within("distance", self.distance, 0.0, 15.0)


@dataclass(frozen=True)
class Patches:
    block: int = 8
    radius: int = 8
    threshold: float = 0.85
    most: int = 128

    def __post_init__(self):
        _within("block", self.block, 4, 64)
        _within("threshold", self.threshold, 0.0, 1.0)
        if self.radius < 0 or self.most < 1:
            raise ValueError("a radius is not negative, and at least one patch is kept")


@dataclass(frozen=True)
class Spline:
    """Control points, and 32 coefficients each of three colours and of the width."""

    points: tuple[tuple[float, float], ...]
    colours: tuple[tuple[float, ...], ...]
    width: tuple[float, ...]

    def __post_init__(self):
        if len(self.points) < 2:
            raise ValueError("a spline has two points at least")
        if len(self.colours) != 3 or any(len(c) != 32 for c in (*self.colours, self.width)):
            raise ValueError("a spline has 32 coefficients of three colours and of its width")

    @classmethod
    def line(cls, start: tuple[float, float], end: tuple[float, float], colour: tuple[float, float, float], width: float) -> Spline:
        """A straight line of one colour: means alone, which the transform scales by the root of two."""
        flat = lambda v: (v * 2**0.5, *[0.0] * 31)
        return cls((start, end), tuple(flat(v) for v in colour), flat(width))
