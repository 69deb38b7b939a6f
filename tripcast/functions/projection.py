"""Map coordinates to degrees, as column arithmetic (Snyder, Map Projections: A Working
Manual, 1987: the conformal conic with two standard parallels on an ellipsoid)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Conic:
    """A conformal conic; angles in degrees, lengths in the unit of the coordinates."""

    axis: float            # of the ellipsoid
    flattening: float      # 1 / f
    origin_lat: float
    origin_lon: float
    parallel_1: float
    parallel_2: float
    false_east: float = 0.0
    false_north: float = 0.0

    @classmethod
    def from_wkt(cls, text: str) -> Conic | None:
        """The projection that a ``.prj`` text describes; None if its coordinates are degrees."""
        if not re.match(r"\s*PROJCS", text, re.I):
            return None
        kind = re.search(r'PROJECTION\s*\[\s*"([^"]+)"', text, re.I)
        if not kind or "lambert_conformal_conic" not in kind[1].lower():
            raise ValueError(f"projection {kind[1] if kind else 'unknown'} is not a conformal conic")
        value = {name.lower(): float(x) for name, x in re.findall(r'PARAMETER\s*\[\s*"([^"]+)"\s*,\s*([-+.\deE]+)', text, re.I)}
        axis, flattening = map(float, re.search(r'SPHEROID\s*\[\s*"[^"]*"\s*,\s*([.\deE+]+)\s*,\s*([.\deE+]+)', text, re.I).groups())
        unit = float(re.findall(r'UNIT\s*\[\s*"[^"]*"\s*,\s*([.\deE+-]+)', text, re.I)[-1])    # the last is that of lengths
        first = value["standard_parallel_1"]
        # false origins are told in the unit of the coordinates, the axis in metres
        return cls(axis / unit, flattening, value["latitude_of_origin"], value["central_meridian"],
                   first, value.get("standard_parallel_2", first), value["false_easting"], value["false_northing"])

    @property
    def _e(self) -> float:
        f = 1 / self.flattening
        return math.sqrt(2 * f - f * f)

    def _m(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1 - self._e ** 2 * s * s)

    def _t(self, lat: float) -> float:
        s, e = math.sin(math.radians(lat)), self._e
        return math.tan(math.pi / 4 - math.radians(lat) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

    def _cone(self) -> tuple[float, float, float]:
        """The cone's constant, its scale, and the radius at the origin."""
        m1, t1 = self._m(self.parallel_1), self._t(self.parallel_1)
        if self.parallel_1 == self.parallel_2:
            n = math.sin(math.radians(self.parallel_1))
        else:
            n = math.log(m1 / self._m(self.parallel_2)) / math.log(t1 / self._t(self.parallel_2))
        scale = self.axis * m1 / (n * t1 ** n)
        return n, scale, scale * self._t(self.origin_lat) ** n

    def to_degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude. The latitude follows from the conformal one by a series
        whose rest is far below a millimetre, so no iteration is needed."""
        n, scale, origin = self._cone()
        sign = math.copysign(1.0, n)
        east, north = x - self.false_east, F.lit(origin) - (y - self.false_north)
        radius = sign * F.sqrt(east * east + north * north)
        chi = math.pi / 2 - 2 * F.atan(F.pow(radius / scale, F.lit(1 / n)))
        q = self._e ** 2
        series = (
            (2, q / 2 + 5 * q**2 / 24 + q**3 / 12 + 13 * q**4 / 360), (4, 7 * q**2 / 48 + 29 * q**3 / 240 + 811 * q**4 / 11520),
            (6, 7 * q**3 / 120 + 81 * q**4 / 1120), (8, 4279 * q**4 / 161280))
        lat = chi
        for times, factor in series:
            lat = lat + factor * F.sin(times * chi)
        lon = F.atan2(sign * east, sign * north) / n + math.radians(self.origin_lon)
        return F.degrees(lon), F.degrees(lat)

    def from_degrees(self, lon: float, lat: float) -> tuple[float, float]:
        """Map coordinates of one point."""
        n, scale, origin = self._cone()
        radius, angle = scale * self._t(lat) ** n, n * math.radians(lon - self.origin_lon)
        return self.false_east + radius * math.sin(angle), self.false_north + origin - radius * math.cos(angle)
