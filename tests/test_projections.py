"""Published control points, and there and back."""

import math

import pytest
from pyspark.sql import functions as F

from nichesearch.functions import projections as p
from nichesearch.sources import occurrences

AIRY, CLARKE = (6377563.396, 299.3249646), (6378206.4, 294.978698214)


def moved(spark, f, *points):
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in points], "a double, b double")
    x, y = f(F.col("a"), F.col("b"))
    return [tuple(r) for r in rows.select(x, y).collect()]


def test_worked_examples_of_the_guidance_and_of_the_working_manual(spark):
    """EPSG's guidance note 7-2 (transverse Mercator, Lambert's conic) and Snyder's working manual (Albers)."""
    grid = p.TransverseMercator(AIRY, -2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0)
    x, y = moved(spark, grid.forward, (0.5, 50.5))[0]
    assert x == pytest.approx(577274.99, abs=0.01) and y == pytest.approx(69740.50, abs=0.01)
    foot = 12 / 39.37
    texas = p.LambertConformal(CLARKE, -99.0, 27 + 50 / 60, 28 + 23 / 60, 30 + 17 / 60, 2_000_000 * foot, 0.0)
    x, y = moved(spark, texas.forward, (-96.0, 28.5))[0]
    assert x / foot == pytest.approx(2963503.91, abs=0.02) and y / foot == pytest.approx(254759.80, abs=0.02)
    albers = p.Albers(CLARKE, -96.0, 23.0, 29.5, 45.5)
    x, y = moved(spark, albers.forward, (-75.0, 35.0))[0]
    assert x == pytest.approx(1885472.7, abs=0.1) and y == pytest.approx(1535925.0, abs=0.1)


def test_zones_and_origins(spark):
    x, y = moved(spark, p.system("EPSG:32617").forward, (-79.387139, 43.642567))[0]
    assert x == pytest.approx(630084, abs=1.5) and y == pytest.approx(4833438, abs=1.5)  # a tower whose grid position is published to the metre
    assert moved(spark, p.system("epsg:2154 ").forward, (3.0, 46.5))[0] == pytest.approx((700_000, 6_600_000), abs=1e-6)
    assert moved(spark, p.system("EPSG:32733").forward, (15.0, 0.0))[0] == pytest.approx((500_000, 10_000_000), abs=1e-6)
    assert p.system("EPSG:27700") is None and p.system("ESRI:1") is None and p.system("EPSG:32661") is None


@pytest.mark.parametrize(("crs", "points"), [
    ("EPSG:32631", [(0.1, 0.0), (3, 45.5), (6, 84), (2.2945, 48.8583), (9.5, 60)]), ("EPSG:32719", [(-69, -0.1), (-72, -33.4), (-66.1, -55)]), ("EPSG:25832", [(9, 50), (7.7, 47.9)]),
    ("EPSG:2154", [(-5, 48), (3, 46.5), (9.5, 42)]), ("EPSG:3034", [(10, 52), (-10, 36), (30, 70)]), ("EPSG:5070", [(-120, 49), (-75, 25), (-96, 23)]), ("EPSG:3577", [(115, -33), (150, -10)]), ("EPSG:3857", [(1, 2)]),
])
def test_there_and_back(spark, crs, points):
    s = p.system(crs)
    there = moved(spark, s.forward, *points)
    for (lon, lat), (x, y) in zip(points, moved(spark, s.inverse, *there), strict=True):
        assert x == pytest.approx(lon, abs=2e-9) and y == pytest.approx(lat, abs=2e-9)


def test_equal_areas_and_angles(spark):
    """A small square's area under Albers is the ellipsoid's; its sides stay at right angles under the conformal ones."""
    lon, lat, h = -100.0, 40.0, 1e-4
    e2 = p._e(p.GRS80) ** 2
    m, n = 6378137.0 * (1 - e2) / (1 - e2 * math.sin(math.radians(lat)) ** 2) ** 1.5, 6378137.0 / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
    area = math.radians(h) ** 2 * m * n * math.cos(math.radians(lat))
    for crs in ("EPSG:5070", "EPSG:3978", "EPSG:32614"):
        (x0, y0), (x1, y1), (x2, y2) = moved(spark, p.system(crs).forward, (lon, lat), (lon + h, lat), (lon, lat + h))
        cross, dot = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0), (x1 - x0) * (x2 - x0) + (y1 - y0) * (y2 - y0)
        if crs == "EPSG:5070":
            assert cross == pytest.approx(area, rel=1e-5)
        else:
            assert abs(dot) < 1e-4 * abs(cross)


def test_occurrences_are_moved_between_projections(spark):
    lon, lat = 2.35, 48.85
    rows = spark.createDataFrame([(lon, lat)], "x double, y double")
    lambert = rows.select(*[c.alias(n) for c, n in zip(p.move(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:2154"), "xy", strict=True)])
    x, y, said = occurrences.reproject(F.col("x"), F.col("y"), "EPSG:2154", "EPSG:32631")
    got = lambert.select(x, y).first()
    want = moved(spark, p.system("EPSG:32631").forward, (lon, lat))[0]
    assert tuple(got) == pytest.approx(want, abs=1e-3) and said[0].code == "reprojected_occurrences"
