import pytest

from tessera.functions.settings import Layers, Noise, Patches, Region, Spline


def test_valid_settings():
    assert Region.parse("1,2,3,4").check(10, 10) == Region(1, 2, 3, 4)
    line = Spline.line((0, 0), (8, 8), (1.0, 0.5, 0.25), 2.0)
    assert line.colours[0][0] == 2**0.5 and len(line.width) == 32
    Noise(0.3), Layers(3, 1.0), Patches()


@pytest.mark.parametrize(
    "make",
    [
        lambda: Region.parse("1,2,3"), lambda: Region(0, 0, 0, 4).check(9, 9), lambda: Region(8, 0, 4, 4).check(9, 9),
            lambda: Region(-1, 0, 4, 4).check(9, 9),
        lambda: Noise(2.0), lambda: Noise(0.5, seed=0), lambda: Layers(1, 1.0), lambda: Patches(block=2), lambda: Patches(threshold=2.0),
            lambda: Spline(((0, 0),), (), ()),
    ],
)
def test_invalid_settings(make):
    with pytest.raises(ValueError):
        make()
