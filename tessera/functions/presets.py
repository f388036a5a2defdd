"""Named settings, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: the presets by family and name
PRESETS: dict[str, dict[str, dict[str, float]]] = {
    "noise": {
        "subtle": {"amplitude": 0.15, "luma": 1.0, "chroma": 0.4},
        "moderate": {"amplitude": 0.35, "luma": 1.0, "chroma": 0.5},
        "heavy": {"amplitude": 0.65, "luma": 1.2, "chroma": 0.6},
        "film": {"amplitude": 0.45, "luma": 1.1, "chroma": 0.7},
    },
    "patch": {
        "aggressive": {"least": 8, "most": 64, "threshold": 0.98, "block": 8, "per_frame": 512, "radius": 3},
        "balanced": {"least": 8, "most": 128, "threshold": 0.95, "block": 8, "per_frame": 256, "radius": 2},
        "conservative": {"least": 16, "most": 128, "threshold": 0.99, "block": 8, "per_frame": 128, "radius": 1},
        "screen": {"least": 4, "most": 96, "threshold": 0.92, "block": 4, "per_frame": 1024, "radius": 4},
    },
    "spline": {
        "subtle": {"adjustment": 0, "distance": 8.0, "per_frame": 32, "edge": 0.6, "length": 20.0},
        "moderate": {"adjustment": 2, "distance": 4.0, "per_frame": 64, "edge": 0.3, "length": 10.0},
        "artistic": {"adjustment": 4, "distance": 2.0, "per_frame": 128, "edge": 0.15, "length": 5.0},
    },
    "reference": {
        "aggressive": {"interval": 60, "deltas": 240, "threshold": 0.6, "frames": 4},
        "balanced": {"interval": 30, "deltas": 120, "threshold": 0.7, "frames": 4},
        "conservative": {"interval": 15, "deltas": 60, "threshold": 0.8, "frames": 2},
    },
    "responsive": {"two": {"layers": 2}, "three": {"layers": 3}, "four": {"layers": 4}},
    "validation": {
        "strict": {"psnr": 40.0, "ssim": 0.95, "distance": 2.0, "ratio": 1.5, "seconds": 10.0},
        "relaxed": {"psnr": 25.0, "ssim": 0.8, "distance": 10.0, "ratio": 0.5, "seconds": 60.0},
        "lossless": {"psnr": float("inf"), "ssim": 1.0, "distance": 0.0, "ratio": 0.5, "seconds": 60.0},
    },
}


def presets(spark: SparkSession) -> DataFrame:
    """family, name, setting, value: a row a setting."""
    rows = [(f, n, k, float(v)) for f, names in PRESETS.items() for n, settings in names.items() for k, v in settings.items()]
    return spark.createDataFrame(rows, "family string, name string, setting string, value double")
