"""Parameters with their ranges."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EngineConfig:
    """Defaults are fixed values; a value out of range raises."""

    min_page_chars: int = 20
    usable_ratio: float = 0.6
    high_quality_ratio: float = 0.8
    full_page_pixels: int = 300_000
    garbled_ratio: float = 0.05
    route_mode: str = "auto"
    max_pending: int = 4
    workers: int = 1
    task_timeout_s: float = 300.0
    ocr_budget_s: float = 60.0
    ttl_s: int = 3600
    max_retries: int = 1

    def __post_init__(self):
        ok = (
            self.min_page_chars >= 1 and 0 < self.usable_ratio <= 1 and 0 < self.high_quality_ratio <= 1 and self.full_page_pixels >= 1
            and 0 <= self.garbled_ratio <= 1 and self.route_mode in ("auto", "text", "ocr") and 1 <= self.workers <= 4
            and self.max_pending >= self.workers and self.task_timeout_s > 0 and self.ocr_budget_s > 0 and self.ttl_s > 0 and 0 <= self.max_retries <= 3
        )
        if not ok:
            raise ValueError(f"out of range: {self}")

    def as_rows(self, spark: SparkSession) -> DataFrame:
        """A row a parameter: name, value as text (whole numbers without a fraction)."""
        plain = {k: f"{v:g}" if isinstance(v, float) else str(v) for k, v in asdict(self).items()}
        return spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for kv in plain.items() for x in kv])).alias("name", "value"))
