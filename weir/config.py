"""Domain constants and tunable parameters.

Everything a deployment may want to change is a dataclass field or a function
argument; the values below are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: sensors, raw-file names, limits, weights, classes ----

RAW_TO_SENSOR = {
    "ph": "ph",
    "Hardness": "hardness",
    "Solids": "tds",
    "Chloramines": "chloramine",
    "Sulfate": "sulfate",
    "Conductivity": "conductivity",
    "Organic_carbon": "organic_carbon",
    "Trihalomethanes": "thm",
    "Turbidity": "turbidity",
}

SENSORS = tuple(RAW_TO_SENSOR.values())


@dataclass(frozen=True)
class Limit:
    low: float
    high: float
    unit: str
    weight: float
    label: str

    @property
    def mid(self) -> float:
        return (self.low + self.high) / 2

    @property
    def half(self) -> float:
        return (self.high - self.low) / 2 or 1.0


# sensor -> low, high, unit, weight in the risk index, safe range as text
LIMITS = {
    "chloramine": Limit(0.2, 4.0, "mg/L", 0.22, "0.2-4.0"),
    "turbidity": Limit(0.0, 4.0, "NTU", 0.20, "0-4.0"),
    "thm": Limit(0.0, 80.0, "µg/L", 0.15, "0-80"),
    "ph": Limit(6.5, 8.5, "pH", 0.12, "6.5-8.5"),
    "conductivity": Limit(0.0, 800.0, "µS/cm", 0.10, "0-800"),
    "organic_carbon": Limit(0.0, 4.0, "mg/L", 0.08, "0-4.0"),
    "tds": Limit(0.0, 500.0, "mg/L", 0.05, "0-500"),
    "sulfate": Limit(0.0, 250.0, "mg/L", 0.04, "0-250"),
    "hardness": Limit(0.0, 300.0, "mg/L CaCO₃", 0.04, "0-300"),
}

# class order is the label encoding
CAUSES = (
    "normal",
    "disinfectant_decay",
    "contamination_intrusion",
    "pipe_corrosion",
    "stagnation",
    "operational_change",
    "sensor_fault",
)

CAUSE_TEXT = {
    "normal": "All parameters within expected ranges",
    "disinfectant_decay": "Disinfectant (chloramine) levels declining — pathogen risk",
    "contamination_intrusion": "External contamination detected — possible pipe break",
    "pipe_corrosion": "Pipe corrosion indicators — metal leaching",
    "stagnation": "Water stagnation in distribution network",
    "operational_change": "Treatment or operational parameter change detected",
    "sensor_fault": "Sensor malfunction — readings unreliable",
}

# risk >= bound -> label, highest first; below the last bound: excellent
RISK_BANDS = ((80.0, "critical"), (65.0, "warning"), (50.0, "caution"), (30.0, "normal"))

WINDOWS = (6, 12, 36, 72)
SPANS = (6, 24)
DIFFS = (1, 3)
LAGS = (1, 3, 6, 12)
STUCK_WINDOW = 12
STUCK_EPS = 1e-6
HORIZON = 12
RISK_SPAN = 6

# outlier bounds stated for two sensors; others are user parameters
PHYSICAL_BOUNDS = {"ph": (0.0, 14.0), "turbidity": (0.0, None)}

# ---- end of fixed values ----


@dataclass(frozen=True)
class AlertParams:
    warn: float = 65.0
    crit: float = 80.0
    persistence: int = 3
    hysteresis: float = 5.0

    def __post_init__(self):
        if self.persistence < 1:
            raise ValueError("persistence must be at least 1")


@dataclass(frozen=True)
class Layout:
    """How a series is cut so that no task ever holds a whole site.

    A site's rows are numbered 0..n-1 (``seq``). Windowed work is partitioned by
    (site, seq div chunk); each chunk is preceded by the rows its windows look
    back on. ``block`` is the grain of the per-series index from which values that
    must cross a chunk (null runs, alert states) are carried, and ``fan`` the
    number of index rows folded into one at the next level up.

    A chunk with its halo stays below 4096 rows, the size up to which a window keeps its
    rows in memory by default (spark.sql.windowExec.buffer.in.memory.threshold).
    """

    chunk: int = 3072
    block: int = 1024
    fan: int = 1024
    ewma_block: int = 512

    def __post_init__(self):
        if self.chunk % self.block or self.block % self.ewma_block:
            raise ValueError("chunk must be a multiple of block, block of ewma_block")


LAYOUT = Layout()
META = ("site", "ts", "seq", "event_id", "event_type", "potability")
