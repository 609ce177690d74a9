"""Thresholds and tuning of every stage.

Fixed values: all defaults here are those of the station network, in PhysicsThresholds, StatisticalThresholds, CleaningConfig,
KalmanConfig, RuleLimits and SensorProfile.
"""

from __future__ import annotations

from dataclasses import dataclass, field

CHANNELS = ("temperature", "pressure", "humidity", "wind_speed")


@dataclass(frozen=True)
class PhysicsThresholds:
    rh_min: float = 0.0
    rh_max: float = 102.0
    dew_point_tolerance: float = 0.5
    absolute_humidity_min: float = 0.0
    absolute_humidity_max: float = 60.0
    temperature_min: float = -50.0
    temperature_max: float = 60.0
    pressure_min: float = 800.0
    pressure_max: float = 1090.0
    wind_min: float = 0.0
    wind_typical: float = 50.0
    wind_extreme: float = 90.0


@dataclass(frozen=True)
class StatisticalThresholds:
    """Windows are counted in rows. Wind is tested for flatlines over twice the window, calm left out."""

    sentinels: tuple[float, ...] = (-999.0, -9999.0, 999.0, 9999.0, -99.0)
    iqr_multiplier: float = 2.0
    zscore: float = 3.5
    window: int = 24
    robust: bool = True
    max_step: dict[str, float] = field(default_factory=lambda: {"temperature": 5.0, "pressure": 4.0, "humidity": 25.0, "wind_speed": 15.0})
    default_step: float = 10.0
    stuck_window: int = 12
    stuck_variance: float = 1e-6
    calm: float = 0.1


@dataclass(frozen=True)
class CleaningConfig:
    strategy: str = "interpolate"
    limit: int = 6


@dataclass(frozen=True)
class KalmanConfig:
    """Standard deviations by channel; minutes are the unit of time."""

    weather_noise: dict[str, float] = field(default_factory=lambda: {"temperature": 0.05, "pressure": 0.03, "humidity": 0.15, "wind_speed": 0.20})
    bias_noise: dict[str, float] = field(default_factory=lambda: {"temperature": 0.002, "pressure": 0.001, "humidity": 0.005, "wind_speed": 0.003})
    sensor_noise: dict[str, float] = field(default_factory=lambda: {"temperature": 0.3, "pressure": 0.2, "humidity": 1.5, "wind_speed": 0.5})
    initial_value: dict[str, float] = field(default_factory=lambda: {"temperature": 5.0, "pressure": 10.0, "humidity": 15.0, "wind_speed": 5.0})
    initial_rate: float = 0.1
    initial_bias: float = 1.0
    reference_noise: float = 0.05
    default_minutes: float = 5.0


@dataclass(frozen=True)
class RuleLimits:
    temperature_min: float = -45.0
    temperature_max: float = 55.0
    pressure_min: float = 850.0
    pressure_max: float = 1080.0
    rh_max: float = 105.0
    wind_max: float = 50.0
    dew_point_tolerance: float = 0.5


@dataclass(frozen=True)
class SensorProfile:
    sensor_name: str
    instrument_model: str = "Standard AWS Sensor"
    unit: str = ""
    last_calibration_date: str = "2026-01-01"
    calibration_interval_days: int = 365
    max_allowable_bias: float = 0.8
    max_allowable_noise_std: float = 0.5
    min_completeness_threshold: float = 95.0
    degradation_score_threshold: float = 60.0


#: The hardware of the network's four sensors.
PROFILES = (
    SensorProfile("temperature", "Pt100 4-Wire RTD Class 1/10 DIN", "°C", "2026-03-01", 365, 0.6, 0.35),
    SensorProfile("pressure", "Vaisala PTB330 Digital Barometer", "hPa", "2026-01-15", 365, 1.2, 0.25),
    SensorProfile("humidity", "Rotronic HygroMet4 Thin-Film Capacitive", "%", "2026-04-10", 180, 3.5, 1.8),
    SensorProfile("wind_speed", "Gill WindObserver II Ultrasonic Anemometer", "m/s", "2025-11-01", 365, 0.8, 0.6),
)
EVALUATION_DATE = "2026-09-24"
