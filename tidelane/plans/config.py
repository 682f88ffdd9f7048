"""Settings of the lifecycles, with the ranges that they must lie in."""

from __future__ import annotations

from dataclasses import dataclass, fields


def _check(settings) -> None:
    for f in fields(settings):
        low, high = f.metadata.get("range", (None, None)) if f.metadata else (None, None)
        value = getattr(settings, f.name)
        if low is not None and value < low or high is not None and value > high:
            raise ValueError(f"{f.name} is out of range")


@dataclass(frozen=True)
class NoiseRules:
    """Limits of the noise label; None switches a rule off. isi_ratio and isi_count count together."""

    isi_ratio: float | None = 5.0
    isi_count: float | None = 50.0
    presence: float | None = 0.1
    snr: float | None = 0.5
    amplitude: float | None = 20.0
    peak_to_valley: float | None = 1.0
    half_width: float | None = 0.6
    rate: float | None = 0.05

    def rules(self) -> dict[str, tuple[str, float]]:
        how = {
            "isi_ratio": ("isi_violations_ratio", ">"), "isi_count": ("isi_violations_count", ">"), "presence": ("presence_ratio", "<"), "snr": ("snr", "<"),
            "amplitude": ("amplitude_median", "abs<"), "peak_to_valley": ("peak_to_valley", ">"), "half_width": ("half_width", ">"), "rate": ("firing_rate", "<="),
        }
        return {column: (op, getattr(self, name)) for name, (column, op) in how.items() if getattr(self, name) is not None}

    def together(self) -> tuple[str, str] | None:
        return ("isi_violations_ratio", "isi_violations_count") if self.isi_ratio is not None and self.isi_count is not None else None


@dataclass(frozen=True)
class StateSettings:
    slow_wave: float = 0.5
    emg: float = 0.5
    theta: float = 0.5
    packet_s: float = 30.0
    microarousal_s: float = 40.0
    smoothing: int = 15
