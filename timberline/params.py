"""Detector settings: defaults and the bounds they are kept in."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    hash_words: int = 3
    source_spike_multiplier: float = 3.0
    min_occurrences: int = 2
    ngram_window: int = 10
    ngram_examples: int = 3
    window_seconds: int = 60
    error_rate: float = 0.5
    window_burst: int = 100
    silence_seconds: int = 300
    window_history: int = 12
    spike_ratio: float = 3.0
    spike_short: int = 60
    spike_baseline: int = 600
    spike_min_short: int = 5
    spike_min_baseline: int = 10
    samples: int = 5
    z_threshold: float = 3.0
    z_min_events: int = 10
    rate_window: int = 600
    rate_average: int = 100
    burst_seconds: int = 60
    burst_repeats: int = 20
    rare_ip: int = 5
    top: int = 10
    moving_average: int = 10
    gap_minutes: int = 10
    partial_seconds: int = 50

    def __post_init__(self):
        low = {"spike_ratio": 1.1, "z_threshold": 1.0, "source_spike_multiplier": 1.0, "hash_words": 1, "min_occurrences": 1, "ngram_window": 2, "window_seconds": 1, "burst_repeats": 2, "rare_ip": 1}
        for name, least in low.items():
            if getattr(self, name) < least:
                object.__setattr__(self, name, type(least)(least))
        object.__setattr__(self, "error_rate", min(1.0, max(0.0, self.error_rate)))
