"""Settings of an extraction, with their defaults, and how they resolve for one call."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    max_retries: int = 2
    chunking: str = "automatic"  # 'none', 'fixed', 'automatic'
    budget: int = 12_000
    tables: str = "automatic"  # 'off', 'automatic'
    invariants: str = "strict"  # 'strict', 'report'
    text_layer: str = "auto"  # 'always', 'never', 'auto'
    text_layer_threshold: float = 0.85
    dpi: int = 300
    auto_orient: bool = True
    corrects_language: bool = True
    languages: tuple[str, ...] = ("en",)
    extra_passes: tuple[str, ...] = ()
    sharpen: float | None = None
    token_cap: int | None = None
    temperature: float | None = None

    def __post_init__(self) -> None:
        allowed = {"chunking": ("none", "fixed", "automatic"), "tables": ("off", "automatic"), "invariants": ("strict", "report"), "text_layer": ("always", "never", "auto")}
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} is one of {', '.join(values)}")

    def resolved(self, backend_temperature: float, backend_cap: int) -> dict:
        """What a backend is called with: its own temperature and cap unless overridden; no
        negative retries, resolution within what a page can be drawn at."""
        return {
            "temperature": backend_temperature if self.temperature is None else self.temperature,
            "token_cap": backend_cap if self.token_cap is None else min(self.token_cap, backend_cap),
            "attempts": max(1, self.max_retries + 1),
            "dpi": min(max(self.dpi, 72), 1200),
        }

    def replaced(self, **changes) -> "Options":
        return dataclasses.replace(self, **changes)
