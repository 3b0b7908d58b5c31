"""Configuration: frozen, and validated with all errors reported at once."""

from __future__ import annotations

from dataclasses import dataclass

LONG = ("truncate", "skip", "single")
MODES = ("bucket", "interleave")


@dataclass(frozen=True)
class PackConfig:
    """How examples are packed into token-budgeted batches."""

    budget: int
    width: int = 16
    max_length: int | None = None
    long: str = "truncate"
    drop_last: bool = False
    strict_drop_last: bool = False  # also drop every batch that the budget closed
    shuffle: bool = False
    mode: str = "bucket"
    seed: str = "0"

    def __post_init__(self) -> None:
        wrong = []
        if self.budget < 1:
            wrong.append("budget must be at least 1")
        if self.width < 1:
            wrong.append("width must be at least 1")
        if self.max_length is not None and self.max_length < 1:
            wrong.append("max_length must be at least 1")
        if self.long not in LONG:
            wrong.append(f"long must be one of {LONG}")
        if self.mode not in MODES:
            wrong.append(f"mode must be one of {MODES}")
        if wrong:
            raise ValueError("; ".join(wrong))


@dataclass(frozen=True)
class RegimeConfig:
    """Limits of the adaptive state machine and how they move."""

    tokens: int | None = 400
    examples: int | None = None
    min_tokens: int = 64
    min_examples: int = 1
    max_examples: int | None = None
    ramp_every: int = 4
    ramp_examples: float = 1.25
    ramp_tokens: float = 1.10
    safe_floor: int = 0
    autotune_safety: float = 0.70
    autotune_oom_safety: float = 0.55
    eval_ramp_every: int = 30
    eval_ramp_tokens: float = 1.05
    shrink_examples: float = 0.5
    shrink_tokens: float = 0.85
    max_retries: int = 3

    def __post_init__(self) -> None:
        wrong = [f"{name} must be at least 1" for name in ("min_tokens", "min_examples", "ramp_every", "eval_ramp_every") if getattr(self, name) < 1]
        wrong += [f"{name} must lie between 0 and 1" for name in ("autotune_safety", "autotune_oom_safety", "shrink_examples", "shrink_tokens") if not 0 < getattr(self, name) < 1]
        if self.tokens is not None and self.tokens < 1:
            wrong.append("tokens must be at least 1")
        if self.max_retries < 0:
            wrong.append("max_retries must not be negative")
        if wrong:
            raise ValueError("; ".join(wrong))

    @property
    def top_examples(self) -> int:
        if self.max_examples is not None:
            return self.max_examples
        return 8192 if self.tokens is None else max(1024, self.tokens)

    @property
    def top_tokens(self) -> int:
        return 16 * (400 if self.tokens is None else self.tokens)


#: By video memory in GB: at least 80, 48, 24, and less.
TIERS = {
    "ramp_every": (2, 3, 4, 6),
    "ramp_examples": (1.40, 1.30, 1.25, 1.15),
    "ramp_tokens": (1.20, 1.15, 1.10, 1.05),
    "autotune_safety": (0.75, 0.72, 0.70, 0.66),
    "autotune_oom_safety": (0.66, 0.60, 0.55, 0.50),
    "eval_ramp_every": (10, 20, 30, 50),
    "eval_ramp_tokens": (1.10, 1.08, 1.05, 1.03),
}
EDGES = (80.0, 48.0, 24.0)


def tier_value(name: str, gigabytes: float, given=None):
    """A tier's value, unless one is given."""
    if given not in (None, "auto"):
        return given
    return TIERS[name][next((i for i, edge in enumerate(EDGES) if gigabytes >= edge), 3)]


def device_memory(gigabytes: list[float], default: float = 24.0) -> float:
    """The least memory of all devices, as limits must fit each; without devices the default."""
    return min(gigabytes, default=default)


def generation_arguments(settings: dict, stored: dict | None = None) -> dict:
    """Arguments of a generation: stored ones, over which explicit settings go; top_k and top_p count only for sampling."""
    out = dict(stored or {})
    for name, key, kind in (("generation_max_length", "max_length", int), ("generation_num_beams", "num_beams", int)):
        if settings.get(name) is not None:
            out[key] = kind(settings[name])
    if settings.get("do_sample"):
        out["do_sample"] = True
        out |= {key: kind(settings[key]) for key, kind in (("top_k", int), ("top_p", float)) if settings.get(key) is not None}
    return out
