"""Training parameters resolved from a budget of tokens, steps or epochs."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Bounds and defaults.
MOST_EPOCHS, MOST_BUFFER_RECORDS, MOST_BUFFER_BYTES, INT64 = 1_000_000, 1_000_000, 17_179_869_184, (1 << 63) - 1
WARMUP, CHECKPOINT, BUFFER_RECORDS, BUFFER_BYTES = 100, 500, 1024, 64 << 20
FRACTION, EVALUATION_RECORDS, EVALUATION_BYTES, WEIGHT_DECAY = 0.01, 256, 1 << 20, 0.1
ORDERS = {"default": ("bounded-shuffle-v1", "lowest-sha256-v1"), "balanced": ("corpus-balanced-shuffle-v1", "stratified-lowest-sha256-v1"), "weighted": ("corpus-weighted-shuffle-v1", "stratified-lowest-sha256-v1")}


@dataclass(frozen=True)
class Parameters:
    """What a plan declares; None takes the default."""

    batch_size: int
    sequence_length: int
    learning_rate: float
    tokens: int = 0
    steps: int = 0
    epochs: int = 0
    profile: str = "default"
    warmup_steps: int | None = None
    checkpoint_every: int | None = None
    evaluate_every: int | None = None
    shuffle_records: int | None = None
    shuffle_bytes: int | None = None
    evaluation_fraction: float | None = None
    evaluation_records: int | None = None
    evaluation_bytes: int | None = None
    weight_decay: float | None = None


@dataclass(frozen=True)
class Resolved:
    steps: int
    epochs: int
    token_capacity: int
    requested_tokens: int
    order: str
    selection: str
    warmup_steps: int
    checkpoint_every: int
    evaluate_every: int
    shuffle_records: int
    shuffle_bytes: int
    evaluation_fraction: float
    evaluation_records: int
    evaluation_bytes: int
    weight_decay: float
    learning_rate: float

    def rate_at(self, step: int) -> float:
        """Linear warm-up, then a cosine down to zero."""
        if step < self.warmup_steps:
            return self.learning_rate * (step + 1) / self.warmup_steps
        done = (step - self.warmup_steps) / max(1, self.steps - self.warmup_steps)
        return self.learning_rate * 0.5 * (1 + math.cos(math.pi * min(1.0, done)))


def _within(name: str, value, low, high):
    if not (math.isfinite(value) and low <= value <= high):
        raise ValueError(f"{name} must be in {low}..{high}")
    return value


def _checked_product(*factors: int) -> int:
    out = math.prod(factors)
    if out > INT64:
        raise ValueError("token capacity overflows 64 bits")
    return out


def resolve(p: Parameters, derived_steps: int | None = None) -> Resolved:
    """Resolved parameters; an epoch budget needs the steps that its finite stream gives."""
    if p.profile not in ORDERS:
        raise ValueError(f"unknown profile {p.profile!r}")
    for name in ("batch_size", "sequence_length", "learning_rate"):
        if not (math.isfinite(getattr(p, name)) and getattr(p, name) > 0):
            raise ValueError(f"{name} must be finite and positive")
    if min(p.tokens, p.steps, p.epochs) < 0 or not (p.tokens or p.steps or p.epochs):
        raise ValueError("one of tokens, steps or epochs is asked for")
    if p.tokens and (p.steps or p.epochs):
        raise ValueError("tokens go without steps and epochs")
    if derived_steps is not None and (p.tokens or p.steps):
        raise ValueError("derived steps need a budget of epochs alone")
    capacity = _checked_product(p.batch_size, p.sequence_length)
    steps = -(-p.tokens // capacity) if p.tokens else p.steps or derived_steps or 0
    if steps <= 0:
        raise ValueError("the epochs' steps aren't derived yet")
    pick = lambda value, default: default if value is None else value
    fraction = pick(p.evaluation_fraction, FRACTION)
    if not (math.isfinite(fraction) and 0 <= fraction < 1):
        raise ValueError("evaluation_fraction must be in 0..<1")
    records, size = _within("evaluation_records", pick(p.evaluation_records, EVALUATION_RECORDS), 0, MOST_BUFFER_RECORDS), _within("evaluation_bytes", pick(p.evaluation_bytes, EVALUATION_BYTES), 0, MOST_BUFFER_BYTES)
    if not (fraction and records and size):
        fraction, records, size = 0.0, 0, 0
    order, selection = ORDERS[p.profile]
    return Resolved(
        steps, _within("epochs", p.epochs or 1, 1, MOST_EPOCHS), _checked_product(steps, capacity), p.tokens, order, selection,
        _within("warmup_steps", pick(p.warmup_steps, max(min(WARMUP, steps // 10), int(steps > 1))), 0, steps),
        _within("checkpoint_every", pick(p.checkpoint_every, min(CHECKPOINT, steps)), 0, steps), _within("evaluate_every", pick(p.evaluate_every, min(CHECKPOINT, steps)), 0, steps),
        _within("shuffle_records", pick(p.shuffle_records, BUFFER_RECORDS), 1, MOST_BUFFER_RECORDS), _within("shuffle_bytes", pick(p.shuffle_bytes, BUFFER_BYTES), 1, MOST_BUFFER_BYTES),
        fraction, records, size, _within("weight_decay", pick(p.weight_decay, WEIGHT_DECAY), 0, 1), p.learning_rate,
    )
