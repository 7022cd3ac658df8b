"""cotejo: reconcile noisy, confidence-scored readings and meter the service around them, on Spark."""

from cotejo.params import VoteParams, LayoutParams

__all__ = ["VoteParams", "LayoutParams"]
