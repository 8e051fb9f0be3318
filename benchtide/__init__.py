"""benchtide: continuous-benchmark data work (webhook intake, build-state
folding, dispatch, results history, indexed chart series, log decoding)
expressed as Spark DataFrame transformations and Structured Streaming."""

from benchtide.session import build_session, checkpoint_dir, configure

__all__ = ["build_session", "checkpoint_dir", "configure"]
