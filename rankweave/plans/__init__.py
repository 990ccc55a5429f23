"""plans of rankweave."""

from . import inference, metrics, profiles, scores, streams, summaries, traces  # noqa: F401  they add their queries to the registry
