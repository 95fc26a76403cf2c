"""Change-feed projection on Spark.

Versioned change events in, delivery tables out: every operator takes and
returns DataFrames, the clock is always an argument (``as_of``), and only
``sources.store``, ``sources.sinks`` and ``streaming`` write anything.
"""

from feedproj.session import build_session, use_utc

__all__ = ["build_session", "use_utc"]
