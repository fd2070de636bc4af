"""All queries of the engine by name, with their SQL counterparts."""

from __future__ import annotations

from quarry.plans import analyses, corpus, gates, measures, reading, repairs, sets, training, windows  # noqa: F401  the others put their queries beside those of sets

QUERIES: dict = {**corpus.QUERIES, **sets.QUERIES}
ORACLES: dict = {**corpus.ORACLES, **sets.ORACLES}
