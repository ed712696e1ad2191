"""All registered catalogue queries and their DuckDB forms."""

from shutterlake.plans import core, documents, library, matching, signals, updates

QUERIES: dict = core.QUERIES | matching.QUERIES | library.QUERIES | signals.QUERIES | documents.QUERIES | updates.QUERIES
ORACLES: dict = core.ORACLES | matching.ORACLES | library.ORACLES | signals.ORACLES | documents.ORACLES | updates.ORACLES
