"""Every query of the tracking engine, by name, and its DuckDB twin."""

from __future__ import annotations

from touchline.plans import crops, motion, projection, scene, tracking

QUERIES = {**tracking.QUERIES, **motion.QUERIES, **scene.QUERIES, **projection.QUERIES, **crops.QUERIES}
ORACLES = {**tracking.ORACLES, **motion.ORACLES, **scene.ORACLES, **projection.ORACLES, **crops.ORACLES}
