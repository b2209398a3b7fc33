"""All named queries; importing this module registers them."""
from aislemetry.plans import (catalog_detections, catalog_kpi, catalog_ranges, catalog_scoring,  # noqa: F401
                              catalog_sequence, catalog_stores, catalog_streaming, catalog_tables)
from aislemetry.plans.registry import ORACLES, QUERIES  # noqa: F401
