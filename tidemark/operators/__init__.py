"""Query operators: functions from DataFrames to DataFrames."""

from tidemark.operators.asof import as_of
from tidemark.operators.latest import latest_at
from tidemark.operators.proximity import near_pairs, proximity_pairs
from tidemark.operators.ranges import range_scan
from tidemark.operators.speed import speed_over_ground

__all__ = ["as_of", "latest_at", "near_pairs", "proximity_pairs", "range_scan", "speed_over_ground"]
