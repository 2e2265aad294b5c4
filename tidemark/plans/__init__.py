"""Manifests and plan counters."""

from tidemark.plans.manifest import QueryPlan, counters, manifest_of, merge_manifests, reaches_latest, reaches_range

__all__ = ["QueryPlan", "counters", "manifest_of", "merge_manifests", "reaches_latest", "reaches_range"]
