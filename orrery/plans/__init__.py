"""Named queries over the driver's tables and their SQL oracles."""

from orrery.plans import candidate_plans, metric_plans, model_plans, ranking_plans, spatial_plans, state_plans

QUERIES, ORACLES = metric_plans.Q, metric_plans.SQL

__all__ = ["ORACLES", "QUERIES", "candidate_plans", "metric_plans", "model_plans", "ranking_plans", "spatial_plans", "state_plans"]
