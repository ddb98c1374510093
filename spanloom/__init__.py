"""spanloom: agent execution traces as tables, built from Spark DataFrame steps."""

from spanloom.plans.workbench import Workbench

__all__ = ["Workbench"]
