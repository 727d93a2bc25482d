from .cleaning import CleaningPlan, STEPS
from .eda import EdaReport, eda_report

__all__ = ["CleaningPlan", "STEPS", "EdaReport", "eda_report"]
