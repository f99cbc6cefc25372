"""Spark-native audit of scored records: performance, fairness, data quality, explanations."""

from predaudit.spec import AuditSpec

__all__ = ["AuditSpec"]
