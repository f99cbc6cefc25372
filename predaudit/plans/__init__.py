"""Whole audits: findings, the overall score and the report."""
