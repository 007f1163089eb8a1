"""Whole dashboards put together from the operators."""
