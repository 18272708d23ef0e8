"""Views made of several operators, one function per page of the application."""

from .views import (
    analysis_view,
    anomalies_view,
    explorer_page,
    explorer_view,
    home_view,
    reports_view,
    sellers_view,
    types_view,
)

__all__ = [
    "analysis_view", "anomalies_view", "explorer_page", "explorer_view", "home_view",
    "reports_view", "sellers_view", "types_view",
]
