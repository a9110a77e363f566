"""Log-incident analytics on Spark DataFrames."""

from faultline.plans.analyze import Analysis, analyze_events, analyze_logs
from faultline.plans.dashboard import Dashboard, dashboard
from faultline.plans.stored import analyze_to_store, set_incident_status, stored_dashboard, stored_health, stored_incidents, write_analysis
from faultline.sources.store import Conflict, Store

__all__ = [
    "Analysis", "Conflict", "Dashboard", "Store", "analyze_events", "analyze_logs", "analyze_to_store", "dashboard",
    "set_incident_status", "stored_dashboard", "stored_health", "stored_incidents", "write_analysis",
]
