from .fixtures import INCIDENTS_SQL, incident_reports, table
from .io import load_reports, write_table

__all__ = ["INCIDENTS_SQL", "incident_reports", "table", "load_reports", "write_table"]
