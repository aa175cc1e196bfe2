"""ordinal_spark: ordinal-severity analytics as Spark DataFrame / ML jobs."""

from .schema import FIXTURE_SCHEMA, REFERENCE_SCHEMA, OrdinalSpec, SeveritySchema
from .session import checkpoint_dir, cut_lineage, get_session

__all__ = ["FIXTURE_SCHEMA", "REFERENCE_SCHEMA", "OrdinalSpec", "SeveritySchema",
           "checkpoint_dir", "cut_lineage", "get_session"]
