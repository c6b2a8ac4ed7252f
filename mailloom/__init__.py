"""Mail triage at scale on PySpark: DataFrame operators, jobs and streams."""

__version__ = "0.1.0"
