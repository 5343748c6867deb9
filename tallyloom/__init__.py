"""Set-based activity scoring and design-aware statistics on PySpark."""
