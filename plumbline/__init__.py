"""plumbline: land-survey analytics expressed as lazy PySpark plans."""
