"""timberline: log analytics and anomaly detection as PySpark DataFrame plans."""
