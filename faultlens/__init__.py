"""faultlens: anomaly analytics for multi-node metric and log series, as Spark DataFrame operators."""

__version__ = "0.1.0"
