"""faultline: a Spark-first analytics engine for continuous-integration test failures."""

__version__ = "0.1.0"
