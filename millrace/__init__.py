"""millrace: durable work queues, event routing and finite executions as Spark plans."""

__version__ = "0.1.0"
