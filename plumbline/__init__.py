"""plumbline: what does a benchmark score depend on?  Evaluation-validity analytics on Spark."""
