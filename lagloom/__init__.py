"""Event-diary analytics on Spark: which items raise or lower an outcome, at an unknown delay."""
