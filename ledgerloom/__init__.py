"""Event-ledger analytics and corpus preparation as Spark jobs."""
