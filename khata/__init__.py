"""khata: message-ledger analytics as PySpark DataFrame jobs."""
