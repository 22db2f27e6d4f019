"""leafledger: schemaless document collections and their change log on Spark."""
