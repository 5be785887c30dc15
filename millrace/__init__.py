"""Search, content intelligence and corpus preparation on PySpark."""
