"""Column expressions; all are built-in Spark functions except ``dist``."""
