"""Column expressions: pure functions of columns, all inside whole-stage code where Spark allows."""
