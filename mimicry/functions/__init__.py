"""Column expressions. Built-in functions throughout, Arrow UDFs where Spark has none."""
