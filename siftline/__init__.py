"""Profile-guided corpus ranking, expressed as lazy Spark DataFrame plans."""
