"""Graph analytics and graph learning as lazy Spark plans."""
