"""Spark-native analytics over keyed, frame-indexed series and their segments."""
