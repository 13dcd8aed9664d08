"""PySpark-native analytics over annotated frames, boxes, observations and identities."""
