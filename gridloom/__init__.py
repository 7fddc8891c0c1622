"""gridloom: analytics over dense arrays, detections and per-entity streams, as lazy Spark DataFrame functions."""
