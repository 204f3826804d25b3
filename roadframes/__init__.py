"""Road-camera frame analytics as DataFrame operators on Spark."""
