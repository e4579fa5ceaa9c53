"""Sky-camera analytics and training-data operators on Spark."""
